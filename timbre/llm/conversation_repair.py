"""Repair of conversation structure by a dynamic programme whose layers are shared along a prefix trie.

Each turn becomes one letter (its role's initial and its fault), each conversation the word of its
letters, its signature. Signatures are dealt out by ranges and sorted, so those of a task form a prefix
trie in the order of a depth-first walk: the programme keeps one layer a letter of the current path, goes
back to the prefix that the next signature shares, adds layers for the rest only, and answers at the
signature's end. Equal signatures are answered once a task; a signature that many conversations have is
spread over tasks, for ranges are of signature and conversation.

Texts are no part of that. Turns are ordered by a range partitioning of (conversation, turn, role,
digest), which also splits a conversation that holds a large share of all rows; they are joined to
words by pieces of :data:`PIECE` turns; duplicates are found by digest, after map-side aggregation.
What a single task holds of a conversation is its signature (one byte a turn; the audit that is
returned is as long) and about 40 bytes a turn of layers. Texts meet the edits by (conversation,
digest) once, and only the query's SHA-256, a chain by nature, has a conversation's repaired turns
stream through one task, a turn at a time.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbre.llm.common import bounded, checkpointed, only, schema

#: White space of the contract, as characters to trim.
BLANK = " \t\n\x0b\x0c\r"
#: Costs of edits; a truncated turn that stays adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns of a conversation that are one row at most.
PIECE = 16_384
#: Equal turns of one conversation beyond which they are found by a broadcast instead of a shuffle by their
#: digest: there is at most one such group for each so many rows.
HOT = 100_000
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. START and AFTER_A accept.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NONE, BLANKED, DUPLICATE, CUT = range(4)
_FAR = 1 << 60


# ── signatures ──


def _numbered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows with texts: c, t, role, text, digest; rows without: c, id, t, digest, kind, fault; both of all turns). The id
    is a structure, so that null ids equal each other and joins need no shuffle of their own."""
    rows = only(turns, c=conv, t=turn, role=role, text=text).select(F.struct("c").alias("c"), F.col("t").cast("long").alias("t"), *(F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    end = F.substring(F.rtrim(F.col("text"), F.lit(BLANK)), -1, 1)
    fault = F.when(end == "", BLANKED).when(~end.isin(".", "!", "?"), CUT).otherwise(NONE).cast("int")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).cast("int")
    order = ["c", "t", "role", "digest"]
    light = rows.select(*order, kind.alias("kind"), fault.alias("fault")).repartitionByRange(*order).sortWithinPartitions(*order)
    return rows, checkpointed(light.select("c", F.monotonically_increasing_id().alias("id"), "t", "digest", "kind", "fault"))


def _with_duplicates(light: DataFrame) -> DataFrame:
    """``light`` with turns seen earlier in their conversation marked; a blank turn stays blank."""
    seen = light.where(F.col("fault") != BLANKED).groupBy("c", "digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    seen = checkpointed(seen.where("n > 1"))
    for some in (F.broadcast(seen.where(F.col("n") > HOT)), seen.where(F.col("n") <= HOT)):
        later = (F.col("fault") != BLANKED) & (F.col("id") > F.col("first"))
        light = light.join(some, ["c", "digest"], "left").select("c", "id", "t", "digest", "kind", F.when(later, DUPLICATE).otherwise(F.col("fault")).alias("fault"))
    return light


def _pieces(light: DataFrame) -> DataFrame:
    """c, piece, signature (of the piece), digests: a conversation's turns in order, PIECE at most a row."""
    letter = F.chr(F.lit(65) + F.col("kind") * 4 + F.col("fault"))
    rows = light.select("c", F.expr(f"id div {PIECE}").alias("piece"), F.struct("id", letter.alias("x"), "digest").alias("turn"))
    listed = F.array_sort(F.collect_list("turn"))
    grouped = rows.groupBy("c", "piece").agg(listed.alias("turns"))
    return grouped.select("c", "piece", F.array_join("turns.x", "").alias("signature"), F.col("turns.digest").alias("digests"))


# ── the programme ──


def _steps(letter: str) -> list[tuple[str, int, int, int]]:
    """(edit, from, to, cost) that a turn of that letter allows, in ASCII order of edits within a state."""
    kind, fault = divmod(ord(letter) - 65, 4)
    extra = TRUNCATED if fault == CUT else 0
    steps = [("D", x, x, DELETE) for x in range(4)]
    if fault in (NONE, CUT):
        steps += [("K", x, y, extra) for x, y in {0: [(START, AFTER_S)], 1: [(x, AFTER_U) for x in (START, AFTER_S, AFTER_A)], 2: [(AFTER_U, AFTER_A)], 3: []}[kind]]
        steps += [("R", x, y, REROLE + extra) for x, y in _NEXT.items()]
    return steps


#: Where a user's or an assistant's turn leads from each state: only one of the two fits.
_NEXT = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}
STEPS = {chr(65 + i): _steps(chr(65 + i)) for i in range(16)}


class SharedProgramme:
    """Least costs along the path of a prefix trie: one layer of four states a letter, inserts included."""

    def __init__(self) -> None:
        self.path, self.costs = "", array("q", self._inserted([0, _FAR, _FAR, _FAR]))
        self.layers_made = 0

    @staticmethod
    def _inserted(layer: list[int]) -> list[int]:
        for x in (START, AFTER_S, AFTER_A, AFTER_U):  # no path takes more than two inserts in a row
            layer[_NEXT[x]] = min(layer[_NEXT[x]], layer[x] + INSERT)
        return layer

    def _go(self, signature: str) -> None:
        shared = _common(self.path, signature)
        del self.costs[4 * (shared + 1) :]
        for letter in signature[shared:]:
            before, layer = self.costs[-4:], [_FAR] * 4
            for _, x, y, cost in STEPS[letter]:
                if before[x] + cost < layer[y]:
                    layer[y] = before[x] + cost
            self.costs.extend(self._inserted(layer))
            self.layers_made += 1
        self.path = signature

    def answer(self, signature: str) -> tuple[int, str]:
        """(least cost, ASCII-least of the cheapest audits)."""
        self._go(signature)
        costs, n = self.costs, len(signature)
        best = min(costs[4 * n + START], costs[4 * n + AFTER_A])
        good = bytearray(4 * (n + 1))  # states from which the end is reached at the least cost
        for x in (START, AFTER_A):
            good[4 * n + x] = costs[4 * n + x] == best
        for i in range(n, -1, -1):
            at = 4 * i
            for x in (AFTER_U, AFTER_A, AFTER_S, START):
                if not good[at + x] and good[at + _NEXT[x]] and costs[at + x] + INSERT == costs[at + _NEXT[x]]:
                    good[at + x] = 1
            if i:
                for _, x, y, cost in STEPS[signature[i - 1]]:
                    if good[at + y] and costs[at - 4 + x] + cost == costs[at + y]:
                        good[at - 4 + x] = 1
        audit, state, i = [], START, 0
        while i < n or costs[4 * n + state] != best or state not in (START, AFTER_A):
            at, taken = 4 * i + state, None
            for edit, x, y, cost in STEPS[signature[i]] if i < n else []:
                if x == state and good[4 * i + 4 + y] and costs[at] + cost == costs[4 * i + 4 + y]:
                    taken = edit, y
                    break
            after = _NEXT[state]
            if (taken is None or taken[0] != "D") and good[4 * i + after] and costs[at] + INSERT == costs[4 * i + after]:
                taken = "I", after
            audit.append(taken[0])
            state, i = taken[1], i + (taken[0] != "I")
        return best, "".join(audit)


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


#: (role initials, faults) of the letters, for counts.
_KIND = {chr(65 + i): "suax"[i // 4] for i in range(16)}
_LEGAL = {"su", "ua", "au"}


def _counts(signature: str) -> tuple[int, int, int, int]:
    blank, duplicate, cut = (sum(signature.count(chr(65 + 4 * k + fault)) for k in range(4)) for fault in (BLANKED, DUPLICATE, CUT))
    kinds = signature.translate({ord(x): y for x, y in _KIND.items()})
    legal = sum(1 for x, y in zip(kinds, kinds[1:], strict=False) if x + y in _LEGAL)
    return blank, duplicate, cut, max(len(kinds) - 1, 0) - legal


def _answered(words: DataFrame) -> DataFrame:
    """``words`` (c, signature, sizes of its pieces) with counts, cost, audit and the audit's part for each piece."""
    out = schema(words, ["c"], "blank long, duplicate long, truncated long, illegal long, cost long, audit string, parts array<struct<piece: long, state: int, place: long, audit: string>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        programme, last, answer = SharedProgramme(), None, None
        for batch in batches:
            columns = [[] for _ in range(7)]
            for signature, sizes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if signature != last:
                    last, answer = signature, (*_counts(signature), *programme.answer(signature))
                for column, x in zip(columns, (*answer, _parts(signature, answer[5], sizes)), strict=True):
                    column.append(x)
            kinds = _kinds(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, kind) for x, kind in zip(columns, kinds[1:], strict=True))], names=out.names)

    spread = words.repartitionByRange("signature", "c").sortWithinPartitions("signature", "c")
    return bounded(spread.select("c", "signature", "sizes")).mapInArrow(run, out)


def _kinds(out: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return [f.type for f in to_arrow_schema(out)]


def _parts(signature: str, audit: str, sizes: list[dict]) -> list[dict]:
    """For each piece of the conversation: its part of the audit, the state before it and the turns before it in the result."""
    parts, at, state, place, row = [], 0, START, 0, 0
    for k, piece in enumerate(sizes):
        start, first, before, left = at, place, state, piece["n"]
        while at < len(audit) and (left or k == len(sizes) - 1):
            edit = audit[at]
            if edit != "I":
                row, left = row + 1, left - 1
            if edit != "D":
                state = AFTER_S if edit == "K" and _KIND[signature[row - 1]] == "s" else _NEXT[state]
                place += 1
            at += 1
        parts.append({"piece": piece["piece"], "state": before, "place": first, "audit": audit[start:at]})
    return parts


# ── the operator ──


def examined(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(one row a conversation, repaired turns).

    The first: the conversation's id, ``gaps`` (turn numbers missing between the least and the greatest),
    ``blank``, ``duplicate``, ``truncated`` (turns by their first fault), ``illegal`` (neighbours whose roles'
    initials aren't su, ua or au), ``cost`` and ``audit`` (initials of the cheapest edits Keep, Rerole, Delete,
    Insert that give roles ``(s?(ua)+)?``; of equally cheap ones the ASCII-least). The second: id, ``place``
    (from 0), ``edit`` (K, R or I), ``role``, ``text``.

    Nulls: a null role or text counts as one space, a null turn comes first and is no part of gaps, rows without
    an id are a conversation of their own. An empty role has no initial and can't be kept as it is. Turns of one
    number are ordered by role and digest of the text; repeated rows are duplicates of each other. Texts of
    any length only travel once; other columns play no part; an empty table gives two empty results.
    """
    rows, light = _numbered(turns, conv, turn, role, text)
    pieces = checkpointed(_pieces(_with_duplicates(light)))
    listed = F.array_sort(F.collect_list(F.struct("piece", "signature")))
    words = pieces.groupBy("c").agg(listed.alias("all")).select("c", F.array_join("all.signature", "").alias("signature"), F.transform("all", lambda x: F.struct(x["piece"].alias("piece"), F.length(x["signature"]).alias("n"))).alias("sizes"))
    answers = checkpointed(_answered(words))
    by_turn = light.groupBy("c", "t").agg(F.lit(1).alias("one"))
    gaps = by_turn.groupBy("c").agg(F.coalesce(F.max("t") - F.min("t") + 1 - F.count("t"), F.lit(0)).cast("long").alias("gaps"))
    summary = answers.join(gaps, "c").select(F.col("c.c").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return summary, _repaired(rows, pieces, answers, conv)


def _repaired(rows: DataFrame, pieces: DataFrame, answers: DataFrame, conv: str) -> DataFrame:
    parts = answers.select("c", F.explode("parts").alias("part")).select("c", "part.piece", "part.state", "part.place", "part.audit")
    both = pieces.join(parts, ["c", "piece"]).select("c", "signature", "digests", "state", "place", "audit")
    out = schema(both, ["c"], "place long, edit string, new string, digest binary")

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                signature, digests, state, place, audit = (batch.column(k)[i].as_py() for k in range(1, 6))
                row, columns = 0, [[], [], [], []]
                for edit in audit:
                    row += edit != "I"
                    if edit == "D":
                        continue
                    state = AFTER_S if edit == "K" and _KIND[signature[row - 1]] == "s" else _NEXT[state]
                    given = None if edit == "K" else "user" if state == AFTER_U else "assistant"
                    for column, x in zip(columns, (place, edit, given, None if edit == "I" else digests[row - 1]), strict=True):
                        column.append(x)
                    place += 1
                ids = batch.column(0).take(pa.array([i] * len(columns[0]), pa.int64()))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True))], names=out.names)

    done = checkpointed(bounded(both).mapInArrow(edits, out))
    texts = rows.groupBy("c", "digest").agg(F.first("role").alias("own"), F.first("text").alias("text"))
    kept = done.where("digest is not null").join(texts, ["c", "digest"])
    kept = kept.select(F.col("c.c").alias(conv), "place", "edit", F.coalesce("new", "own").alias("role"), "text")
    return kept.unionAll(done.where("digest is null").select(F.col("c.c").alias(conv), "place", "edit", F.col("new").alias("role"), F.lit("").alias("text")))


def chained_sha256(repaired: DataFrame, conv: str = "conv_id", name: str = "repaired_sha256") -> DataFrame:
    """Per conversation: the SHA-256 (lowercase hex) of its ``role:text`` in order, joined by newlines."""
    lines = repaired.select(conv, "place", F.concat("role", F.lit(":"), "text").alias("line")).repartition(conv).sortWithinPartitions(conv, "place").select(conv, "line")
    out = schema(lines, [conv], f"{name} string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unset = object()
        last, chain = unset, None
        kind = _kinds(out)[0]
        for batch in batches:
            done = []
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if last is unset or key != last:
                    if last is not unset:
                        done.append((last, chain.hexdigest()))
                    last, chain = key, hashlib.sha256()
                else:
                    chain.update(b"\n")
                chain.update(line.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), pa.array([x for _, x in done], pa.string())], names=out.names)
        if last is not unset:
            yield pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([chain.hexdigest()], pa.string())], names=out.names)

    return bounded(lines).mapInArrow(run, out)


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage by CRC-32 of ``conv_id:turn``, nulls as one space: dropped, emptied, without end marks,
    repeated or with the user's role."""
    shown = [F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn", "role", "text")]
    rows = turns.select("conv_id", "turn", shown[2].alias("role"), shown[3].alias("text"), F.pmod(F.crc32(F.concat(shown[0], F.lit(":"), shown[1])), F.lit(20)).alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


NOTHING = hashlib.sha256(b"").hexdigest()


def report(turns: DataFrame) -> DataFrame:
    """The query's rows: every conversation of ``turns`` after :func:`damaged`, zeros where nothing is left of it."""
    summary, repaired = examined(damaged(turns))
    hashes = chained_sha256(repaired).select(F.col("conv_id").alias("hashed"), "repaired_sha256")
    every = turns.groupBy(F.col("conv_id").alias("id")).agg(F.lit(1).alias("one"))
    found = every.join(summary, F.col("id").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("id").eqNullSafe(F.col("hashed")), "left")
    numbers: list[Column] = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NOTHING)).alias("repaired_sha256"))


#: The same by plain means: CRC-32 bit by bit, a recursion over turns that keeps the best (cost, audit) a state.
ORACLE = r"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
keys AS (SELECT k, xor(list_reduce(list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT), lambda crc, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(crc, b)), 4294967295::BIGINT), 4294967295) % 20 AS h FROM (SELECT DISTINCT k FROM src)),
hit AS (SELECT src.*, h FROM src JOIN keys USING (k) WHERE h <> 0),
dam AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy FROM hit, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR h = 3),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, rtrim(text, E' \t\n\x0b\x0c\r') AS body FROM dam),
lab AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS ini, CASE WHEN body = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'n' END AS fault FROM num),
pairs AS (SELECT conv_id, turn, fault, ini, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM lab),
stat AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'b')::BIGINT AS blank, count(*) FILTER (fault = 'd')::BIGINT AS duplicate, count(*) FILTER (fault = 't')::BIGINT AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM pairs GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES ('0', '0', '', 0), ('0', 'u', 'I', 3), ('0', 'a', 'II', 6), ('s', 's', '', 0), ('s', 'u', 'I', 3), ('s', 'a', 'II', 6), ('u', 'u', '', 0), ('u', 'a', 'I', 3), ('a', 'a', '', 0), ('a', 'u', 'I', 3)) v(was, now, added, price)),
step AS (SELECT f.fault, m.ini, e.* FROM (VALUES ('b'), ('d'), ('t'), ('n')) f(fault), (VALUES ('s'), ('u'), ('a'), ('x')) m(ini), (VALUES ('0', '0', 'D', ''), ('s', 's', 'D', ''), ('u', 'u', 'D', ''), ('a', 'a', 'D', ''), ('0', 's', 'K', 's'), ('0', 'u', 'K', 'u'), ('s', 'u', 'K', 'u'), ('a', 'u', 'K', 'u'), ('u', 'a', 'K', 'a'), ('0', 'u', 'R', ''), ('s', 'u', 'R', ''), ('a', 'u', 'R', ''), ('u', 'a', 'R', '')) e(was, now, edit, needs) WHERE edit = 'D' OR (fault IN ('t', 'n') AND needs IN ('', m.ini))),
dp AS (SELECT s.conv_id, 0::BIGINT AS i, ins.now AS state, ins.price::BIGINT AS cost, ins.added::VARCHAR AS audit FROM stat s, ins WHERE ins.was = '0'
UNION ALL
SELECT conv_id, i, state, cost, audit FROM (SELECT d.conv_id, l.i AS i, ins.now AS state, d.cost + ins.price + CASE step.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN step.edit <> 'D' AND l.fault = 't' THEN 3 ELSE 0 END AS cost, d.audit || step.edit || ins.added AS audit,
row_number() OVER (PARTITION BY d.conv_id, ins.now ORDER BY d.cost + ins.price + CASE step.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN step.edit <> 'D' AND l.fault = 't' THEN 3 ELSE 0 END, d.audit || step.edit || ins.added) AS best
FROM dp d JOIN lab l ON l.conv_id IS NOT DISTINCT FROM d.conv_id AND l.i = d.i + 1 JOIN step ON step.was = d.state AND step.fault = l.fault AND step.ini = CASE WHEN l.ini IN ('s', 'u', 'a') THEN l.ini ELSE 'x' END JOIN ins ON ins.was = step.now) WHERE best = 1),
fin AS (SELECT conv_id, min((cost, audit)) AS got FROM (SELECT dp.* FROM dp JOIN (SELECT conv_id, max(i) AS last FROM lab GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.last = dp.i WHERE state IN ('0', 'a')) GROUP BY conv_id),
won AS (SELECT conv_id, got[1] AS cost, got[2] AS audit FROM fin),
let AS (SELECT conv_id, p, audit[p] AS edit FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM won)),
out AS (SELECT let.conv_id, let.edit, sum((edit <> 'I')::INT) OVER w AS i, sum((edit <> 'D')::INT) OVER w - 1 AS place FROM let WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
full_ AS (SELECT o.conv_id, o.edit, o.place, l.role, l.text, first_value(o.edit = 'K' AND l.ini = 's') OVER (PARTITION BY o.conv_id ORDER BY o.place) AS sys FROM (SELECT * FROM out WHERE edit <> 'D') o LEFT JOIN lab l ON o.edit <> 'I' AND l.conv_id IS NOT DISTINCT FROM o.conv_id AND l.i = o.i),
sha AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - coalesce(sys, false)::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY place)) AS repaired_sha256 FROM full_ GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stat ON stat.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN won ON won.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN sha ON sha.conv_id IS NOT DISTINCT FROM c.conv_id
"""
