"""Exact n-gram Jaccard join of whole texts by multiple-global-order filtering.

A text's set holds its distinct 5-word shingles. Two sets of Jaccard similarity t or more share a
token among the first |x| - ceil(t |x|) + 1 of each, under any order of all tokens. All prefixes are
written when a text is read. Candidates share a token under the first order, which puts tokens known
to be common last and the rest in the order of their hash; they stay candidates only if they also
share one under each of two further orders, whose prefixes are small columns, and if their sketches
don't tell them apart. Only then are texts fetched and compared.

* Equal sets are one node; only its number travels.
* Common tokens are told from sums of each task's most repeated tokens. The list is bounded, and
  any list gives a valid order: it decides how much is compared, not what is found. The sets of a very
  common token are dealt to several tasks.
* Groups of up to four sets with a common prefix token give their pairs. In larger ones each set is
  compared with the group's least, its pivot, which joins nearly all of a cluster of near copies in a
  number of comparisons that grows with its size. What is still apart is compared in blocks, once for
  all tokens that link the same sets: the sets outside the largest part with each other and with that
  part. Parity sketches bound the similarity of two sets from above; first only the likeliest
  links that would join a block's parts are verified, then what the bound lets through between sets that
  are still apart. So no group's links are all listed, and no link between components is missed.
* Shingles are 64-bit hashes throughout. That two of some thousand in a pair collide has a chance
  under one in 10^12.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timbre.llm.common import bounded, checkpointed, compact, few, release, schema, slices
from timbre.llm.components import components

WORDS, PERCENT = 5, 80
#: Most common tokens that the first order puts last, and most that a task reports.
COMMON, COMMON_A_TASK, LEAST_COUNT = 200_000, 20_000, 8
SMALL_GROUP, BLOCK = 4, 1000
#: Sets of one token in a task, about, where the token is known to be common.
DEAL = 1000
LEAST_BITS, MOST_BITS = 512, 8192
#: Rows of an id table that is broadcast (16 bytes each); larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Pairs whose sketches, and whose texts, a task compares before they are dealt to further ones.
SKETCHES_A_TASK, TEXTS_A_TASK = 4000, 500
#: Multipliers of the further orders.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_CACHE, _TOKENS = 250_000, 2_000_000

_FAR = np.uint16(65535)


#: Bytes of a word that are hashed eight at a time for all words of a text; longer words are hashed one by one.
LONG_WORD = 64
#: By byte: A-Z in lower case; whether it is part of a word (no blank and none of \\t to \\r).
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_INSIDE = np.array([not bytes([b]).isspace() for b in range(256)])
#: What is left of eight bytes, the first one lowest, if a word ends after so many of them.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once (``np.unique`` would put them into a hash table first)."""
    hashes = np.sort(hashes)
    return hashes[_firsts(hashes)]


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Which of sorted numbers differ from the one before."""
    first = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return first


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in turn, A-Z as a-z, and how many there are up to each text's end. All words
    take a step for each eight bytes that they have; words of up to eight bytes of one length never collide."""
    text = b" ".join([b"", *texts, bytes(8)])  # a blank before each, and eight bytes to read beyond the last word
    raw = _LOWER[np.frombuffer(text, np.uint8)]
    inside = _INSIDE[raw]
    inside[-8:] = False
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the eight bytes from each place on
    out = _stepped(lengths.astype(np.uint64), eight[starts] & _MASKS[np.minimum(lengths, 8)])
    left = np.flatnonzero(lengths > 8)
    for at in range(8, LONG_WORD, 8):
        out[left] = _stepped(out[left], eight[starts[left] + at] & _MASKS[np.minimum(lengths[left] - at, 8)])
        left = left[lengths[left] > at + 8]
    for i in left.tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + lengths[i]])
    return out, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))


def _stepped(state: np.ndarray, data: np.ndarray) -> np.ndarray:
    return _mixed((state * np.uint64(ORDERS[1])) ^ data)


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    return next(shingles_of([text], words))


def shingles_of(texts: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """:func:`shingle_hashes` of each of some texts, which are hashed as one."""
    h, ends = word_hashes(texts)
    many = _joined_hashes(h, words) if len(h) >= words else h
    start = 0
    for end in ends.tolist():
        if end - start >= words:
            yield _distinct(many[start : end - words + 1])
        else:  # the whole sequence, or nothing
            yield _joined_hashes(h[start:end], end - start) if end > start else h[:0]
        start = end


def _joined_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of so many of the hashes."""
    n = len(h) - width + 1
    out = h[:n].copy()
    for k in range(1, width):
        out *= np.uint64(ORDERS[0])
        out += h[k : n + k]
    return _mixed(out + np.uint64(width))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def _set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), len(hashes)) >> 1


def parity(hashes: np.ndarray) -> bytes:
    """Parity of the number of members in each of so many classes, at least twice as many as members
    (up to a bound): sets differ in at least as many members as their parities in bits."""
    bits = min(max(LEAST_BITS, 1 << (2 * len(hashes) - 1).bit_length()), MOST_BITS)
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def difference(a: bytes, b: bytes) -> int:
    """Bits in which two parities differ, the longer folded to the shorter: classes are halved by sums."""
    x, y = (int.from_bytes(p, "little") for p in (a, b))
    n, m = len(a), len(b)
    while n > m:
        n //= 2
        x = (x >> 8 * n) ^ (x & ((1 << 8 * n) - 1))
    while m > n:
        m //= 2
        y = (y >> 8 * m) ^ (y & ((1 << 8 * m) - 1))
    return (x ^ y).bit_count()


def folded(parity: bytes) -> bytes:
    """A parity of half as many classes, if that isn't fewer than the least: classes are halved by sums."""
    half = len(parity) // 2
    if 8 * half < LEAST_BITS:
        return parity
    return (int.from_bytes(parity[:half], "little") ^ int.from_bytes(parity[half:], "little")).to_bytes(half, "little")


def _binary(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def common_tokens(rows: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of many different sets, sorted, and about how many; at most :data:`COMMON`. A task forgets a set it has seen,
    and of its tokens the least repeated ones, beyond a bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, waiting, size = set(), [], 0
        tokens, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merged():
            new = np.sort(np.concatenate([np.zeros(0, np.uint64), *waiting]))
            at = np.flatnonzero(_firsts(new))
            both, n = np.concatenate([tokens, new[at]]), np.concatenate([counts, np.diff(at, append=len(new))])
            order = np.argsort(both)
            both, n = both[order], n[order]
            at = np.flatnonzero(_firsts(both))
            return both[at], np.add.reduceat(n, at) if len(at) else n

        for batch in slices(batches, 0):
            for hashes in shingles_of(_binary(batch.column(0)), words):
                if len(hashes) < 2 or (key := _set_key(hashes)) in seen:
                    continue
                if len(seen) > _CACHE:
                    seen.clear()
                seen.add(key)
                waiting.append(hashes)
                size += len(hashes)
            if size > _TOKENS:
                tokens, counts = merged()
                keep = np.flatnonzero(counts > 1)
                if len(keep) > _TOKENS // 4:
                    keep = keep[np.argsort(-counts[keep], kind="stable")[: _TOKENS // 4]]
                tokens, counts, waiting, size = tokens[keep], counts[keep], [], 0
        tokens, counts = merged()
        keep = np.flatnonzero(counts > 1)
        keep = keep[np.argsort(-counts[keep], kind="stable")[:COMMON_A_TASK]]
        for at in range(0, len(keep), 10_000):
            k = keep[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(tokens[k].view(np.int64)), pa.array(counts[k])], names=["token", "n"])
        release()

    sums = bounded(rows.select("text")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    sums = checkpointed(sums.where(F.col("n") >= LEAST_COUNT).withColumn("size", F.floor(8 * F.log2("n"))))
    room, least = COMMON, None
    for size, n in sorted(map(tuple, sums.groupBy("size").agg(F.count("*")).collect()), reverse=True):  # some hundred sizes
        if n > room:
            break
        room, least = room - n, size
    top = (sums.where(F.col("size") >= least) if least is not None else sums.where("false")).toPandas()  # at most COMMON rows
    tokens, n = top["token"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], n[order]


def further(hashes: np.ndarray, percent: int = PERCENT) -> bytes:
    """The prefixes under the further orders, some low bytes a token, one after the other: sets that share a token
    share its bits. The longer a prefix, the more bytes, so that disjoint sets of any size seldom share some."""
    n = prefix_length(len(hashes), percent)
    width = _width(n)
    low = lambda m: m.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
    return b"".join(low(np.partition(m, n - 1)[:n] if n < len(m) else m) for m in (_mixed(hashes * np.uint64(order)) for order in ORDERS))


def _width(prefix: int) -> int:
    """Bytes of a token in further prefixes of such a length."""
    return 2 if prefix <= 128 else 3 if prefix <= 1024 else 4


def described(rows: DataFrame, common: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: id, hash, ``n_shingles``, ``node`` (the set's number; null for an empty set) and, where a task
    meets a set first, its ``parity``, its ``prefix`` under the first order and its prefixes ``further``."""
    out = schema(rows, ["id", "hash"], "n_shingles long, node long, parity binary, prefix array<long>, further binary")
    shared = rows.sparkSession.sparkContext.broadcast(common)  # at most COMMON numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        late = shared.value
        maybe = np.zeros(1 << 22, bool)
        maybe[(late >> np.uint64(42)).astype(np.int64)] = True
        for batch in slices(batches, 2):
            n, nodes, sketches, prefixes, others = [], [], [], [], []
            for hashes in shingles_of(_binary(batch.column(2)), words):
                n.append(len(hashes))
                node = _set_key(hashes) if len(hashes) else None
                nodes.append(node)
                if node is None or node in seen:
                    sketches.append(None)
                    prefixes.append(None)
                    others.append(None)
                    continue
                if len(seen) > _CACHE:
                    seen.clear()
                seen.add(node)
                length = prefix_length(len(hashes), percent)
                is_late = maybe[(hashes >> np.uint64(42)).astype(np.int64)]
                if is_late.any():
                    some = np.flatnonzero(is_late)
                    at = np.minimum(np.searchsorted(late, hashes[some]), len(late) - 1)
                    is_late[some] = late[at] == hashes[some]
                first = hashes[~is_late][:length]
                prefix = np.concatenate([first, hashes[is_late][: length - len(first)]])
                sketches.append(parity(hashes))
                prefixes.append(prefix.view(np.int64))
                others.append(further(hashes, percent))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(others, pa.binary())], names=out.names
            )
        release()

    return bounded(rows).mapInArrow(run, out)


def _distances(parities: list[bytes], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Lower bounds of how many members two sets differ in; _FAR where they cannot be linked."""
    n = len(parities)
    out = np.full((n, n), _FAR, np.uint16)
    lengths = np.array(list(map(len, parities)))
    for length in np.unique(lengths):  # pairs whose shorter parity has this length
        rows = np.flatnonzero(lengths >= length)
        bits = np.zeros((len(rows), length), np.uint8)
        for k, i in enumerate(rows):
            p = np.frombuffer(parities[i], np.uint8)
            while len(p) > length:
                p = p[: len(p) // 2] ^ p[len(p) // 2 :]
            bits[k] = p
        found = np.zeros((len(rows), len(rows)), np.uint16)
        for w in np.ascontiguousarray(bits).view(np.uint64).T:
            found += np.bitwise_count(w[:, None] ^ w[None, :])
        shorter = np.minimum(lengths[rows][:, None], lengths[rows][None, :]) == length
        view = np.ix_(rows, rows)
        out[view] = np.where(shorter, found, out[view])
    both = sizes[:, None] + sizes[None, :]
    less, more = np.minimum(sizes[:, None], sizes[None, :]), np.maximum(sizes[:, None], sizes[None, :])
    out[(out.astype(np.int64) * (100 + percent) > both * (100 - percent)) | (100 * less < percent * more)] = _FAR
    np.fill_diagonal(out, _FAR)
    return out


def _likeliest(distance: np.ndarray, labels: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a forest of least distances that joins what can be joined, given labels of parts."""
    labels = np.unique(labels, return_inverse=True)[1]
    while True:
        d = np.where(labels[:, None] == labels[None, :], _FAR, distance)
        nearest = d.argmin(1)
        best = d[np.arange(len(d)), nearest]
        order = np.lexsort((best, labels))
        firsts = order[np.unique(labels[order], return_index=True)[1]]
        edges = [(int(i), int(nearest[i])) for i in firsts if best[i] != _FAR]
        if not edges:
            return
        for i, j in edges:
            if labels[i] != labels[j]:
                yield i, j
                labels[labels == labels[j]] = labels[i]


def _units(groups: DataFrame) -> DataFrame:
    """Rows of groups (``token``) by unit: two blocks (or one). Blocks have about BLOCK sets; those of a
    group's largest part meet the others' blocks alone."""
    n = groups.count()
    parts = few(groups.groupBy("token", "root").agg(F.count("*").alias("n")), n)
    most = parts.groupBy("token").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"))
    most = compact(most.select(F.col("token").alias("_token"), F.col("most.root").alias("_root"), F.ceil((F.col("all") - F.col("most.n")) / BLOCK).cast("int").alias("few"), F.ceil(F.col("most.n") / BLOCK).cast("int").alias("many")).where("few > 0"), n)
    rows = groups.join(F.broadcast(most) if most.count() <= BROADCAST_ROWS else most, F.col("token") == F.col("_token"))
    main = F.col("root") == F.col("_root")
    place = F.xxhash64("node", "token")
    own = F.when(main, F.col("few") + F.pmod(place, "many")).otherwise(F.pmod(place, "few")).cast("int")
    meets = F.sequence(F.lit(0), F.when(main, F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1))
    rows = rows.withColumns({"own": own, "other": F.explode(meets)})
    return rows.select("token", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "n_shingles", "root", "parity")


def block_pairs(groups: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs a < b of the units that may be linked and whose roots differ: all, or the likeliest that
    would join them. In the latter case ``open`` names, in rows of its own, the tokens of units with
    further pairs."""

    def pairs(unit: list[tuple]) -> list[tuple]:
        roots = np.array([r[5] for r in unit], np.int64)
        if (roots == roots[0]).all():
            return []
        nodes = [r[3] for r in unit]
        distance = _distances([r[6] for r in unit], np.array([r[4] for r in unit], np.int64), percent)
        able = np.triu((distance != _FAR) & (roots[:, None] != roots[None, :]))
        some = list(zip(*np.nonzero(able), strict=True)) if every else list(_likeliest(distance, roots))
        found = [(min(nodes[i], nodes[j]), max(nodes[i], nodes[j]), None) for i, j in some]
        return found + [(None, None, unit[0][0])] if len(found) < np.count_nonzero(able) else found

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(3)], names=["a", "b", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if unit and unit[0][:3] != row[:3]:
                    found += pairs(unit)
                    unit = []
                unit.append(row)
            if found:
                yield batch_of(found)
        if unit and (found := pairs(unit)):
            yield batch_of(found)

    units = _units(groups).repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi")
    return units.mapInArrow(run, "a long, b long, open long").distinct()


class Verifier:
    """Whether two texts link. A text's hashes are kept while a batch lasts."""

    def __init__(self, words: int = WORDS, percent: int = PERCENT):
        self.words, self.percent, self.known = words, percent, {}

    def _set(self, key, text: bytes) -> np.ndarray:
        if key not in self.known:
            self.known[key] = shingle_hashes(text, self.words)
        return self.known[key]

    def linked(self, a, x: bytes, b, y: bytes) -> bool:
        s, t = self._set(a, x), self._set(b, y)
        both = np.intersect1d(s, t, assume_unique=True).size
        return both > 0 and 100 * both >= self.percent * (len(s) + len(t) - both)


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that link. Texts of the nodes in question, one row each, are read again; they travel
    deflated."""
    n = pairs.count()
    ends = few(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 2 * n)
    ends = F.broadcast(ends) if 2 * n <= BROADCAST_ROWS else ends
    wanted = compact(nodes.select("node", "first").join(ends, "node", "left_semi"))  # in the tasks of all sets; only what is left is put together
    ids = wanted.select(F.col("first.id").alias("_id"), F.col("first.hash").alias("_hash"))
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_ROWS else ids
    some = rows.join(ids, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left_semi")

    def deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            found = {}
            texts = _binary(batch.column(0))
            for text, hashes in zip(texts, shingles_of(texts, words), strict=True):
                if len(hashes):
                    found[_set_key(hashes)] = zlib.compress(text, 1)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["node", "z"])
        release()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            texts = {k: zlib.decompress(z) for k, z in {**dict(zip(a, x, strict=True)), **dict(zip(b, y, strict=True))}.items()}
            found = Verifier(words, percent)
            found.known = dict(zip(texts, shingles_of(list(texts.values()), words), strict=True))
            keep = [i for i, (p, q) in enumerate(zip(a, b, strict=True)) if found.linked(p, texts[p], q, texts[q])]
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in keep], pa.int64()) for c in (a, b)], names=["a", "b"])
        release()

    texts = some.select("text").mapInArrow(deflate, "node long, z binary").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])
    texts = checkpointed(few(texts, wanted.count(), TEXTS_A_TASK))
    side = lambda c: texts.select(F.col("node").alias(c), F.col("z").alias(f"z{c}"))
    both = few(few(pairs.join(side("a"), "a"), n, TEXTS_A_TASK).join(side("b"), "b"), n, TEXTS_A_TASK)
    return both.select("a", "b", "za", "zb").mapInArrow(check, "a long, b long")


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id``, ``hash`` of the text, ``n_shingles``, ``node`` (number of its set) and ``first``.

    Links join texts whose sets have a Jaccard similarity of ``percent`` / 100 or more. ``first`` is the
    component's first row: that of least id (null ids last), then least hash. A null or empty text, or
    one without words, has an empty set, no node and itself as first. Repeated rows share a set and so
    a component. Other columns play no part; an empty table gives an empty result.
    """
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("hash"), docs[text_col].alias("text"))
    common, often = common_tokens(rows, words)
    known = checkpointed(described(rows, common, words, percent))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    nodes = compact(known.where("node is not null").groupBy("node").agg(F.min(place).alias("first"), F.max("n_shingles").alias("n_shingles")))
    sketches = checkpointed(known.where("parity is not null").select("node", "n_shingles", "parity", "further"))  # a row from each task that met the set
    groups = compact(grouped(known.where("prefix is not null").select("node", F.explode("prefix").alias("token")), common, often))

    # every set of a group with its pivot, and all pairs of small groups
    pairs = groups.where("other <> node").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    pairs = compact(pairs, groups.count())
    pairs = compact(_like_sized(pairs, nodes, percent))
    tested = compact(screened(pairs, sketches, percent))
    links = compact(verified(tested, nodes, rows, words, percent))
    roots = checkpointed(components(links))
    apart = _apart(groups.where("token is not null"), roots)
    if apart is not None:
        apart = compact(apart)
        apart = checkpointed(apart.join(_of(apart, halved(sketches), apart.count()), "node"))
        first = compact(block_pairs(apart, percent, every=False))
        found = screened(compact(first.where("a is not null").select("a", "b").join(tested, ["a", "b"], "left_anti")), sketches, percent)
        found = compact(found)
        links = compact(links.unionByName(verified(found, nodes, rows, words, percent)))
        roots = checkpointed(components(links))
        tested = compact(tested.unionByName(found))
        still = apart.drop("root").join(first.where("open is not null").select(F.col("open").alias("token")).distinct(), "token", "left_semi")
        still = still.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rest = block_pairs(still, percent, every=True).where("a is not null").select("a", "b")
        rest = compact(screened(compact(rest.join(tested, ["a", "b"], "left_anti")), sketches, percent))
        if rest.take(1):
            links = compact(links.unionByName(verified(rest, nodes, rows, words, percent)))
            roots = checkpointed(components(links))

    named = nodes.select("node", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first").alias("first"))
    of = named.select("node", "root").join(least, "root").select(F.col("node").alias("_node"), F.col("first").alias("_first"))
    done = known.select("id", "hash", "n_shingles", "node").join(of, F.col("node") == F.col("_node"), "left")
    return done.select("id", "hash", "n_shingles", "node", F.when(F.col("node").isNull(), place).otherwise(F.col("_first")).alias("first"))


def grouped(postings: DataFrame, common: np.ndarray, often: np.ndarray) -> DataFrame:
    """Rows ``node``, ``other``, ``token``: with a null token the pairs of small groups; else each member of a
    large one with its pivot. Pivots of one token in several tasks also come with the least of them.

    A very common token's sets are dealt out by their number; a token that no one knew to be common is whole in
    a task, where its rows are streamed in order.
    """
    many = often > DEAL
    hot = [(int(t), int(-(-n // DEAL))) for t, n in zip(common[many].view(np.int64), often[many], strict=True)]
    deals = postings.sparkSession.createDataFrame(hot, "_token long, deals int")  # at most COMMON rows
    dealt = postings.join(F.broadcast(deals), F.col("token") == F.col("_token"), "left").select("node", "token", F.coalesce(F.pmod(F.xxhash64("node"), "deals"), F.lit(0)).cast("int").alias("deal"), (F.col("deals") > 1).alias("dealt"))
    dealt = dealt.repartition("token", "deal").dropDuplicates(["token", "deal", "node"])
    here = Window.partitionBy("token", "deal")
    ordered = here.orderBy("node")
    nexts = F.array(*(F.lead("node", k).over(ordered) for k in range(1, SMALL_GROUP)))
    split = F.coalesce("dealt", F.lit(False))
    sized = dealt.withColumns({"size": F.count("*").over(here), "pivot": F.first("node").over(ordered), "next": nexts}).where((F.col("size") > 1) | split)
    small = (F.col("size") <= SMALL_GROUP) & ~split
    others = F.when(small, F.filter("next", lambda x: x.isNotNull())).otherwise(F.array("pivot"))
    rows = compact(sized.select("node", F.explode(others).alias("other"), F.when(~small, F.col("token")).alias("token"), split.alias("dealt")))
    pivots = rows.where("dealt and node = other").select("node", "token")
    least = pivots.groupBy("token").agg(F.min("node").alias("other"))
    return rows.drop("dealt").unionByName(pivots.join(least, "token").where("node <> other").select("node", "other", "token"))


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Rows ``token`` (number of a group), ``node`` and ``root`` of the groups with sets that are still apart;
    none if there are none.

    Groups of one pivot, as near copies have for nearly all of their tokens, are one group where comparing that
    whole is less work than comparing each.
    """
    n = members.count()
    rows = few(members.join(roots, "node", "left"), n).withColumn("root", F.coalesce("root", "node"))
    opened = rows.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("other").alias("pivot"), F.countDistinct("node").alias("n")).where("x <> y")
    opened = compact(opened.select("token", "pivot", "n"), n)
    if not opened.take(1):
        return None
    placed = compact(rows.join(_small(opened), "token").select("token", "pivot", "node", "root").distinct(), n)
    whole = few(placed.select("pivot", "node").distinct(), n).groupBy("pivot").agg(F.count("*").cast("double").alias("size"))
    each = opened.groupBy("pivot").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("work"))
    better = compact(whole.join(each, "pivot").where("size * size <= work").select("pivot", F.lit(True).alias("better")), n)
    named = placed.join(_small(better), "pivot", "left")
    return named.select(F.when(F.col("better"), F.col("pivot")).otherwise(F.col("token")).alias("token"), "node", "root").distinct()


def _small(rows: DataFrame) -> DataFrame:
    """A checkpointed table of some numbers a row, to be broadcast if it is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _of(nodes: DataFrame, sketches: DataFrame, most: int) -> DataFrame:
    """One row of ``sketches`` for each of the nodes (``most`` at most), however many tasks wrote one: only these rows travel."""
    wanted = compact(nodes.select("node").distinct(), most)
    return sketches.join(_small(wanted), "node", "left_semi").dropDuplicates(["node"])


def halved(sketches: DataFrame) -> DataFrame:
    """``node``, ``n_shingles`` and ``parity`` with each parity folded once, but for the shortest. A set goes to as many
    units as its group has blocks, so that what it takes along counts; pairs that only the whole parities tell apart
    are screened by these afterwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(map(folded, batch.column(2).to_pylist()), pa.binary())], names=batch.schema.names)

    some = sketches.select("node", "n_shingles", "parity")
    return bounded(some).mapInArrow(run, some.schema)


def _like_sized(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs a, b those whose sizes let them link; only numbers travel."""
    n = pairs.count()
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"))
    both = few(few(pairs.join(side("a"), "a"), n).join(side("b"), "b"), n)
    return both.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")


def screened(pairs: DataFrame, sketches: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of the pairs a, b those that may link: whose sizes and parities let them, and that share a token under
    each further order. The longer columns travel for the pairs that the shorter ones leave."""
    near = compact(_filtered(pairs, sketches.select("node", "n_shingles", "parity"), _similar(percent)))
    return _filtered(near, sketches.select("node", "n_shingles", F.col("further").alias("parity")), _sharing(percent))


def _similar(percent: int):
    return lambda x, y, n, m: 100 * min(n, m) >= percent * max(n, m) and difference(x, y) * (100 + percent) <= (n + m) * (100 - percent)


def _sharing(percent: int):
    def halves(data: bytes, width: int, common: int) -> list[frozenset]:
        raw = np.frombuffer(data, np.uint8).reshape(-1, width)[:, :common]
        tokens = np.zeros((len(raw), 4), np.uint8)
        tokens[:, :common] = raw
        return [frozenset(half.tolist()) for half in tokens.view("<u4").reshape(len(ORDERS), -1)]

    def test(x: bytes, y: bytes, n: int, m: int) -> bool:
        a, b = _width(prefix_length(n, percent)), _width(prefix_length(m, percent))
        return not any(p.isdisjoint(q) for p, q in zip(halves(x, a, min(a, b)), halves(y, b, min(a, b)), strict=True))

    return test


def _filtered(pairs: DataFrame, column: DataFrame, test) -> DataFrame:
    """Pairs a, b of which ``test`` of both sides' ``parity`` and ``n_shingles`` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y, n, m = (c.to_pylist() for c in batch.columns)
            keep = [i for i in range(len(a)) if test(x[i], y[i], n[i], m[i])]
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for i in keep], pa.int64()) for c in (a, b)], names=["a", "b"])

    n = pairs.count()
    some = _of(pairs.select(F.explode(F.array("a", "b")).alias("node")), column, 2 * n)
    side = lambda c: some.select(F.col("node").alias(c), F.col("parity").alias(f"p{c}"), F.col("n_shingles").alias(f"n{c}"))
    both = few(few(pairs.join(side("a"), "a"), n, SKETCHES_A_TASK).join(side("b"), "b"), n, SKETCHES_A_TASK)
    return bounded(both.select("a", "b", "pa", "pb", "na", "nb")).mapInArrow(run, "a long, b long")


def component_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles`` and ``component_id``, the least id of its component (see :func:`joined`)."""
    return joined(docs, id_col=id_col, text_col=text_col).select(F.col("id").alias(id_col), "n_shingles", F.col("first.id").alias("component_id"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, its first (see :func:`joined`), all columns as they are.

    Rows without words are linked with nothing and all stay. Of rows equal in id and text any one stays.
    """
    known = checkpointed(joined(docs, id_col=id_col, text_col=text_col).where("node is not null"))
    is_first = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("hash") == F.col("first.hash"))
    names = [F.col("id").alias("__timbre_id"), F.col("hash").alias("__timbre_of")]
    gone = checkpointed(known.where(~is_first).select(*names).distinct())
    twice = checkpointed(known.where(is_first).groupBy("id", "hash").agg(F.count("*").alias("n")).where("n > 1").select(*names))
    small = lambda t: F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    same = F.col(id_col).eqNullSafe(F.col("__timbre_id")) & (F.col("__timbre_key") == F.col("__timbre_of"))
    left = docs.withColumn("__timbre_key", F.xxhash64(docs[text_col])).join(small(gone), same, "left_anti")
    if twice.take(1):
        repeated = left.join(small(twice), same, "left_semi").dropDuplicates([id_col, "__timbre_key"])
        left = left.join(small(twice), same, "left_anti").unionByName(repeated)
    return left.select(*docs.columns)


#: The same for DuckDB over ``documents`` (ids are unique there).
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT w.doc_id, count(s) AS n FROM words w LEFT JOIN shingles USING (doc_id) GROUP BY w.doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
), reach AS (
  SELECT doc_id, doc_id AS c FROM sizes
  UNION
  SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.doc_id
)
SELECT doc_id, any_value(sizes.n)::BIGINT AS n_shingles, min(c)::BIGINT AS component_id FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id
"""
