"""Line dedup over content-defined chunks of lines, in DataFrame operations only.

Lines with text have a hash each; a rolling hash over two neighbours' hashes ends a chunk where it is
less than those before and after it. So a chunk has two lines or more, and chunks depend on the lines
around them and not on their place: lines put in front of a shared passage shift it without changing
its chunks. A chunk that occurs again, in any document, is kept at its first place and removed
elsewhere. Where it is removed the removal grows, line by line, over the equal lines before and after
the two places, up to the ends of the neighbouring chunks: so a repeated passage goes as a whole though
its edges share chunks with other lines.

Digests of chunks only find what may be equal: lines are compared before anything is removed. Digests
and places travel without texts; only repeated chunks travel with theirs, and the copies of a common
one are dealt to several tasks with a copy of the first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbre.llm.common import checkpointed

FACTOR, RANGE = 31, 1 << 32
#: Rows of a key table that is broadcast: 100 bytes or so each; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Copies of one chunk that are compared with their first in one task.
COPIES = 256
_MARK = "__timbre_"
WORD = r"[^\x20\x09-\x0D]"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def line_hash(line: Column) -> Column:
    """First 32 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def _numbers(n: Column) -> Column:
    """0 .. n - 1; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _ends(hashes: Column) -> Column:
    """Numbers of the lines with text that end a chunk, the last of them included; none without lines."""

    def local(rolled: Column) -> Column:
        n = F.size(rolled)
        low = lambda i: (F.get(rolled, i) < F.get(rolled, i - 1)) & (F.get(rolled, i) < F.get(rolled, i + 1))
        inner = F.filter(_numbers(n), lambda i: (i >= 1) & (i < n - 2) & low(i))
        return F.concat(inner, F.when(n > 0, F.array(n - 1)).otherwise(F.array().cast("array<int>")))

    # nothing comes before the first line, so its rolling hash is above all others
    rolled = _let(hashes, lambda h: F.transform(h, lambda x, i: F.when(i == 0, F.lit(RANGE)).otherwise(F.pmod(F.get(h, i - 1) * FACTOR + x, F.lit(RANGE)))))
    return _let(rolled, local)


def _chunked(text: Column) -> Column:
    """Of a text: ``lines``, ``full`` (numbers of the lines with text) and ``ends`` (of chunks, as places in
    ``full``). Null texts have one empty line."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")

    def parts(a: Column) -> Column:
        full = F.filter(F.transform(a, lambda x, i: F.when(x.rlike(WORD), i)), lambda i: i.isNotNull())
        of = lambda f: F.named_struct(F.lit("lines"), a, F.lit("full"), f, F.lit("ends"), _ends(F.transform(f, lambda i: line_hash(F.get(a, i)))))
        return _let(full, of)

    return _let(lines, parts)


def _first(c: Column, k: Column) -> Column:
    """Place in ``full`` of the first line of chunk ``k``."""
    return F.when(k == 0, F.lit(0)).otherwise(F.get(c["ends"], k - 1) + 1)


def _texts(c: Column, start: Column, end: Column) -> Column:
    """Lines with text from place ``start`` to ``end`` (included; none where the end comes first)."""
    return F.transform(F.slice(c["full"], start + 1, F.greatest(end - start + 1, F.lit(0))), lambda i: F.get(c["lines"], i))


def _chunk_text(c: Column, k: Column) -> Column:
    """A chunk's bytes: from its first to its last line with text, with blank lines between."""
    a, b = F.get(c["full"], _first(c, k)), F.get(c["full"], F.get(c["ends"], k))
    return F.array_join(F.slice(c["lines"], a + 1, b - a + 1), "\n")


def _small(rows: DataFrame) -> DataFrame:
    """A checkpointed table, to be broadcast if it is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _equal_run(a: Column, b: Column, last: bool) -> Column:
    """How many lines from the start (the end, if ``last``) of two arrays are equal."""

    def run(x: Column, y: Column) -> Column:
        n = F.least(F.size(x), F.size(y))
        differs = (lambda i: F.get(x, F.size(x) - 1 - i) != F.get(y, F.size(y) - 1 - i)) if last else (lambda i: F.get(x, i) != F.get(y, i))
        return F.coalesce(F.get(F.filter(_numbers(n), differs), F.lit(0)), n)

    return _let(a, lambda x: _let(b, lambda y: run(x, y)))


def _part(c: Column, m: Column) -> Column:
    """Of the text that :func:`_chunked` has cut, what a mark's comparison needs: its chunk, where it lies, and
    the lines with text of the chunks before and after."""
    k, nothing = m["k"], F.array().cast("array<string>")
    start, end = _first(c, k), F.get(c["ends"], k)
    before = F.when(k > 0, _texts(c, _first(c, k - 1), start - 1)).otherwise(nothing)
    after = F.when(k < F.size(c["ends"]) - 1, _texts(c, end + 1, F.get(c["ends"], k + 1))).otherwise(nothing)
    fields = {"digest": m["digest"], "deal": m["deal"], "origin": m["origin"], "start": start, "end": end, "chunk": _chunk_text(c, k), "before": before, "after": after}
    return F.named_struct(*(x for name, value in fields.items() for x in (F.lit(name), value)))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What to remove: ``id``, ``hash`` of the text, ``chunks`` (how many of its chunks are copies) and
    ``gone`` (ranges of its lines with text: struct of ``a`` and ``b``, both included), one row a document.

    The first place of a chunk is that of the lowest id (null ids last), then text hash, then number.
    Rows equal in id and text are one document.
    """
    base = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("hash"), _chunked(docs[text_col]).alias("c"))
    c = F.col("c")
    whole = lambda k: F.get(c["ends"], k) > _first(c, k)  # two lines or more
    keys = F.transform(F.filter(_numbers(F.size(c["ends"])), whole), lambda k: F.named_struct(F.lit("k"), k, F.lit("digest"), F.md5(_chunk_text(c, k))))
    places = base.select("id", "hash", F.explode(keys).alias("p")).select("id", "hash", "p.k", "p.digest")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "hash", "k")
    firsts = checkpointed(places.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    named = firsts.select(F.col("digest").alias("_digest"), "first", F.ceil(F.col("n") / COPIES).cast("int").alias("deals"))
    copies = places.join(_small(named), F.col("digest") == F.col("_digest")).where(place != F.col("first"))
    copies = copies.select("id", "hash", "k", "digest", F.pmod(F.xxhash64("id", "hash", "k"), "deals").cast("int").alias("deal")).distinct()
    copies = checkpointed(copies)
    # a first is wanted only where copies of it are
    wanted = copies.groupBy("digest", "deal").agg(F.count("*").alias("m")).drop("m").join(_small(firsts), "digest")
    origins = wanted.select(F.col("first.id").alias("id"), F.col("first.hash").alias("hash"), F.col("first.k").alias("k"), "digest", "deal", F.lit(True).alias("origin"))
    marks = copies.withColumn("origin", F.lit(False)).unionByName(origins)
    marks = marks.groupBy("id", "hash").agg(F.collect_list(F.struct("k", "digest", "deal", "origin")).alias("marks"), F.count("*").alias("n"))
    marks = checkpointed(marks.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), "marks", "n"))
    few = (marks.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_ROWS
    texts = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("hash"), docs[text_col].alias("text"))
    marked = texts.join(F.broadcast(marks) if few else marks, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")))
    # what each mark needs is cut out before marks become rows, so that no row carries a whole text
    parts = marked.select("id", "hash", F.explode(_let(_chunked(F.col("text")), lambda c: F.transform("marks", lambda m: _part(c, m)))).alias("m")).select("id", "hash", "m.*")
    origin = parts.where("origin").select("digest", "deal", *(F.col(x).alias(f"first_{x}") for x in ("chunk", "before", "after"))).dropDuplicates(["digest", "deal"])
    both = parts.where("not origin").join(origin, ["digest", "deal"]).where("chunk = first_chunk")
    a = F.col("start") - _equal_run(F.col("before"), F.col("first_before"), True)
    b = F.col("end") + _equal_run(F.col("after"), F.col("first_after"), False)
    grown = both.select("id", "hash", "start", a.alias("a"), b.alias("b"))
    return grown.groupBy("id", "hash").agg(F.countDistinct("start").alias("chunks"), F.collect_set(F.struct("a", "b")).alias("gone"))


def _kept(c: Column, gone: Column) -> Column:
    """Numbers of the lines outside the removed ranges. A line with text goes with the blank lines behind it;
    blank lines before the first line with text stay."""
    n, full = F.size(c["lines"]), c["full"]
    places = F.array_distinct(F.flatten(F.transform(gone, lambda r: F.sequence(r["a"], r["b"]))))
    lines = F.flatten(F.transform(places, lambda p: F.sequence(F.get(full, p), F.coalesce(F.get(full, p + 1), n) - 1)))
    return F.array_except(_numbers(n), lines)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tally: bool = False, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the repeated passages taken out of their texts, other columns as they are.

    ``tally`` adds ``n_lines``, ``n_removed_lines`` and ``n_removed_chunks`` (copies, without what they grew
    by). A null text stays null and a text without repeated chunks stays as it is; a text of which no word
    stays becomes empty or blank, and its row goes with ``drop_emptied``. Repeated rows change alike. An
    empty table gives an empty result.
    """
    gone = checkpointed(removals(docs, id_col, text_col).select(*(F.col(c).alias(_MARK + c) for c in ("id", "hash", "chunks", "gone"))))
    few = (gone.agg(F.sum(F.size(_MARK + "gone"))).first()[0] or 0) <= BROADCAST_ROWS
    key = F.xxhash64(docs[text_col])
    joined = docs.withColumn(_MARK + "key", key).join(
        F.broadcast(gone) if few else gone, F.col(id_col).eqNullSafe(F.col(_MARK + "id")) & (F.col(_MARK + "key") == F.col(_MARK + "hash")), "left"
    )
    some = F.col(_MARK + "gone").isNotNull()
    text = joined[text_col]
    # lines are cut again only where some go
    done = F.when(some, _let(_chunked(text), lambda c: _let(_kept(c, F.col(_MARK + "gone")), lambda k: F.named_struct(F.lit("left"), F.size(k), F.lit("text"), F.array_join(F.transform(k, lambda i: F.get(c["lines"], i)), "\n")))))
    whole = joined.withColumn(_MARK + "done", done)
    out = [F.when(some, F.col(_MARK + "done.text")).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if tally:
        n = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
        out += [
            n.alias("n_lines"),
            F.when(some, n - F.col(_MARK + "done.left")).otherwise(0).cast("long").alias("n_removed_lines"),
            F.coalesce(_MARK + "chunks", F.lit(0)).cast("long").alias("n_removed_chunks"),
        ]
    changed = whole.select(*out, some.alias(_MARK + "some"))
    if drop_emptied:
        changed = changed.where(~F.col(_MARK + "some") | F.col(text_col).rlike(WORD))
    return changed.drop(_MARK + "some")


#: The same for DuckDB over ``documents`` (ids are unique there): the digest of op8.
ORACLE = rf"""
WITH texts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents
), lines AS (
  SELECT doc_id, i, a[i] AS line, regexp_matches(a[i], '{WORD}') AS word FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM texts)
), full_lines AS (
  SELECT doc_id, i, line, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, row_number() OVER d - 1 AS u, count(*) OVER (PARTITION BY doc_id) AS m
  FROM lines WHERE word WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), rolled AS (
  SELECT *, CASE WHEN u = 0 THEN {RANGE} ELSE (lag(h) OVER (PARTITION BY doc_id ORDER BY u) * {FACTOR} + h) % {RANGE} END AS r FROM full_lines
), ends AS (
  SELECT *, CASE WHEN u = m - 1 OR (u >= 1 AND u < m - 2 AND r < lag(r) OVER d AND r < lead(r) OVER d) THEN 1 ELSE 0 END AS e
  FROM rolled WINDOW d AS (PARTITION BY doc_id ORDER BY u)
), numbered AS (
  SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM ends
), bounds AS (
  SELECT doc_id, k, min(u) AS s, max(u) AS t, min(i) AS lo, max(i) AS hi FROM numbered GROUP BY doc_id, k
), chunks AS (
  SELECT b.*, array_to_string(a[lo:hi], chr(10)) AS chunk, lag(s) OVER d AS before_s, lead(t) OVER d AS after_t
  FROM bounds b JOIN texts USING (doc_id) WINDOW d AS (PARTITION BY doc_id ORDER BY k)
), units AS (
  SELECT doc_id, list(line ORDER BY u) AS w FROM full_lines GROUP BY doc_id
), ordered AS (
  SELECT *, row_number() OVER d AS nth, first_value(doc_id) OVER d AS first_doc, first_value(k) OVER d AS first_k
  FROM chunks WHERE t > s WINDOW d AS (PARTITION BY chunk ORDER BY doc_id, k)
), copies AS (
  SELECT o.doc_id, o.s, o.t,
         CASE WHEN o.before_s IS NULL THEN [] ELSE x.w[o.before_s + 1:o.s] END AS b1, CASE WHEN f.before_s IS NULL THEN [] ELSE y.w[f.before_s + 1:f.s] END AS b2,
         CASE WHEN o.after_t IS NULL THEN [] ELSE x.w[o.t + 2:o.after_t + 1] END AS a1, CASE WHEN f.after_t IS NULL THEN [] ELSE y.w[f.t + 2:f.after_t + 1] END AS a2
  FROM ordered o JOIN chunks f ON f.doc_id = o.first_doc AND f.k = o.first_k JOIN units x ON x.doc_id = o.doc_id JOIN units y ON y.doc_id = f.doc_id
  WHERE o.nth > 1
), grown AS (
  SELECT doc_id, s, s - coalesce(list_min(list_filter(range(least(len(b1), len(b2))), lambda j: b1[len(b1) - j] <> b2[len(b2) - j])), least(len(b1), len(b2))) AS a,
         t + coalesce(list_min(list_filter(range(least(len(a1), len(a2))), lambda j: a1[j + 1] <> a2[j + 1])), least(len(a1), len(a2))) AS b
  FROM copies
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS u FROM grown
), counted AS (
  SELECT doc_id, count(DISTINCT s) AS n FROM grown GROUP BY doc_id
), placed AS (
  SELECT doc_id, i, line, sum(word::INT) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS u FROM lines
)
SELECT p.doc_id, count(*)::BIGINT AS n_lines, count(g.u)::BIGINT AS n_removed_lines, coalesce(any_value(c.n), 0)::BIGINT AS n_removed_chunks,
       md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE g.u IS NULL), '')) AS text_md5
FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.u = p.u LEFT JOIN counted c ON c.doc_id = p.doc_id GROUP BY p.doc_id
"""
