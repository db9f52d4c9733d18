"""Quality rules with adaptive thresholds per language and source.

Fixed limits are replaced by fences read from each group's own quantiles. A sketch here is a
histogram over logarithmic buckets (relative error 1 %) with a bucket for zero: two sketches merge
by adding their counts, so tasks pre-aggregate, a hot source needs no row to move, and the sketch of
a language or of everything is the sum of its groups'. Each language's sketch is blended with everything's and each
group's with its language's: :data:`PRIOR` rows are added in the parent's proportions, so fences move from the
parent's to a group's own as it grows, without a size at which they jump. The fences are then joined to the rows.

Most of these measures are zero in most documents, so quantiles are those of the values above zero
and the share of zeros counts by itself (:data:`RARE`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbre.llm.common import checkpointed
from timbre.llm.statistics import COUNTS, measured

GAMMA = 1.02
#: Rows that a group's sketch is given in the proportions of its parent's.
PRIOR = 50
#: Shares of rows nearer than that are equal: sums of blended counts are rounded.
EVEN = 1e-9
#: A fence lies so many times the distance between median and outer quantile beyond the outer quantile.
SPREAD = 5.0
#: Signs of machine text (``presence``) are out of place in a group where at most this share of the
#: documents has them: there the fence is half the lower quantile of what those documents have.
RARE = 0.2
#: Numerical noise: presence is not judged by less than so many characters in the group's median document.
NOISE = 8
#: measure: (numerator, denominator, kind). ``degree`` has a fence above, ``range`` also one below.
MEASURES = {
    "symbols": ("n_symbols", "n_words", "presence"),
    "exclamations": ("n_exclaim", "n_words", "presence"),
    "upper": ("n_upper", "n_letters", "degree"),
    "echo": ("n_echo", "n_words", "degree"),
    "dup_lines": ("n_dup_lines", "n_lines", "degree"),
    "word_length": ("word_chars", "n_words", "range"),
}
#: Sketched for its median alone.
LENGTH = "length"
QUANTILES = {"lo": 0.15, "mid": 0.5, "hi": 0.85}
#: Groups (language and source) whose fences are broadcast; more are joined by a shuffle, where
#: Spark splits skewed keys.
BROADCAST_GROUPS = 50_000
#: Rejected texts (some 30 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_REJECTED = 500_000
MARK = "__timbre_q_"


def _measure(name: str, prefix: str) -> Column:
    if name == LENGTH:
        return F.col(prefix + "n_words").cast("double")
    over, under, _ = MEASURES[name]
    return F.col(prefix + over) / F.greatest(F.col(prefix + under), F.lit(1))


def _bucket(value: Column) -> Column:
    """Number of the bucket (gamma^(i-1), gamma^i] that holds a value; null for zero."""
    return F.when(value > 0, F.ceil(F.log(value) / F.log(F.lit(GAMMA))))


def base_failed(prefix: str = "") -> Column:
    """Under 20 words, or over 30 % of the words in repeated 8-word windows."""
    n = F.col(f"{prefix}n_words")
    return (n < 20) | (100 * F.col(f"{prefix}n_repeat_words") > 30 * n)


def sketches(counted: DataFrame, prefix: str = "", lang: str = "lang", source: str = "source") -> DataFrame:
    """Mergeable sketches: lang, source, measure, bucket, n, of all rows with a word."""
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), _bucket(_measure(m, prefix)).alias("bucket")) for m in (*MEASURES, LENGTH))))
    rows = counted.where(F.col(f"{prefix}n_words") > 0).select(F.col(lang).alias("lang"), F.col(source).alias("source"), values.alias("v"))
    return rows.groupBy("lang", "source", "v.measure", "v.bucket").agg(F.count("*").alias("n"))


def _blended(own: DataFrame, parent: DataFrame, keys: list[str], prior: int) -> DataFrame:
    """The counts of ``own`` (keys, measure, bucket, n), and of each group ``prior`` rows in the proportions of its parent's
    (a key less; with ``rows``), by equal measure and keys. Each bucket gets one or two addends."""
    sizes = own.groupBy(*keys, "measure").agg(F.sum("n").alias("rows"))
    shares = parent.select(*(F.col(k).alias(f"_{k}") for k in keys[:-1]), F.col("measure").alias("_measure"), "bucket", (F.col("n") * F.lit(float(prior)) / F.col("rows")).alias("n"))
    same = F.col("measure") == F.col("_measure")
    for k in keys[:-1]:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    given = sizes.join(shares, same).select(*keys, "measure", "bucket", "n")
    both = own.select(*keys, "measure", "bucket", F.col("n").cast("double").alias("n")).unionByName(given)
    sums = both.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    total = sizes.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("measure").alias("_measure"), (F.col("rows") + F.lit(float(prior))).alias("rows"))
    same = F.col("measure") == F.col("_measure")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return sums.join(total, same).select(*keys, "measure", "bucket", "n", "rows")


def fences(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """One row per lang and source: ``lo_<measure>`` and ``hi_<measure>``."""
    keys = ["lang", "source"]
    own = checkpointed(sketch.select(*(F.col(k).cast("string").alias(k) for k in keys), "measure", "bucket", "n"))
    summed = lambda *by: own.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    whole = own.groupBy(F.col("measure").alias("_m")).agg(F.sum("n").cast("double").alias("rows"))
    overall = summed().join(F.broadcast(whole), F.col("measure") == F.col("_m")).drop("_m")  # a row a measure
    by_lang = checkpointed(_blended(summed("lang"), overall, ["lang"], prior))
    blended = _blended(summed(*keys), by_lang, keys, prior)
    # quantiles of what is above zero; the zero bucket's count is its own column
    group = Window.partitionBy(*keys, "measure")
    above = F.when(F.col("bucket").isNotNull(), F.col("n")).otherwise(0.0)
    upto = F.sum(above).over(group.orderBy(F.asc_nulls_first("bucket")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = blended.withColumns({"upto": upto, "some": F.sum(above).over(group)})
    value = 2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1)
    quantiles = ranked.groupBy(*keys, "measure").agg(
        F.max("rows").alias("rows"), F.max("some").alias("some"), *(F.min(F.when(F.col("bucket").isNotNull() & (F.col("upto") >= F.col("some") * (q - EVEN)), value)).alias(name) for name, q in QUANTILES.items())
    )
    length = quantiles.where(F.col("measure") == LENGTH).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("mid").alias("length"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    quantiles = quantiles.where(F.col("measure") != LENGTH).join(length, same).drop(*(f"_{k}" for k in keys))
    # a sketch's value is off by 1 %: fences are set wider by its two buckets
    outer = (F.col("hi") + SPREAD * (F.col("hi") - F.col("mid"))) * GAMMA**2
    inner = (F.col("lo") - SPREAD * (F.col("mid") - F.col("lo"))) / GAMMA**2
    rare = F.col("some") <= (RARE + EVEN) * F.col("rows")
    seldom = F.greatest(F.col("lo") / 2, NOISE / F.col("length"))
    nothing = F.lit(float("inf"))  # no document has any
    limits = []
    for m, (_, _, kind) in MEASURES.items():
        here = F.col("measure") == m
        high = F.when(rare, seldom).otherwise(outer) if kind == "presence" else outer
        limits.append(F.max(F.when(here, F.coalesce(high, nothing))).alias(f"hi_{m}"))
        limits.append(F.max(F.when(here, F.coalesce(inner, F.lit(0.0)) if kind == "range" else F.lit(0.0))).alias(f"lo_{m}"))
    return quantiles.groupBy(*keys).agg(*limits)


def judged(counted: DataFrame, limits: DataFrame, prefix: str = "", lang: str = "lang", source: str = "source") -> DataFrame:
    """``counted`` with ``{prefix}base_failed`` and ``{prefix}kept`` added, by a join with the fences."""
    limits = limits.select(*(F.col(c).alias(f"{MARK}{c}") for c in limits.columns))
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    joined = counted.join(limits, F.col(lang).cast("string").eqNullSafe(F.col(f"{MARK}lang")) & F.col(source).cast("string").eqNullSafe(F.col(f"{MARK}source")), "left")
    inside = F.lit(True)
    for m in MEASURES:
        inside &= _measure(m, prefix).between(F.col(f"{MARK}lo_{m}"), F.col(f"{MARK}hi_{m}"))
    failed = base_failed(prefix)
    return joined.select(*counted.columns, failed.alias(f"{prefix}base_failed"), (~failed & F.coalesce(inside, F.lit(False))).alias(f"{prefix}kept"))


def verdicts(docs: DataFrame, prior: int = PRIOR, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row: id, counts, ``base_failed`` and ``kept``.

    A null text has no words and fails; null languages and sources are groups of their own; repeated
    rows count and are judged each on their own; an empty table gives an empty result; other columns
    play no part.
    """
    rows = docs.select(docs[id_col], docs[lang].cast("string").alias("lang"), docs[source].cast("string").alias("source"), docs[text_col].alias("text"))
    counted = checkpointed(measured(rows, [id_col, "lang", "source"]))
    done = judged(counted, checkpointed(fences(sketches(counted), prior)))
    return done.select(id_col, *COUNTS[:5], "base_failed", "kept")


def filtered(docs: DataFrame, prior: int = PRIOR, text_col: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they are.

    Texts are read once for their counts and once to be returned; rows stay in the JVM. Language,
    source and text decide, so the rejected rows are known by these and two hashes of the text. Null
    texts and those without words go; null languages and sources are groups of their own; repeated rows
    count and stay or go together; an empty table stays empty.
    """
    hashes = {f"{MARK}h{k}": h(docs[text_col]) for k, h in enumerate((F.xxhash64, F.hash))}
    keys = ["lang", "source", *hashes]
    rows = docs.select(docs[lang].cast("string").alias("lang"), docs[source].cast("string").alias("source"), *(h.alias(k) for k, h in hashes.items()), docs[text_col].alias("text"))
    counted = checkpointed(measured(rows, keys))
    done = judged(counted, checkpointed(fences(sketches(counted), prior)))
    gone = checkpointed(done.where(~F.col("kept")).select(*(F.col(k).alias(f"{MARK}{i}") for i, k in enumerate(keys))).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_REJECTED else gone
    same = F.col(lang).cast("string").eqNullSafe(F.col(f"{MARK}0")) & F.col(source).cast("string").eqNullSafe(F.col(f"{MARK}1"))
    for i, k in enumerate(hashes, 2):
        same &= F.col(k) == F.col(f"{MARK}{i}")
    return docs.withColumns(hashes).join(gone, same, "left_anti").select(*docs.columns)


_VALUES = {m: f"{over} / greatest({under}, 1)" for m, (over, under, _) in MEASURES.items()}
_STRUCTS = ", ".join(f"{{'measure': '{m}', 'v': ({v})::DOUBLE}}" for m, v in (_VALUES | {LENGTH: "n_words"}).items())


def _limit_sql(m: str, kind: str) -> str:
    outer = f"(hi + {SPREAD} * (hi - mid)) * {GAMMA} * {GAMMA}"
    high = f"CASE WHEN n_some <= {RARE + EVEN!r}::DOUBLE * n_rows THEN greatest(lo / 2, {NOISE} / length) ELSE {outer} END" if kind == "presence" else outer
    low = f"(lo - {SPREAD} * (mid - lo)) / ({GAMMA} * {GAMMA})" if kind == "range" else "0.0"
    return f"max(coalesce({high}, 'infinity'::DOUBLE)) FILTER (WHERE measure = '{m}') AS hi_{m}, max(coalesce({low}, 0.0)) FILTER (WHERE measure = '{m}') AS lo_{m}"


#: The same for DuckDB over ``documents``: the digest of op4.
ORACLE = rf"""
WITH texts AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM texts WHERE len(w) >= 8)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) r(k) GROUP BY doc_id
), counted AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         CASE WHEN len(all_lines) = 1 THEN 1 ELSE len(list_filter(all_lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) END AS n_lines,
         CASE WHEN len(all_lines) = 1 THEN 0 ELSE len(list_filter(all_lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(all_lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) END::BIGINT AS n_dup_lines,
         len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_echo, len(regexp_extract_all(t, '[A-Z]')) AS n_upper,
         len(regexp_extract_all(t, '[A-Za-z]|[^\x00-\x7F]')) AS n_letters, len(regexp_extract_all(t, '!')) AS n_exclaim
  FROM texts LEFT JOIN covered c USING (doc_id)
), levels AS (
  SELECT unnest([{{'depth': 0, 'l': NULL, 's': NULL}}, {{'depth': 1, 'l': lang, 's': NULL}}, {{'depth': 2, 'l': lang, 's': source}}]) AS g, m
  FROM (SELECT lang, source, unnest([{_STRUCTS}]) AS m FROM counted WHERE n_words > 0)
), buckets AS (
  SELECT g.depth AS depth, g.l AS lang, g.s AS source, m.measure AS measure, CASE WHEN m.v > 0 THEN ceil(ln(m.v) / ln({GAMMA})) END AS bucket, count(*) AS n
  FROM levels GROUP BY ALL
), b0 AS (
  SELECT measure, bucket, n::DOUBLE AS n, sum(n) OVER (PARTITION BY measure)::DOUBLE AS n_rows FROM buckets WHERE depth = 0
), s1 AS (
  SELECT lang, measure, sum(n)::DOUBLE AS n_rows FROM buckets WHERE depth = 1 GROUP BY lang, measure
), b1 AS (
  SELECT lang, measure, bucket, sum(n) AS n, any_value(n_rows) + {PRIOR} AS n_rows FROM (
    SELECT s.lang, measure, bucket, b.n::DOUBLE AS n, s.n_rows FROM buckets b JOIN s1 s USING (measure) WHERE depth = 1 AND b.lang IS NOT DISTINCT FROM s.lang
    UNION ALL SELECT s.lang, measure, bucket, b.n * {PRIOR}.0::DOUBLE / b.n_rows, s.n_rows FROM s1 s JOIN b0 b USING (measure)) GROUP BY ALL
), s2 AS (
  SELECT lang, source, measure, sum(n)::DOUBLE AS n_rows FROM buckets WHERE depth = 2 GROUP BY lang, source, measure
), b2 AS (
  SELECT lang, source, measure, bucket, sum(n) AS n, any_value(n_rows) + {PRIOR} AS n_rows FROM (
    SELECT s.lang, s.source, measure, bucket, b.n::DOUBLE AS n, s.n_rows FROM buckets b JOIN s2 s USING (measure) WHERE depth = 2 AND b.lang IS NOT DISTINCT FROM s.lang AND b.source IS NOT DISTINCT FROM s.source
    UNION ALL SELECT s.lang, s.source, measure, bucket, b.n * {PRIOR}.0::DOUBLE / b.n_rows, s.n_rows FROM s2 s JOIN b1 b USING (measure) WHERE b.lang IS NOT DISTINCT FROM s.lang) GROUP BY ALL
), ranked AS (
  SELECT *, sum(n) FILTER (WHERE bucket IS NOT NULL) OVER (PARTITION BY lang, source, measure ORDER BY bucket NULLS FIRST) AS upto,
         coalesce(sum(n) FILTER (WHERE bucket IS NOT NULL) OVER (PARTITION BY lang, source, measure), 0) AS n_some FROM b2
), quantiles AS (
  SELECT lang, source, measure, any_value(n_rows) AS n_rows, any_value(n_some) AS n_some,
         {", ".join(f"min(2 * pow({GAMMA}, bucket) / ({GAMMA} + 1)) FILTER (WHERE bucket IS NOT NULL AND upto >= n_some * {q - EVEN!r}::DOUBLE) AS {name}" for name, q in QUANTILES.items())}
  FROM ranked GROUP BY lang, source, measure
), lengths AS (
  SELECT q.*, l.mid AS length FROM quantiles q JOIN quantiles l
  ON l.measure = '{LENGTH}' AND l.lang IS NOT DISTINCT FROM q.lang AND l.source IS NOT DISTINCT FROM q.source
), fences AS (
  SELECT lang, source, {", ".join(_limit_sql(m, kind) for m, (_, _, kind) in MEASURES.items())}
  FROM lengths GROUP BY lang, source
), failing AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce({" AND ".join(f"({v})::DOUBLE BETWEEN lo_{m} AND hi_{m}" for m, v in _VALUES.items())}, false) AS kept
FROM failing c LEFT JOIN fences f ON c.lang IS NOT DISTINCT FROM f.lang AND c.source IS NOT DISTINCT FROM f.source
"""
