"""Grouped statistics of feature tables: descriptions, effect sizes, bootstrap, contrast, keyness.

A feature table is wide (one double column a feature). Statistics work on its long form (``feature``,
``value``), so none of them names a feature. Nulls are left out.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from timbre.functions import text as T
from timbre.session import checkpointed

#: Up to so many conversations are numbered in one task, more of them by ranges of ids: the same numbers.
MAX_CLUSTERS = 2000
#: Rows of sums by conversation that a bootstrap broadcasts, draws of a task, and sums (16 bytes each) that a bootstrap broadcasts.
BROADCAST_ROWS, TASK_DRAWS, BROADCAST_SUMS = 500_000, 2_000_000, 2_500_000
#: Features that are drawn for at once, so that a row's columns stay few enough to be compiled.
DRAWN_TOGETHER = 40
NOT_FEATURES = ("doc_id", "turn_id", "speaker", "grp", "held", "reply_to", "prev_turn_id", "label")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, ST.NumericType) and f.name not in NOT_FEATURES]


def long(df: DataFrame, features: list[str] | None = None, keep: tuple[str, ...] = ("doc_id", "grp")) -> DataFrame:
    """``keep``, feature, value; without nulls and NaN."""
    features = features or numeric_columns(df)
    rows = df.select(*keep, *(F.col(c).cast("double").alias(c) for c in features)).unpivot(list(keep), features, "feature", "value")
    return rows.where("value is not null and not isnan(value)")


#: Distinct values of a range that one task sorts to pick ranks from.
SELECT_ROWS = 50_000
#: Percentiles of a description.
PERCENTILES = {"median": 0.5, "p10": 0.1, "p90": 0.9}


def describe(values: DataFrame, by: tuple[str, ...] = ("feature",), limit: int = SELECT_ROWS, classes: int = 256) -> DataFrame:
    """mean, median, p10, p90, present (share not 0) and n of each feature; a row for each group of ``by``, also a null one.

    Percentiles are exact and interpolate between the two values beside them. Values are counted by distinct
    value once, the rest reads those counts (see :func:`_at_ranks`); ``limit`` and ``classes`` change no result.
    No values give no rows.
    """
    counted = checkpointed(values.groupBy(F.struct(*by).alias("k"), "value").agg(F.count("*").alias("c")))
    v, c = F.col("value"), F.col("c")
    groups = checkpointed(counted.groupBy("k").agg(
        (F.sum(v * c) / F.sum("c")).alias("mean"), (F.sum((v != 0).cast("long") * c) / F.sum("c")).alias("present"), F.sum("c").alias("n"),
        F.count("*").alias("d"), F.min("value").alias("lo"), F.max("value").alias("hi"),
    ))
    place = lambda q: (F.col("n") - 1) * F.lit(q)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(q)), F.ceil(place(q))) for q in PERCENTILES.values()))))
    wanted = groups.select("k", F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("before"), "d")
    found = _at_ranks(counted, wanted, limit, classes).groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))  # six a group

    def percentile(q: float) -> Column:
        low, high = F.floor(place(q)), F.ceil(place(q))
        part = place(q) - low
        return F.when(low == high, F.col("at")[low]).otherwise((1 - part) * F.col("at")[low] + part * F.col("at")[high])

    rows = groups.join(F.broadcast(found), "k")
    return rows.select("k.*", "mean", *(percentile(q).alias(name) for name, q in PERCENTILES.items()), "present", "n")


def _at_ranks(counted: DataFrame, wanted: DataFrame, limit: int, classes: int) -> DataFrame:
    """k, rank, value: the values at ranks (from 0) of the groups of ``counted`` (k, value, c: how often it occurs).

    ``wanted`` (k, rank, lo, hi, before, d; some rows a group) says of each rank between which values it lies, how many rows
    lie before them and how many distinct values between. A range of more than ``limit`` distinct values is cut at
    quantiles of those, read from a sketch; the exact count of each class says in which the rank lies, and only its values go
    on. Each round leaves a share of about 1 / ``classes``. Ranges within the limit are sorted at last.
    """
    inner = [(i + 1) / classes for i in range(classes - 1)]
    while wanted.where(F.col("d") > limit).limit(1).count():
        large = wanted.where(F.col("d") > limit)
        ranges = large.select("k", "lo", "hi").distinct()
        inside = counted.join(F.broadcast(ranges), "k").where("value >= lo and value <= hi")
        bounds = inside.groupBy("k", "lo", "hi").agg(F.percentile_approx("value", inner, 20 * classes).alias("bounds"))  # a row a range
        parts = inside.join(F.broadcast(bounds), ["k", "lo", "hi"]).withColumn("part", F.size(F.filter("bounds", lambda b: b < F.col("value"))))
        sums = parts.groupBy("k", "lo", "hi", "part").agg(F.sum("c").alias("n"), F.count("*").alias("d1"), F.min("value").alias("lo1"), F.max("value").alias("hi1"))
        earlier = F.sum("n").over(Window.partitionBy("k", "lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a class
        sums = sums.withColumn("earlier", F.coalesce(earlier, F.lit(0)))
        inner_rank = F.col("rank") - F.col("before")
        nearer = large.drop("d").join(sums, ["k", "lo", "hi"]).where((inner_rank >= F.col("earlier")) & (inner_rank < F.col("earlier") + F.col("n")))
        nearer = nearer.select("k", "rank", F.col("lo1").alias("lo"), F.col("hi1").alias("hi"), (F.col("before") + F.col("earlier")).alias("before"), F.col("d1").alias("d"))
        wanted = checkpointed(wanted.where(F.col("d") <= limit).unionByName(nearer))
        open_ranges = wanted.where("lo < hi").select("k", "lo", "hi").distinct()
        counted = checkpointed(counted.join(F.broadcast(open_ranges), "k").where("value >= lo and value <= hi").select("k", "value", "c"))
    ranges = wanted.where("lo < hi").select("k", "lo", "hi").distinct()
    between = counted.join(F.broadcast(ranges), "k").where("value >= lo and value <= hi")
    listed = between.groupBy("k", "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("value", "c"))).alias("rows"))  # at most ``limit``
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("double").alias("at"))
    inner_rank = F.col("rank") - F.col("before")

    def pick(a: Column, r: Column) -> Column:
        reached = a["at"].isNull() & (a["sum"] + r["c"] > inner_rank)
        return F.struct((a["sum"] + r["c"]).alias("sum"), F.when(reached, r["value"]).otherwise(a["at"]).alias("at"))

    picked = wanted.where("lo < hi").join(listed, ["k", "lo", "hi"]).select("k", "rank", F.aggregate("rows", start, pick, lambda a: a["at"]).alias("value"))
    return picked.unionByName(wanted.where("lo = hi").select("k", "rank", F.col("lo").alias("value")))


def bootstrap_ci(values: DataFrame, draws: int = 400, seed: int = 7) -> DataFrame:
    """feature, ci_lo, ci_hi: 95 % interval of the mean, resampling whole conversations with replacement.

    Sums by conversation come first, so a draw costs what conversations cost, not turns, and a conversation's sums of all
    features are one row, so it costs that once; draws are MD5 numbers, as many of all conversations as there are. Fewer than
    three values, or no draws, give nulls.
    """
    by_doc = checkpointed(values.groupBy("feature", "doc_id").agg(F.sum("value").alias("s"), F.count("*").alias("c")))
    docs = by_doc.select("doc_id").distinct()
    n_docs = docs.count()
    sizes = by_doc.groupBy("feature").agg(F.sum("c").alias("n"))
    spark = values.sparkSession
    if not n_docs or not draws:
        return sizes.select("feature", F.lit(None).cast("double").alias("ci_lo"), F.lit(None).cast("double").alias("ci_hi"))
    by_doc = by_doc.join(_numbered(docs, n_docs), "doc_id")
    total = draws * n_docs
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_DRAWS))
    grid = spark.range(0, total, 1, tasks).select(F.floor(F.col("id") / n_docs).alias("b"), F.pmod("id", F.lit(n_docs)).alias("i"))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "b", "i")), 1, 8), 16, 10).cast("long")
    picks = grid.select("b", F.pmod(number, F.lit(n_docs)).alias("cluster"))
    names = [r.feature for r in sizes.select("feature").orderBy("feature").collect()]  # columns of a feature table
    means = None
    for start in range(0, len(names), DRAWN_TOGETHER):
        some = names[start : start + DRAWN_TOGETHER]
        of = lambda value: [F.sum(F.when(F.col("feature") == name, F.col(value))).alias(f"{value}{k}") for k, name in enumerate(some)]  # noqa: B023, E731
        sums = by_doc.where(F.col("feature").isin(some)).groupBy("cluster").agg(*of("s"), *of("c"))
        if n_docs <= BROADCAST_ROWS and n_docs * len(some) <= BROADCAST_SUMS:
            sums = F.broadcast(sums)
        drawn = picks.join(sums, "cluster").groupBy("b").agg(*((F.sum(f"s{k}") / F.greatest(F.sum(f"c{k}"), F.lit(1))).alias(f"m{k}") for k in range(len(some))))
        part = drawn.select(F.inline(F.array(*(F.struct(F.lit(name).alias("feature"), F.col(f"m{k}").alias("m")) for k, name in enumerate(some)))))
        means = part if means is None else means.unionByName(part)
    ends = means.groupBy("feature").agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    enough = F.col("n") >= 3
    return sizes.join(ends, "feature", "left").select("feature", F.when(enough, F.col("lo")).alias("ci_lo"), F.when(enough, F.col("hi")).alias("ci_hi"))


def _numbered(docs: DataFrame, n: int) -> DataFrame:
    """``docs`` with ``cluster``, their numbers from 0 in the order of ``doc_id``; no task has all of many."""
    if n <= MAX_CLUSTERS:
        return docs.withColumn("cluster", F.row_number().over(Window.orderBy("doc_id")).cast("long") - 1)
    ranges = checkpointed(docs.repartitionByRange("doc_id").withColumn("_part", F.spark_partition_id()))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    firsts = ranges.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("doc_id"))
    return ranges.join(F.broadcast(firsts), "_part").select("doc_id", (F.col("_before") + inside - 1).alias("cluster"))


def _sides(values: DataFrame) -> tuple[Column, Column]:
    v = F.col("value")
    return F.when(F.col("grp") == "target", v), F.when(F.col("grp") == "reference", v)


def hedges_g(values: DataFrame) -> DataFrame:
    """feature, hedges_g of target against reference; null with fewer than two values on a side."""
    a, b = _sides(values)
    m = values.groupBy("feature").agg(*(f(x).alias(f"{n}{s}") for x, s in ((a, "a"), (b, "b")) for f, n in ((F.count, "n"), (F.avg, "m"), (F.var_samp, "v"))))
    na, nb, ma, mb = (F.col(c) for c in ("na", "nb", "ma", "mb"))
    pooled = F.sqrt(((na - 1) * F.col("va") + (nb - 1) * F.col("vb")) / (na + nb - 2))
    g = (ma - mb) / pooled * (1 - 3 / (4 * (na + nb) - 9))
    flat = F.when(ma == mb, F.lit(0.0)).otherwise(F.signum(ma - mb) * 3.0)
    return m.select("feature", F.when((na >= 2) & (nb >= 2), F.when(pooled == 0, flat).otherwise(g)).alias("hedges_g"))


#: Classes of a running total, parted at quantiles.
CLASSES = 256


def upto(rows: DataFrame, by: str, value: str, weight: str, name: str, classes: int = CLASSES) -> DataFrame:
    """``rows`` with the running total of ``weight`` in the order of ``value`` within each ``by``, itself
    included. Values are put into classes between quantiles of each group, read from a sketch, so a class has about
    as many rows as any other however values lie; totals are taken over the classes (so many rows a group
    at most) and then inside each, so no task has a whole group."""
    inner = [(i + 1) / classes for i in range(classes - 1)] or [1.0]
    bounds = rows.groupBy(by).agg(F.percentile_approx(value, inner, 20 * classes).alias("_bounds"))  # a row a group
    rows = rows.join(F.broadcast(bounds), by).withColumn("_class", F.size(F.filter("_bounds", lambda b: b < F.col(value)))).drop("_bounds")
    sums = rows.groupBy(by, "_class").agg(F.sum(weight).alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(by).orderBy("_class").rowsBetween(Window.unboundedPreceding, -1))
    known = sums.select(by, "_class", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum(weight).over(Window.partitionBy(by, "_class").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.join(F.broadcast(known), [by, "_class"]).withColumn(name, F.col("_before") + inside).drop("_class", "_before")


def cliffs_delta(values: DataFrame) -> DataFrame:
    """feature, cliffs_delta: exact, from counts by distinct value and their running sums."""
    is_a = F.col("grp") == "target"
    by_value = values.groupBy("feature", "value").agg(F.count(F.when(is_a, 1)).alias("a"), F.count(F.when(F.col("grp") == "reference", 1)).alias("b"))
    rows = upto(by_value, "feature", "value", "b", "upto")
    total = rows.groupBy("feature").agg(
        F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum(F.col("a") * (F.col("upto") - F.col("b"))).alias("more"), F.sum(F.col("a") * F.col("upto")).alias("more_or_equal")
    )
    less = F.col("na") * F.col("nb") - F.col("more_or_equal")
    pairs = F.col("na") * F.col("nb")
    return total.select("feature", F.when(pairs > 0, (F.col("more") - less) / pairs).alias("cliffs_delta"))


def contrast(df: DataFrame, features: list[str] | None = None, draws: int = 400, seed: int = 7) -> DataFrame:
    """Target against reference, a row a feature: means, interval of the target's mean, presence, effect
    sizes, ``separated`` (the interval leaves out the reference's mean) and ``distinctiveness``."""
    features = features or numeric_columns(df)
    table = checkpointed(df.select("doc_id", "grp", *(F.col(c).cast("double").alias(c) for c in features)))  # four statistics read it: none makes features again
    values = long(table, features)
    target, reference = (values.where(F.col("grp") == g) for g in ("target", "reference"))
    stats = values.groupBy("feature").agg(
        *(f(F.when(F.col("grp") == g, x)).alias(f"{g}_{n}") for g in ("target", "reference") for f, x, n in ((F.avg, F.col("value"), "mean"), (F.avg, (F.col("value") != 0).cast("double"), "present"))),
        *(F.count(F.when(F.col("grp") == g, 1)).alias(f"n_{g}") for g in ("target", "reference")),
    )
    rows = stats.where("n_target > 0 and n_reference > 0").join(bootstrap_ci(target, draws, seed), "feature").join(hedges_g(values), "feature").join(cliffs_delta(values), "feature")
    separated = F.coalesce((F.col("reference_mean") < F.col("ci_lo")) | (F.col("reference_mean") > F.col("ci_hi")), F.lit(False))
    size = 0.6 * F.least(F.coalesce(F.abs("hedges_g"), F.lit(0.0)), F.lit(3.0)) + 0.8 * F.coalesce(F.abs("cliffs_delta"), F.lit(0.0))
    return rows.select(
        "feature", "target_mean", F.col("ci_lo").alias("target_ci_lo"), F.col("ci_hi").alias("target_ci_hi"), "target_present", "reference_mean", "reference_present", "hedges_g", "cliffs_delta",
        separated.alias("separated"), "n_target", "n_reference", (size * separated.cast("double")).alias("distinctiveness"),
    ).orderBy(F.desc("distinctiveness"), "feature")


def terms(lower_words: Column) -> Column:
    """Unigrams and bigrams."""
    return F.concat(lower_words, T.ngrams(lower_words, 2))


def keyness(turns: DataFrame, top: int = 40, least: int = 3, strength: float = 500.0) -> DataFrame:
    """Log-odds with an informative Dirichlet prior, of words and bigrams: side (over, under), rank, term,
    z, target and reference counts. ``turns`` has text and grp."""
    lower = F.transform(T.words(F.col("text")), F.lower)
    rows = turns.select("grp", lower.alias("_lower"))  # a column of its own: bigrams refer to it once a word
    counts = rows.select("grp", F.explode(terms(F.col("_lower"))).alias("term")).groupBy("term").agg(
        F.count(F.when(F.col("grp") == "target", 1)).alias("target"), F.count(F.when(F.col("grp") == "reference", 1)).alias("reference")
    )
    totals = counts.agg(F.sum("target").alias("nt"), F.sum("reference").alias("nr"))
    rows = counts.where((F.col("target") + F.col("reference") >= least) & ~F.col("term").isin("name", "url")).join(F.broadcast(totals))
    ct, cr, one = F.col("target"), F.col("reference"), F.lit(1)
    prior = (ct + cr) * (F.lit(strength) / (F.col("nt") + F.col("nr")))
    nt, nr = F.greatest("nt", one), F.greatest("nr", one)
    odds = lambda c, n: F.log((c + prior) / (n + strength - c - prior))
    z = (odds(ct, nt) - odds(cr, nr)) / F.sqrt(1 / (ct + prior) + 1 / (cr + prior))
    rows = rows.select("term", z.alias("z"), "target", "reference").where(F.abs("z") > 1.96)
    rows = rows.withColumn("side", F.when(F.col("z") > 0, "over").otherwise("under"))
    rank = F.row_number().over(Window.partitionBy("side").orderBy(F.desc(F.abs("z")), "term"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("side", "rank", "term", F.round("z", 2).alias("z"), "target", "reference")


def act_profile(df: DataFrame, prefix: str) -> DataFrame:
    """act, share: mean of each ``<prefix>*`` column that isn't a probability or confidence."""
    names = [c for c in df.columns if c.startswith(prefix) and not c.endswith(("_p", "_confidence"))]
    return df.select(*(F.avg(c).alias(c.removeprefix(prefix)) for c in names)).unpivot([], [c.removeprefix(prefix) for c in names], "act", "share")


def auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: area under the ROC curve, ties at half, from counts by distinct score."""
    by = scored.groupBy(score).agg(F.count(F.when(F.col(label) == 1, 1)).alias("p"), F.count(F.when(F.col(label) != 1, 1)).alias("n"))
    rows = upto(by.withColumn("_all", F.lit(0)), "_all", score, "n", "upto").withColumn("below", F.col("upto") - F.col("n"))
    return rows.agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


# Lanczos's approximation of the gamma function, g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_factorial(n: Column) -> Column:
    """ln n! in constant time, to about 14 digits."""
    x = n.cast("double")
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        series = series + F.lit(c) / (x + F.lit(float(i)))
    t = x + F.lit(7.5)
    return F.when(x < 2, F.lit(0.0)).otherwise(F.lit(0.9189385332046727) + (x + F.lit(0.5)) * F.log(t) - t + F.log(series))


def fisher_p(t_hits: Column, t_n: Column, r_hits: Column, r_n: Column, greater: bool = True) -> Column:
    """One-sided Fisher exact test that the target hits more (less) often than the reference.

    The first table's chance comes from factorials, each further one's from the one before.
    """
    choose = lambda n, k: log_factorial(n) - log_factorial(k) - log_factorial(n - k)
    hits = t_hits + r_hits
    last = F.least(hits, t_n) if greater else F.greatest(F.lit(0), hits - r_n)
    first = F.exp(choose(t_n, t_hits) + choose(r_n, r_hits) - choose(t_n + r_n, hits))
    steps = F.abs(last - t_hits).cast("int")
    d = lambda c: c.cast("double")

    def step(a: Column, i: Column) -> Column:
        k = d(t_hits) + d(i - 1) * (1 if greater else -1)
        up = (d(t_n) - k) * (d(hits) - k) / ((k + 1) * (d(r_n) - d(hits) + k + 1))
        down = k * (d(r_n) - d(hits) + k) / ((d(t_n) - k + 1) * (d(hits) - k + 1))
        now = a["now"] * (up if greater else down)
        return F.struct(now.alias("now"), (a["all"] + now).alias("all"))

    whole = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), F.struct(first.alias("now"), first.alias("all")), step, lambda a: a["all"])
    return F.least(whole, F.lit(1.0))


def spearman(a: list[float], b: list[float]) -> float | None:
    """Rank correlation of two short lists, ties by mean rank."""
    if len(a) < 2:
        return None

    def ranks(x):
        order, out, i = sorted(range(len(x)), key=lambda k: x[k]), [0.0] * len(x), 0
        while i < len(order):
            j = i
            while j + 1 < len(order) and x[order[j + 1]] == x[order[i]]:
                j += 1
            for k in order[i : j + 1]:
                out[k] = (i + j) / 2
            i = j + 1
        return out

    ra, rb = ranks(a), ranks(b)
    ma, mb = sum(ra) / len(ra), sum(rb) / len(rb)
    cov = sum((x - ma) * (y - mb) for x, y in zip(ra, rb, strict=True))
    va, vb = sum((x - ma) ** 2 for x in ra), sum((y - mb) ** 2 for y in rb)
    return cov / (va * vb) ** 0.5 if va and vb else None


def within_correlation(df: DataFrame, features: list[str]) -> DataFrame:
    """a, b, r: Pearson correlation of features centred on their group's mean, nulls as 0."""
    filled = df.select("grp", *(F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in features))
    means = filled.groupBy("grp").agg(*(F.avg(c).alias(f"_m_{c}") for c in features))  # two rows: no window over all turns
    centred = filled.join(F.broadcast(means), "grp").select(*((F.col(c) - F.col(f"_m_{c}")).alias(c) for c in features))
    if len(features) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    vectors = VectorAssembler(inputCols=features, outputCol="_v").transform(centred).select("_v")
    matrix = Correlation.corr(vectors, "_v").first()[0].toArray()  # one pass of sums of products; features x features
    rows = [(a, b, 0.0 if matrix[i, j] != matrix[i, j] else float(matrix[i, j])) for i, a in enumerate(features) for j, b in enumerate(features) if i < j]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def style_richness(turns: DataFrame, by: str = "speaker", sample: int = 42) -> DataFrame:
    """tokens, types and HD-D (expected types in a random sample of tokens; null if there are fewer)."""
    lower = F.transform(T.words(F.col("text")), F.lower)
    counts = turns.select(by, F.explode(lower).alias("term")).groupBy(by, "term").agg(F.count("*").alias("c"))
    sums = checkpointed(counts.groupBy(F.col(by).alias("_by")).agg(F.sum("c").alias("n")))
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_ROWS else sums
    rows = counts.join(sums, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    c, n = F.col("c").cast("double"), F.col("n").cast("double")
    none = F.aggregate(F.sequence(F.lit(0), F.lit(sample - 1)), F.lit(1.0), lambda a, j: a * (n - c - j) / (n - j))
    missed = F.when(n - c >= sample, none).otherwise(F.lit(0.0))
    return rows.groupBy(by).agg(F.max("n").alias("tokens"), F.count("*").alias("types"), F.when(F.max("n") >= sample, F.sum(1 - missed)).alias("hdd"))
