"""Situations: clusters of the messages a speaker answers, and their keywords; nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timbre.functions import lexicons as L
from timbre.functions import text as T
from timbre.operators import density, neighbours
from timbre.session import checkpointed

#: An embedder adds ``vector`` (ml vectors of length 1) to a table with ``text``.
Embedder = Callable[[DataFrame], DataFrame]


def hashed_embedder(dim: int = 256) -> Embedder:
    """The default: hashed words and bigrams, weighted by rarity. A stand-in for a sentence encoder."""

    def embed(df: DataFrame) -> DataFrame:
        lower = F.transform(T.words(F.col("text")), F.lower)
        rows = df.withColumn("_w", lower).withColumn("_t", F.concat("_w", T.ngrams(F.col("_w"), 2)))
        rows = HashingTF(inputCol="_t", outputCol="_tf", numFeatures=dim).transform(rows)
        rows = IDF(inputCol="_tf", outputCol="_idf").fit(rows).transform(rows)
        return Normalizer(inputCol="_idf", outputCol="vector").transform(rows).drop("_w", "_t", "_tf", "_idf")

    return embed


#: Clusters by density are taken if there are two at least and less than this share of the rows lies outside.
MOST_NOISE = 0.6


def cluster(rows: DataFrame, seed: int = 7, vector: str = "vector") -> DataFrame:
    """``rows`` with ``cluster``: by density, with -1 for rows outside any (see :mod:`timbre.operators.density`), where that finds
    two clusters or more and leaves less than :data:`MOST_NOISE` outside; else k-means of the k in 2..9 with the
    best silhouette; all 0 under twelve rows."""
    rows = checkpointed(rows.withColumn("_id", F.monotonically_increasing_id()))
    n = rows.count()
    if n < 12:
        return rows.drop("_id").withColumn("cluster", F.lit(0))
    found = checkpointed(density.clusters(rows.select("_id", vector_to_array(vector).alias("_v")), "_id", "_v", least=max(5, n // 60)))
    outside, most = found.agg(F.avg((F.col("label") < 0).cast("double")), F.max("label")).first()
    if most >= 1 and outside < MOST_NOISE:
        return rows.join(found.withColumnRenamed("label", "cluster"), "_id").drop("_id")
    return _k_means(rows.drop("_id"), n, seed, vector)


def _k_means(rows: DataFrame, n: int, seed: int, vector: str) -> DataFrame:
    best, best_score = None, -1.0
    for k in range(2, min(9, n // 5) + 1):
        model = KMeans(featuresCol=vector, predictionCol="cluster", k=k, seed=seed, initSteps=5).fit(rows)
        found = model.transform(rows)
        if found.select("cluster").distinct().count() < 2:
            continue
        score = ClusteringEvaluator(featuresCol=vector, predictionCol="cluster").evaluate(found)
        if score > best_score:
            best, best_score = model, score
    return best.transform(rows) if best is not None else rows.withColumn("cluster", F.lit(0))


def keywords(rows: DataFrame, top: int = 8, by: str = "cluster") -> DataFrame:
    """by, rank, term, score: class-based TF-IDF of words of three letters or more that aren't stop words."""
    terms = rows.select(by, F.explode(F.transform(T.words(F.col("text")), F.lower)).alias("term"))
    told = terms.where((F.char_length("term") > 2) & ~F.col("term").isin(*L.FUNCTION_WORDS, *L.EXTRA_STOP_WORDS))
    tf = told.groupBy(by, "term").agg(F.count("*").alias("v"))
    sizes = tf.groupBy(by).agg(F.sum("v").alias("n"), F.count("*").alias("terms"))
    mean = sizes.agg(F.avg("n").alias("avg"))
    totals = tf.groupBy("term").agg(F.sum("v").alias("total"))
    scored = tf.join(sizes, by).join(F.broadcast(mean)).join(totals, "term").where((F.col("v") >= 2) | (F.col("terms") < 30))
    scored = scored.withColumn("score", F.col("v") / F.col("n") * F.log(1 + F.col("avg") / F.col("total")))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select(by, "rank", "term", "score")


def find(turns: DataFrame, seed: int = 7, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns with ``cluster`` of what they answer, or of themselves; situations: cluster, size, keywords, name)."""
    rows = turns.withColumn("_own", F.col("text")).withColumn("text", F.coalesce("prev_text", "text"))
    found = cluster((embedder or hashed_embedder())(rows), seed).drop("vector")
    terms = keywords(found).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("keywords"))
    sizes = found.groupBy("cluster").agg(F.count("*").alias("size"))
    situations = sizes.join(terms, "cluster", "left").withColumn("name", F.concat_ws(", ", F.slice("keywords", 1, 3))).orderBy(F.desc("size"), "cluster")
    return found.withColumn("text", F.col("_own")).drop("_own"), situations


def nearest(queries: DataFrame, rows: DataFrame, key: str = "vec_id", vector: str = "embedding", limit: int | None = None, pivots: int | None = None) -> DataFrame:
    """key, match, product: for each query the row of greatest dot product; ties by the lesser key.

    All queries are answered, or with ``limit`` those of least key. ``pivots``: how many cells the search has, which
    changes nothing in its result (see :mod:`timbre.operators.neighbours`).
    """
    some = queries.select(key, vector)
    if limit is not None:
        some = some.orderBy(key).limit(limit)
    found = neighbours.nearest(some, neighbours.built(rows, key, vector, pivots=pivots), metric=neighbours.PRODUCT)
    return found.select(key, "match", (-F.col("cost")).alias("product"))


def as_array(rows: DataFrame, vector: str = "vector") -> DataFrame:
    return rows.withColumn(vector, vector_to_array(vector))
