"""The on-voice scorer: logistic regression over portable surface features, applied as an expression."""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbre.functions import lexicons as L
from timbre.functions.surface import surface
from timbre.operators.stats import auc

C, FOLDS = 0.5, 5


def transformed(feature: str) -> Column:
    """A feature as the scorer sees it: null as 0, heavy-tailed counts by their logarithm."""
    value = F.coalesce(F.col(feature).cast("double"), F.lit(0.0))
    return F.log1p(value) if feature in L.LOG_FEATURES else value


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _standardised(df: DataFrame, features: list[str], mean: list[float], scale: list[float]) -> DataFrame:
    z = [((transformed(f) - F.lit(m)) / F.lit(s)).alias(f"_z{i}") for i, (f, m, s) in enumerate(zip(features, mean, scale, strict=True))]
    rows = df.select("doc_id", (F.col("grp") == "target").cast("double").alias("label"), *z)
    return VectorAssembler(inputCols=[f"_z{i}" for i in range(len(features))], outputCol="x").transform(rows).select("doc_id", "label", "x")


def _fitted(rows: DataFrame):
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    total = sum(n.values())
    weight = F.when(F.col("label") == 1, total / (2 * n[1.0])).otherwise(total / (2 * n[0.0]))
    model = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", regParam=1 / (C * total), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9)
    return model.fit(rows.withColumn("w", weight))


def fit(df: DataFrame, seed: int = 7, cross_validate: bool = True) -> dict:
    """A scorer from a feature table with ``grp`` and ``doc_id``: features, logarithms, means, scales,
    coefficients, intercept, cross-validated AUC over folds of whole conversations, greatest weights."""
    features = [f for f in L.PORTABLE if f in df.columns]
    stats = df.agg(*(x for f in features for x in (F.avg(transformed(f)), F.stddev_pop(transformed(f))))).first()
    mean, scale = list(stats[0::2]), [s + 1e-6 for s in stats[1::2]]
    rows = _standardised(df, features, mean, scale).persist()
    try:
        model = _fitted(rows)
        if model is None:
            raise ValueError("a scorer needs turns of both target and reference")
        scores, docs = [], rows.select("doc_id").distinct().count() if cross_validate else 0
        k = min(FOLDS, docs)
        if docs >= 4:
            fold = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), F.lit(k))
            for i in range(k):
                test = rows.where(fold == i)
                one = _fitted(rows.where(fold != i))
                if one is not None and test.select("label").distinct().count() == 2:
                    scores.append(BinaryClassificationEvaluator(rawPredictionCol="rawPrediction", numBins=0).evaluate(one.transform(test)))
    finally:
        rows.unpersist()
    coef = model.coefficients.toArray().tolist()
    top = sorted(zip(features, coef, strict=True), key=lambda x: (-abs(x[1]), x[0]))[:12]
    r6 = lambda xs: [round(float(x), 6) for x in xs]
    return {
        "type": "logistic_regression_surface", "features": features, "log1p": list(L.LOG_FEATURES), "mean": r6(mean), "scale": r6(scale), "coef": r6(coef), "intercept": round(float(model.intercept), 6),
        "cv_auc": round(sum(scores) / len(scores), 4) if scores else None, "cv_folds": len(scores), "top_weights": [[f, round(w, 3)] for f, w in top],
    }


def score(model: dict) -> Column:
    """The scorer over a table that has its features: a narrow projection, in batches or streams."""
    x = F.lit(float(model["intercept"]))
    for f, m, s, w in zip(model["features"], model["mean"], model["scale"], model["coef"], strict=True):
        x = x + (transformed(f) - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(w))
    return sigmoid(x)


def score_texts(df: DataFrame, model: dict, text: str = "text", name: str = "score") -> DataFrame:
    """``df`` with the score of each text, features computed on the way."""
    made = surface(df, model["features"], text)
    return made.select(*df.columns, score(model).alias(name))


def to_sql(model: dict) -> str:
    """The scorer as a SQL expression over feature columns: the portable export."""
    terms = [f"{model['intercept']!r}"]
    for f, m, s, w in zip(model["features"], model["mean"], model["scale"], model["coef"], strict=True):
        value = f"coalesce({f}, 0)"
        value = f"ln(1 + {value})" if f in model["log1p"] else value
        terms.append(f"({value} - ({m!r})) / {s!r} * ({w!r})")
    return f"1 / (1 + exp(-({' + '.join(terms)})))"


def to_typescript(model: dict) -> str:
    """The scorer for another runtime: a function from feature values to the score."""
    import json

    return (
        f"export const model = {json.dumps({k: model[k] for k in ('features', 'log1p', 'mean', 'scale', 'coef', 'intercept')})};\n\n"
        "/** Score in 0..1 of named feature values; missing ones count as 0. */\n"
        "export function score(values: Record<string, number>): number {\n"
        "  let x = model.intercept;\n"
        "  model.features.forEach((name, i) => {\n"
        "    const raw = values[name] ?? 0;\n"
        "    const value = model.log1p.includes(name) ? Math.log1p(raw) : raw;\n"
        "    x += ((value - model.mean[i]) / model.scale[i]) * model.coef[i];\n"
        "  });\n"
        "  return 1 / (1 + Math.exp(-x));\n"
        "}\n"
    )


def heldout_auc(scored: DataFrame) -> float | None:
    """AUC of a table with ``score`` and ``grp``."""
    value = auc(scored.withColumn("label", (F.col("grp") == "target").cast("int"))).first()["auc"]
    return None if value is None or math.isnan(value) else float(value)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, centroid: mean vector of each label, of length 1."""
    parts = vectors.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = parts.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p")).select(label, F.transform("p", lambda s: s["x"]).alias("m"))
    norm = F.sqrt(dot(F.col("m"), F.col("m")))
    return whole.withColumn("_n", norm).select(label, F.transform("m", lambda x: x / F.col("_n")).alias("centroid"))


def nearest_centroid(vectors: DataFrame, cents: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """key, predicted: the label whose centroid has the greatest product; ties by the lesser label. A row a
    label is broadcast."""
    pairs = vectors.select(key, vector).crossJoin(F.broadcast(cents.select(F.col(label).alias("predicted"), "centroid")))
    best = F.max_by("predicted", F.struct(dot(F.col(vector), F.col("centroid")), (-F.col("predicted").cast("double")).alias("t")))
    return pairs.groupBy(key).agg(best.alias("predicted"))


def style_score(vectors: DataFrame, cents: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, style: product with the target's centroid minus that with the reference's; ``cents`` has grp."""
    both = cents.groupBy().agg(*(F.first(F.when(F.col("grp") == g, F.col("centroid")), ignorenulls=True).alias(g) for g in ("target", "reference")))
    rows = vectors.crossJoin(F.broadcast(both))
    return rows.select(key, (dot(F.col(vector), F.col("target")) - dot(F.col(vector), F.col("reference"))).alias("style"))


def combined(surface_score: Column, style: Column) -> Column:
    return 0.5 * surface_score + 0.5 * sigmoid(20 * style)
