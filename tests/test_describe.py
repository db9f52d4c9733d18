"""Descriptions with exact percentiles, however few values a task may sort."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbre.operators import stats

VALUES = "feature string, grp string, value double"


def _values():
    rng = random.Random(3)
    rows = [("tail", "target", rng.lognormvariate(0, 3)) for _ in range(900)] + [("tail", "target", 1e9)]
    rows += [("tail", "reference", rng.gauss(0, 1)) for _ in range(400)]
    rows += [("spike", "target", 0.0)] * 800 + [("spike", "target", rng.random() - 0.5) for _ in range(300)]
    rows += [("few", "target", float(rng.randint(0, 3))) for _ in range(500)]
    rows += [("one", None, 4.5), ("two", "target", 1.0), ("two", "target", 2.0), ("same", "target", 7.0), ("same", "target", 7.0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("limit", "classes"), [(50_000, 256), (20, 8), (1, 4), (100, 256)])
@pytest.mark.parametrize("by", [("feature",), ("feature", "grp")])
def test_percentiles_are_exact_at_any_limit(spark, limit, classes, by):
    rows = _values()
    groups = {}
    for feature, grp, value in rows:
        groups.setdefault((feature, grp)[: len(by)], []).append(value)
    df = stats.describe(spark.createDataFrame(rows, VALUES).repartition(5), by, limit, classes)
    assert df.columns == [*by, "mean", "median", "p10", "p90", "present", "n"]
    found = {tuple(r[c] for c in by): r for r in df.collect()}
    assert found.keys() == groups.keys()
    for k, v in groups.items():
        r = found[k]
        assert (r["median"], r["p10"], r["p90"]) == pytest.approx(np.quantile(v, [0.5, 0.1, 0.9]), rel=1e-12)
        assert r["mean"] == pytest.approx(np.mean(v)) and r["present"] == pytest.approx(np.mean(np.array(v) != 0)) and r["n"] == len(v)


def test_no_values(spark):
    assert stats.describe(spark.createDataFrame([], VALUES)).collect() == []


def test_one_far_value_leaves_small_ranges(spark):
    """Classes lie at quantiles, so a value of 10^9 doesn't put all others into one."""
    rows = spark.range(20_000).select(F.lit("f").alias("feature"), (F.col("id") % 9973 * F.lit(0.001)).alias("value"))
    df = rows.unionByName(spark.createDataFrame([("f", 1e9)], "feature string, value double"))
    (r,) = stats.describe(df, limit=200).collect()
    values = np.array([*(np.arange(20_000) % 9973 * 0.001), 1e9])
    assert (r["median"], r["p10"], r["p90"]) == pytest.approx(np.quantile(values, [0.5, 0.1, 0.9]), rel=1e-12)
