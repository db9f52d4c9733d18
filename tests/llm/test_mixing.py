import math
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from timbre.llm import mixing, registry


def weights(sizes, exponent):
    raised = [(x / sum(sizes)) ** exponent if x else 0.0 for x in sizes]
    return [x / sum(raised) for x in raised]


def entropy(w):
    n = sum(x > 0 for x in w)
    return -sum(x * math.log(x) for x in w if x) / math.log(n) if n > 1 else 1.0


def least_budget(sizes, w):
    return max((s / x for s, x in zip(sizes, w, strict=True) if x), default=0.0)


def temperature(sizes, max_repeats=2.0, target=None, budget=None):
    """One exponent at a time, over lists."""

    def repeats(a):
        w = weights(sizes, a)
        tokens = least_budget(sizes, w) if budget is None else budget
        return max(tokens * x / s for s, x in zip(sizes, w, strict=True) if s)

    def bisected(high_side):
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if high_side(mid) else (mid, high)
        return low, high

    found = []
    if max_repeats is not None:
        found.append(0.0 if repeats(0.0) <= max_repeats else bisected(lambda a: repeats(a) <= max_repeats)[1])
    if target is not None:
        found.append(1.0 if entropy(weights(sizes, 1.0)) >= target else bisected(lambda a: entropy(weights(sizes, a)) < target)[0])
    return round(max(found), 9) if found and any(sizes) else 1.0


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def chain(*values, width=8):
    """Spark's xxhash64 of the columns: each hash is the next one's seed; nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v, h)
    return signed(h)


def long(x):
    return None if x is None else x.to_bytes(8, "little", signed=True)


def int4(x):
    return x.to_bytes(4, "little", signed=True)


def brute(rows, blocks, max_repeats=2.0, target=None, budget=None, seed=0):
    words = lambda t: len((t or "").encode().split())
    placed = [(i, t, s, chain(long(i), t) % blocks) for i, t, s in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is not None, s))
    sums = {s: Counter() for s in names}
    for _, t, s, b in placed:
        sums[s][b] += words(t)
    totals = [float(sum(sums[s].values())) for s in names]
    w = weights(totals, temperature(totals, max_repeats, target, budget))
    tokens = least_budget(totals, w) if budget is None else budget
    copies = {}
    for s, total, x in zip(names, totals, w, strict=True):
        passes = math.floor(tokens * x / total + 1e-9) if total else 1
        rest, upto = tokens * x - passes * total, 0
        for b in sorted(sums[s], key=lambda b: (chain(int4(seed), s, int4(b), int4(passes)), b)):
            upto += sums[s][b]
            copies[s, b] = passes + (total > 0 and rest > 0 and upto - sums[s][b] / 2 <= rest)
    return Counter((i, t, s, e) for i, t, s, b in placed for e in range(copies[s, b]))


ROWS = [(i, "word " * (i % 90), f"s{min(i % 17, 4)}") for i in range(800)] + [(None, None, None), (1, "", None), (2, "a b", None), (3, "", "void"), (4, "tie", "s0"), (4, "tie", "s0")]


@pytest.mark.parametrize("how", [{}, {"max_repeats": 1.25}, {"max_repeats": None, "target": 0.95}, {"max_repeats": 3.0, "budget": 9000.0}, {"max_repeats": 2.0, "target": 0.9}, {"max_repeats": None}])
@pytest.mark.parametrize("limit", [0, 10**6])
def test_equals_brute_force(spark, monkeypatch, how, limit):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", limit)
    docs = spark.createDataFrame([(*r, 1, 2) for r in ROWS], "doc_id long, text string, source string, n int, block int").repartition(3)
    args = {("target_entropy" if k == "target" else k): v for k, v in how.items()}
    got = mixing.mixed(docs, blocks=16, **args)
    assert got.columns == docs.columns
    want = Counter()
    for (i, t, s, _), n in brute(ROWS, 16, **how).items():
        want[i, t, s] += n
    assert Counter((r.doc_id, r.text, r.source) for r in got.collect()) == want
    if "budget" not in how:
        assert set(want) == {(i, t, s) for i, t, s in ROWS}


def test_exponents(spark):
    sizes = [1000.0, 100.0, 10.0]
    table = spark.createDataFrame([(int(x),) for x in (*sizes, 0)], "total long")
    a = mixing.solved(table, 2.0)
    w = weights(sizes, a.exponent)
    assert abs(max(a.tokens * x / s for s, x in zip(sizes, w, strict=True)) - 2) < 1e-6 and a.tokens >= sum(sizes)
    assert mixing.solved(table, 1000.0).exponent == 0 and mixing.solved(table.where("total = 0"), 2.0).exponent == 1
    b = mixing.solved(table, None, 0.8).exponent
    assert abs(entropy(weights(sizes, b)) - 0.8) < 1e-6 and mixing.solved(table, 2.0, 0.8).exponent == max(a.exponent, b)


def test_places_and_empty(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    got = mixing.mixed(docs, blocks=16, places=True).collect()
    by = {(r.source, r.block, r.epoch): r.place for r in got}
    assert all(by[r.source, r.block, r.epoch] == r.place for r in got) and len(set(by.values())) == len(by)
    assert mixing.mixed(docs.limit(0)).count() == 0


def gain(sizes, mixed):
    """The part of the way to the greatest entropy that the mixture goes."""
    own = entropy([x / sum(sizes) for x in sizes])
    return (entropy([x / sum(mixed) for x in mixed]) - own) / (1 - own)


@pytest.mark.parametrize("sizes", [[1000.0, 100.0, 10.0], [9_900_000.0] + [900_000.0 + 5000 * i for i in range(19)], [100.0, 101.0, 99.0]])
def test_entropy_gain(spark, sizes):
    table = spark.createDataFrame([(int(x),) for x in (*sizes, 0)], "total long")
    for part in (0.25, 0.75):
        a = mixing.solved(table, None, entropy_gain=part).exponent
        assert 0 < a < 1 and abs(gain(sizes, weights(sizes, a)) - part) < 1e-5
        assert mixing.solved(table, 1.01, entropy_gain=part).exponent == max(a, mixing.solved(table, 1.01).exponent)
    assert mixing.solved(table, None, entropy_gain=0.0).exponent == 1 and mixing.solved(table.limit(1), None, entropy_gain=0.75).exponent == 1


def skewed(spark, folder):
    """A source of ten times the words of the others, and one row without a source."""
    words = " ".join(["word"] * 20)
    rows = [(i, words, f"s{max(0, i % 14 - 9)}") for i in range(2800)] + [(9999, words, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1", "skewed"])
def test_the_query_mixes(spark, tmp_path, sf):
    """The rows of the query go most of the way to equal sources, and each document is among them."""
    path = skewed(spark, tmp_path) if sf == "skewed" else f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), mixing.n_words(F.col("text")).alias("n_words"))
    sums = {r.source: r.n for r in docs.groupBy("source").agg(F.sum("n_words").alias("n")).collect()}
    done = registry.op6_source_mixing(spark, path).withColumn("source", F.coalesce("source", F.lit("none"))).cache()
    got = {r.source: r.n for r in done.groupBy("source").agg(F.sum("n_words").alias("n")).collect()}
    if sf != "skewed":
        assert abs(gain([*sums.values()], [got[s] for s in sums]) - registry.ENTROPY_GAIN) < 0.1
    assert got["s0" if sf == "skewed" else max(sums, key=sums.get)] / sum(got.values()) < 0.95 * max(sums.values()) / sum(sums.values())
    assert done.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert done.agg(F.max("epoch")).first()[0] <= registry.MAX_REPEATS
