import hashlib
import math
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from timbre.llm import vector_codes as V


def plain(rows, rounds=4, entries=256):
    """(key, label, vector) to (key, code, error, label_error) and the codebooks, pair by pair in whole numbers."""
    kept = [(k, lab, [math.floor(1024 * x) for x in v]) for k, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(min((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[2]))[2])
    kept = [r for r in kept if len(r[2]) == width]
    cut = width // 4
    parts = [[v[p * cut : (p + 1) * cut] for _, _, v in kept] for p in range(4)]
    firsts = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[2]))[:entries]
    books = [[v[p * cut : (p + 1) * cut] for _, _, v in firsts] for p in range(4)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(e, x, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            of = defaultdict(list)
            for x in parts[p]:
                of[nearest(book, x)[1]].append(x)
            for i, xs in of.items():
                book[i] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [[nearest(books[p], x) for x in parts[p]] for p in range(4)]
    errors = [sum(d for d, _ in f) for f in zip(*found, strict=True)]
    total = defaultdict(int)
    for (_, lab, _), e in zip(kept, errors, strict=True):
        total[lab] += e
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(((k, "".join(f"{i:02x}" for _, i in f), min(e, V.MOST), min(total[lab], V.MOST)) for (k, lab, _), f, e in zip(kept, zip(*found, strict=True), errors, strict=True)), key=repr), hashlib.sha256(text.encode()).hexdigest()


def tables(spark, rows):
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "vec_id long, label int, embedding array<float>, error int, code string").repartition(3)


def check(spark, rows):
    codes, books = V.compress(tables(spark, rows))
    want, sha = plain([(k, lab, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, lab, v in rows])
    assert sorted(map(tuple, codes.select("vec_id", "code", "error", "label_error").collect()), key=repr) == want
    assert V.books_sha256(books) == sha


ODD = [(None, 3, [0.25] * 8), (9000, None, [1.0] * 8), (9001, None, None), (9002, 1, [float("nan")] + [0.0] * 7), (9003, 1, [float("inf")] + [0.0] * 7), (9004, 1, [None] + [0.0] * 7), (9005, 1, []), (9006, 1, [1.0] * 12)]


@pytest.mark.parametrize("size,kinds", [(700, 3), (40, 2), (300, 1)])
def test_equals_plain_version(spark, size, kinds):
    """Many vectors, fewer than entries, and ones on a coarse grid with ties and repeated rows; odd rows among them."""
    rng = np.random.default_rng(size)
    vectors = np.round(rng.normal(size=(size, 8)), 1 if kinds > 1 else 0)
    rows = [(i // 2 if kinds == 1 else i, int(rng.integers(kinds)), v.tolist()) for i, v in enumerate(vectors)]
    check(spark, rows + ODD)


@pytest.mark.parametrize("scale", [1e4, 3e6, 1e19, 3e38])
def test_huge_components(spark, scale):
    rng = np.random.default_rng(7)
    check(spark, [(i, i % 2, (v * scale).tolist()) for i, v in enumerate(rng.uniform(-1, 1, size=(280, 4)))])


def test_tree_equals_all_distances_and_prunes(monkeypatch):
    rng = np.random.default_rng(1)
    spots = rng.integers(-5000, 5000, (16, 4))
    entries = np.concatenate([rng.integers(-3, 4, (128, 4)), spots.repeat(8, axis=0) + rng.integers(-40, 40, (128, 4))])
    points = np.concatenate([rng.integers(-3, 4, (2000, 4)), spots[rng.integers(16, size=2000)] + rng.integers(-60, 60, (2000, 4))])
    offered = []
    offer = V.BallTree._offer
    monkeypatch.setattr(V.BallTree, "_offer", staticmethod(lambda d, some, leaf, *rest: (offered.append(len(some) * len(leaf)), offer(d, some, leaf, *rest))))
    index, best = V.BallTree(entries).nearest(points)
    square = ((points[:, None] - entries) ** 2).sum(axis=2)
    assert (index == square.argmin(axis=1)).all() and (best == square.min(axis=1)).all()
    assert sum(offered) < 0.5 * square.size


def test_empty_and_unfit(spark):
    codes, books = V.compress(tables(spark, []))
    assert codes.count() == 0 and books.size == 0 and codes.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert V.report(tables(spark, [(None, 1, [0.0] * 4)])).count() == 0
    assert V.compress(tables(spark, [(1, 1, [])]))[0].count() == 1
    with pytest.raises(ValueError):
        V.compress(tables(spark, [(1, 1, [0.0] * 6)]))


def test_equals_sql(spark):
    path = Path("/root/testdata/sf0.001/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as from '{path}'")
    got = V.report(spark.read.parquet(str(path)))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"select {', '.join(got.columns)} from ({V.ORACLE})").fetchall())
