"""Neighbours and clusters by density against plain versions over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbre.operators import density, neighbours, situations


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)


def spots(seed, n=240, dim=3):
    """Dense spots of different width, some noise and repeated rows."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(c, s, (n // 4, dim)) for c, s in ((0, 0.3), (4, 0.2), (5, 0.6))]
    return np.concatenate([*parts, rng.uniform(-8, 12, (n // 5, dim)), parts[0][:9], np.repeat(parts[1][:1], 6, axis=0)])


@pytest.mark.parametrize("pivots,tile", [(1, 4096), (12, 4096), (40, 30)])
@pytest.mark.parametrize("metric", [neighbours.PRODUCT, neighbours.DISTANCE])
def test_nearest_equals_all_pairs(spark, monkeypatch, pivots, tile, metric):
    monkeypatch.setattr(neighbours, "TILE", tile)
    x, q = spots(1), spots(2, 100)
    cells = neighbours.built(table(spark, x), "vec_id", "embedding", pivots=pivots)
    got = {}
    for r in neighbours.nearest(table(spark, q), cells, 4, metric).collect():
        got.setdefault(r.vec_id, []).append((r.cost, r.match))
    cost = -(q[:, None] * x).sum(axis=2) if metric == neighbours.PRODUCT else np.sqrt(((q[:, None] - x) ** 2).sum(axis=2))
    for i, row in enumerate(cost):
        want = [(row[j], j) for j in np.lexsort((np.arange(len(x)), row))[:4]]
        assert sorted(got[i]) == want


def test_bounds_skip_cells(spark):
    x = np.concatenate([np.random.default_rng(i).normal(20 * i, 0.1, (60, 4)) for i in range(8)])
    cells = neighbours.built(table(spark, x), "vec_id", "embedding", pivots=40)
    assert neighbours.skipped_share(table(spark, x), cells) > 0.8
    none = table(spark, x).where("false")
    assert neighbours.nearest(none, cells).count() == 0 and neighbours.nearest(table(spark, x), neighbours.built(none, "vec_id", "embedding")).count() == 0


def plain_labels(x, least, samples=3):
    """Components of each threshold from the greatest down, all pairs."""
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, samples - 1]
    m = np.maximum(d, np.maximum(core[:, None], core))

    def parts(rows, limit):
        """Components of pairs nearer than the limit."""
        left, found = set(rows), []
        while left:
            todo, seen = [left.pop()], set()
            while todo:
                i = todo.pop()
                seen.add(i)
                new = [j for j in left if m[i, j] < limit]
                left.difference_update(new)
                todo += new
            found.append(sorted(seen))
        return found

    clusters = []

    def walk(rows, born, parent):
        me = len(clusters)
        clusters.append({"parent": parent, "stability": 0.0, "rows": list(rows), "children": []})
        while True:
            limit = _joins(rows, m)
            lam = 1 / max(limit, density.SMALLEST)
            pieces = parts(rows, limit)
            large = [p for p in pieces if len(p) >= least]
            gone = len(rows) - sum(map(len, large))
            clusters[me]["stability"] += gone * (lam - born)
            if len(large) != 1:
                clusters[me]["stability"] += sum(map(len, large)) * (lam - born)
                for p in large:
                    clusters[me]["children"].append(walk(p, lam, me))
                return me
            rows = large[0]

    walk(list(range(len(x))), 0.0, None)
    out = np.full(len(x), -1)

    def best(c):
        below = sum(best(k)[0] for k in clusters[c]["children"])
        chosen = [k for child in clusters[c]["children"] for k in best(child)[1]]
        if clusters[c]["parent"] is None or (clusters[c]["children"] and clusters[c]["stability"] < below):
            return below, chosen
        return clusters[c]["stability"], [c]

    found = sorted((clusters[c]["rows"] for c in best(0)[1]), key=lambda r: (-len(r), r[0]))
    for label, rows in enumerate(found):
        out[rows] = label
    return out.tolist()


def _joins(rows, m):
    """The least threshold at which the rows are one component."""
    seen, far, nearest = {rows[0]}, 0.0, dict.fromkeys(rows[1:], np.inf)
    last = rows[0]
    while nearest:
        for j in nearest:
            nearest[j] = min(nearest[j], m[last, j])
        last = min(nearest, key=nearest.get)
        far = max(far, nearest.pop(last))
        seen.add(last)
    return far


def test_clusters_equal_plain_version(spark):
    x = spots(1)
    got = density.clusters(table(spark, x), "vec_id", "embedding", 8, pivots=9).orderBy("vec_id").collect()
    want = plain_labels(x, 8)
    assert len(set(want)) > 2 and [r.label for r in got] == want


def reachability(x, samples=3):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, samples - 1]
    return np.maximum(d, np.maximum(core[:, None], core))


def plain_tree(m):
    """Edges a, b, w of a minimum spanning tree, row by row."""
    near, way, edges = m[0].copy(), np.zeros(len(m), int), []
    near[0] = np.inf
    inside = {0}
    for _ in range(len(m) - 1):
        i = int(near.argmin())
        edges.append((min(i, int(way[i])), max(i, int(way[i])), float(near[i])))
        inside.add(i)
        closer = m[i] < near
        closer[list(inside)] = False
        near[closer], way[closer] = m[i][closer], i
        near[list(inside)] = np.inf
    return edges


@pytest.mark.parametrize("seed,least,direct", [(2, 5, 110), (3, 12, 50_000)])
def test_trees_of_many_edges_are_folded_in_parts(spark, seed, least, direct):
    x = spots(seed)
    tree = spark.createDataFrame(plain_tree(reachability(x)), "a long, b long, w double")
    points = spark.createDataFrame([(i,) for i in range(len(x))], "node long")
    got = density.labels(points, tree, least, direct).orderBy("node").collect()
    want = plain_labels(x, least)
    assert len(set(want)) > 2 and [r.label for r in got] == want


def test_tree_has_least_weight(spark):
    x = spots(5, 120)
    tree = density.spanning_tree(table(spark, x), "vec_id", "embedding", graph=4, pivots=9).toPandas()
    total = sum(w for _, _, w in plain_tree(reachability(x)))
    assert len(tree) == len(x) - 1 and abs(tree.w.sum() - total) < 1e-9


def test_copies_are_one_row_and_the_largest_component_waits(spark, monkeypatch):
    """Equal vectors are searched for once, and a round searches for rows of the smaller components only."""
    plain, asked = neighbours.nearest, []

    def counted(queries, cells, *rest, **named):
        if "group" in named:
            largest = cells.rows.groupBy("comp").count().orderBy(F.desc("count"), "comp").first()["comp"]
            assert queries.where(F.col("comp") == largest).count() == 0
        asked.append(queries.count())
        return plain(queries, cells, *rest, **named)

    monkeypatch.setattr(neighbours, "nearest", counted)
    x = np.concatenate([spots(5, 60), spots(5, 60)])
    tree = density.spanning_tree(table(spark, x), "vec_id", "embedding", graph=3, pivots=9).toPandas()
    total = sum(w for _, _, w in plain_tree(reachability(x)))
    assert len(tree) == len(x) - 1 and abs(tree.w.sum() - total) < 1e-9
    assert asked[0] == len(np.unique(x, axis=0)) and len(asked) > 1


def test_packed_vectors_and_places():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 40)) * (rng.uniform(size=(50, 40)) < np.linspace(0, 1, 50)[:, None])
    packed = neighbours._packed(x)
    assert (neighbours._unpacked(packed, 40) == x).all() and len(packed[0]) == 0 and max(map(len, packed)) <= 320
    for near in (x > 1, x[:3, :7] > 0):
        assert neighbours._hits(near).tolist() == np.flatnonzero(near).tolist()


def test_large_least_folds_in_time():
    """A component that grows row by row to a great least size (a sixtieth of all rows for situations) isn't copied a merge."""
    import time

    import pandas as pd

    n = 100_000
    nodes = pd.DataFrame({"part": "t", "node": range(n), "size": 1, "cluster": None})
    edges = pd.DataFrame({"a": range(n - 1), "b": range(1, n), "w": np.arange(1.0, n)})
    start = time.perf_counter()
    out = density._folded(n // 2)(nodes, edges)
    assert time.perf_counter() - start < 15
    rows = out[out.kind == "row"].sort_values("node")
    assert rows.node.tolist() == list(range(n)) and rows.w.tolist() == [max(float(i), n // 2 - 1.0) for i in range(n)]


def test_few_rows(spark):
    x = spots(1)[:4]
    assert [r.label for r in density.clusters(table(spark, x), "vec_id", "embedding", 5).collect()] == [-1] * 4
    assert density.clusters(table(spark, x).where("false"), "vec_id", "embedding", 5).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30) if i % 10 != 9] + [(50, 40), (60, 50)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(31), 40, 50, 60, 70]], "node long")
    for direct in (0, 100):
        got = {r.node: r.comp for r in density.components(nodes, edges, direct).collect()}
        assert got == {**{i: i // 10 * 10 for i in range(31)}, 40: 40, 50: 40, 60: 40, 70: 70}


def test_situations_take_density_where_it_finds_some(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(0)
    two = np.concatenate([rng.normal(0, 0.1, (40, 3)), rng.normal(5, 0.1, (30, 3))])
    rows = table(spark, two).select("vec_id", array_to_vector("embedding").alias("vector"))
    got = situations.cluster(rows).select("vec_id", "cluster").orderBy("vec_id").collect()
    assert [r.cluster for r in got] == [0] * 40 + [1] * 30
    even = table(spark, rng.uniform(size=(60, 8))).select("vec_id", array_to_vector("embedding").alias("vector"))
    assert situations.cluster(even).where(F.col("cluster") < 0).count() < 36


@pytest.mark.parametrize("metric", [neighbours.PRODUCT, neighbours.DISTANCE])
def test_queries_go_to_few_groups_and_tiny_differences_count(spark, metric):
    """A query is copied for groups of cells, not for cells; what single precision can't tell apart is told apart."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 48))
    x = np.concatenate([base + 1e-9 * rng.normal(size=base.shape) for _ in range(500)])
    cells = neighbours.built(table(spark, x), "vec_id", "embedding")
    sizes = np.bincount(cells.group, cells.count)
    assert len(sizes) <= 2 * neighbours.GROUPS < len(cells.count) and sizes.sum() == len(x) and sizes.max() <= max(cells.tile, cells.count.max())
    q = x[:40]
    got = {r.vec_id: (r.match, r.cost) for r in neighbours.nearest(table(spark, q), cells, 1, metric, but_itself=True).collect()}
    cost = -(q[:, None] * x).sum(axis=2) if metric == neighbours.PRODUCT else np.sqrt(((q[:, None] - x) ** 2).sum(axis=2))
    cost[np.arange(40), np.arange(40)] = np.inf
    for i in range(40):
        assert cost[i, got[i][0]] <= cost[i].min() + 1e-14 and abs(got[i][1] - cost[i].min()) < 1e-14
