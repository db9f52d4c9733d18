"""Clusters by density: mutual reachability, a minimum spanning tree by Boruvka rounds, a condensed tree.

The distance of two rows is the greatest of their distance and of both core distances (to the ``samples``-th
nearest row, itself included). At a threshold, rows within it are linked; a component is large if it has
``least`` rows or more. From a great threshold to small ones, large components lose rows or split
into several large ones; what lies between two splits is a cluster. Its stability is the sum, over its rows, of
the reciprocal distances that they stay in it for; the clusters that are returned are those, without the
whole, whose stability isn't exceeded by that of the clusters inside. Rows outside are noise (-1).

What is decided at a threshold doesn't depend on the order of equal distances, so rows and partitions can come
in any order. Large components are few (at most rows / least of them at once), so splits and stabilities
are a small table; everything of a row or an edge a row stays distributed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timbre.operators import neighbours
from timbre.session import checkpointed

#: Neighbours by which most edges of the tree are found; rows of a table of parents that is followed at once; edges of
#: a part of the tree that one task folds; distances under SMALLEST count as that.
GRAPH, DIRECT, FOLD, SMALLEST = 16, 50_000, 500_000, 1e-9


def _cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, without the estimate of its size: a checkpoint keeps its plan's, each join multiplies the
    estimates of both sides, and in loops of self-joins their digits double every round until planning takes minutes."""
    done = checkpointed(df)
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.javaRDD(), done._jdf.schema()), spark)


# ── components ──


def _rooted(parents: DataFrame, direct: int = DIRECT) -> DataFrame:
    """node, comp: the end of each node's chain of parents. Chains shrink by half a round; a table of at most
    ``direct`` rows is followed at once."""
    parents = _cut(parents)
    while True:
        if parents.limit(direct + 1).count() <= direct:
            up = {r.node: r.comp for r in parents.collect()}  # at most ``direct`` rows
            for n in up:
                while up[n] != up[up[n]]:
                    up[n] = up[up[n]]
            return parents.sparkSession.createDataFrame(list(up.items()), parents.schema)
        up = parents.select(F.col("node").alias("_up"), F.col("comp").alias("_root"))
        after = _cut(parents.join(up, F.col("comp") == F.col("_up")).select("node", "comp", F.col("_root").alias("then")))
        moved = after.where("comp <> then").limit(1).count()
        parents = after.select("node", F.col("then").alias("comp"))
        if not moved:
            return parents


def components(nodes: DataFrame, edges: DataFrame, direct: int = DIRECT) -> DataFrame:
    """node, comp: the least node of each node's component. ``nodes``: node; ``edges``: a, b."""
    labels = _cut(nodes.select("node", F.col("node").alias("comp")))
    left = edges.select("a", "b")
    while True:
        of = lambda end: labels.select(F.col("node").alias(end), F.col("comp").alias(f"_{end}"))
        left = _cut(left.join(of("a"), "a").join(of("b"), "b").where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
        if not left.limit(1).count():
            return labels
        hooks = left.groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("to"))
        roots = labels.select(F.col("comp").alias("node")).distinct().join(hooks, "node", "left").select("node", F.coalesce("to", "node").alias("comp"))
        labels = _cut(labels.withColumnRenamed("comp", "_c").join(_rooted(roots, direct).select(F.col("node").alias("_c"), "comp"), "_c").select("node", "comp"))


# ── the spanning tree ──


def spanning_tree(rows: DataFrame, key: str, vector: str, samples: int = 3, graph: int = GRAPH, pivots: int | None = None, direct: int = DIRECT) -> DataFrame:
    """a, b, w: a minimum spanning tree of the mutual reachability distances between rows of distinct keys.

    Equal vectors are one row of several copies: no edge at a copy is shorter than its core distance, which is that of
    its edge to the first. Each row's nearest neighbours are found once. In a round each component but the largest takes its least
    edge to another; the neighbours give it, unless a row's are all nearer than that: only such rows are searched for
    again, among rows of other components that are nearer than what is known. The largest waits for the others to come to it.
    """
    hashed = rows.select(key, F.col(vector).cast("array<double>").alias(vector)).where(F.col(vector).isNotNull()).withColumn("_h", F.xxhash64(vector))
    firsts = _cut(hashed.groupBy("_h", vector).agg(F.min(key).alias(key), F.count("*").alias("copies")))
    copies = firsts.where("copies > 1").select("_h", vector, F.col(key).alias("a"))
    copies = _cut(hashed.join(copies, ["_h", vector]).where(F.col(key) != F.col("a")).select("a", F.col(key).alias("b")))
    plain = firsts.select(key, vector)
    cells = neighbours.built(plain, key, vector, pivots=pivots)
    near = _cut(neighbours.nearest(plain, cells, max(graph, samples - 1), but_itself=True))
    # rows nearer than a neighbour: the row's own copies and those of neighbours before it; at most ``graph`` neighbours a key
    before = F.sum("_copies").over(Window.partitionBy(key).orderBy("cost", "match").rowsBetween(Window.unboundedPreceding, -1))
    counted = near.join(firsts.select(F.col(key).alias("match"), F.col("copies").alias("_copies")), "match").join(firsts.select(key, "copies"), key)
    counted = counted.withColumn("before", F.col("copies") + F.coalesce(before, F.lit(0)))
    told = counted.groupBy(key).agg(F.max(F.when(F.col("before") < samples, F.col("cost"))).alias("core"), F.max("cost").alias("reach"), F.count("*").alias("n"))
    points = _cut(plain.join(told, key, "left").select(F.col(key).alias("node"), F.coalesce("core", F.lit(0.0)).alias("core"), F.when(F.col("n") >= graph, F.col("reach")).otherwise(F.lit(float("inf"))).alias("reach")))
    core = lambda end: points.select(F.col("node").alias(end), F.col("core").alias(f"core_{end}"))
    pairs = near.select(F.least(key, "match").alias("a"), F.greatest(key, "match").alias("b"), "cost").distinct()
    known = _cut(pairs.join(core("a"), "a").join(core("b"), "b").select("a", "b", F.greatest("cost", "core_a", "core_b").alias("w")))
    tree = _cut(copies.join(points.select(F.col("node").alias("a"), F.col("core").alias("w")), "a").select("a", "b", "w"))
    labels = _cut(points.select("node", F.col("node").alias("comp")))
    cored = neighbours.Cells(_cut(cells.rows.join(points.select(F.col("node").alias(key), "core"), key).select(*cells.rows.columns, "core")), cells.pivots, cells.radius, cells.count, key, vector)
    while True:
        of = lambda end: labels.select(F.col("node").alias(end), F.col("comp").alias(f"_{end}"))  # noqa: E731, B023
        crossing = lambda e: e.join(of("a"), "a").join(of("b"), "b").where("_a <> _b").select("a", "b", "w", "_a", "_b")  # noqa: E731, B023
        known = _cut(crossing(known.select("a", "b", "w")))
        largest = labels.groupBy("comp").count().orderBy(F.desc("count"), "comp").limit(1).collect()
        if not largest:
            return tree
        others = F.col("comp") != F.lit(largest[0]["comp"])
        asked = points.join(labels, "node").join(_taken(known).select(F.col("_a").alias("comp"), F.col("best.w").alias("most")), "comp", "left")
        asked = _cut(asked.select("node", "comp", "core", F.coalesce("most", F.lit(float("inf"))).alias("most"), "reach").where(others & (F.greatest("core", "reach") < F.col("most"))))
        if asked.limit(1).count():
            placed = cored.rows.join(labels.withColumnRenamed("node", key), key).select(*cored.rows.columns, "comp")
            here = neighbours.Cells(placed, cells.pivots, cells.radius, cells.count, key, vector)
            queries = asked.withColumnRenamed("node", key).join(plain, key)
            found = neighbours.nearest(queries, here, 1, core="core", group="comp", most="most")
            more = found.select(F.least(key, "match").alias("a"), F.greatest(key, "match").alias("b"), F.col("cost").alias("w")).distinct()
            known = _cut(known.unionByName(crossing(more)).distinct())
        taken = _cut(_taken(known).where(F.col("_a") != F.lit(largest[0]["comp"])))
        if not taken.limit(1).count():
            return tree
        chosen = taken.select("best.a", "best.b", "best.w").distinct()
        tree = _cut(tree.unionByName(chosen))
        to = taken.select(F.col("_a").alias("node"), F.col("best.to").alias("comp"))
        back = to.select(F.col("node").alias("comp"), F.col("comp").alias("_back"))
        parents = to.join(back, "comp", "left").select("node", F.when((F.col("_back") == F.col("node")) & (F.col("node") < F.col("comp")), F.col("node")).otherwise(F.col("comp")).alias("comp"))
        every = labels.select(F.col("comp").alias("node")).distinct().join(parents, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
        labels = _cut(labels.withColumnRenamed("comp", "_c").join(_rooted(every, direct).select(F.col("node").alias("_c"), "comp"), "_c").select("node", "comp"))


def _taken(known: DataFrame) -> DataFrame:
    """For each component (_a) its least edge: best (w, a, b, to). One order of edges for all, so no cycle arises."""
    ways = known.unionByName(known.select("a", "b", "w", F.col("_b").alias("_a"), F.col("_a").alias("_b")))
    return ways.groupBy("_a").agg(F.min(F.struct("w", "a", "b", F.col("_b").alias("to"))).alias("best"))


# ── the condensed tree ──


def _folded(least: int):
    """Folds one part of the tree: edges by weight, equal ones at once. Rows out: a node that joined a large component
    (node, w, cluster), or an event: a component that became large (cluster, w), children that merged
    (cluster, w, child), the part's last large component (cluster, part)."""

    def fold(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        part = nodes["part"].iloc[0]
        names = nodes["node"].tolist()
        place = {n: i for i, n in enumerate(names)}
        up, size = list(range(len(names))), nodes["size"].tolist()
        large = {i: c for i, c in enumerate(nodes["cluster"]) if c is not None and c == c}
        small = {i: [i] for i in up if i not in large}

        def root(n):
            while up[n] != n:
                up[n] = up[up[n]]
                n = up[n]
            return n

        edges = edges.sort_values("w")
        weights, starts, ends_ = edges["w"].tolist(), edges["a"].map(place).tolist(), edges["b"].map(place).tolist()
        at = 0
        while at < len(weights):
            w, touched = weights[at], {}
            while at < len(weights) and weights[at] == w:
                a, b = root(starts[at]), root(ends_[at])
                at += 1
                if a == b:
                    continue
                if size[a] < size[b]:
                    a, b = b, a
                up[b] = a
                size[a] += size[b]
                one, two = touched.pop(a, [a]), touched.pop(b, [b])
                if len(one) < len(two):
                    one, two = two, one
                one.extend(two)
                touched[a] = one
            for top, ends in touched.items():
                bigs = sorted({large.pop(e) for e in ends if e in large})
                if size[top] < least and not bigs:
                    lists = sorted((small.pop(e) for e in ends), key=len)
                    for few in lists[:-1]:  # the longest takes in the others: no row moves more often than its component doubles
                        lists[-1].extend(few)
                    small[top] = lists[-1]
                    continue
                cluster = bigs[0] if len(bigs) == 1 else f"{part}/{w!r}/{min(str(names[e]) for e in ends)}"
                if len(bigs) != 1:
                    out.append(("born", None, w, cluster, None))
                    out += [("child", None, w, cluster, c) for c in bigs]
                large[top] = cluster
                out += [("row", names[n], w, cluster, None) for e in ends for n in small.pop(e, [])]
        out += [("last", None, None, c, str(part)) for c in large.values()]
        return pd.DataFrame(out, columns=["kind", "node", "w", "cluster", "child"])

    return fold


def condensed(points: DataFrame, tree: DataFrame, least: int, direct: int = FOLD) -> tuple[DataFrame, list]:
    """(node, w, cluster: the distance at which a row joins a large component, and which; events: kind, w, cluster, child).

    ``points``: node. A tree of more than ``direct`` edges is parted at the median weight: its light edges'
    components that are large are parts of their own, others become single nodes, as do the large ones for the
    heavy edges' part. Each edge goes to one part, so parts shrink by half a level, and parts of at most ``direct``
    edges are folded, each by a task.
    """
    kind = dict(points.dtypes)["node"]
    nodes = _cut(points.select(F.lit("t").alias("part"), "node", F.lit(1).cast("long").alias("size"), F.lit(None).cast("string").alias("cluster")))
    edges, maps, rows, events, level = _cut(tree.select(F.lit("t").alias("part"), "a", "b", "w")), [], [], [], 0
    while True:
        counts = edges.groupBy("part").agg(F.count("*").alias("n"), F.percentile_approx("w", 0.5).alias("mid"), F.max("w").alias("top"), F.min("w").alias("low"))
        wide = _cut(counts.where((F.col("n") > direct) & (F.col("low") < F.col("top"))))  # parts of many edges are few
        rest = [df.join(F.broadcast(wide.select("part")), "part", "left_anti") for df in (nodes, edges)]
        folded = rest[0].groupBy("part").cogroup(rest[1].groupBy("part")).applyInPandas(_folded(least), f"kind string, node {kind}, w double, cluster string, child string")
        folded = _cut(folded)
        rows.append(folded.where("kind = 'row'").select("node", "w", "cluster"))
        events += folded.where("kind <> 'row'").select("kind", "w", "cluster", "child").collect()  # large components: few
        if not wide.limit(1).count():
            break
        level += 1
        cut = F.broadcast(wide.select("part", "mid", "top"))
        light = (F.col("w") < F.col("mid")) | ((F.col("w") == F.col("mid")) & (F.col("mid") < F.col("top")))
        place = lambda end: F.struct("part", F.col(end).alias("node"))  # noqa: E731  (a component of several nodes has an id in two parts)
        split = _cut(edges.join(cut, "part").select("part", "a", "b", "w", light.alias("light"), place("a").alias("at"), place("b").alias("to")))
        mine = _cut(nodes.join(cut.select("part"), "part").withColumn("at", place("node")))
        found = _cut(components(mine.select(F.col("at").alias("node")), split.where("light").select(F.col("at").alias("a"), F.col("to").alias("b")), min(direct, DIRECT)))
        placed = _cut(mine.join(found.select(F.col("node").alias("at"), "comp"), "at"))
        sums = placed.groupBy("part", "comp").agg(F.sum("size").alias("size"), F.count("cluster").alias("bigs"), F.max("cluster").alias("one"), F.count("*").alias("n"))
        # a single large node stays what it is; a part of several is named, and tells its last large component later
        name = F.concat_ws(".", F.lit(f"l{level}"), "comp.part", F.col("comp.node").cast("string"))
        big = (F.col("size") >= least) | (F.col("bigs") > 0)
        sums = _cut(sums.withColumn("inner", F.when(big & (F.col("n") > 1), name)).withColumn("cluster", F.when(big, F.coalesce("inner", "one"))))
        inner = sums.where("inner is not null").select("comp", "inner")
        lower = placed.join(inner, "comp").select(F.col("inner").alias("part"), "node", "size", "cluster")
        upper = sums.select("part", F.col("comp.node").alias("node"), "size", "cluster")
        maps.append(placed.join(sums.where("cluster is null").select("comp"), "comp").select(F.col("comp.node").alias("of"), "node"))
        at = found.select(F.col("node").alias("at"), F.col("comp").alias("_a"))
        under = split.where("light").join(at, "at").join(inner.select(F.col("comp").alias("_a"), "inner"), "_a").select(F.col("inner").alias("part"), "a", "b", "w")
        ends = split.where("not light").join(at, "at").join(at.select(F.col("at").alias("to"), F.col("_a").alias("_b")), "to")
        over = ends.select("part", F.col("_a.node").alias("a"), F.col("_b.node").alias("b"), "w")
        nodes, edges = _cut(lower.unionByName(upper)), _cut(under.unionByName(over))
    return _spread(rows, maps), events


def _spread(rows: list[DataFrame], maps: list[DataFrame]) -> DataFrame:
    """What single nodes stand for gets what they got: the last level's first. ``rows[k]`` are those folded at level k."""
    done = rows[-1]
    for k in range(len(maps) - 1, -1, -1):
        inside = maps[k].select(F.col("of").alias("_of"), F.col("node").alias("_node"))
        given = done.join(inside, F.col("node") == F.col("_of"), "left").select(F.coalesce("_node", "node").alias("node"), "w", "cluster")
        done = _cut(given.unionByName(rows[k]))
    return done


def labels(points: DataFrame, tree: DataFrame, least: int, direct: int = FOLD) -> DataFrame:
    """node, label: clusters from 0, the largest first (ties: the one of the least node), and -1 for noise."""
    joined, events = condensed(points, tree, least, direct)
    names = {e.child: e.cluster for e in events if e.kind == "last"}

    def real(c: str) -> str:
        while c in names and names[c] != c:
            c = names[c]
        return c

    made = {real(e.cluster): max(e.w, SMALLEST) for e in events if e.kind == "born"}
    parent = {real(e.child): real(e.cluster) for e in events if e.kind == "child"}
    alias = joined.sparkSession.createDataFrame([(c, real(c)) for c in {e.cluster for e in events} | set(names)] or [("", "")], "_name string, real string")
    joined = _cut(joined.join(F.broadcast(alias), F.col("cluster") == F.col("_name"), "left").select("node", "w", F.coalesce("real", "cluster").alias("cluster")))
    sums = {r.cluster: (r.lam, r.n) for r in joined.groupBy("cluster").agg(F.sum(1 / F.greatest("w", F.lit(SMALLEST))).alias("lam"), F.count("*").alias("n")).collect()}
    chosen = _chosen(made, parent, sums)
    table = joined.sparkSession.createDataFrame([(c, x) for c, x in chosen.items()] or [("", "")], "_c string, top string")
    told = joined.join(F.broadcast(table), F.col("cluster") == F.col("_c"), "left").select("node", "top")
    sizes = told.where("top is not null").groupBy("top").agg(F.count("*").alias("n"), F.min("node").alias("first")).collect()
    order = [(r.top, i) for i, r in enumerate(sorted(sizes, key=lambda r: (-r.n, r.first)))]
    ranks = joined.sparkSession.createDataFrame(order or [("", 0)], "top string, label int")
    clustered = told.join(F.broadcast(ranks), "top", "left").select("node", F.coalesce("label", F.lit(-1)).alias("label"))
    return points.select("node").join(clustered, "node", "left").select("node", F.coalesce("label", F.lit(-1)).alias("label"))


def _chosen(made: dict[str, float], parent: dict[str, str], sums: dict[str, tuple[float, int]]) -> dict[str, str]:
    """cluster: the chosen cluster that it is or lies in. ``made``: the distance at which each became large or its children
    merged; ``sums``: of each, reciprocal distances and number of the rows that joined it."""
    children: dict[str, list[str]] = {c: [] for c in made}
    for c, p in parent.items():
        children[p].append(c)
    order = sorted(made, key=made.get)  # children merge before what they merge into does
    size, stability, best, kept = {}, {}, {}, {}
    for c in order:
        lam, n = sums.get(c, (0.0, 0))
        inside = sum(size[x] for x in children[c])
        size[c] = n + inside
        born = 1 / made[parent[c]] if c in parent else 0.0
        stability[c] = lam - n * born + inside * (1 / made[c] - born)
        below = sum(best[x] for x in children[c])
        kept[c] = c in parent and not (children[c] and stability[c] < below)
        best[c] = stability[c] if kept[c] else below
    out: dict[str, str] = {}
    for c in reversed(order):
        if c in parent and parent[c] in out:
            out[c] = out[parent[c]]
        elif kept[c]:
            out[c] = c
    return out


def clusters(rows: DataFrame, key: str, vector: str, least: int, samples: int = 3, graph: int = GRAPH, direct: int = DIRECT, pivots: int | None = None, fold: int = FOLD) -> DataFrame:
    """key, label of all rows with a vector; keys are distinct. Fewer than ``least`` rows are all noise."""
    tree = spanning_tree(rows, key, vector, samples, graph, pivots, direct)
    points = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("node"))
    return labels(_cut(points), tree, least, fold).select(F.col("node").alias(key), "label")

