"""Exact nearest neighbours: cells around pivots, bounds that skip cells, tiles of bounded size.

Pivots are a bounded sample of the rows; each row lies in the cell of its nearest pivot. For a query, a cell's
pivot and radius bound what its rows can offer: the distance is at least the distance to the pivot less the
radius, the product at most the pivot's product plus the radius times the query's length. A query
meets the cell of the best bound first; with what that offers, all cells that can't offer more are skipped,
and the others are met. Any choice of pivots gives the same result.

Cells that lie by each other form groups, and a query goes once to each group that has a cell for it: where no cell can be
skipped, a query is copied as often as there are groups (about :data:`GROUPS`, until a group is as large as a tile may be),
not as there are cells. Queries and rows of a group meet in tiles: rows are dealt into parts by key and copied for
each part of the queries, and the other way round, so a group or a set of queries of any size is spread over tasks and no
task holds more than a tile. Vectors travel packed, those of few numbers other than zero as these alone. A tile is gone
through in blocks of products in single precision; what its rounding can't rule out against the best known so far is
compared in double precision. Nothing but pivots, radii and counts of cells reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbre.session import checkpointed

#: Most pivots (each as long as a vector; they are broadcast), least rows of a tile's side, queries compared at once.
PIVOTS, TILE, SLICE = 4096, 4096, 256
#: Groups of cells that are aimed at, most bytes of the vectors of a tile's side, products held at once, rows in a block of them.
GROUPS, TILE_BYTES, HELD, BLOCK = 8, 64 << 20, 1 << 20, 2048
#: A packed vector's number and its place.
ENTRY = np.dtype([("i", "<u2"), ("v", "<f8")])
#: Bounds are loosened by this share of the numbers they are made of, which is far above what rounding takes.
SLACK = 1e-9
PRODUCT, DISTANCE = "product", "distance"


@dataclass
class Cells:
    """Rows by cell (cell, key, vector and what else was kept), pivots, and each cell's radius, rows and extras."""

    rows: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    key: str
    vector: str

    @property
    def tile(self) -> int:
        """Rows of a tile's side: an eighth of all, within what a task holds."""
        most = TILE_BYTES // (8 * max(1, self.pivots.shape[1] if len(self.pivots) else 1))
        return max(1, min(most, max(TILE, -(-int(self.count.sum()) // GROUPS))))

    @property
    def group(self) -> np.ndarray:
        """The group of each cell: neighbours in the pivots' order, at most a tile's rows or a single cell."""
        out, at, size, tile = np.zeros(len(self.count), np.int32), 0, 0, self.tile
        for i, n in enumerate(self.count.tolist()):
            if size and size + n > tile:
                at, size = at + 1, 0
            out[i], size = at, size + n
        return out


def _packed(x: np.ndarray) -> list[bytes]:
    """A row's bytes: its numbers, or its entries other than zero where that is shorter."""
    size = (x != 0).sum(axis=1)
    sparse = size * ENTRY.itemsize < x.shape[1] * 8 if x.shape[1] <= 1 << 16 else np.zeros(len(x), bool)
    a, b = np.nonzero((x != 0) & sparse[:, None])
    entries = np.empty(len(a), ENTRY)
    entries["i"], entries["v"] = b, x[a, b]
    told, ends = entries.tobytes(), np.cumsum(size * sparse) * ENTRY.itemsize
    return [told[end - n * ENTRY.itemsize : end] if few else row.tobytes() for row, few, n, end in zip(x, sparse.tolist(), size.tolist(), ends.tolist(), strict=True)]


def _unpacked(column: pd.Series, dim: int) -> np.ndarray:
    rows = list(column)
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    x, full = np.zeros((len(rows), dim)), size == 8 * dim
    if full.any() and dim:
        x[full] = np.frombuffer(b"".join(r for r, f in zip(rows, full, strict=True) if f), "<f8").reshape(-1, dim)
    if not full.all():
        entries = np.frombuffer(b"".join(r for r, f in zip(rows, full, strict=True) if not f), ENTRY)
        x[np.repeat(np.flatnonzero(~full), size[~full] // ENTRY.itemsize), entries["i"]] = entries["v"]
    return x


def _hits(near: np.ndarray) -> np.ndarray:
    """The flat places of what is true, which is rare: eight at a time."""
    flat = near.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    return (words[:, None] * 8 + np.arange(8))[flat.reshape(-1, 8)[words]]


def built(rows: DataFrame, key: str, vector: str, keep: tuple[str, ...] = (), pivots: int | None = None) -> Cells:
    """The cells of ``rows``: their keys, vectors (arrays of doubles without nulls) and the columns to keep.
    Rows without a vector play no part."""
    rows = rows.select(key, F.col(vector).cast("array<double>").alias(vector), *keep).where(F.col(vector).isNotNull())
    if pivots is None:
        pivots = min(PIVOTS, int(rows.count() ** 0.5) + 1)
    drawn = rows.select(F.xxhash64(F.col(key).cast("string")).alias("h"), vector).orderBy("h", vector).limit(pivots).collect()  # at most PIVOTS rows
    centres = np.unique(np.array([r[1] for r in drawn], np.float64), axis=0) if drawn else np.zeros((0, 0))
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    out = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType()), *_packing(rows, vector)])

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf[vector].to_numpy())
                cell = np.concatenate([_squares(x[i : i + SLICE], shared.value).argmin(axis=1) for i in range(0, len(x), SLICE)])
                pdf.insert(0, "away", np.sqrt(((x - shared.value[cell]) ** 2).sum(axis=1)))
                pdf.insert(0, "cell", cell.astype(np.int32))
                pdf[vector] = _packed(x)
                yield pdf

    placed = checkpointed(rows.mapInPandas(assign, out))
    radius, count = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in placed.groupBy("cell").agg(F.max("away"), F.count("*")).collect():  # a row a pivot
        radius[r[0]], count[r[0]] = r[1], r[2]
    return Cells(placed.drop("away"), centres, radius, count, key, vector)


def _packing(rows: DataFrame, vector: str) -> list[T.StructField]:
    return [T.StructField(vector, T.BinaryType()) if f.name == vector else f for f in rows.schema.fields]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b**2).sum(axis=1), 0)


def _floor(cells: Cells, metric: str):
    """For vectors: the least cost that each cell can offer (cost: distance, or the product's negative)."""
    pivots, radius, empty = cells.pivots, cells.radius, cells.count == 0

    def bound(x: np.ndarray) -> np.ndarray:
        if metric == PRODUCT:
            length = np.sqrt((x**2).sum(axis=1))[:, None]
            size = length * (np.sqrt((pivots**2).sum(axis=1)) + radius)
            out = -(x @ pivots.T) - length * radius - SLACK * size
        else:
            away = np.sqrt(_squares(x, pivots))
            size = np.sqrt((x**2).sum(axis=1))[:, None] + np.sqrt((pivots**2).sum(axis=1)) + radius
            out = np.maximum(away - radius - np.sqrt(SLACK) * size, 0)  # a root magnifies rounding near zero
        out[:, empty] = np.inf
        return out

    return bound


def nearest(queries: DataFrame, cells: Cells, k: int = 1, metric: str = DISTANCE, but_itself: bool = False, core: str | None = None, group: str | None = None, most: str | None = None) -> DataFrame:
    """key, match, cost: for each query the k rows of least cost, ties by the lesser match.

    ``queries`` has the cells' key and vector. ``but_itself``: a row of the query's own key is passed over.
    ``core``: a column of both sides; the cost is at least either side's. ``group``: a column of both sides;
    rows of the query's own group are passed over. ``most``: a column of the queries; only rows of at most that
    cost are looked for. Queries without a vector, and those for which there is no row, have none.
    """
    key, vector = cells.key, cells.vector
    extra = [c for c in (core, group) if c]
    queries = queries.select(key, F.col(vector).cast("array<double>").alias(vector), *extra, (F.col(most).cast("double") if most else F.lit(float("inf"))).alias("_most")).where(F.col(vector).isNotNull())
    if not len(cells.pivots):
        none = queries.select(key, F.col(key).alias("match"), F.lit(0.0).alias("cost"))
        return none.where("false")
    bound, group_of, dim = _floor(cells, metric), cells.group, cells.pivots.shape[1]

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf[vector].to_numpy())
                if x.shape[1] != dim:
                    raise ValueError(f"vectors of {x.shape[1]} and of {dim} numbers")
                pdf[vector] = _packed(x)
                yield pdf

    queries = checkpointed(queries.mapInPandas(pack, T.StructType(_packing(queries, vector))))
    asking = T.StructType([*queries.schema.fields, T.StructField("_groups", T.ArrayType(T.IntegerType()))])
    cores = core and _least_core(cells, core)

    def floors(pdf: pd.DataFrame) -> np.ndarray:
        floor = bound(_unpacked(pdf[vector], dim))
        if core:
            floor = np.maximum(floor, np.maximum(pdf[core].to_numpy()[:, None], cores))
        return np.where(floor <= pdf["_most"].to_numpy()[:, None], floor, np.inf)

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), SLICE):
                some = pdf.iloc[i : i + SLICE].copy()
                floor = floors(some)
                cell = floor.argmin(axis=1)
                some["_groups"] = [[g] for g in group_of[cell].tolist()]
                yield some[floor[np.arange(len(some)), cell] < np.inf]

    def others(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), SLICE):
                some = pdf.iloc[i : i + SLICE].copy()
                floor = floors(some)
                met, known = group_of[floor.argmin(axis=1)], some.pop("_known").to_numpy()
                still = (floor <= known[:, None]) & (floor < np.inf) & (group_of != met[:, None])
                some["_most"] = np.minimum(some["_most"], known)
                some["_groups"] = [np.unique(group_of[row]).tolist() for row in still]
                yield some[still.any(axis=1)]

    met = checkpointed(_met(queries.mapInPandas(first, asking), cells, k, metric, but_itself, core, group))
    known = met.groupBy(F.col(key).alias("_key")).agg(F.max("cost").alias("_kth"), F.count("*").alias("_n"))
    worst = F.when(F.col("_n") >= k, F.col("_kth")).otherwise(float("inf"))
    again = queries.join(known, F.col(key) == F.col("_key"), "left").select(*queries.columns, F.coalesce(worst, F.lit(float("inf"))).alias("_known"))
    more = _met(again.mapInPandas(others, asking), cells, k, metric, but_itself, core, group)
    return _least(met.unionByName(more), key, k)


def _least_core(cells: Cells, core: str) -> np.ndarray:
    """The least core of each cell's rows."""
    least = np.full(len(cells.pivots), np.inf)
    for r in cells.rows.groupBy("cell").agg(F.min(core)).collect():  # a row a pivot
        least[r[0]] = r[1]
    return least


def _least(found: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows of least cost a key; each tile has sent at most k."""
    if k == 1:
        best = found.groupBy(key).agg(F.min(F.struct("cost", "match")).alias("b"))
        return best.select(key, "b.match", "b.cost")
    best = found.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("cost", "match"))), 1, k).alias("b"))
    return best.select(key, F.explode("b").alias("b")).select(key, "b.match", "b.cost")


def _met(asked: DataFrame, cells: Cells, k: int, metric: str, but_itself: bool, core: str | None, group: str | None) -> DataFrame:
    """key, match, cost of the queries asked of a cell, tile by tile."""
    key, vector, tile = cells.key, cells.vector, cells.tile
    asked = checkpointed(asked)  # a row a query
    told = asked.sparkSession.createDataFrame(list(enumerate(cells.group.tolist())), "cell int, grp int")
    counts = asked.select(F.explode("_groups").alias("_grp")).groupBy("_grp").agg(F.ceil(F.count("*") / tile).cast("int").alias("_turns"))
    held = np.bincount(cells.group, cells.count, cells.group.max() + 1)
    sizes = asked.sparkSession.createDataFrame([(i, max(1, -(-int(n) // tile))) for i, n in enumerate(held) if n], "_grp int, _deals int")
    tiles = F.broadcast(checkpointed(counts.join(sizes, "_grp")))  # a row a group
    part = lambda n: F.pmod(F.xxhash64(F.lit(11), F.col(key).cast("string")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sent = asked.withColumn("grp", F.explode("_groups")).drop("_groups")
    sides = []
    for df, own, other in ((sent, "_turns", "_deals"), (cells.rows.join(F.broadcast(told), "cell").drop("cell"), "_deals", "_turns")):
        placed = df.join(tiles, F.col("grp") == F.col("_grp"))
        placed = placed.withColumns({f"p{own}": part(own), f"p{other}": every(other)}).drop("_grp", "_turns", "_deals")
        sides.append(placed.groupBy("grp", "p_turns", "p_deals"))
    of = asked.schema[key]
    out = T.StructType([of, T.StructField("match", cells.rows.schema[key].dataType), T.StructField("cost", T.DoubleType())])

    dim = cells.pivots.shape[1]

    def compare(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame({key: [], "match": [], "cost": []})
        rows = rows.sort_values(key)
        x, keys, found = _unpacked(rows.pop(vector), dim), rows[key].to_numpy(), []
        squares = (x**2).sum(axis=1)
        longest = np.sqrt(squares.max())
        # products with this are squares of distances, without the query's own, or negative products
        sides = {np.float64: x if metric == PRODUCT else np.column_stack([x, squares])}
        if longest < 1e15:
            sides[np.float32] = sides[np.float64].astype(np.float32)
        cores, groups = core and rows[core].to_numpy(), group and rows[group].to_numpy()
        for i in range(0, len(asked), HELD // BLOCK):
            some = asked.iloc[i : i + HELD // BLOCK]
            q, own, limit = _unpacked(some[vector], dim), some[key].to_numpy(), some["_most"].to_numpy().astype(np.float64)
            length = np.sqrt((q**2).sum(axis=1))
            kind = np.float32 if np.float32 in sides and length.max() < 1e15 else np.float64
            share = (dim + 8) * 2.0 ** (-23 if kind == np.float32 else -52)  # of the sizes: its rounding, from above
            loose = share * (length * longest if metric == PRODUCT else (length + longest) ** 2)
            left = (-q if metric == PRODUCT else np.column_stack([-2 * q, np.ones(len(q))])).astype(kind)
            if but_itself:
                low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
                same = np.repeat(np.arange(len(q)), high - low)
                at = np.arange(len(same)) - np.repeat(np.cumsum(high - low) - high, high - low)

            def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                """Costs in double precision, the same for equal vectors whatever the tile."""
                cost, step = np.empty(len(a)), max(1, HELD // max(1, dim))  # noqa: B023
                for s in range(0, len(a), step):
                    u, v = q[a[s : s + step]], x[b[s : s + step]]  # noqa: B023
                    cost[s : s + step] = -(u * v).sum(axis=1) if metric == PRODUCT else np.sqrt(((u - v) ** 2).sum(axis=1))
                return np.maximum(cost, np.maximum(some[core].to_numpy()[a], cores[b])) if core else cost  # noqa: B023

            best, waiting, due = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)], [], 1
            for number, s in enumerate(range(0, len(x), BLOCK)):
                cost = left @ sides[kind][s : s + BLOCK].T
                if group:
                    cost[some[group].to_numpy()[:, None] == groups[s : s + BLOCK]] = np.inf
                if but_itself:
                    here = (at >= s) & (at < s + BLOCK)
                    cost[same[here], at[here] - s] = np.inf
                if number == 0 and cost.shape[1] >= k and np.isinf(limit).any():  # any k rows bound the cost of the k-th
                    some_k = cost.argmin(axis=1)[:, None] if k == 1 else np.argpartition(cost, k - 1, axis=1)[:, :k]
                    there = np.isfinite(np.take_along_axis(cost, some_k, axis=1)).all(axis=1)
                    a = np.flatnonzero(there)
                    limit[a] = np.minimum(limit[a], exact(np.repeat(a, k), some_k[a].ravel()).reshape(-1, k).max(axis=1))
                far = (limit if metric == PRODUCT else limit**2 - length**2) + 2 * loose
                near = cost <= (np.nextafter(far.astype(np.float32), np.float32(np.inf)) if kind == np.float32 else far)[:, None]
                a, b = np.divmod(_hits(near), cost.shape[1])
                there = np.isfinite(cost[a, b])
                a, b = a[there], b[there] + s
                true = exact(a, b)
                told = true <= limit[a]
                waiting.append((a[told], b[told], true[told]))
                if number + 1 < due and sum(len(w[0]) for w in waiting) < HELD and s + BLOCK < len(x):
                    continue
                due = 2 * (number + 1)
                a, b, true = (np.concatenate(c) for c in zip(best, *waiting, strict=True))
                order = np.lexsort((b, true, a))
                a, b, true = a[order], b[order], true[order]
                rank, waiting = np.arange(len(a)) - np.searchsorted(a, a), []
                limit[a[rank == k - 1]] = np.minimum(limit[a[rank == k - 1]], true[rank == k - 1])
                best = [c[rank < k] for c in (a, b, true)]
            found.append(pd.DataFrame({key: own[best[0]], "match": keys[best[1]], "cost": best[2]}))
        return pd.concat(found)

    return sides[0].cogroup(sides[1]).applyInPandas(compare, out)


def skipped_share(queries: DataFrame, cells: Cells, metric: str = DISTANCE) -> float:
    """The share of pairs of a query and a row that bounds leave out once each query knows its best."""
    best = nearest(queries, cells, 1, metric).select(F.col(cells.key).alias("_key"), "cost")
    rows, bound, vector, count = queries.join(best, F.col(cells.key) == F.col("_key")), _floor(cells, metric), cells.vector, cells.count

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                met = bound(np.stack(pdf[vector].to_numpy())) <= pdf["cost"].to_numpy()[:, None]
                yield pd.DataFrame({"met": [float((met * count).sum())], "n": [float(len(pdf) * count.sum())]})

    some = rows.select(F.col(vector).cast("array<double>").alias(vector), "cost").mapInPandas(compared, "met double, n double")
    met, n = some.agg(F.sum("met"), F.sum("n")).first()
    return 1 - met / n if n else 0.0
