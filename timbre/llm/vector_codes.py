"""Vector code compression: codes of parts against codebooks, found by a ball tree over the entries.

Vectors become whole numbers and are cut into equal consecutive parts. Each part position has a codebook of
256 entries, refined in rounds: every part is assigned to its nearest entry, then each entry becomes the
floor of the mean of its parts. A round is one pass over the vectors where they lie: a task sends, for each
entry, the count and the sum of its parts (at most 1,024 rows of some numbers a task, added up by key), and
the driver gets one row an entry. Broadcast are the codebooks: 256 entries of one vector's length.

The nearest entry is found by branch and bound over a ball tree of each position's entries. All numbers
that decide are whole: a ball's centre is one of its entries, its radius is rounded up and a distance to a
centre down, so the bound of the triangle inequality never exceeds the true distance; balls whose bound
equals the best distance are visited too, as ties go to the lower index; and what a leaf offers is
compared by exact squared distances.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbre.llm.common import bounded, checkpointed, only, schema

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a leaf; vectors that are compared at once.
LEAF, BLOCK = 16, 4096
#: Whole numbers up to this are exact as doubles; squared distances that stay below are computed by them.
EXACT = 1 << 52
#: Sums travel as digits of so many bits, so that no number of vectors overflows a long.
DIGIT = 24
#: Errors beyond the greatest long are given as that.
MOST = (1 << 63) - 1
#: Rows of a table of labels that is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


class BallTree:
    """A tree of balls around entries: nodes in preorder, leaves of at most LEAF entries."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.most = int(np.abs(entries).max(initial=0))
        #: (entry that is the centre, radius rounded up, node behind the subtree, entries of a leaf or None)
        self.nodes: list[tuple[int, int, int, np.ndarray | None]] = []
        self._build(np.arange(len(entries)))

    def _build(self, some: np.ndarray) -> None:
        exact = self.entries[some].astype(object) if _wide(self.most, self.entries.shape[1]) else self.entries[some]
        middle = exact.sum(axis=0) // len(some)
        centre = int(np.argmin(((exact - middle) ** 2).sum(axis=1)))
        far = ((exact - exact[centre]) ** 2).sum(axis=1)
        at = len(self.nodes)
        self.nodes.append(())
        radius = math.isqrt(int(far.max())) + 1
        if len(some) <= LEAF or not far.max():
            self.nodes[at] = int(some[centre]), radius, at + 1, some
            return
        pole = int(np.argmax(far))
        order = np.argsort(((exact - exact[pole]) ** 2).sum(axis=1) - far, kind="stable")
        for half in (order[: len(some) // 2], order[len(some) // 2 :]):
            self._build(np.sort(some[half]))
        self.nodes[at] = int(some[centre]), radius, len(self.nodes), None

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row: the nearest entry's index (ties: the lower) and the squared distance, exact."""
        n, top = len(points), max(self.most, int(np.abs(points).max(initial=0)))
        distances = _distances(self.entries, top, points)
        best = np.full(n, -1 if distances.kind is not object else None, distances.kind)
        index = np.full(n, len(self.entries), np.int64)
        self._seed(distances, np.arange(n), best, index)
        self._visit(distances, np.arange(n), best, index)
        return index, best

    def _visit(self, distances: _distances, some: np.ndarray, best: np.ndarray, index: np.ndarray, at: int = 0) -> None:
        """Offers the entries of a subtree to the points whose bound doesn't rule its ball out."""
        centre, radius, _, leaf = self.nodes[at]
        bound = distances.roots(some, centre) - radius
        some = some[(bound <= 0) | (bound * bound <= best[some])]  # non-strict: an equal distance may have a lower index
        if len(some) and leaf is not None:
            self._offer(distances, some, leaf, best, index)
        elif len(some):
            self._visit(distances, some, best, index, at + 1)
            self._visit(distances, some, best, index, self.nodes[at + 1][2])

    def _seed(self, distances: _distances, some: np.ndarray, best: np.ndarray, index: np.ndarray, at: int = 0) -> None:
        """A first best for each point: from the leaf that it reaches by the nearer centre."""
        centre, _, _, leaf = self.nodes[at]
        if leaf is not None:
            best[some], index[some] = distances.squares(some, leaf[:1])[:, 0], leaf[0]
            self._offer(distances, some, leaf, best, index)
            return
        left, right = at + 1, self.nodes[at + 1][2]
        nearer = distances.squares(some, np.array([self.nodes[left][0]]))[:, 0] <= distances.squares(some, np.array([self.nodes[right][0]]))[:, 0]
        for node, mine in ((left, some[nearer]), (right, some[~nearer])):
            if len(mine):
                self._seed(distances, mine, best, index, node)

    @staticmethod
    def _offer(distances: _distances, some: np.ndarray, leaf: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        """Takes a leaf's nearest entry where it is nearer, or as near and of a lower index."""
        found = distances.squares(some, leaf)  # a leaf's entries are in order, so argmin is the lowest index
        k = found.argmin(axis=1)
        square, entry = found[np.arange(len(some)), k], leaf[k]
        better = (square < best[some]) | ((square == best[some]) & (entry < index[some]))
        best[some[better]], index[some[better]] = square[better], entry[better]


def _wide(top: int, width: int) -> bool:
    """Whether squared distances of such numbers may not fit into a long."""
    return 4 * top * top * max(width, 1) >= 1 << 62


class _distances:
    """Exact squared distances between points and entries: as doubles while all numbers are exact ones, else as
    longs, else as Python's whole numbers."""

    def __init__(self, entries: np.ndarray, top: int, points: np.ndarray) -> None:
        width = entries.shape[1]
        self.kind = object if _wide(top, width) else np.int64
        self.quick = 4 * top * top * max(width, 1) < EXACT
        kind = np.float64 if self.quick else self.kind
        self.entries, self.points = entries.astype(kind), points.astype(kind)
        if self.quick:
            self.entry_squares, self.point_squares = (self.entries**2).sum(axis=1), (self.points**2).sum(axis=1)

    def squares(self, some: np.ndarray, entries: np.ndarray) -> np.ndarray:
        if self.quick:
            cross = self.points[some] @ self.entries[entries].T
            return (self.point_squares[some, None] - 2 * cross + self.entry_squares[entries]).astype(np.int64)
        out = np.empty((len(some), len(entries)), self.kind)
        for k, e in enumerate(entries):
            out[:, k] = ((self.points[some] - self.entries[e]) ** 2).sum(axis=1)
        return out

    def roots(self, some: np.ndarray, entry: int) -> np.ndarray:
        """Distances rounded down; never above the true ones."""
        squares = self.squares(some, np.array([entry]))[:, 0]
        if self.kind is object:
            return np.array([math.isqrt(x) for x in squares], object)
        roots = np.sqrt(squares.astype(np.float64)).astype(np.int64)
        return np.maximum(roots - (1 if self.quick else 2), 0)


# ── passes over the vectors ──


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """key, label, x (array of doubles) of the vectors whose components are all there and finite."""
    rows = only(vectors, key=key, label=label, vector=vector)
    x = F.col("vector").cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False)))
    return rows.select("key", "label", x.alias("x")).where(F.col("x").isNotNull() & finite)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE x) of a column of arrays of doubles, as longs, or as Python's whole numbers where those don't fit."""
    scaled = np.floor(np.asarray(column.flatten(), np.float64) * SCALE).reshape(len(column), width)
    if np.abs(scaled).max(initial=0) < 1 << 48:  # a block's sums fit into longs
        return scaled.astype(np.int64)
    return np.array([[int(v) for v in row] for row in scaled], object).reshape(len(column), width)


def _digits(total: int, n: int) -> list[int]:
    """``total`` as n digits of DIGIT bits, least first; the last one has the sign."""
    return [total >> DIGIT * k if k == n - 1 else total >> DIGIT * k & (1 << DIGIT) - 1 for k in range(n)]


def start(rows: DataFrame, width: int, entries: int = ENTRIES) -> np.ndarray:
    """The first codebooks: (part, entry, component), from the vectors of the least keys."""
    firsts = rows.where("key is not null").orderBy("key", "x").limit(entries).collect()  # at most ``entries`` rows
    matrix = _matrix(pa.array([r.x for r in firsts], pa.list_(pa.float64())), width) if firsts else np.zeros((0, width), np.int64)
    return _parts(matrix).copy()


def _parts(matrix: np.ndarray) -> np.ndarray:
    """(part, row, component)"""
    n, width = matrix.shape
    return matrix.reshape(n, PARTS, width // PARTS).transpose(1, 0, 2)


def refined(rows: DataFrame, books: np.ndarray, digits: int) -> np.ndarray:
    """The codebooks after a round: floors of means of each entry's parts; unused entries stay."""
    width = books.shape[0] * books.shape[2]
    shared = rows.sparkSession.sparkContext.broadcast(books)  # ENTRIES rows of one vector's length

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        trees, totals, counts = [BallTree(b) for b in books], books.astype(object) * 0, np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                for p, part in enumerate(_parts(_matrix(batch.column(0).slice(at, BLOCK), width))):
                    index, _ = trees[p].nearest(part)
                    counts[p] += np.bincount(index, minlength=len(counts[p]))
                    used, where = np.unique(index, return_inverse=True)
                    some = np.zeros((len(used), part.shape[1]), part.dtype)
                    np.add.at(some, where, part)
                    totals[p][used] += some.astype(object)
        p, e = np.nonzero(counts)
        listed = [[d for v in totals[a, b] for d in _digits(int(v), digits)] for a, b in zip(p, e, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.array(listed, pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    by_task = bounded(rows.select("x")).mapInArrow(sums, "part int, entry int, n long, sums array<long>")
    size = books.shape[2] * digits
    added = by_task.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(size)))
    after = books.copy()
    for r in added.collect():  # at most PARTS x ENTRIES rows
        values = [sum(r[f"s{c * digits + k}"] << DIGIT * k for k in range(digits)) // r.n for c in range(books.shape[2])]
        after[r.part, r.entry] = values
    return after


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """key, label, code, error."""
    width = books.shape[0] * books.shape[2]
    shared = rows.sparkSession.sparkContext.broadcast(books)
    out = schema(rows, ["key", "label"], "code string, error long")

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [BallTree(b) for b in shared.value]
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                some = batch.slice(at, BLOCK)
                found = [t.nearest(part) for t, part in zip(trees, _parts(_matrix(some.column(2), width)), strict=True)]
                code = ["".join(f"{i:02x}" for i in row) for row in np.stack([i for i, _ in found], axis=1).tolist()]
                error = [min(sum(row), MOST) for row in zip(*(e.tolist() for _, e in found), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=out.names)

    return bounded(rows.select("key", "label", "x")).mapInArrow(codes, out)


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(key, label, ``code``, ``error``, ``label_error`` a vector; the final codebooks, part by entry by component).

    Vectors that are null or hold null or non-finite components go, and so do those of another length than the
    vector of the least key, which must be a multiple of :data:`PARTS`. A vector without a key is encoded but
    starts no entry; of vectors of one key the lesser comes first. Fewer than 256 vectors start fewer entries,
    and without any key there is no entry and no row. A null label is a label. Repeated rows are encoded each;
    other columns, texts among them, play no part; an empty table gives an empty result and empty codebooks.
    Components of any finite size are exact; errors beyond the greatest long are given as that.
    """
    rows = checkpointed(usable(vectors, key, vector, label))
    first = rows.orderBy(F.col("key").asc_nulls_last(), "x").select(F.size("x").alias("n")).first()
    width = first.n if first else 0
    if width % PARTS:
        raise ValueError(f"vectors of {width} components can't be cut into {PARTS} equal parts")
    rows = rows.where(F.size("x") == width)
    names = [F.col("key").alias(key), F.col("label").alias(label), "code", "error"]
    n, top = rows.agg(F.count("key"), F.max(F.aggregate("x", F.lit(0.0), lambda m, v: F.greatest(m, F.abs(v))))).first()
    books = start(rows, width)
    if not n:
        none = rows.select("key", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where("false")
        return none.select(*names, F.lit(0).cast("long").alias("label_error")), books
    digits = (int(top * SCALE) + 1).bit_length() // DIGIT + 1
    for _ in range(rounds):
        books = refined(rows, books, digits)
    done = checkpointed(encoded(rows, books))
    errors = checkpointed(done.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error")))
    errors = F.broadcast(errors) if errors.count() <= BROADCAST_ROWS else errors
    return done.join(errors, F.col("label").eqNullSafe(F.col("of"))).select(*names, "label_error"), books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in books.reshape(-1)).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """The query's rows."""
    codes, books = compress(vectors)
    return codes.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """Assignments to the codebook of round k, and the codebook after it."""
    return f"""a{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (SELECT p.vec_id, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{k} b USING (part)) GROUP BY vec_id, part),
m{k} AS MATERIALIZED (SELECT part, entry, list(m ORDER BY c) AS v FROM (SELECT part, entry, c, (s - ((s % n) + n) % n) // n AS m FROM (SELECT a.part, a.entry, c, sum(p.v[c])::BIGINT AS s, count(*) AS n FROM a{k} a JOIN p USING (vec_id, part), range(1, 17) r(c) GROUP BY ALL)) GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (part, entry))"""


#: All pairs of parts and entries, round by round; for vectors of 64 components, as the table has.
ORACLE = f"""
WITH w AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS MATERIALIZED (SELECT vec_id, part, v[part * 16 + 1:part * 16 + 16] AS v FROM w, range(0, 4) r(part)),
b0 AS MATERIALIZED (SELECT part, entry, v FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM w) USING (vec_id) WHERE entry < 256),
{", ".join(_round_sql(k) for k in range(ROUNDS + 1))},
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT e.vec_id, e.code, e.error, sum(e.error) OVER (PARTITION BY w.label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b{ROUNDS}) AS codebooks_sha256 FROM e JOIN w USING (vec_id)
"""
