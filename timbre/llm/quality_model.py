"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are ratios of the counts of :mod:`timbre.llm.statistics`. Trees are grown level by
level over binned features on the driver, from a bounded sample of labelled rows, and flattened into
arrays of complete binary trees; scoring walks all rows of a batch down all trees at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbre.llm.common import bounded, checkpointed, only, schema, slices
from timbre.llm.statistics import counts

#: Most labelled rows that a classifier is fitted on, taken evenly by a hash.
MAX_LABELLED = 20_000
THRESHOLD = 0.3
FOLDS = 5
FEATURES = [
    "log_words", "log_lines", "word_length", "longest_word", "distinct", "echo", "short", "repeats", "dup_lines", "symbols", "exclaim", "upper", "digits", "stops", "brackets", "other", "words_a_line",
]


def features(texts: list[bytes]) -> np.ndarray:
    """float32 matrix: a row for each text, a column for each of :data:`FEATURES`."""
    c = {k: v.astype(np.float64) for k, v in counts(texts).items()}
    words, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1)
    chars = np.maximum(c["word_chars"], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]), np.log1p(c["n_lines"]), c["word_chars"] / words, np.log1p(c["longest_word"]), c["n_distinct"] / words, c["n_echo"] / words, c["n_short"] / words,
            c["n_repeat_words"] / words, c["n_dup_lines"] / lines, c["n_symbols"] / words, c["n_exclaim"] / words, c["n_upper"] / np.maximum(c["n_letters"], 1), c["n_digits"] / chars,
            c["n_stops"] / words, c["n_brackets"] / words, c["n_other"] / words, np.log1p(words / lines),
        ],
        axis=1,
    ).astype(np.float32)


@dataclass
class Forest:
    """Complete binary trees: node i of a tree goes to 2i+1 if its feature is at most its cut, else to 2i+2."""

    feature: np.ndarray  # int16 [trees, 2**depth - 1]
    cut: np.ndarray  # float32, same shape
    leaf: np.ndarray  # float64 [trees, 2**depth]
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        depth, rows = int(np.log2(self.leaf.shape[1])), np.arange(len(x))
        total = np.full(len(x), self.base)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - (2**depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Forest:
    """Boosted trees with logistic loss; ``least``: hessian sum that each side of a cut keeps."""
    n, m, inner = len(x), x.shape[1], 2**depth - 1
    share = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    forest = Forest(np.zeros((trees, inner), np.int16), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, 2**depth)), float(np.log(share / (1 - share))))
    if not n or y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    total = np.full(n, forest.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h, node = p - y, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            local = node - first
            best = np.full(width, 1e-9)
            for j in range(m):
                slot, size = local * bins + binned[j], width * bins
                gl = np.bincount(slot, g, size).reshape(width, bins).cumsum(1)
                hl = np.bincount(slot, h, size).reshape(width, bins).cumsum(1)
                ga, ha = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < least) | (ha - hl < least)] = 0
                gain[:, len(edges[j]) :] = 0
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                for k in np.flatnonzero(top > best):
                    best[k] = top[k]
                    forest.feature[t, first + k], forest.cut[t, first + k] = j, edges[j][at[k]]
            node = 2 * node + 1 + (x[np.arange(n), forest.feature[t][node]] > forest.cut[t][node])
        leaf = node - inner
        forest.leaf[t] = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        total += forest.leaf[t][leaf]
    return forest


def _held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % FOLDS == 0


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``held_out`` and the features as packed float32."""
    rows = only(docs, **{id_col: id_col, "text": text_col})
    out = schema(rows, [id_col], "held_out boolean, features binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = features([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
            held = [_held_out(i) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array([r.tobytes() for r in x], pa.binary())], names=out.names)

    return bounded(rows).mapInArrow(run, out)


def train(features_of: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, id_col: str = "doc_id", label_col: str = "quality") -> Forest:
    """A forest from at most ``limit`` labelled rows outside the held-out fold.

    The rows are those of least hash of id and features, so the sample is even over all labelled rows and
    the same on any partitioning. Of several labels of an id the least counts; rows without a label or id
    are no use and left out.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).where("_id is not null and _y is not null")
    known = known.where(F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(FOLDS)) != 0).groupBy("_id").agg(F.min("_y").alias("_y"))
    rows = features_of.where(~F.col("held_out")).join(known, F.col(id_col) == F.col("_id")).select("_id", "_y", "features")
    rows = rows.orderBy(F.xxhash64("_id", "features"), "_id", "features").limit(limit).toPandas()
    x = np.frombuffer(b"".join(rows["features"]), np.float32).reshape(-1, len(FEATURES))
    return fit(x, rows["_y"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 if score >= ``threshold``).

    Null and empty texts have all statistics 0 and get a score like any other; a null id counts as
    an empty one for the fold; repeated rows are scored each on their own; without usable labels all
    scores are the labels' share (0.5 if there are none). Other columns play no part.
    """
    known = checkpointed(described(docs, id_col, text_col))
    forest = docs.sparkSession.sparkContext.broadcast(train(known, labels, limit, id_col))
    out = schema(known, [id_col, "held_out"], "score double, predicted int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, len(FEATURES))
            s = forest.value.scores(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=out.names)

    return known.mapInArrow(run, out)
