"""Best-fit packing of token sequences by minimum bin slack.

Lengths are whole numbers up to the capacity, so a histogram of at most ``capacity`` counts says all
that a packer needs. On the driver, each bin gets the longest length left and the fullest feasible
combination of the lengths available besides it (subset sums as bits of one integer); this pattern
is then taken out as often as the counts allow, so the work does not depend on the number of pieces.
Pieces learn their place from their rank among those of their length: a rank within the task that
cut them plus the counts of the tasks before, which are summed by key and never gathered in one
place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timbre.llm.common import bounded, checkpointed, only, schema, slices, texts
from timbre.llm.vocab import WORD_PIECES, WordEndCache, le_bytes

CAPACITY, END_ID = 2048, 0

_caches: dict = {}


def fullest(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """(length, copies) of available lengths whose sum comes closest to ``room`` from below.

    ``counts[l]`` pieces of length l are there. Bit s of ``reach`` says that a sum s is feasible;
    longer lengths come first, so short ones stay for later bins.
    """
    mask, reach, layers = (1 << (room + 1)) - 1, 1, []
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        for _ in range(min(int(counts[length]), room // length)):
            wider = reach | (reach << length) & mask
            if wider == reach:
                break
            layers.append((length, reach))
            reach = wider
            if reach >> room:
                break
        if reach >> room:
            break
    left, took = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        if not before >> left & 1:
            took[length] = took.get(length, 0) + 1
            left -= length
    return list(took.items())


def plan_bins(histogram: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Minimum bin slack over a histogram of lengths 1..capacity.

    Returns the number of bins and rows (length, first rank, first bin, copies a bin, first offset):
    piece ``r`` of its length lies in bin ``first bin + (r - first rank) // copies``.
    """
    counts, used, bins, rows = histogram.astype(np.int64).copy(), np.zeros(capacity + 1, np.int64), 0, []
    for longest in range(capacity, 0, -1):
        while counts[longest]:
            counts[longest] -= 1
            pattern = {longest: 1}
            for length, copies in fullest(counts, capacity - longest):
                pattern[length] = pattern.get(length, 0) + copies
            counts[longest] += 1
            times, offset = min(int(counts[x]) // m for x, m in pattern.items()), 0
            for length, m in sorted(pattern.items(), reverse=True):
                rows.append((length, used[length], bins, m, offset))
                counts[length] -= m * times
                used[length] += m * times
                offset += m * length
            bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5), bins


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces: id, piece, start, length, ids_crc32, and the task's number and the rank in it by length."""
    rows = only(docs, **{id_col: id_col, "text": text_col})
    out = schema(rows, [id_col], "piece int, start long, length long, ids_crc32 long, part int, rank long")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _caches:
            _caches[path] = WordEndCache(path, WORD_PIECES, True)
        part, seen, end = TaskContext.get().partitionId(), [0] * (capacity + 1), le_bytes([END_ID])
        for batch in slices(batches):
            row, columns = [], [[], [], [], [], []]
            for i, values in enumerate(_caches[path].values(texts(batch.column(1)))):
                ids = memoryview(b"".join(values) + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    chunk = ids[at : at + 4 * capacity]
                    n = len(chunk) // 4
                    row.append(i)
                    for c, x in zip(columns, (k, at // 4, n, zlib.crc32(chunk), seen[n]), strict=True):
                        c.append(x)
                    seen[n] += 1
            k, start, length, crc, rank = (np.array(c, np.int64) for c in columns)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(k.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(row), part, np.int32)), pa.array(rank)],
                names=out.names,
            )

    return bounded(rows).mapInArrow(pieces, out)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the (checkpointed) pieces of :func:`cut`."""
    by_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = by_task.select(F.col("part").alias("_part"), F.col("length").alias("_length"), F.coalesce(before, F.lit(0)).alias("_before"))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows
        histogram[length] = n
    table, _ = plan_bins(histogram, capacity)
    shared = pieces.sparkSession.sparkContext.broadcast(table)  # bounded by the number of lengths, not of pieces
    ranked = pieces.join(firsts, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length"))).select(
        *pieces.columns[:5], (F.col("rank") + F.col("_before")).alias("rank")
    )
    out = schema(pieces, pieces.columns[:5], "sequence_id long, offset long")

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, first_bin, copies, offset = shared.value.T if len(shared.value) else np.zeros((5, 0), np.int64)
        starts = (length << 48) + first
        for batch in batches:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in (3, 5))
            i = np.searchsorted(starts, (n << 48) + rank, "right") - 1
            k = rank - first[i]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(first_bin[i] + k // copies[i]), pa.array(offset[i] + k % copies[i] * n)], names=out.names
            )

    return ranked.mapInArrow(lookup, out)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every text, encoded by the tokenizer file at ``path`` with id 0 behind it, into sequences.

    Returns per piece: id, ``piece``, ``start`` (ids of the same text before it), ``length``,
    ``ids_crc32``, ``sequence_id`` and ``offset`` (gapless from 0). Only texts of more than
    ``capacity`` ids are cut. A null or empty text is one piece of one id. Repeated rows are packed
    each on their own; other columns play no part; an empty table gives an empty result.
    """
    return place(checkpointed(cut(docs, path, capacity, id_col, text_col)), capacity)
