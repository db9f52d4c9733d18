"""What several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from timbre.session import checkpointed  # noqa: F401  (operators take it from here)

#: Rows and text bytes that a Python worker turns into objects at once.
SLICE_ROWS, SLICE_BYTES = 512, 2 << 20
#: Rows that travel between Spark and a Python worker at once.
BATCH_ROWS = 1000
#: Rows of some numbers that a task takes before a table is dealt to further ones.
ROWS_A_TASK = 20_000


def release(*caches) -> None:
    """Empties caches at the end of a task and gives freed memory back to the system: Python workers
    live on, and what one stage leaves counts against the next."""
    for cache in caches:
        cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def only(df: DataFrame, **names: str) -> DataFrame:
    """The named columns alone, under the given names: others, whatever their names, play no part."""
    return df.select(*(df[v].alias(k) for k, v in names.items()))


def bounded(df: DataFrame) -> DataFrame:
    """``df``, after setting the session's Arrow batches to :data:`BATCH_ROWS` rows. A batch is held whole, on
    both sides, on its way to Python and back; Spark's 10,000 rows of long texts would be gigabytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def few(df: DataFrame, rows: int, a_task: int = ROWS_A_TASK) -> DataFrame:
    """``df``, which has at most ``rows`` rows, in no more tasks than these need. Each task of a shuffle writes a
    block for each of the next ones: a small table in as many tasks as a large one is mostly files. The rows of a
    single task aren't shuffled at all."""
    return df.coalesce(max(1, -(-rows // a_task)))


def compact(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` checkpointed and counted, in no more tasks than its rows need; ``most``: rows that it has at most, if
    known, so that no more tasks write it."""
    done = checkpointed(df if most is None else few(df, most))
    return few(done, done.count())


def slices(batches: Iterator[pa.RecordBatch], text: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of bounded rows and text bytes (a longer single text stays whole)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(sizes):
            if i > start and (i - start >= SLICE_ROWS or size + n > SLICE_BYTES):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        if len(sizes) > start:
            yield batch.slice(start)


def texts(column: pa.Array) -> list[str]:
    """The strings of a column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def schema(df: DataFrame, ids: list[str], rest: str) -> T.StructType:
    """The given columns of ``df`` as they are, then ``rest`` (DDL)."""
    return T.StructType([df.schema[c] for c in ids] + T._parse_datatype_string(rest).fields)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
