"""Token counts by a map-side two-tier look-up; no pre-token is shuffled.

First tier: a compact hash table of the lengths of the corpus's most frequent pre-tokens, broadcast.
They are counted in a sample of rows (:data:`SAMPLE_ROWS`): each task counts its own and reports its
most frequent ones, sums are taken by key, and the most frequent are encoded once on the driver.
Second tier: each worker encodes what the table lacks with the library and remembers it (bounded, see
``vocab.CACHE_LIMIT``). Both tiers hold what the library says, so counts equal the library's on every
text, whatever the sample.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbre.llm.common import bounded, only, schema, slices, texts
from timbre.llm.vocab import BYTE_PIECES, PieceCache, tokenizer

#: Rows whose pre-tokens are counted, about; most entries of the first tier; most that a task reports.
SAMPLE_ROWS, TABLE_ENTRIES, TASK_ENTRIES = 20_000, 50_000, 20_000
#: A length takes two bytes; longer pre-tokens (there are no frequent ones) are left to the second tier.
LONGEST = (1 << 16) - 1

_caches: dict = {}


def frequent_pieces(rows: DataFrame, path: str, sample: int = SAMPLE_ROWS, entries: int = TABLE_ENTRIES) -> list[str]:
    """The most frequent pre-tokens of a sample of rows; at most ``entries``. Column ``text``."""
    there = rows.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, seen = PieceCache(path, BYTE_PIECES, False, len).plain, Counter()
        for batch in slices(batches, 0):
            for text in texts(batch.column(0)):
                if plain(text):
                    seen.update(BYTE_PIECES.findall(text))
            if len(seen) > 20 * TASK_ENTRIES:
                seen = Counter(dict(seen.most_common(10 * TASK_ENTRIES)))
        top = seen.most_common(TASK_ENTRIES)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    some = rows.select("text").sample(min(1.0, sample / max(there, 1)), 7) if there else rows.select("text")
    sums = bounded(some).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r.piece for r in sums.orderBy(F.desc("n"), "piece").limit(entries).collect()]


def frequent_lengths(pieces: list[str], path: str) -> tuple[bytes, bytes]:
    """Compact table: the pre-tokens, NUL-separated and deflated, and their lengths in tokens."""
    pieces = [p for p in pieces if "\0" not in p]
    lengths = np.array([len(e.ids) for e in tokenizer(path).encode_batch(pieces, add_special_tokens=False)], np.int64)
    kept = [p for p, n in zip(pieces, lengths, strict=True) if n <= LONGEST]
    return zlib.compress("\0".join(kept).encode()), lengths[lengths <= LONGEST].astype("<u2").tobytes()


def _cache(path: str, table: tuple[bytes, bytes]) -> PieceCache:
    """The worker's cache for this table; the one for another table goes."""
    key = path, zlib.crc32(table[0])
    if key not in _caches:
        _caches.clear()
        lengths = np.frombuffer(table[1], "<u2").tolist()
        known = dict(zip(zlib.decompress(table[0]).decode().split("\0"), lengths, strict=True)) if lengths else {}
        _caches[key] = PieceCache(path, BYTE_PIECES, False, len, known)
    return _caches[key]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``path``: a byte-level BPE file of the tokenizers library. A null text counts as empty: 0 bytes,
    0 tokens. Repeated rows and ids are counted each on their own; other columns play no part; an
    empty table gives an empty result. Special strings inside texts are handled as the library does.
    """
    rows = only(docs, **{id_col: id_col, "text": text_col})
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(frequent_pieces(rows, path), path))  # at most TABLE_ENTRIES
    out = schema(rows, [id_col], "n_bytes long, n_tokens long, over_limit boolean")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(path, table.value)
        for batch in slices(batches):
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            n = np.fromiter(map(sum, cache.values(texts(batch.column(1)))), np.int64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], names=out.names)

    return bounded(rows).mapInArrow(count, out)
