"""Document fingerprints from prefix polynomial hashes.

A text's code points c give prefix sums of (c + 1) * B^j modulo a prime, under two bases B. The
difference of two prefix sums, times B^-i, is the hash of the span from i: the same for equal spans
anywhere in any text. So spans compare in constant time, and the longest common extension of two
places is found by binary search.

A fingerprint holds the length, the hashes of the whole text under both bases, the hashes of its
prefixes at fixed places, and the smallest distinct values of all its 12-character spans' hashes. Two
fingerprints' likeness is the greater of two shares: of distinct spans that their texts have in
common, as the smallest values estimate it, and of the longer text that their longest common prefix
takes, found by binary search over the prefixes' places.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from timbre.llm.common import bounded, only, schema, slices

PRIME = np.uint64((1 << 31) - 1)
BASES = (1_000_003, 763_546_847)
SPAN, SMALLEST = 12, 32
_MIX, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x < 2^62: the upper bits are worth as much as the lower."""
    x = (x & PRIME) + (x >> np.uint64(31))
    x = (x & PRIME) + (x >> np.uint64(31))
    x[x == PRIME] = 0
    return x


def _table(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:  # base^(i + done) = base^i * base^done
        more = min(done, n - done)
        out[done : done + more] = _mod(out[:more] * np.uint64(pow(base, done, int(PRIME))))
        done += more
    return out


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n at least; kept, and doubled when a longer text comes."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(12, n.bit_length())
        _powers[base] = _table(base, size), _table(pow(base, -1, int(PRIME)), size)
    return _powers[base]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def places(n: int) -> list[int]:
    """Lengths of the prefixes that a fingerprint of ``n`` code points tells: each some 12 % more than the last."""
    if not _places or _places[-1] <= n:
        size = _places[-1] if _places else 0
        while size <= n:
            size += 1 + size // 8
            _places.append(size)
    return _places[: bisect_right(_places, n)]


_places: list[int] = []


class PrefixHash:
    """Prefix arrays of one text under both bases; ``head``: another text's, whose first ``kept`` code points
    this one shares."""

    def __init__(self, codes: np.ndarray, head: PrefixHash | None = None, kept: int = 0):
        self.n = len(codes)
        self.prefix, self.down = [], []
        for k, base in enumerate(BASES):
            up, down = powers(base, self.n + 1)
            sums = np.zeros(self.n + 1, np.uint64)
            if head is not None:
                sums[: kept + 1] = head.prefix[k][: kept + 1]
            np.cumsum(_mod((codes[kept:] + np.uint64(1)) * up[kept : self.n]), out=sums[kept + 1 :])
            if kept:
                sums[kept + 1 :] += sums[kept]
            self.prefix.append(sums)
            self.down.append(down)

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """Hashes of the code points from ``start`` to before ``end``, one under each base."""
        p = int(PRIME)
        return tuple((int(sums[end]) - int(sums[start])) % p * int(down[start]) % p for sums, down in zip(self.prefix, self.down, strict=True))

    def spans(self, width: int, start: int = 0) -> np.ndarray:
        """Hashes, under the first base, of all spans of ``width`` from ``start`` on."""
        if width > self.n - start:
            return np.zeros(0, np.uint64)
        sums = self.prefix[0][start:]
        return _mod(_mod(sums[width:] - sums[: len(sums) - width]) * self.down[0][start : self.n + 1 - width])

    def prefixes(self) -> np.ndarray:
        """32 bits for each of the :func:`places`, mixed from both bases' prefix sums."""
        at = places(self.n)
        one, two = (_mod(sums[at]) for sums in self.prefix)
        return _sampled((one << np.uint64(31)) ^ two)

    def equal(self, start: int, other: PrefixHash, at: int, width: int) -> bool:
        return self.span(start, start + width) == other.span(at, at + width)

    def extension(self, start: int, other: PrefixHash, at: int) -> int:
        """Length of the longest common span from ``start`` here and ``at`` there."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(start, other, at, mid) else (low, mid - 1)
        return low


def _sampled(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * _MIX) >> _HALF).astype(np.uint32)


class Fingerprint:
    """n, the whole text's two hashes, the prefixes' hashes and the smallest span values."""

    __slots__ = ("n", "whole", "prefixes", "low")

    def __init__(self, n: int, whole: tuple[int, ...], prefixes: list[int], values: np.ndarray):
        self.n, self.whole, self.prefixes = n, whole, prefixes
        values = np.sort(values)
        low = np.unique(values[: SMALLEST * 4])
        if len(low) < SMALLEST < len(values):
            low = np.unique(values)
        self.low = frozenset(low[:SMALLEST].tolist())

    def __str__(self) -> str:
        return ".".join((f"{self.n:x}", "".join(f"{x:08x}" for x in self.whole), "".join(f"{x:08x}" for x in self.prefixes), "".join(f"{x:08x}" for x in sorted(self.low))))

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        n, *rest = text.split(".")
        whole, prefixes, low = ([int(x[i : i + 8], 16) for i in range(0, len(x), 8)] for x in rest)
        return cls(int(n, 16), tuple(whole), prefixes, np.array(low, np.uint32))

    def common_prefix(self, other: Fingerprint) -> int:
        """The longest told prefix that both have: a longer one is unequal wherever a shorter one is."""
        low, high = 0, min(len(self.prefixes), len(other.prefixes))
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.prefixes[mid - 1] == other.prefixes[mid - 1] else (low, mid - 1)
        return places(min(self.n, other.n))[low - 1] if low else 0

    def likeness(self, other: Fingerprint) -> float:
        """0 to 1: estimated share of what is common; 1 for equal texts, 0 with one empty."""
        if (self.n, self.whole) == (other.n, other.whole):
            return 1.0
        if not self.n or not other.n:
            return 0.0
        union = sorted(self.low | other.low)[:SMALLEST]
        spans = sum(x in self.low and x in other.low for x in union) / len(union)
        return max(spans, self.common_prefix(other) / max(self.n, other.n))


class _Text:
    """A text with its arrays and fingerprint."""

    __slots__ = ("text", "codes", "hash", "values", "print")

    def __init__(self, text: str, head: _Text | None = None, kept: int = 0):
        self.text, self.codes = text, code_points(text)
        self.hash = PrefixHash(self.codes, head.hash if head else None, kept)
        n = len(self.codes)
        width = min(SPAN, n)
        # spans inside the shared head keep their hashes; only those that reach beyond it are new
        old = max(0, kept - width + 1) if head and len(head.codes) >= SPAN <= n else 0
        self.values = _sampled(self.hash.spans(width, old)) if n else np.zeros(0, np.uint32)
        if old:
            self.values = np.concatenate([head.values[:old], self.values])
        self.print = Fingerprint(n, self.hash.span(0, n), self.hash.prefixes().tolist(), self.values)

    def edited(self, other: str) -> tuple[_Text, int]:
        """The last third replaced by the start of ``other``, and the length of the common prefix."""
        n = len(self.codes)
        stays = n - n // 3
        changed = _Text(self.text[:stays] + other[: n // 3], self, stays)
        return changed, self.hash.extension(0, changed.hash, 0)


def fingerprint(text: str | None) -> str:
    return str(_Text(text or "").print)


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints."""
    return Fingerprint.parse(a).likeness(Fingerprint.parse(b))


def _sortable(key: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Pairs of longs as bytes in the same order."""
    top = np.uint64(1 << 63)
    both = np.stack([key.view(np.uint64) ^ top, low.view(np.uint64) ^ top], axis=1).astype(">u8")
    return np.ascontiguousarray(both).view("S16").ravel()


def _ordered(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows id, text as bucket, tail, id, text: each bucket whole in a partition and in descending
    order, the first row of the next bucket (of the first after the last) behind it as its tail.

    Buckets are ranges of ids, and of text hashes within an id, so many rows of one id (or without one)
    are several buckets. Their bounds come from a range partitioning of ids and hashes alone; what goes to
    the driver, and from there to all tasks, is the first row's pair of each bucket, and only those rows
    are sent to a neighbour.
    """
    kind = rows.schema["id"].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise ValueError(f"ids must be whole numbers, not {kind.simpleString()}")
    key = F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))  # null ids come last
    rows = rows.select("id", "text", key.alias("key"), F.xxhash64("text").alias("hash"))
    ranges = rows.select("key", "hash").repartitionByRange(buckets, F.desc("key"), F.desc("hash"))
    heads = ranges.groupBy(F.spark_partition_id()).agg(F.max(F.struct("key", "hash")).alias("head")).select("head.*").collect()  # a row a bucket
    heads = sorted((tuple(h) for h in heads), reverse=True)
    shared = rows.sparkSession.sparkContext.broadcast(_sortable(*np.array(heads[::-1] or [(0, 0)], np.int64).T))

    @F.pandas_udf("int")
    def bucket_of(key: pd.Series, low: pd.Series) -> pd.Series:
        at = np.searchsorted(shared.value, _sortable(key.to_numpy(np.int64), low.to_numpy(np.int64)), "left")
        return pd.Series(len(shared.value) - 1 - at).astype("int32")

    rows = rows.withColumn("bucket", bucket_of("key", "hash"))
    follows = [(i, *heads[(i + 1) % len(heads)]) for i in range(len(heads))]
    after = rows.sparkSession.createDataFrame(follows, "to int, hkey long, hhash long")
    here = (F.col("key") == F.col("hkey")) & (F.col("hash") == F.col("hhash"))
    tails = rows.select("id", "text", "key", "hash").join(F.broadcast(after.select("hkey", "hhash").distinct()), here)
    tails = tails.dropDuplicates(["key", "hash"]).drop("hkey", "hhash").join(F.broadcast(after), here)
    tails = tails.select("id", "text", "key", "hash", F.col("to").alias("bucket"), F.lit(True).alias("tail"))
    return rows.withColumn("tail", F.lit(False)).select("id", "text", "key", "hash", "bucket", "tail").unionByName(tails)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Per row: id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next`` and ``common_prefix`` (of a text and its edited text).

    A row's next is that of the next lower id (whole numbers; others raise), after the last the first; rows of the
    same id are in the order of a hash of their texts, equal rows follow each other; null ids come
    last; a single row is its own next. Null texts count as empty. Other columns play no part; an
    empty table gives an empty result.
    """
    rows = only(docs, id=id_col, text=text_col)
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = _ordered(rows, 4 * n).repartition(n, "bucket").sortWithinPartitions("bucket", "tail", F.desc("key"), F.desc("hash"))
    out = schema(rows, ["id"], "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long")
    out = type(out)([type(out.fields[0])(id_col, out.fields[0].dataType), *out.fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (bucket, id, text) that waits for its next
        for batch in slices(batches):
            found = []
            for i, text, bucket, tail in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                here = _Text(text or "")
                if last and last[0] == bucket:
                    _, of, before = last
                    changed, common = before.edited(here.text)
                    sha = hashlib.sha256(changed.text.encode()).hexdigest()
                    found.append((of, before.print.n, sha, str(before.print), str(changed.print), before.print.likeness(changed.print), before.print.likeness(here.print), common))
                last = None if tail else (bucket, i, here)
            if found:
                columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=out.names)

    types = [to_arrow_type(f.dataType) for f in out.fields]
    return bounded(ordered.select("id", "text", "bucket", "tail")).mapInArrow(run, out)
