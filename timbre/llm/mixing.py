"""Mixing sources to target weights by temperature.

A source's share of all words, raised to an exponent and normalised, is its weight: 1 keeps the
shares, 0 makes all sources equal. The exponent is bisected: as low as a limit on repetition
allows, or as a target entropy asks for, which may be a part of the way from the sources' own to the
greatest. A budget of words then gives each source a quota: whole
passes over the source, and a part of one more. The part is a prefix of a random permutation of the
source's blocks, which are hash classes of its documents: what is decided is bounded by the number
of sources and blocks, and no document has to be sorted or moved.

The table of sources stays a table, however many there are: a bisecting step takes two sums for each
of several exponents at once, and only those sums come to the driver. Sizes are counted in words.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbre.llm.common import checkpointed

BLOCKS, MAX_REPEATS = 1024, 2.0
#: Exponents tried at once, and rounds: together the exponent's 9 digits.
TRIED, ROUNDS, DIGITS = 15, 8, 9
#: Rows of a table of sources or blocks that is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def n_words(text: Column) -> Column:
    """Words of a text: what a source's size is measured in."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


@dataclass
class Mixture:
    """A source of ``total`` words of all ``words`` has the weight (total / words) ** exponent / norm, and
    the mixture has ``tokens`` words."""

    exponent: float
    norm: float
    words: float
    tokens: float


def solved(sizes: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None, budget: float | None = None, budget_passes: float | None = None, entropy_gain: float | None = None) -> Mixture:
    """The mixture of sources of ``total`` words each.

    Its exponent lies in 0..1. With a repetition limit: the least at which no source is passed over more
    often than that. With a target entropy (as a share of the greatest possible): the greatest that reaches
    it; the limit goes first if both are given. ``entropy_gain`` (0..1) sets the target that part of the way from the
    entropy of the sources as they are to the greatest possible, so that it asks as much of any sources. ``budget`` words, or ``budget_passes`` times all words, are
    mixed; without either, as many as the smallest mixture has that holds every document. Sources without
    words have no part in this.
    """
    some = sizes.where("total > 0")
    words, least, most, n = some.agg(F.sum("total"), F.min("total"), F.max("total"), F.count("*")).first()
    if not n:
        return Mixture(1.0, 1.0, 0.0, 0.0)
    words, small, large = float(words), least / words, most / words
    fixed = budget if budget is not None else budget_passes * words if budget_passes is not None else None
    share = F.col("total") / F.lit(words)

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        powers = [F.pow(share, F.lit(a)) for a in exponents]
        row = some.agg(*(F.sum(x) for p in powers for x in (p, p * F.log(share)))).first()
        return list(zip(row[::2], row[1::2], strict=True))

    def tokens(a: float, norm: float) -> float:
        return fixed if fixed is not None else words * norm * large ** (1 - a)

    def repeats(a: float, norm: float, _: float) -> float:
        return tokens(a, norm) * small ** (a - 1) / norm / words

    def entropy(a: float, norm: float, logs: float) -> float:
        return (math.log(norm) - a * logs / norm) / math.log(n) if n > 1 else 1.0

    def border(holds: Callable[[float, float, float], bool], above: bool) -> float:
        """The border between exponents that hold (above it, or below) and others; exact to DIGITS."""
        low, high = 0.0, 1.0
        (ends,) = [sums([low, high])]
        if holds(low if above else high, *ends[0 if above else 1]):
            return low if above else high
        for _ in range(ROUNDS):
            tried = [low + (high - low) * (i + 1) / (TRIED + 1) for i in range(TRIED)]
            good = [holds(a, *x) for a, x in zip(tried, sums(tried), strict=True)]
            first = next((i for i, g in enumerate(good) if g == above), TRIED)
            low, high = ([low, *tried][first], [*tried, high][first])
        return round(high if above else low, DIGITS)

    if entropy_gain is not None:
        own = entropy(1.0, *sums([1.0])[0])
        target_entropy = max(target_entropy or 0.0, own + entropy_gain * (1 - own))
    limited = border(lambda *x: repeats(*x) <= max_repeats, True) if max_repeats is not None else None
    wanted = border(lambda *x: entropy(*x) >= target_entropy, False) if target_entropy is not None else None
    exponent = max(x for x in (limited, wanted) if x is not None) if (limited, wanted) != (None, None) else 1.0
    norm = sums([exponent])[0][0]
    return Mixture(exponent, norm, words, tokens(exponent, norm))


def _block(id_col: Column, text: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(id_col, text), F.lit(blocks)).cast("int")


def _small(rows: DataFrame) -> DataFrame:
    """A checkpointed table, to be broadcast if it is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def block_copies(docs: DataFrame, blocks: int = BLOCKS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source: str = "source", **how) -> DataFrame:
    """``source``, ``block`` and ``copies``: how often a source's block is in the mixture (``how``: see
    :func:`solved`).

    Copies are the whole passes that the source's quota holds, and one more for the blocks that come
    first in a permutation of the next pass, up to the rest of the quota, to the nearest block.
    """
    rows = docs.select(docs[source].cast("string").alias("source"), _block(docs[id_col], docs[text_col], blocks).alias("block"), n_words(docs[text_col]).alias("n"))
    sums = checkpointed(rows.groupBy("source", "block").agg(F.sum("n").alias("n")))
    sizes = checkpointed(sums.groupBy("source").agg(F.sum("n").alias("total")))
    mix = solved(sizes, **how)
    weight = F.pow(F.col("total") / F.lit(mix.words or 1.0), F.lit(mix.exponent)) / F.lit(mix.norm)
    quota = F.when(F.col("total") > 0, weight * F.lit(mix.tokens)).otherwise(0.0)
    known = sums.join(_small(sizes.select(F.col("source").alias("of"), "total", quota.alias("quota"))), F.col("source").eqNullSafe(F.col("of")))
    passes = F.when(F.col("total") > 0, F.floor(F.col("quota") / F.col("total") + 1e-9)).otherwise(1).cast("int")
    rest = F.col("quota") - F.col("passes") * F.col("total")
    order = Window.partitionBy("source").orderBy(_permuted(F.col("source"), F.col("block"), F.col("passes"), seed), "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = known.withColumn("passes", passes).withColumn("upto", F.sum("n").over(order))
    in_part = (F.col("total") > 0) & (F.col("upto") - F.col("n") / 2 <= rest) & (rest > 0)
    return upto.select("source", "block", (F.col("passes") + in_part.cast("int")).alias("copies"))


def _permuted(source: Column, block: Column, epoch: Column, seed: int) -> Column:
    """Place of a block in a pass: sort by it for the permutation."""
    return F.xxhash64(F.lit(seed), source, block, epoch.cast("int"))


def mixed(docs: DataFrame, blocks: int = BLOCKS, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source: str = "source", places: bool = False, **how) -> DataFrame:
    """``docs`` mixed: each row as often as its block is in the mixture, all columns as they are.

    ``how``: a repetition limit, target entropy and budget, see :func:`solved`. ``places`` adds ``epoch`` (0, 1, ...), ``block`` and ``place``, by which each epoch's blocks are in
    random order. Without a budget each document is there at least once. A null source is a source; a
    source without words is passed over once; null texts have no words; rows equal in id and text
    share a block. An empty table gives an empty result.
    """
    copies = checkpointed(block_copies(docs, blocks, seed, id_col, text_col, source, **how))
    copies = copies.select(F.col("source").alias("__timbre_of"), F.col("block").alias("__timbre_b"), F.col("copies").alias("__timbre_n"))
    copies = _small(copies)
    rows = docs.withColumn("__timbre_block", _block(docs[id_col], docs[text_col], blocks))
    rows = rows.join(copies, F.col(source).cast("string").eqNullSafe(F.col("__timbre_of")) & (F.col("__timbre_block") == F.col("__timbre_b")))
    rows = rows.where("__timbre_n > 0").withColumn("__timbre_epoch", F.explode(F.sequence(F.lit(0), F.col("__timbre_n") - 1)))
    more = [F.col("__timbre_epoch").alias("epoch"), F.col("__timbre_block").alias("block"), _permuted(F.col(source).cast("string"), F.col("__timbre_block"), F.col("__timbre_epoch"), seed).alias("place")]
    return rows.select(*docs.columns, *(more if places else []))
