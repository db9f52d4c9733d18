"""Filters, speaker selection, splits and samples of a ``turns`` table.

``turns``: doc_id, turn_id, speaker, text, and optionally ts, reply_to, meta. Whatever is drawn is drawn
by the order of an MD5 of seed and key, so it is the same on any partitioning. Running totals over
that order are taken in two levels, by the first four digits of the MD5 and within them, so no
single task sees all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbre.functions import text as T
from timbre.session import checkpointed

TURNS = "doc_id string, turn_id int, speaker string, text string, ts timestamp, reply_to int, meta map<string,string>"


def key() -> Column:
    """A turn's primary key."""
    return F.concat_ws("#", F.col("doc_id").cast("string"), F.col("turn_id").cast("string"))


def draw(seed: int, *columns: Column) -> Column:
    """Place of a row in a random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in columns)))


def running(df: DataFrame, order: Column, weight: Column, name: str, by: str) -> DataFrame:
    """``df`` with the total of ``weight`` up to each row, in the order of a hexadecimal digest and ``by``."""
    df = df.withColumns({"_o": order, "_w": weight}).withColumn("_b", F.substring("_o", 1, 4))
    sums = df.groupBy("_b").agg(F.sum("_w").alias("_s"))  # at most 65,536 rows
    before = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("_w").over(Window.partitionBy("_b").orderBy("_o", by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = df.join(F.broadcast(before), "_b").withColumn(name, F.col("_before") + inside)
    return out.drop("_o", "_w", "_b", "_before")


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in the given order. Rows are parted by ranges of it and numbered where they lie;
    only the parts' sizes come to the driver."""
    rows = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_id", 33))
    before, firsts = 0, []
    for part, n in sorted(map(tuple, rows.groupBy("_part").agg(F.count("*")).collect())):  # a row a partition
        firsts.append((part, before))
        before += n
    at = df.sparkSession.createDataFrame(firsts, "_part long, _first long")
    return rows.join(F.broadcast(at), "_part").withColumn(name, F.col("_first") + F.col("_id") - F.shiftleft("_part", 33)).drop("_id", "_part", "_first")


def speakers(turns: DataFrame) -> DataFrame:
    """Turns by speaker, most first; ties by name."""
    return turns.groupBy("speaker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "speaker")


def most_frequent_speaker(turns: DataFrame) -> str:
    return speakers(turns).first()["speaker"]


def of_speakers(turns: DataFrame, names: list[str]) -> DataFrame:
    return turns.where(F.col("speaker").isin(names))


def non_empty(turns: DataFrame) -> DataFrame:
    return turns.where(T.strip(F.col("text")) != "")


def at_least_words(turns: DataFrame, n: int = 2) -> DataFrame:
    """Turns of n or more blank-separated tokens."""
    return turns.where(F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")) >= n)


def english_only(turns: DataFrame, least_latin: float = 0.9) -> DataFrame:
    return turns.where(T.is_english(F.col("text"), least_latin))


def without_signatures(turns: DataFrame) -> DataFrame:
    return turns.withColumn("text", T.strip_signature(F.col("text")))


def grouped(turns: DataFrame, targets: list[str] | None = None, reference: list[str] | None = None) -> DataFrame:
    """Non-empty turns with ``grp``: target or reference. Without targets, the most frequent speaker is
    the target; without a reference, everyone else is. An unknown target is an error."""
    targets = targets or [most_frequent_speaker(turns)]
    known = {r.speaker for r in turns.where(F.col("speaker").isin(targets)).select("speaker").distinct().collect()}
    if missing := [t for t in targets if t not in known]:
        raise ValueError(f"no turns of target speakers {missing}")
    is_target = F.col("speaker").isin(targets)
    rows = non_empty(turns).withColumn("grp", F.when(is_target, "target").otherwise("reference"))
    return rows if reference is None else rows.where(is_target | F.col("speaker").isin(reference))


def split_docs(turns: DataFrame, share: float = 0.2, seed: int = 7) -> DataFrame:
    """``turns`` with ``held``: whole conversations, about ``share`` of them and at least one. A corpus of
    fewer than five is cut into contiguous blocks of a tenth of its turns instead."""
    docs = turns.groupBy("doc_id").agg(F.lit(1).alias("one"))
    n = docs.count()
    if n < 5:
        total = turns.count()
        block = max(total // 10, 1)
        rows = numbered(turns, "_number", "doc_id", "turn_id").withColumn("_block", F.floor(F.col("_number") / block).cast("int")).drop("_number")
        blocks = rows.select("_block").distinct()
        n_blocks, drawn = -(-total // block), draw(seed, F.col("_block"))
        held = blocks.orderBy(drawn, "_block").limit(max(1, round(n_blocks * share))).withColumn("_held", F.lit(True))
        return rows.join(F.broadcast(held), "_block", "left").withColumn("held", F.coalesce("_held", F.lit(False))).drop("_block", "_held")
    held = running(docs, draw(seed, F.col("doc_id")), F.lit(1), "_n", "doc_id").where(F.col("_n") <= max(1, round(n * share)))
    return turns.join(held.select("doc_id", F.lit(True).alias("_held")), "doc_id", "left").withColumn("held", F.coalesce("_held", F.lit(False))).drop("_held")


def cap_target_docs(turns: DataFrame, most: int, seed: int = 7) -> DataFrame:
    """Whole conversations in random order until ``most`` turns are there, then cut to exactly that."""
    docs = turns.groupBy("doc_id").agg(F.count("*").alias("n"))
    drawn = running(docs, draw(seed, F.col("doc_id")), F.col("n"), "upto", "doc_id").where(F.col("upto") - F.col("n") < most)
    inside = F.row_number().over(Window.partitionBy("doc_id").orderBy("turn_id"))
    kept = turns.join(drawn.select("doc_id", F.col("upto").alias("_upto"), F.col("n").alias("_n")), "doc_id").withColumn("_i", inside)
    return kept.where(F.col("_upto") - F.col("_n") + F.col("_i") <= most).drop("_upto", "_n", "_i")


def sample_turns(turns: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """A uniform sample of n turns (all, if there are fewer)."""
    return running(turns.withColumn("_k", key()), draw(seed, key()), F.lit(1), "_n", "_k").where(F.col("_n") <= n).drop("_k", "_n")


def reference_caps(n_target_train: int, n_target_held: int, max_reference: int = 20_000) -> tuple[int, int]:
    """Most reference turns for training and held-out, given the target's."""
    return min(max(3 * n_target_train, 500), max_reference), max(2 * n_target_held, 200)
