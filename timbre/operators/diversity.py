"""Lexical diversity over an order (MTLD), folded in segments that start before it is known how they do.

A speaker's tokens are cut into segments of equal length. Every segment is folded from an empty state
(speculation); the state in which it ends is then what the next one really starts with. A fold that starts
otherwise soon restarts at a token where the speculative one restarts as well, and from there both are the same, so
most segments are walked once and a little. What a segment makes of a state is a row (state in, factors, state out);
rows of neighbouring segments are composed a block at a time, until one row a speaker is left.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbre.functions import text as T
from timbre.session import checkpointed

#: A run of tokens ends where its share of types falls to this.
LEAST = 0.72
#: Tokens below which there is no value.
MIN_TOKENS = 50
#: Tokens of a segment, and segments whose rows are composed in one task.
SEGMENT, BLOCK = 16_384, 1000
#: The name of the state without tokens.
EMPTY = ""
_STATE = "n long, types array<string>"
_STEP = f"c long, out string, {_STATE}"


class _Run:
    """A fold over tokens from a given state: types and number of the tokens since the last restart."""

    def __init__(self, tokens: list[str], types=(), n: int = 0, least: float = LEAST):
        self.tokens, self.types, self.n, self.least = tokens, set(types), n, least
        self.at = self.ends = self._next = 0

    def advance(self) -> bool:
        """Go on to the next restart, which is then before token ``at``; false if there is none."""
        types, n = self.types, self.n
        for i in range(self._next, len(self.tokens)):
            types.add(self.tokens[i])
            n += 1
            if len(types) / n <= self.least:
                self.types, self.n, self.ends = set(), 0, self.ends + 1
                self.at = self._next = i + 1
                return True
        self.n, self._next, self.at = n, len(self.tokens), len(self.tokens) + 1
        return False


def mtld_of(tokens: list[str], least: float = LEAST) -> float | None:
    """Lexical diversity of a token stream: mean length of runs that keep a type share above a limit,
    forwards and backwards; None under 50 tokens."""
    if len(tokens) < MIN_TOKENS:
        return None

    def length(stream) -> float:
        run = _Run(stream, least=least)
        while run.advance():
            pass
        factors = run.ends + ((1 - len(run.types) / run.n) / (1 - least) if run.n else 0.0)
        return len(tokens) / factors if factors else float(len(tokens))

    return (length(tokens) + length(tokens[::-1])) / 2


def _named(n: int, types: list[str]) -> str:
    return hashlib.md5(repr((n, types)).encode("utf-8", "surrogatepass")).hexdigest() if n else EMPTY


def _stepper(least: float):
    """A segment's tokens, its direction, the state before it, and what it makes of an empty one (null if that is
    what is asked for): factors, name and content of the state after it. A row is thousands of tokens."""

    def step(text, back, n, types, c0, out0, n0, types0):
        tokens = text.split(" ")[:: -1 if back else 1]
        run, fresh = _Run(tokens, types, n, least), _Run(tokens, least=least)
        while run.advance():
            while c0 is not None and fresh.at < run.at and fresh.advance():
                pass
            if fresh.at == run.at:  # from here on both are the same
                return c0 + run.ends - fresh.ends, out0, n0, types0
        kinds = sorted(run.types)
        return run.ends, _named(run.n, kinds), run.n, kinds

    return F.udf(step, _STEP)


def _segments(rows: DataFrame, segment: int) -> DataFrame:
    """key, seg, text: the words of each key's texts (``rows``: key, doc, turn, text) in order, ``segment`` a row but for the last.

    Texts are put into ranges, and only there cut into words; a text's place is the words of its key in the ranges before
    and, within its own, in the texts before. A text of many words is cut, so no task has more than a range, whoever speaks.
    """
    order = (F.asc_nulls_last("doc"), F.asc_nulls_last("turn"), F.asc("tie"))
    ranged = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("key", *order).withColumn("part", F.spark_partition_id())
    lower = F.transform(T.words(F.col("text")), F.lower)
    ranged = ranged.select("key", "doc", "turn", "tie", "part", lower.alias("w")).where(F.size("w") > 0)
    ranged = checkpointed(ranged.select("key", "doc", "turn", "tie", "part", F.array_join("w", " ").alias("text"), F.size("w").cast("long").alias("n")))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ranged.groupBy("key", "part").agg(F.sum("n").alias("n"))  # a row a range and key
    parts = parts.select("key", "part", earlier(Window.partitionBy("key").orderBy("part")).alias("before"))
    placed = ranged.withColumn("inside", earlier(Window.partitionBy("key", "part").orderBy(*order))).join(parts, ["key", "part"])
    placed = placed.select("key", F.split("text", " ").alias("w"), (F.col("before") + F.col("inside")).alias("start"), "n")

    def piece(seg: Column) -> Column:
        first = F.greatest(seg * segment, F.col("start"))
        last = F.least((seg + 1) * segment, F.col("start") + F.col("n"))
        words = F.slice("w", (first - F.col("start") + 1).cast("int"), (last - first).cast("int"))
        return F.struct(seg.alias("seg"), first.alias("at"), F.array_join(words, " ").alias("text"))

    segs = F.sequence(F.floor(F.col("start") / segment), F.floor((F.col("start") + F.col("n") - 1) / segment))
    pieces = placed.select("key", F.explode(F.transform(segs, piece)).alias("p")).select("key", "p.seg", F.struct("p.at", "p.text").alias("p"))
    whole = F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"])  # at most ``segment`` tokens
    return pieces.groupBy("key", "seg").agg(F.array_join(whole, " ").alias("text"))


def _transitions(segments: DataFrame, least: float, only_one: bool) -> DataFrame:
    """key, back, seg, into, c, out, n, kinds: what every segment makes of each state that it can meet."""
    step = _stepper(least)
    at = ["key", "back", "seg"]

    def stepped(rows: DataFrame, *fresh: Column) -> DataFrame:
        made = rows.withColumn("s", step("text", "back", "n", "types", *fresh))
        return checkpointed(made.select(*at, "into", "s.*"))

    empty = (F.lit(EMPTY).alias("into"), F.lit(0).cast("long").alias("n"), F.array().cast("array<string>").alias("types"))
    none = F.lit(None)
    first = stepped(segments.select("key", "seg", "text", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"), *empty), none.cast("long"), none.cast("string"), none.cast("long"), none.cast("array<string>"))
    slim = lambda rows: rows.select(*at, "into", "c", "out", "n", F.size("types").alias("kinds"))
    known, last = slim(first), first
    speculated = first.select(*at, F.col("c").alias("c0"), F.col("out").alias("out0"), F.col("n").alias("n0"), F.col("types").alias("types0"))
    while not only_one:
        following = F.col("seg") + F.when(F.col("back"), -1).otherwise(1)
        met = last.select("key", "back", following.alias("seg"), F.col("out").alias("into"), "n", "types").dropDuplicates([*at, "into"])
        new = checkpointed(met.join(known, [*at, "into"], "left_anti").join(segments.select("key", "seg"), ["key", "seg"], "left_semi"))
        if new.isEmpty():
            break
        rows = new.join(speculated, at).join(segments, ["key", "seg"])
        last = stepped(rows, *(F.col(c) for c in ("c0", "out0", "n0", "types0")))
        known = known.unionByName(slim(last))
    return known


def _composed(rows: DataFrame, block: int) -> DataFrame:
    """Transitions of blocks of neighbouring segments, numbered as segments are."""

    columns = rows.columns

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        key, back = pdf["key"].iloc[0], bool(pdf["back"].iloc[0])
        by_seg: dict[int, dict[str, tuple]] = {}
        for seg, into, c, out, n, kinds in zip(*(pdf[x] for x in ("seg", "into", "c", "out", "n", "kinds")), strict=True):
            by_seg.setdefault(seg, {})[into] = (c, out, n, kinds)
        order = sorted(by_seg, reverse=back)
        made = []
        for start in by_seg[order[0]]:
            total, state, n, kinds = 0, start, 0, 0
            for seg in order:
                c, state, n, kinds = by_seg[seg][state]
                total += c
            made.append((key, back, order[0] // block, start, total, state, n, kinds))
        return pd.DataFrame(made, columns=columns)

    return rows.groupBy("key", "back", F.floor(F.col("seg") / block).alias("block")).applyInPandas(walk, rows.schema)


def mtld(turns: DataFrame, by: str = "speaker", segment: int = SEGMENT, block: int = BLOCK, least: float = LEAST) -> DataFrame:
    """``by``, mtld over a speaker's tokens in the order of conversation (as text) and turn, nulls last.

    The same value as :func:`mtld_of` for any ``segment`` and ``block``. Turns of one number follow each other by a hash
    of their texts. Null speakers are a speaker; one of fewer than 50 tokens, or of empty and null texts only, has
    null; an empty table gives no row. A very long text is cut into segments as a long conversation is. What passes between
    segments is the distinct tokens of one run, at most a speaker's vocabulary. Segments that never fall in step
    (one word for ever, a run longer than a segment) take further rounds, one for each state that is new.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    rows = turns.select(key.alias("key"), F.col("doc_id").cast("string").alias("doc"), F.col("turn_id").cast("long").alias("turn"), "text")
    speakers = rows.select("key").distinct()
    segments = checkpointed(_segments(rows.where(F.col("text").isNotNull()), segment))
    last = segments.agg(F.max("seg")).first()[0] or 0
    steps = _transitions(segments, least, only_one=last == 0)
    while last:
        steps, last = checkpointed(_composed(steps, block)), last // block
    whole = steps.where(F.col("into") == EMPTY)
    open_run = F.when(F.col("n") > 0, (1 - F.col("kinds") / F.col("n")) / F.lit(1 - least)).otherwise(F.lit(0.0))
    factors = whole.select("key", "back", (F.col("c") + open_run).alias("f"))
    tokens = segments.groupBy("key").agg(F.sum(F.size(F.split("text", " "))).alias("tokens"))
    length = F.when(F.col("f") > 0, F.col("tokens") / F.col("f")).otherwise(F.col("tokens").cast("double"))
    values = factors.join(tokens, "key").where(F.col("tokens") >= MIN_TOKENS).groupBy("key").agg((F.sum(length) / 2).alias("mtld"))
    name = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30))
    return speakers.join(values, "key", "left").select(name.alias(by), "mtld")
