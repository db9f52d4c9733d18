"""Streams of turns, beyond what is asked of batches: scores, and bursts by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbre.operators import scorer


def scored(turns: DataFrame, model: dict) -> DataFrame:
    """A stream (or table) of turns with the score of each text: a narrow projection without state."""
    return scorer.score_texts(turns, model)


def sessions(turns: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """speaker, start, end, length: runs of a speaker's turns with no pause longer than ``gap``."""
    rows = turns.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "speaker").agg(F.count("*").alias("length"))
    return rows.select("speaker", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "length")
