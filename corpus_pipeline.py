"""From raw documents to packed training sequences, stage by stage.

Each stage gets what its predecessor kept, as rows of ``documents``; the last gives the pieces of
the packed sequences. Between stages the rows are written to the cluster's shared folder and read
again, so a lost executor costs the work of one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from timbre.llm import jaccard, line_dedup, mixing, packing, quality_rules
from timbre.llm.registry import tokenizer_path
from timbre.session import shared_folder, table

#: The mixture goes that part of the way from the sources' own entropy to the greatest, and passes over no source more
#: often than that; every document is there at least once.
ENTROPY_GAIN, MAX_REPEATS = 0.25, 1.25


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose counts fail the base rules or lie outside their group's fences go, and so do null and
    empty texts; repeated rows go or stay together."""
    return quality_rules.filtered(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of lines go; a document that consists of such passages alone goes with them. Null texts
    stay null."""
    return line_dedup.deduplicated(docs, drop_emptied=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id; of repeated rows one. Texts
    without words are near nothing and stay."""
    return jaccard.without_copies(docs)


def mixing_of_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more: of equal texts under one id all are repeated alike. A null source is a source."""
    return mixing.mixed(docs, entropy_gain=ENTROPY_GAIN, max_repeats=MAX_REPEATS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences; null and empty texts are pieces of one id."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram jaccard join", near_copies),
    ("mixing sources", mixing_of_sources),
    ("best-fit packing", packed),
]

#: A tokenizer's ids and packing can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``. The last stage's folder stays, as the result is read from it."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _delete(spark, f"{folder}/{k - 1}")
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    """What a finished stage has read is no longer needed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
