"""The queries of the corpus operators, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbre.llm import bpe_automaton, conversation_repair, fingerprints, jaccard, line_dedup, mixing, packing, pii, quality_model, quality_rules, sharding, token_counts, vector_codes
from timbre.llm.common import documents

TOKENIZERS = "/opt/tokenizers"
#: The mixture goes that part of the way from the sources' own entropy to the greatest, and passes over no source more
#: often than that; it is as small as holds every document.
ENTROPY_GAIN, MAX_REPEATS = 0.75, 4.0


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer; the folder is the installed package's where there is one."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality_model.score(documents(spark, sf_dir), labels)


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_table(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    done = mixing.mixed(docs, places=True, entropy_gain=ENTROPY_GAIN, max_repeats=MAX_REPEATS)
    return done.select("doc_id", "source", mixing.n_words(F.col("text")).alias("n_words"), "epoch", "block", "place")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.even_tree(8)
    return sharding.shard(documents(spark, sf_dir), tree, sharding.grown(tree, 8))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.deduplicated(documents(spark, sf_dir).select("doc_id", "text"), tally=True)
    return done.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))


def op12_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.digests(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_counts": op5_token_counts,
    "op6_source_mixing": op6_source_mixing,
    "op7_sharding": op7_sharding,
    "op8_line_dedup": op8_line_dedup,
    "op9_pii": op9_pii,
    "op10_document_fingerprints": op10_document_fingerprints,
    "op11_vector_codes": op11_vector_codes,
    "op12_bpe_automaton": op12_bpe_automaton,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLES = {
    "op3_ngram_jaccard_join": jaccard.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op13_conversation_repair": conversation_repair.ORACLE,
}
