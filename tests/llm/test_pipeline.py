"""The pipeline's rows against the stages' brute-force versions, one after the other."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from timbre.llm import common, components, jaccard, mixing, quality_rules, statistics
from timbre.llm.registry import tokenizer_path

from . import test_jaccard, test_line_dedup, test_mixing, test_quality

SF = "/root/testdata/sf0.001"


def good(rows):
    found = statistics.counts([t.encode() for _, t, *_ in rows])
    counted = [{"lang": r[2], "source": r[3], **{c: int(found[c][k]) for c in statistics.COUNTS}} for k, r in enumerate(rows)]
    fences = test_quality.brute_fences(counted, quality_rules.PRIOR)
    for r, c in zip(rows, counted, strict=True):
        inside = all(lo <= c[quality_rules.MEASURES[m][0]] / max(c[quality_rules.MEASURES[m][1]], 1) <= hi for m, (lo, hi) in fences.get((r[2], r[3]), {}).items())
        if c["n_words"] >= 20 and 100 * c["n_repeat_words"] <= 30 * c["n_words"] and inside:
            yield r


def brute(rows):
    rows = list(good(rows))
    texts = {i: t for i, t in test_line_dedup.brute([(r[0], r[1]) for r in rows])}
    rows = [(r[0], texts[r[0]], *r[2:]) for r in rows if texts[r[0]].strip(" \t\n\v\f\r") or texts[r[0]] == r[1]]
    component, _ = test_jaccard.brute([(r[0], r[1]) for r in rows])
    firsts = {i for i, n, c in component if n == 0 or c == i}
    rows = [r for r in rows if r[0] in firsts]
    words = Counter()
    for r in rows:
        words[r[3]] += len((r[1] or "").encode().split())
    own = test_mixing.entropy([x / sum(words.values()) for x in words.values()])
    target = own + corpus_pipeline.ENTROPY_GAIN * (1 - own)
    mixed = test_mixing.brute([(r[0], r[1], r[3]) for r in rows], 1024, corpus_pipeline.MAX_REPEATS, target)
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for (i, t, _, _), n in mixed.items():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            piece = ids[at : at + 2048]
            yield from [(i, k, at, len(piece), zlib.crc32(piece.tobytes()))] * n


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(brute(rows))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        ends = [o + n for o, n in sorted(members)]
        assert [o for o, _ in sorted(members)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_mixing_has_a_temperature(spark, sf):
    """Sources are neither as they are nor all equal."""
    rows = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("total"))
    assert 0 < mixing.solved(rows.cache(), corpus_pipeline.MAX_REPEATS, entropy_gain=corpus_pipeline.ENTROPY_GAIN).exponent < 1


def test_stages_keep_columns_and_bear_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 as node", "'x' as gone")
    for some in (docs.limit(40), docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            some = stage(spark, some, SF)
            assert some.columns == docs.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, some, SF)
        assert packed.columns[:2] == ["doc_id", "piece"]
        packed.count()


def test_near_copies_keep_small_tables_in_few_tasks(spark, monkeypatch):
    """The n-gram stage of a session with many shuffle partitions doesn't deal small tables to all of them."""
    parts, own = [], common.checkpointed

    def counted(df):
        done = own(df)
        parts.append(done.rdd.getNumPartitions())
        return done

    for module in (common, components, jaccard):
        monkeypatch.setattr(module, "checkpointed", counted)
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    known = {k: spark.conf.get(k) for k in conf}
    base = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join([*base[:60], f"x{i}", *base[60:]]), "en", "s") for i in range(60)] + [(100 + i, " ".join(f"u{i}x{k}" for k in range(30)), "en", "s") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    finally:
        for k, v in known.items():
            spark.conf.set(k, v)
    assert got == [0, *range(100, 120)]
    assert len(parts) > 15 and sum(n < 32 for n in parts) > 0.5 * len(parts), parts
