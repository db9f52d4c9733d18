import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from timbre.llm import packing, token_counts, vocab
from timbre.llm.registry import tokenizer_path

WORDS, BYTES = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
ODD = ["", " ", "a", "don't 'S 'll''re", "été ÀÉ œ ﬁ é", "x y\u0085z", "a\x1cb\x00c", "<|endoftext|> x<|startoftext|>", "  two\n\n three \t", "½²3 ٣ 一二", "“q” — 🙂 İ", "\r\n \r", "ſ K"]
CAPACITY = 64
bytes_of = vocab.le_bytes


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sdlé.Aß0½|-"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_cached_pieces_equal_the_library(text):
    for path, cut, lower in ((WORDS, vocab.WORD_PIECES, True), (BYTES, vocab.BYTE_PIECES, False)):
        got = vocab.PieceCache(path, cut, lower, list).values([text])[0]
        assert sum(got, []) == vocab.tokenizer(path).encode(text, add_special_tokens=False).ids
    words = vocab.WordEndCache(WORDS, vocab.WORD_PIECES, True)
    assert b"".join(words.values([text])[0]) == bytes_of(vocab.tokenizer(WORDS).encode(text, add_special_tokens=False).ids)


def rows(spark, texts):
    return spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, length int, part string")


def test_counts(spark, libraries):
    texts = [*ODD, None, "one " * 3000, "tie", "tie"]
    got = {r.doc_id: r for r in token_counts.count_tokens(rows(spark, texts), BYTES).collect()}
    for i, t in enumerate(texts):
        n = len(libraries[1].encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512)
    assert token_counts.count_tokens(rows(spark, []), BYTES).count() == 0


def test_the_table_holds_what_is_frequent(spark):
    """Lengths above 1 are in the table, it is bounded, and it answers nearly all look-ups."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = token_counts.frequent_pieces(docs, BYTES)
    table = token_counts.frequent_lengths(pieces, BYTES)
    lengths = np.frombuffer(table[1], "<u2")
    assert len(lengths) <= token_counts.TABLE_ENTRIES and (lengths > 1).mean() > 0.3
    known, met = set(pieces), [p for r in docs.select("text").collect() for p in vocab.BYTE_PIECES.findall(r.text)]
    assert sum(p in known for p in met) / len(met) > 0.8
    few = set(token_counts.frequent_pieces(docs, BYTES, sample=100, entries=50))
    assert len(few) == 50 and few < known
    assert token_counts.frequent_lengths(["a" * 5_000_000, "ab"], BYTES)[1] == b"\1\0"


def test_packing_round_trip(spark, libraries):
    texts = [*ODD, None, "one two, " * 100, "tie", "tie", *("word " * n for n in range(60))]
    got = packing.pack(rows(spark, texts).repartition(3), WORDS, CAPACITY).collect()
    docs, bins = {}, {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array([*libraries[0].encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(docs[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in pieces] == [
            (k, at, len(c := ids[at : at + CAPACITY]), zlib.crc32(c.tobytes())) for k, at in enumerate(range(0, len(ids), CAPACITY))
        ]
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= CAPACITY
    assert len(bins) <= -(-sum(r.length for r in got) // CAPACITY) + 1
    assert packing.pack(rows(spark, []), WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=14), st.integers(0, 40))
def test_fullest_is_optimal(lengths, room):
    counts = np.bincount(np.array(lengths, int), minlength=64)
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums}
    took = packing.fullest(counts, room)
    assert sum(x * m for x, m in took) == max(s for s in sums if s <= room)
    assert all(m <= counts[x] for x, m in took)
