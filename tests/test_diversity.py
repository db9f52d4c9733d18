"""MTLD in segments against the plain fold over a speaker's whole stream."""

import random

import pytest

from timbre.operators import diversity

TURNS = "doc_id string, turn_id int, speaker string, text string"


def _turns():
    rng = random.Random(5)
    rows = []
    for speaker, vocabulary in (("few", 12), ("some", 90), ("many", 4000), (None, 40)):
        for doc in range(6):
            rows += [(f"d{doc}", turn, speaker, " ".join(f"w{chr(97 + w % 26)}x{chr(97 + w // 26 % 26)}{chr(97 + w // 676)}" for w in (int(rng.paretovariate(0.6)) % vocabulary for _ in range(rng.randint(0, 60))))) for turn in range(10)]
    rows += [("d0", turn, "same", "again") for turn in range(101)]  # never in step: restarts at every second token
    rows += [("d0", 0, "once", " ".join("one" + chr(97 + i % 26) + chr(97 + i // 26) for i in range(400)))]  # no restart at all
    rows += [("d0", 3, "long", "the cat sat on the mat and a dog " * 300), ("d0", None, "long", "last of all"), (None, 1, "long", "after it"), ("d0", 4, "long", None)]
    rows += [("d1", 0, "brief", "hello there"), ("d1", 1, "mute", ""), ("d1", 2, "mute", None)]
    rng.shuffle(rows)
    return rows


def _plain(rows):
    streams = {}
    for doc, turn, speaker, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1] is None, r[1] or 0)):
        streams.setdefault(speaker, []).extend((text or "").split())
    return {k: diversity.mtld_of(v) for k, v in streams.items()}


@pytest.mark.parametrize(("segment", "block", "partitions"), [(16_384, 1000, 3), (64, 4, 5), (37, 3, 2), (500, 1000, 1)])
def test_mtld_is_the_plain_fold_for_any_segments(spark, segment, block, partitions):
    rows = _turns()
    df = spark.createDataFrame(rows, TURNS).repartition(partitions)
    found = {r.speaker: r.mtld for r in diversity.mtld(df, segment=segment, block=block).collect()}
    want = _plain(rows)
    assert found.keys() == want.keys()
    assert found["mute"] is None and found["brief"] is None and want["once"] == 400
    for k, v in want.items():
        assert found[k] == (pytest.approx(v, rel=1e-12) if v is not None else None), k


def test_mtld_of_an_empty_table(spark):
    found = diversity.mtld(spark.createDataFrame([], TURNS))
    assert found.columns == ["speaker", "mtld"] and found.collect() == []


def test_no_segment_is_longer_than_asked(spark):
    rows = spark.createDataFrame([("k", "d", 1, "a b c " * 100), ("k", "d", 2, "Z."), ("k", "e", 0, "y " * 9), ("l", "d", 1, "q"), ("l", "d", 2, "...")], "key string, doc string, turn long, text string")
    pieces = diversity._segments(rows, 16).collect()
    sizes = {(r.key, r.seg): len(r.text.split(" ")) for r in pieces}
    assert sizes == {**{("k", i): 16 for i in range(19)}, ("k", 19): 6, ("l", 0): 1}
    stream = " ".join(r.text for r in sorted((r for r in pieces if r.key == "k"), key=lambda r: r.seg)).split(" ")
    assert stream == ["a", "b", "c"] * 100 + ["z"] + ["y"] * 9


def test_a_fold_falls_in_step_with_the_speculative_one():
    rng = random.Random(1)
    tokens = [f"w{rng.randint(0, 60)}" for _ in range(3000)]
    fresh, carried = diversity._Run(tokens), diversity._Run(tokens, {"other", "word"}, 2)
    ends = [set(), set()]
    for run, seen in zip((fresh, carried), ends):
        while run.advance():
            seen.add(run.at)
    common = min(ends[0] & ends[1])
    assert common < 1500 and {e for e in ends[0] if e > common} == {e for e in ends[1] if e > common}
