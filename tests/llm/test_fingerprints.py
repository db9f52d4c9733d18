import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from timbre.llm import fingerprints as fp

EDGE = [None, "", "a", "ab", "abc", "é🙂" * 3, "tie tie tie", "tie tie tie", "long text " * 3000, "x" * 40, "twelve chars"]
text = st.text(alphabet="abé🙂", max_size=40)


@settings(max_examples=150, deadline=None)
@given(text, text)
def test_spans_and_extensions(a, b):
    one, two = fp.PrefixHash(fp.code_points(a)), fp.PrefixHash(fp.code_points(b))
    for i in range(0, len(a) + 1, 3):
        for j in range(0, len(b) + 1, 2):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            assert one.extension(i, two, j) == n
    spans = one.spans(3)
    assert [int(x) for x in spans] == [one.span(i, i + 3)[0] for i in range(len(a) - 2)]


@settings(max_examples=150, deadline=None)
@given(text, text)
def test_edited_equals_hashing_anew(a, b):
    changed, common = fp._Text(a).edited(b)
    new = changed.text
    assert new == a[: len(a) - len(a) // 3] + b[: len(a) // 3]
    assert str(changed.print) == fp.fingerprint(new)
    assert common == next((i for i, (x, y) in enumerate(zip(a, new)) if x != y), min(len(a), len(new)))


def test_likeness():
    a = " ".join(map(str, range(400)))
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint(a)) == 1
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint("")) == 0
    assert fp.likeness(fp.fingerprint(None), fp.fingerprint("")) == 1
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint(a[:-9] + "changed")) > 0.8
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint(" ".join(map(str, range(5000, 5400))))) < 0.3


def test_prefix_places():
    assert fp.places(0) == [] and fp.places(9)[:8] == [1, 2, 3, 4, 5, 6, 7, 8]
    a = "".join(map(str, range(900)))
    for n in (1, 7, 60, 700, 2000):
        b = a[:n] + "x" + a[n + 1 :]
        found = fp._Text(a).print.common_prefix(fp._Text(b).print)
        assert n / 1.13 - 1 <= found <= n


def test_text_ids_raise(spark):
    with pytest.raises(ValueError, match="whole numbers"):
        fp.fingerprint_documents(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def brute(rows):
    import xxhash

    def order(r):
        h = int.from_bytes(xxhash.xxh64(r[1].encode(), seed=42).digest(), "big") if r[1] is not None else 42
        return (r[0] if r[0] is not None else -(1 << 63), h - (1 << 64) if h >= 1 << 63 else h)

    rows = sorted(rows, key=order, reverse=True)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after = t or "", after or ""
        new = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, b, c = map(fp.fingerprint, (t, new, after))
        yield (i, len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, c))


def test_documents_equal_brute_force(spark):
    rows = [(None if k == 3 else 5 if k % 4 == 1 else k * 7, t) for k, t in enumerate(EDGE)]
    for some in (rows, rows[:1], [], [(1, "same")] * 5, [(1, f"one id {i}") for i in range(90)], [(i, f"text {i} " * (i % 7)) for i in range(300)]):
        docs = spark.createDataFrame([(*r, 1, "x") for r in some], "doc_id long, text string, bucket int, fingerprint string").repartition(3)
        got = [tuple(r)[:7] for r in fp.fingerprint_documents(docs).collect()]
        assert sorted(got, key=repr) == sorted(brute(some), key=repr)


def test_edits_stay_nearer_than_neighbours(spark):
    got = fp.fingerprint_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).toPandas()
    long = got[got.n_chars > 100]
    assert (long.near_edited > long.near_next).mean() > 0.99 and (got.common_prefix >= got.n_chars - got.n_chars // 3).all()
    assert np.isclose(long.near_edited.mean(), 0.63, atol=0.06) and long.near_next.median() < 0.1
    short = got[got.n_chars.between(8, 60)]
    assert (short.near_edited >= 0.5).all()
