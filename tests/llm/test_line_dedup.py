import functools
import hashlib
import random
import re
import time
from collections import Counter

import duckdb
import pytest
import xxhash

from timbre.llm import line_dedup, registry


@functools.cache
def cut(text):
    """The text's lines, the numbers of those with text, and its chunks as ranges of places among these."""
    lines = (text or "").split("\n")
    full = [i for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
    h = [int(hashlib.md5(lines[i].encode()).hexdigest()[:8], 16) for i in full]
    r = [1 << 32] + [(31 * a + b) % (1 << 32) for a, b in zip(h, h[1:], strict=False)]
    ends = [i for i in range(1, len(full) - 2) if r[i - 1] > r[i] < r[i + 1]] + [len(full) - 1] * bool(full)
    return lines, full, list(zip([0, *(e + 1 for e in ends)], ends, strict=False))


def chunks(text):
    lines, full, found = cut(text)
    return [lines[full[a] : full[b] + 1] for a, b in found]


def brute(rows):
    def order(r):
        h = xxhash.xxh64_intdigest(r[1].encode(), 42) if r[1] is not None else 42
        return (r[0] is None, r[0] or 0, h - (1 << 64) if h >= 1 << 63 else h)

    firsts, out = {}, {}
    for i, text in sorted(set(rows), key=order):
        lines, full, found = cut(text)
        gone = set()
        for k, (a, b) in enumerate(found):
            chunk = "\n".join(lines[full[a] : full[b] + 1])
            if b == a or (other := firsts.setdefault(chunk, (i, text, k))) == (i, text, k):
                continue
            theirs, their_full, their_found = cut(other[1])
            c, d = their_found[other[2]]
            x, y, u, v = a, b, c, d
            low, low2 = (f[n - 1][0] if n else m for f, n, m in ((found, k, a), (their_found, other[2], c)))
            high, high2 = (f[n + 1][1] if n + 1 < len(f) else m for f, n, m in ((found, k, b), (their_found, other[2], d)))
            while x > low and u > low2 and lines[full[x - 1]] == theirs[their_full[u - 1]]:
                x, u = x - 1, u - 1
            while y < high and v < high2 and lines[full[y + 1]] == theirs[their_full[v + 1]]:
                y, v = y + 1, v + 1
            for p in range(x, y + 1):
                gone |= set(range(full[p], full[p + 1] if p + 1 < len(full) else len(lines)))
        out[i, text] = None if text is None else "\n".join(x for n, x in enumerate(lines) if n not in gone)
    return Counter((i, out[i, t]) for i, t in rows)


def random_rows(seed):
    rng = random.Random(seed)
    passage = [f"shared line {i}" for i in range(14)]
    rows = [(1, None), (2, ""), (3, "one line"), (3, "two\nlines"), (None, "two\nlines"), (4, "\n\n\n"), (4, "\n\n\n"), (6, "\u2028\n \n\x85\n\n\n x\n"), (5, "a\nb\n" * 3000)]
    for i in range(60):
        lines = [f"own {rng.randrange(10**6)}" for _ in range(rng.randrange(12))]
        if rng.random() < 0.6:
            lines[len(lines) // 2 : 0] = passage[rng.randrange(3) :]
        rows.append((i % 50, "\n".join(lines)))
    return rows + rows[-5:]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize(("broadcast", "copies"), [(0, 3), (10**6, 256)])
def test_equals_brute_force(spark, monkeypatch, seed, broadcast, copies):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(line_dedup, "COPIES", copies)
    rows = random_rows(seed)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, gone string, id int").repartition(3)
    got = line_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == brute(rows)
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0


def test_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    got = registry.op8_line_dedup(spark, d)
    con = duckdb.connect()
    con.execute(f"create view documents as from '{d}/documents.parquet'")
    want = con.execute(line_dedup.ORACLE)
    names = [x[0] for x in want.description]
    want = want.fetchall()
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want)
    assert sum(r[2] for r in want) > 0


def test_shift_resistance():
    passage = "\n".join(f"passage line {i}" for i in range(40))
    a, b = chunks(passage), chunks("new first line\nanother\n" + passage)
    assert len({"\n".join(c) for c in a} & {"\n".join(c) for c in b}) >= len(a) - 1


def test_no_python_in_the_plan(spark):
    plan = registry.op8_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_planted_passages_go_whole(spark):
    """Share of the second copy's lines that goes, over passages between lines of their own."""
    rng = random.Random(2)
    for length, least in ((8, 0.45), (12, 0.85), (20, 0.95), (40, 0.97)):
        passages = [[f"p{t} {j} {rng.random()}" for j in range(length)] for t in range(150)]
        own = lambda: [f"own {rng.random()}" for _ in range(rng.randrange(1, 12))]
        texts = ["\n".join(own() + p + own()) for _ in range(2) for p in passages]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = line_dedup.deduplicated(docs, tally=True).where("doc_id >= 150").selectExpr("sum(n_removed_lines)").first()[0] or 0
        assert least * 150 * length <= got <= 150 * length, (length, got / 150 / length)


def test_long_texts_take_linear_time(spark):
    texts = ["\n".join(f"line {i}" for i in range(200_000)), "x\n" * 200_000, "\n".join(f"line {i // 7}" for i in range(200_000)), "a b " * 250_000]
    docs = spark.createDataFrame(list(enumerate(texts + texts)), "doc_id long, text string")
    line_dedup.deduplicated(docs.limit(1)).count()
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.deduplicated(docs, tally=True).select("doc_id", "n_lines", "n_removed_lines").collect()}
    assert time.time() - began < 90
    assert [got[i].n_removed_lines for i in (0, 4, 5)] == [0, 200_000, 200_001]
