import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from timbre.llm import common, components, jaccard


def shingle_set(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def roots(n, edges):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in edges:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute(rows):
    sets, where = [shingle_set(t) for _, t in rows], defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            where[x].add(i)
    edges = set()
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in where[x] if j > i)
        edges |= {(i, j) for j, n in common.items() if 100 * n >= 80 * (len(s) + len(sets[j]) - n)}
    found, members = roots(len(rows), edges), defaultdict(list)
    for i, r in enumerate(found):
        members[r].append(rows[i][0])
    least = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return Counter((rows[i][0], len(sets[i]), least[r]) for i, r in enumerate(found)), len(members)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.randrange(2)] = [f"e{rng.randrange(10**6)}"]
    return " ".join(words)


def random_rows(seed, n=260):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = " ".join(f"p{i}" for i in range(70))
    bases = [[word() for _ in range(rng.randrange(20, 160))] for _ in range(8)]
    rows = [(None, "a null id of few words"), (0, None), (1, ""), (2, " \n "), (3, "one"), (4, "One"), (5, "one two"), (6, "one two"), (7, "1 2 3 4 5 6 7 8"), (7, "1 2 3 4 5 6 7 8 9"), (7, "1 2 3 4 5 6 7 8"), (8, "É a b c d"), (9, "é a b c d")]
    for i in range(10, n):
        kind = rng.random()
        if kind < 0.35:
            text = edited(rng, bases[0], rng.randrange(9))
        elif kind < 0.6:
            text = edited(rng, rng.choice(bases), rng.randrange(7))
        elif kind < 0.8:
            text = " ".join([*(word() for _ in range(rng.randrange(30))), passage, *(word() for _ in range(rng.randrange(60)))])
        else:
            text = " ".join(word() for _ in range(rng.randrange(1, 300)))
        rows.append((i, text))
    return rows + rows[-4:]


@pytest.mark.parametrize(("seed", "common", "block", "broadcast"), [(0, 100_000, 1000, 10**6), (1, 0, 7, 10**6), (2, 20, 20, 0)])
def test_equals_brute_force(spark, monkeypatch, seed, common, block, broadcast):
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(jaccard, "LEAST_COUNT", 3)
    rows = random_rows(seed)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, hash string").repartition(4)
    got = Counter(map(tuple, jaccard.component_table(docs).collect()))
    want, groups = brute(rows)
    assert got == want
    left = jaccard.without_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == groups
    assert Counter(r.doc_id for r in left.collect() if r.doc_id != 7) <= Counter(i for i, _, c in want if i == c)


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = Counter(map(tuple, jaccard.component_table(docs).collect()))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])[0]
    assert jaccard.component_table(docs.limit(0)).count() == 0 and jaccard.without_copies(docs.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=40), st.lists(st.integers(0, 60), max_size=40))
def test_filters_lose_no_link(a, b):
    texts = [" ".join(map(str, x)).encode() for x in (a, b)]
    s, t = (shingle_set(x.decode()) for x in texts)
    link = bool(s and t) and 100 * len(s & t) >= 80 * len(s | t)
    assert jaccard.Verifier().linked(0, texts[0], 1, texts[1]) == link
    if link:
        x, y = map(jaccard.shingle_hashes, texts)
        assert np.intersect1d(x[: jaccard.prefix_length(len(x))], y[: jaccard.prefix_length(len(y))]).size
        d = jaccard._distances([jaccard.parity(x), jaccard.parity(y)], np.array([len(x), len(y)]), 80)
        assert d[0, 1] != jaccard._FAR


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9000), st.integers(0, 3000), st.integers(0, 3000))
def test_parities_bound_differences(common, own, other):
    rng = np.random.default_rng(common * 31 + own)
    h = np.unique(rng.integers(0, 2**63, common + own + other).astype(np.uint64))
    x, y = h[: common + own], np.concatenate([h[:common], h[common + own :]])
    p, q = jaccard.parity(x), jaccard.parity(y)
    d = jaccard.difference(p, q)
    assert d <= len(np.setxor1d(x, y))
    matrix = jaccard._distances([p, q, p], np.array([len(x), len(y), len(x)]), 10)
    assert matrix[0, 1] == matrix[1, 0] and matrix[0, 1] in (d, jaccard._FAR) and matrix[0, 2] in (0, jaccard._FAR)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(90)] + [(200, 200 + i) for i in range(1, 60)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    found = roots(400, edges)
    least = {}
    for i, r in enumerate(found):
        least.setdefault(r, i)
    assert got == {i: least[found[i]] for e in edges for i in e if e[0] != e[1]}


def test_small_tables_are_in_few_tasks(spark, monkeypatch):
    """What lies on disk between steps follows the rows: pairs, links and edges of some hundred texts aren't dealt
    to as many tasks as the session has for large tables."""
    parts, own = [], common.checkpointed

    def counted(df):
        done = own(df)
        parts.append(done.rdd.getNumPartitions())
        return done

    for module in (common, components, jaccard):
        monkeypatch.setattr(module, "checkpointed", counted)
    conf = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    known = {k: spark.conf.get(k) for k in conf}
    rows = random_rows(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = Counter(map(tuple, jaccard.component_table(docs).collect()))
        assert components.components(spark.range(40).selectExpr("id AS a", "id + 1 AS b")).rdd.getNumPartitions() == 1
    finally:
        for k, v in known.items():
            spark.conf.set(k, v)
    assert got == brute(rows)[0]
    assert len(parts) > 20 and sum(n < 32 for n in parts) > 0.75 * len(parts), parts


def test_few_keeps_large_tables_dealt(spark):
    rows = spark.range(100, numPartitions=10)
    assert [common.few(rows, n, 20).rdd.getNumPartitions() for n in (0, 1, 20, 21, 100, 10**9)] == [1, 1, 1, 2, 5, 10]
    assert common.compact(rows).rdd.getNumPartitions() == 1 and common.compact(rows, 10**9).count() == 100


@pytest.mark.parametrize("n", [300, 1000, 5000, 20_000])
def test_further_orders_part_disjoint_sets_of_any_size(n):
    """Few disjoint sets share a token's bits under each further order; linked ones always do, also across widths."""
    rng = np.random.default_rng(n)
    share = jaccard._sharing(80)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(24)]
    told = [jaccard.further(s) for s in sets]
    passed = [share(told[i], told[j], len(sets[i]), len(sets[j])) for i in range(24) for j in range(i)]
    assert np.mean(passed) < 0.01
    for cut in (0, n // 10):
        near = np.sort(np.concatenate([sets[0][cut:], rng.integers(0, 1 << 63, n // 12).astype(np.uint64)]))
        assert share(told[0], jaccard.further(near), len(sets[0]), len(near))


def test_a_join_of_few_pairs_reads_all_sets_in_many_tasks(spark):
    """Ten pairs among many sets: the sets are read in the tasks that they lie in, and only what is wanted is put together."""
    nodes = spark.range(0, 100_000, 1, 16).selectExpr("id as node", "named_struct('id', id, 'hash', id) as first")
    rows = spark.createDataFrame([(i, i, "a b c d e f g") for i in range(20)], "id long, hash long, text string")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(10)], "a long, b long")
    seen, own = [], jaccard.compact
    try:
        jaccard.compact = lambda df, most=None: (seen.append((df.rdd.getNumPartitions(), most)), own(df, most))[1]
        jaccard.verified(pairs, nodes, rows, 5, 80).count()
    finally:
        jaccard.compact = own
    assert seen[0] == (16, None), seen


@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=900), st.sets(st.integers(0, 2**64 - 1), max_size=60))
@settings(max_examples=30, deadline=None)
def test_folded_parities_bound_differences(common, own):
    x, y = (np.array(sorted(s), np.uint64) for s in (common, common ^ own))
    a, b = jaccard.folded(jaccard.parity(x)), jaccard.folded(jaccard.parity(y))
    assert 8 * len(a) >= jaccard.LEAST_BITS and 2 * len(a) <= max(len(jaccard.parity(x)), jaccard.LEAST_BITS // 4)
    assert jaccard.difference(a, b) <= jaccard.difference(jaccard.parity(x), jaccard.parity(y)) <= len(common ^ (common ^ own))


def test_sketches_travel_for_pairs_of_like_sizes_only(spark, monkeypatch):
    """A text that holds another one shares its tokens; sizes tell that they don't link before any sketch is fetched."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words[:100]), " ".join([*words, "end"]), " ".join(words[:60])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met, plain = [], jaccard.screened
    monkeypatch.setattr(jaccard, "screened", lambda pairs, *rest: met.extend(map(tuple, pairs.collect())) or plain(pairs, *rest))
    assert {r.doc_id: r.component_id for r in jaccard.component_table(docs).collect()} == {0: 0, 1: 1, 2: 0, 3: 3}
    assert len(met) == 1


def test_words_are_hashed_together(monkeypatch):
    """The sets of many texts, hashed as one, are those of each text's words; only words of more than 64 bytes are hashed one by one."""
    rng = random.Random(4)
    alone = []
    digest = jaccard.xxhash.xxh64_intdigest
    monkeypatch.setattr(jaccard.xxhash, "xxh64_intdigest", lambda data, *a: alone.append(len(data)) or digest(data, *a))
    vocabulary = ["".join(rng.choices("abAB\u00e4\u0416\0", k=k)) for k in (1, 2, 3, 7, 8, 9, 15, 16, 17, 63) for _ in range(3)]
    blanks = [" ", "\t", "\n", "\r\n", "\v\f", "  "]
    texts = ["", " ", "one", "\x1c\x85", *("".join(w + rng.choice(blanks) for w in rng.choices(vocabulary, k=rng.choice((1, 4, 5, 6, 80)))) for _ in range(60))]
    texts = [t.encode() for t in [*texts, *(t.swapcase() for t in texts[:9] if t.isascii())]]
    short = [t for t in texts if all(len(w) <= jaccard.LONG_WORD for w in t.split())]
    many = list(jaccard.shingles_of(short))
    assert not alone and len(many) == len(short) > 20
    texts.append(b"x" * 65 + b" " + b"y" * 64)
    many = list(jaccard.shingles_of(texts))
    assert 65 in alone and 64 not in alone
    seen = {}
    for text, hashes in zip(texts, many, strict=True):
        words = [w.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for w in re.findall(rb"[^\x20\x09-\x0D]+", text)]
        sets = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
        assert len(hashes) == len(sets) and (np.diff(hashes.astype(object)) > 0).all()
        assert np.array_equal(hashes, jaccard.shingle_hashes(text))
        assert seen.setdefault(frozenset(sets), hashes.tobytes()) == hashes.tobytes()
    assert len(set(seen.values())) == len(seen)
