import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from timbre.llm import quality_model, quality_rules, statistics

SF = "/root/testdata/sf0.001"
EDGE = [None, "", " \n\n ", "a b", "x " * 4000, "one two three four five six seven eight " * 4, "tie\ntie\n \n tie", "É à b #*$ <|> [0]", "\v\f\x1cq"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t#é \x1c"), max_size=120))
def test_counts(text):
    got = statistics.counts([text.encode()])
    assert tuple(int(got[c][0]) for c in statistics.COUNTS[:5]) == brute(text)


def brute_fences(rows, prior):
    """Fences from counts of the bucket that each value lies in; each group with rows in its parent's proportions."""
    g, some = quality_rules.GAMMA, [r for r in rows if r["n_words"]]

    def bucket(r, m):
        over, under, _ = quality_rules.MEASURES.get(m, ("n_words", None, None))
        v = r[over] / (max(r[under], 1) if under else 1)
        return math.ceil(math.log(v) / math.log(g)) if v > 0 else None

    def blended(own, parent):
        total, size = sum(own.values()), sum(parent.values())
        return {b: own[b] + (prior * parent[b] / size if size else 0) for b in set(own) | set(parent)} if total else {}

    def quantile(counts, q):
        upto, total = 0.0, sum(n for b, n in counts.items() if b is not None)
        for b in sorted(b for b in counts if b is not None):
            upto += counts[b]
            if upto >= total * (q - 1e-9):
                return 2 * g**b / (g + 1)

    out = defaultdict(dict)
    for m, (_, _, kind) in (quality_rules.MEASURES | {quality_rules.LENGTH: (None, None, None)}).items():
        overall, langs, groups = Counter(bucket(r, m) for r in some), defaultdict(Counter), defaultdict(Counter)
        for r in some:
            langs[r["lang"]][bucket(r, m)] += 1
            groups[r["lang"], r["source"]][bucket(r, m)] += 1
        for key, own in groups.items():
            counts = blended(own, Counter(blended(langs[key[0]], overall)))
            there, every = sum(n for b, n in counts.items() if b is not None), sum(counts.values())
            lo, mid, hi = (quantile(counts, q) if there else math.inf for q in (0.15, 0.5, 0.85))
            out[key][m] = kind, lo, mid, hi, there, every
    limits = {}
    for key, found in out.items():
        length = found.pop(quality_rules.LENGTH)[2]
        limits[key] = {}
        for m, (kind, lo, mid, hi, there, every) in found.items():
            above = (hi + 5 * (hi - mid)) * g * g if there else math.inf
            below = (lo - 5 * (mid - lo)) / g / g if there else 0.0
            if kind == "presence" and there and there <= (0.2 + 1e-9) * every:
                above = max(lo / 2, 8 / length)
            limits[key][m] = (below if kind == "range" else 0.0, above)
    return limits


def test_fences_follow_their_sources(spark):
    """The same text is kept where its symbols are usual and dropped where they are not."""
    prose = " ".join(f"word{j}" for j in range(200))
    code = " ".join(f"name{j}" + " &" * (j % 5 == 0) for j in range(200))
    rows = [(i, f"{code} {i}", "en", "code") for i in range(300)] + [(1000 + i, f"{prose} {i}", "en", "prose") for i in range(300)]
    rows += [(2000, code + " x", "en", "code"), (2001, code + " x", "en", "prose")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.verdicts(docs).collect()}
    assert kept[2000] and not kept[2001] and all(kept[i] for i in (*range(300), *range(1000, 1300)))
    counted = statistics.measured(docs, ["lang", "source", "text"])
    limits = {r.source: r for r in quality_rules.fences(quality_rules.sketches(counted)).collect()}
    assert limits["code"].hi_symbols > limits["prose"].hi_symbols
    assert limits["code"].hi_word_length != limits["prose"].hi_word_length
    assert sorted(r.doc_id for r in quality_rules.filtered(docs).select("doc_id").collect()) == sorted(i for i, k in kept.items() if k)


def test_fences_differ_between_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    limits = quality_rules.fences(quality_rules.sketches(statistics.measured(docs, ["lang", "source", "text"]))).toPandas()
    for m in quality_rules.MEASURES:
        assert limits[f"hi_{m}"].nunique() > 3, m


@pytest.mark.parametrize("prior", [0, 5, 50])
def test_verdicts_equal_brute_force(spark, prior):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    edge = spark.createDataFrame([(i, t, [None, "en"][i % 2], None, 0) for i, t in enumerate(EDGE)], docs.schema)
    docs = docs.union(edge).union(edge).selectExpr("*", "1 as base_failed", "'x' as hi_symbols")
    texts = docs.select("doc_id", "text", "lang", "source").toPandas()
    found = statistics.counts([(t or "").encode() for t in texts.text])
    rows = [{"lang": None if pd.isna(a) else a, "source": None if pd.isna(b) else b, "i": i, **{c: int(found[c][k]) for c in statistics.COUNTS}} for k, (i, _, a, b) in enumerate(texts.itertuples(index=False))]
    fences, want = brute_fences(rows, prior), Counter()
    for r, text in zip(rows, texts.text, strict=True):
        assert tuple(r[c] for c in statistics.COUNTS[:5]) == brute(text)
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        limits = fences.get((r["lang"], r["source"]))
        kept = not failed and limits is not None and all(lo <= r[quality_rules.MEASURES[m][0]] / max(r[quality_rules.MEASURES[m][1]], 1) <= hi for m, (lo, hi) in limits.items())
        want[(r["i"], *(r[c] for c in statistics.COUNTS[:5]), failed, kept)] += 1
    got = Counter(map(tuple, quality_rules.verdicts(docs, prior).collect()))
    assert got == want
    kept = quality_rules.filtered(docs, prior)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i: n for (i, *_, k), n in want.items() if k for n in [n]})


def test_fences_have_no_jump_by_size(spark):
    """A source of 199, 200 and 201 rows has nearly the same fences, between its language's and its own."""
    rows = lambda n: [(i, " ".join(["word"] * 30) + " ab" * (i % 40), "en", "big") for i in range(3000)] + [(9000 + i, " ".join(["longerword"] * 30) + " ab" * (i % 20), "en", "new") for i in range(n)]
    fence = []
    for n in (3, 199, 200, 201, 2500):
        docs = spark.createDataFrame(rows(n), "doc_id long, text string, lang string, source string")
        limits = {r.source: r.hi_word_length for r in quality_rules.fences(quality_rules.sketches(statistics.measured(docs, ["lang", "source"]))).collect()}
        fence.append(limits["new"])
    assert max(fence[1:4]) - min(fence[1:4]) < 0.1 * fence[2] and len({round(x, 6) for x in (fence[0], fence[2], fence[4])}) == 3


def test_rules_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert quality_rules.verdicts(docs).count() == 0 and quality_rules.filtered(docs).count() == 0


def test_clean_documents_stay_and_junk_goes(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.verdicts(docs).join(labels, "doc_id").toPandas()
    assert not got[got.quality == 0].kept.mean() > 0.02
    assert got[(got.quality == 1) & ~got.base_failed].kept.mean() > 0.98


def test_forest_equals_a_walk_of_its_nodes():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    forest = quality_model.fit(x, y, trees=20)
    scores = forest.scores(x)
    assert ((scores > 0.5) == y).mean() > 0.97
    for r in range(0, 600, 37):
        total = forest.base
        for f, c, leaf in zip(forest.feature, forest.cut, forest.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if x[r, f[node]] > c[node] else 1)
            total += leaf[node - len(f)]
        assert abs(1 / (1 + math.exp(-total)) - scores[r]) < 1e-12


def test_classifier(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.score(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and ((got.score >= 0.3) == got.predicted).all()
    held = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95
    edge = spark.createDataFrame([(None if i == 1 else i, t, 1) for i, t in enumerate(EDGE)], "doc_id long, text string, score int")
    assert quality_model.score(edge.union(edge), labels).count() == 2 * len(EDGE)
    assert quality_model.score(edge.limit(0), labels).count() == 0
    none = quality_model.score(edge, labels.limit(0)).toPandas()
    assert (none.score == 0.5).all()
