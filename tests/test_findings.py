"""Queries on odd rows, against their SQL or a plain version."""

from pyspark.sql import functions as F

from timbre.plans import registry


def _sql_of_turns(name, rows):
    """A query's SQL over some turns: conv_id, turn, role, text."""
    import duckdb

    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn int, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    return sorted(con.execute(f"select * from ({registry.ORACLES[name]}) order by all").fetchall())


def _query_of_turns(spark, folder, name, rows):
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    return sorted(map(tuple, registry.QUERIES[name](spark, str(folder)).collect()))


def test_cues_that_end_in_a_comma_or_stand_by_odd_letters(spark, tmp_path):
    texts = ["All the best, Sam", "best,", "best,x", "the best,\nS", "un best, b", "thank you_", "Öhey thanks", "dear", "DEAR x", "soırry sorrý x", "thİs is fıne, it's fIne", "ta2 ta", "apologiſe", "TaKe care", "hí"]
    rows = [(i // 8, i % 8, "user", t) for i, t in enumerate(texts * 8)]
    for name in ("social_cues", "social_cues_golden", "act_profile"):
        assert _query_of_turns(spark, tmp_path / name, name, rows) == _sql_of_turns(name, rows), name


def test_casing_of_texts_with_few_plain_letters(spark, tmp_path):
    texts = ["Éñíóé là.", "ßß ßß.", "Ñandú él", "ÀÉÈ îôû", "123", "Ça a été là", "Plain words here", "abcdef", "abcdefg"]
    rows = [(i, turn, "user", t) for i, t in enumerate(texts * 4) for turn in range(3)]
    assert _query_of_turns(spark, tmp_path, "casing_emoji_golden", rows) == _sql_of_turns("casing_emoji_golden", rows)


def test_exemplars_are_clear_of_rare_spans_of_five_words(spark, tmp_path):
    """Words that others use too don't make a span of five words common: three conversations must have it."""
    common, other = "Please send the blue parcel back today", "Today the parcel back blue send please"
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", common) for c in range(3) for t in range(2)] + [(3, 0, "user", other), (4, 0, "user", other)]
    got = _query_of_turns(spark, tmp_path, "exemplars", rows)
    assert got == _sql_of_turns("exemplars", rows)
    assert {r[4] for r in got} == {common}


def test_english_counts_runs_of_letters(spark):
    """Letters are cut out in runs and markers found by one pattern; results are those of a plain count of characters."""
    import re

    from timbre.functions import lexicons as L
    from timbre.functions import text as T

    texts = ["", "the", "then", "it's in a box'a", "Привет the you", "ÀÉ öß the", "x " * 6, "the cat 'the' the's sat on it. " * 9, "1 2 3", "𝒜bc the 你好", "don't can't", "to-you i'm\nhow"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.latin, r.english) for r in rows.select("t", T.latin_share(F.col("t")).alias("latin"), T.is_english(F.col("t")).alias("english")).collect()}
    for t in texts:
        letters = [c for c in t if c.isalpha()]
        latin = sum(bool(re.match("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ]", c)) for c in letters) / len(letters) if letters else 1.0
        words = re.findall("[a-z']+", t.lower())
        hits = sum(w in L.ENGLISH_MARKERS for w in words)
        assert got[t] == (latin, latin >= 0.9 and (hits > 0 or len(words) < 2 if len(words) < 6 else hits / len(words) >= 0.15)), t
    plan = rows.where(T.is_english(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") == 4  # none is computed again


def test_hashes_of_runs_are_equal_where_runs_are(spark):
    from timbre.functions import text as T

    rows = spark.createDataFrame([("a b c d a b c".split(),), (["a", "b"],), ([],), (["b", "c", "d"],)], "t array<string>")
    got = [r.h for r in rows.select(T.gram_hashes(F.col("t"), 3).alias("h")).collect()]
    assert [len(h) for h in got] == [5, 0, 0, 1]
    assert got[0][0] == got[0][4] and got[0][1] == got[3][0] and len(set(got[0])) == 4


def test_rare_spans_are_gathered_after_their_shuffle_alone(spark, tmp_path):
    """Nearly all n-grams are met once: no task may hold all of its own before the shuffle."""
    from timbre.operators import privacy

    rows = [(i, t) for i, t in enumerate(["aa bb cc dd ee ff"] * 3 + ["a b c d e f", "Once more once more once more, once more once more", "x", "", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for turns in (docs, docs.union(docs)):
        rare = privacy.rare_spans(turns, 5, 3)
        assert sorted(map(tuple, rare.collect())) == [("more once more once more", 1), ("once more once more once", 1)]
        plan = rare._jdf.queryExecution().sparkPlan().toString()
        assert "HashAggregate" in plan.split("RepartitionByExpression")[0].split("Exchange")[0] and "Aggregate" not in plan.split("REPARTITION_BY_COL")[1]


def test_clear_texts_are_those_without_rare_spans(spark, monkeypatch):
    """Whatever is counted first and whatever is broadcast, all n-grams of all texts decide."""
    import random

    from timbre.operators import privacy

    draw = random.Random(3)
    words = ["the", "of", "it", "a", "sea", "<person_1>", "b"]
    lines = [" ".join(draw.choices(words, k=draw.choice([3, 5, 6, 9]))) for _ in range(40)]
    texts = [" ".join(draw.choices(lines, k=draw.choice([1, 1, 2]))) for _ in range(300)] + ["", None, "a b a b a b a", "of it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(r.doc_id for r in privacy.quotable(docs, privacy.rare_spans(docs, 5, 3), 5, "doc_id").collect())
    assert 20 < len(want) < 280
    for classes, rows in ((16, 2_000_000), (1, 0), (10**6, 0)):
        monkeypatch.setattr(privacy, "CLASSES", classes)
        monkeypatch.setattr(privacy, "FILTER_ROWS", rows)
        assert sorted(r.doc_id for r in privacy.clear(docs, 5, 3).collect()) == want, classes


def test_contrast_makes_features_once(spark):
    """Four statistics of a contrast read one table: a feature is made once a row, however many of them there are."""
    from timbre.operators import stats

    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def feature(x):
        made.add(1)
        return float(x % 7)

    rows = spark.range(60).selectExpr("id", "concat('d', id div 3) as doc_id", "if(id div 3 % 2 = 0, 'target', 'reference') as grp")
    got = stats.contrast(rows.withColumn("x", feature.asNondeterministic()("id")).drop("id"), ["x"], draws=20).collect()
    assert [(r.feature, r.n_target, r.n_reference) for r in got] == [("x", 30, 30)] and made.value == 60


def test_conversations_are_drawn_once_for_all_features(spark, monkeypatch):
    """Some values missing, some draws without any: as many features at once as may be, sums broadcast or not."""
    import hashlib

    import numpy as np
    import pytest

    from timbre.operators import stats

    n, draws = 9, 40
    value = lambda k, d: None if k == 2 and d else None if k == 1 and d % 2 else float(d * d % (5 + k))
    df = spark.createDataFrame([(f"d{d}", *(value(k, d) for k in range(4))) for d in range(n) for _ in range(1 + d % 3)], "doc_id string, a double, b double, c double, d double")
    want = {}
    for k, name in enumerate("abcd"):
        means = []
        for b in range(draws):
            picks = [int(hashlib.md5(f"7:{b}:{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)]
            found = [value(k, d) for d in picks for _ in range(1 + d % 3) if value(k, d) is not None]
            means += [np.mean(found)] if found else []
        want[name] = tuple(np.percentile(means, [2.5, 97.5])) if name != "c" else (None, None)  # fewer than three values
    for together, sums in ((40, 10**6), (3, 0), (1, 10**6)):
        monkeypatch.setattr(stats, "DRAWN_TOGETHER", together)
        monkeypatch.setattr(stats, "BROADCAST_SUMS", sums)
        got = {r.feature: (r.ci_lo, r.ci_hi) for r in stats.bootstrap_ci(stats.long(df, list("abcd"), ("doc_id",)), draws).collect()}
        assert set(got) == set(want)
        assert all(got[f] == (pytest.approx(want[f], abs=1e-9) if want[f][0] is not None else want[f]) for f in want), together
