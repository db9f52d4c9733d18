"""Golden cases and whole runs."""

import hashlib
import hashlib
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from timbre import judge as J
from timbre.cli import _parser
from timbre.config import Config
from timbre.functions import surface as S
from timbre.functions import text as T
from timbre.operators import context, corpus, diversity, exports, privacy, rules, scorer, situations, stats
from timbre.plans import evaluate, extract
from timbre.sources import readers

TURNS = "doc_id string, turn_id int, speaker string, text string"


def test_mtld():
    assert diversity.mtld_of(["a"] * 10) is None
    low, high = diversity.mtld_of("the cat sat on the mat".split() * 20), diversity.mtld_of([f"w{i}" for i in range(120)])
    assert low < high == 120


def test_style_match(spark):
    rows = spark.createDataFrame([("I will go to the shop and you can come",) * 2, ("I will go to the shop and you can come", "Buy milk.")], "a string, b string")
    lower = lambda c: F.transform(T.words(F.col(c)), F.lower)
    same, other = (r.v for r in rows.withColumns({"x": lower("a"), "y": lower("b")}).select(context.style_match(F.col("x"), F.col("y")).alias("v")).collect())
    assert same == pytest.approx(1, abs=1e-3) and other < 0.9


def test_openers(spark):
    row = spark.createDataFrame([("<PERSON_1>! thanks a Lot", "…")], "a string, b string").select(T.opener(F.col("a")), T.closer(F.col("a")), T.opener(F.col("b"))).first()
    assert tuple(row) == ("<PERSON_1> thanks", "a lot", "∅")


def test_contrast_separates(spark):
    rng = np.random.default_rng(1)
    rows = [(f"t{i % 100}", "target", float(x), float(n)) for i, (x, n) in enumerate(zip(rng.normal(1, 1, 300), rng.normal(0, 1, 300), strict=True))]
    rows += [(f"r{i % 200}", "reference", float(x), float(n)) for i, (x, n) in enumerate(zip(rng.normal(0, 1, 600), rng.normal(0, 1, 600), strict=True))]
    df = spark.createDataFrame(rows, "doc_id string, grp string, x double, noise double")
    found = {r.feature: r for r in stats.contrast(df, draws=100).collect()}
    assert found["x"].separated and found["x"].hedges_g > 0.7 and found["x"].distinctiveness > found["noise"].distinctiveness
    flat = df.withColumn("x", F.when(F.col("grp") == "target", F.lit(0.0)).otherwise(F.lit(100.0)))
    assert stats.cliffs_delta(stats.long(flat, ["x"])).first().cliffs_delta == -1


def test_bootstrap_of_many_conversations_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(stats, "MAX_CLUSTERS", 50)
    df = spark.range(5000).select(F.col("id").cast("string").alias("doc_id"), F.lit("target").alias("grp"), (F.col("id") % 2).cast("double").alias("x"))
    r = stats.bootstrap_ci(stats.long(df, ["x"]), 100).first()
    assert 0.45 < r.ci_lo < 0.5 < r.ci_hi < 0.55


def test_bootstrap_draws_all_of_many_conversations(spark, monkeypatch):
    n, draws = 2300, 20
    df = spark.range(n).select(F.format_string("d%05d", "id").alias("doc_id"), F.lit("target").alias("grp"), F.pmod(F.col("id") * F.col("id"), F.lit(97)).cast("double").alias("x"))
    picks = [[int(hashlib.md5(f"7:{b}:{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)] for b in range(draws)]
    want = np.percentile([np.mean([d * d % 97 for d in p]) for p in picks], [2.5, 97.5])
    for rows in (stats.BROADCAST_ROWS, 0):
        monkeypatch.setattr(stats, "BROADCAST_ROWS", rows)
        r = stats.bootstrap_ci(stats.long(df.repartition(7), ["x"]), draws).first()
        assert (r.ci_lo, r.ci_hi) == pytest.approx(tuple(want), abs=1e-9)


def test_keyness(spark):
    rows = [("target", "cheers mate that is great")] * 30 + [("reference", "thank you that is great")] * 30
    found = stats.keyness(spark.createDataFrame(rows, "grp string, text string")).collect()
    assert "cheers" in {r.term for r in found if r.side == "over"} and "thank" in {r.term for r in found if r.side == "under"}


def contrast_row(feature, t, r, g, d):
    return (feature, t, t - 0.01, t + 0.01, t, r, r, g, d, True, 100, 100, 1.0)


def test_rules(spark):
    rows = [contrast_row("has_emoji", 0.8, 0.1, 2.0, 0.7), contrast_row("social_greet", 0.07, 0.26, -0.5, -0.19), contrast_row("pos_propn", 0.5, 0.1, 2.0, 0.7)]
    names = "feature string, target_mean double, target_ci_lo double, target_ci_hi double, target_present double, reference_mean double, reference_present double, hedges_g double, cliffs_delta double, separated boolean, n_target int, n_reference int, distinctiveness double"
    found = {r["feature"]: r for r in rules.statistical_rules(spark.createDataFrame(rows, names))}
    assert set(found) == {"has_emoji", "social_greet"}
    assert (found["has_emoji"]["statement"], found["has_emoji"]["strength"]) == ("Include an emoji", "usually")
    assert (found["social_greet"]["statement"], found["social_greet"]["strength"]) == ("Skip greetings", "usually")
    said = {r.feature: (r.category, r.statement) for r in rules.phrased(spark.createDataFrame([("emotion_joy", False), ("act_hold", True), ("emotion_neutral", True), ("unknown", True)], "feature string, more boolean")).collect()}
    assert said["emotion_joy"] == ("affect", "Rarely express joy") and said["act_hold"][1].startswith("Buy time") and set(said) == {"emotion_joy", "act_hold", "emotion_neutral"}


def test_redundancy_within_groups(spark):
    rng = np.random.default_rng(2)
    a, b = (rng.random(400) < 0.8).astype(float), (rng.random(400) < 0.8).astype(float)
    rows = [("target", *map(float, x)) for x in zip(a, b, a, strict=True)] + [("reference", 0.0, 0.0, 0.0)] * 400
    df = spark.createDataFrame(rows, "grp string, a double, b double, c double")
    assert rules.prune_redundant(df, ["a", "b"]) == {} and rules.prune_redundant(df, ["a", "b", "c"]) == {"c": "a"}


def scorer_frame(spark):
    rows = [(f"d{i}", "target", "hey <PERSON_1>! yes that's fine 🙂 anything else?") for i in range(60)] + [(f"e{i}", "reference", "Yes. That is fine.") for i in range(60)]
    return S.surface(spark.createDataFrame(rows, "doc_id string, grp string, text string"))


def test_scorer(spark):
    model = scorer.fit(scorer_frame(spark))
    df = spark.createDataFrame([("hey <PERSON_1>! sure that's ok 🙂 anything else?",), ("Yes. That is good.",)], "text string")
    on, off = (r.score for r in scorer.score_texts(df, model).collect())
    assert on > 0.8 and off < 0.2 and model["cv_auc"] > 0.95 and model["cv_folds"] == 5
    table = S.surface(df, model["features"])
    by_sql = [r.s for r in table.selectExpr(f"{scorer.to_sql(model)} as s").collect()]
    assert by_sql == pytest.approx([on, off], abs=1e-9)
    assert "export function score" in scorer.to_typescript(model)


def test_rare_spans(spark):
    shared, own = "thanks so much for letting me know", "my flat is at the corner of elm street and oak road"
    turns = spark.createDataFrame([(f"d{i}", shared) for i in range(5)] + [("x", own)], "doc_id string, text string")
    rare = privacy.rare_spans(turns, 5, 3)
    texts = spark.createDataFrame([(0, shared), (1, own)], "key int, text string")
    assert [r.key for r in privacy.quotable(texts, rare).collect()] == [0]
    leak = spark.createDataFrame([(0, f"He said: {own}!")], "key int, text string")
    assert privacy.memorisation(leak, rare, None, 5).count() > 0
    assert privacy.memorisation(leak, rare, [own], 5).count() == 0


def test_privacy_report(spark):
    turns = spark.createDataFrame([("d", 0, "a", "mail x@y.org to @sam"), ("d", 1, "b", "ref 1234567890123456789012"), ("e", 0, "a", None)], TURNS)
    masked = privacy.anonymise(turns)
    assert privacy.report(masked)["replacements"]["EMAIL_ADDRESS"] == 1
    assert masked.where("turn_id = 0 and doc_id = 'd'").first().text == "mail <EMAIL_ADDRESS> to <PERSON_1>"


def test_split(spark):
    turns = spark.createDataFrame([(f"d{i}", t, "a", "x") for i in range(20) for t in range(3)], TURNS)
    rows = corpus.split_docs(turns, 0.2).collect()
    assert sum(r.held for r in rows) == 12 and not {r.doc_id for r in rows if r.held} & {r.doc_id for r in rows if not r.held}
    book = spark.createDataFrame([("b", t, "a", "x") for t in range(50)], TURNS)
    held = [r.turn_id for r in corpus.split_docs(book, 0.2).where("held").orderBy("turn_id").collect()]
    assert len(held) == 10 and all(x // 5 == held[i - i % 5] // 5 for i, x in enumerate(held))
    assert corpus.reference_caps(10, 5) == (500, 200)
    with pytest.raises(ValueError, match="nobody"):
        corpus.grouped(turns, ["nobody"])


class FakeJudge:
    label = "fake"

    def follows(self, statements, texts):
        return [None if "malformed" in s else ["!" in t for t in texts] if "exclamation" in s else [True] * len(texts) for s in statements]


def test_verify(spark):
    sample = [("target", "great news i!")] * 30 + [("reference", "noted i.")] * 30
    drafts = [{"statement": s, "strength": "usually"} for s in ("Use exclamation marks", "Be polite", "malformed")]
    kept, polite, bad = J.verify(spark, FakeJudge(), drafts, sample)
    assert kept["kept"] and kept["verification"]["target_compliance"] == 1 and not polite["kept"] and not bad["kept"]
    some = [("target", f"ok {'!' if i % 5 < 3 else ''}") for i in range(40)] + [("reference", "ok")] * 40
    again = J.verify(spark, FakeJudge(), drafts[:1], some)[0]
    assert again["kept"] and again["strength"] in ("often", "usually")


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("tier: hybrid\nseed: 3\nprivacy: {k_anonymity: 4}\n")
    assert Config.load(tmp_path / "c.yaml").privacy.k_anonymity == 4
    with pytest.raises(ValueError):
        Config(tier="frontier-direct")
    assert _parser().parse_args(["extract", "x", "--target", "a"]).target == ["a"]


def rows_of(df):
    return [(r.doc_id, r.turn_id, r.speaker, r.text) for r in df.orderBy("doc_id", "turn_id").collect()]


def test_readers(spark, tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
        return str(p)

    chat = put("chat.txt", "12/03/2025, 10:01 - Sam: hi there\ncontinued\n12/03/2025, 10:02 pm - Ella: hey!\n12/03/2025, 10:03 - Ella: <Media omitted>\n")
    assert readers.detect(spark, chat) == "whatsapp"
    got = readers.read_turns(spark, chat)
    assert rows_of(got) == [("chat", 0, "Sam", "hi there\ncontinued"), ("chat", 1, "Ella", "hey!")]
    assert [str(r.ts) for r in got.orderBy("turn_id").collect()] == ["2025-03-12 10:01:00", "2025-03-12 22:02:00"]

    lines = put("t.jsonl", "\n".join(map(json.dumps, [{"doc_id": "a", "speaker": "x", "text": "one", "mood": "up"}, {"doc_id": "a", "turn_id": 7, "text": "two", "timestamp": 1700000000}, {"doc_id": "a", "text": "three", "reply_to": 7}, {"conversation_id": 5, "text": "four"}])))
    got = readers.read_turns(spark, lines)
    assert rows_of(got) == [("5", 0, "unknown", "four"), ("a", 0, "x", "one"), ("a", 7, "unknown", "two"), ("a", 8, "unknown", "three")]
    assert {r.text: (r.reply_to, r.meta) for r in got.collect()}["one"] == (None, {"mood": "up"})
    array = put("t.json", json.dumps([{"text": "solo"}]))
    assert rows_of(readers.read_turns(spark, array)) == [("doc", 0, "unknown", "solo")]
    table = put("t.csv", 'speaker,text,doc_id\na,"x, ""y""\nz",d\nb,w,d\n')
    assert rows_of(readers.read_turns(spark, table)) == [("d", 0, "a", 'x, "y"\nz'), ("d", 1, "b", "w")]

    book = put("books/ann__1.txt", "head\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n\nCHAPTER I.\n\nHe walked home slowly, “Come in,” she said to him.\n\nThe rain fell all night long.\n\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\ntail")
    assert readers.detect(spark, book) == "gutenberg"
    assert [r[2:] for r in rows_of(readers.read_prose(spark, book))] == [("ann:narration", "He walked home slowly, she said to him"), ("ann:dialogue", "Come in,"), ("ann:narration", "The rain fell all night long")]
    assert readers.detect(spark, str(tmp_path / "books")) == "prose-dir"
    assert [r[:3] for r in rows_of(readers.read_prose_dir(spark, str(tmp_path / "books"), block=1))] == [("ann__1#0", 0, "ann"), ("ann__1#1", 0, "ann")]

    meta = put("m/chat_1/message_1.json", json.dumps({"messages": [{"sender_name": "B", "timestamp_ms": 2000, "content": "later"}, {"sender_name": "ZoÃ«", "timestamp_ms": 1000, "content": "cafÃ©"}, {"sender_name": "B", "timestamp_ms": 3000}]}))
    assert readers.detect(spark, meta) == "meta"
    assert rows_of(readers.read_meta_export(spark, str(tmp_path / "m"))) == [("chat_1", 0, "Zoë", "café"), ("chat_1", 1, "B", "later")]

    tweets = put("tw.csv", "tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n1,u1,True,Tue Oct 31 22:10:47 +0000 2017,@Brand help &amp; soon,2,\n2,Brand,False,Tue Oct 31 22:11:47 +0000 2017,@u1 see https://t.co/abc,,1\n3,u2,True,Tue Oct 31 22:12:47 +0000 2017,alone,,99\n")
    assert readers.detect(spark, tweets) == "twitter-support"
    got = readers.read_turns(spark, tweets)
    assert rows_of(got) == [("1", 0, "customer", "help & soon"), ("1", 1, "Brand", "see <URL>"), ("3", 0, "customer", "alone")]
    assert {r.text: r.reply_to for r in got.collect()} == {"help & soon": None, "see <URL>": 0, "alone": None}
    assert got.where("text = 'alone'").first().ts is not None


def test_exemplars_and_pairs(spark):
    whole = "We are happy to help you with that today"
    rows = [("a", f"{whole}.", "can you help me", 0.9, 0), ("b", f"{whole}!", None, 0.8, 0), ("c", "too short", None, 0.99, 0), ("d", "lower case starts are not whole replies here", None, 0.7, 0), ("e", "Part two of a reply that goes on 2/2", None, 0.7, 0)]
    turns = spark.createDataFrame(rows, "key string, text string, prev_text string, score double, cluster int")
    none = spark.createDataFrame([], "ngram string, n_docs long")
    assert [r.key for r in exports.exemplars(turns, none).collect()] == ["a"]
    rare = spark.createDataFrame([("can you help me now", 1), ("we are happy to help", 1)], "ngram string, n_docs long")
    assert exports.exemplars(turns, rare).count() == 0
    near = situations.nearest(spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>"), spark.createDataFrame([(5, [0.9, 0.1]), (4, [0.9, 0.1]), (6, [0.0, 1.0])], "vec_id long, embedding array<double>"))
    assert [tuple(r)[:2] for r in near.collect()] == [(1, 4)]


def test_nearest_answers_all_queries(spark):
    rng = np.random.default_rng(5)
    vectors, others = rng.integers(-9, 10, (3500, 4)).astype(float), rng.integers(-9, 10, (40, 4)).astype(float)
    made = lambda m: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    products = vectors @ others.T
    want = [(i, int(p.argmax()), p.max()) for i, p in enumerate(products)]
    assert sorted(map(tuple, situations.nearest(made(vectors), made(others)).collect())) == want
    assert sorted(map(tuple, situations.nearest(made(vectors), made(others), limit=10).collect())) == want[:10]
    assert situations.nearest(made(vectors).limit(0), made(others)).count() == 0


def test_planted_traits_are_recovered(spark):
    got = evaluate.planted(spark, draws=100)
    assert got["recall"] == 1 and got["auc"] > 0.9, got
    assert not got["null_rules"] and 0.3 < got["null_auc"] < 0.7, got


def test_run_writes_and_gates(spark, tmp_path):
    turns = evaluate.planted_turns(spark, 40).drop("planted")
    result = extract.run(turns, Config(bootstrap=50), targets=["target_host"], public=True)
    result.write(str(tmp_path / "out"))
    data = json.loads((tmp_path / "out" / "voice.json").read_text())
    assert data["rules"] and (tmp_path / "out" / "VOICE.md").exists() and result.sft.count() > 0 and result.dpo.count() > 0


def test_memorisation_gate(spark, monkeypatch):
    """A report that quotes a rare passage of a private corpus stops the run."""
    secret = "the quick secret phrase of nine plain words here today"
    turns = evaluate.planted_turns(spark, 24).drop("planted").union(spark.createDataFrame([("s", 1, "target_host", secret)], TURNS))
    monkeypatch.setattr(exports, "voice_md", lambda name, data: f"As they said: {secret}.")
    with pytest.raises(extract.MemorisationError):
        extract.run(turns, Config(bootstrap=20), targets=["target_host"], pairs=False)


def test_all_leaks_are_counted(spark):
    leaks = spark.range(150).selectExpr("id as key", "cast(149 - id as int) as pos", "concat('span ', id) as ngram")
    assert extract.leak_count(leaks) == (150, [f"span {i}" for i in range(10)])


def test_traits_are_planted_at_their_shares(spark):
    rows = spark.range(3000).selectExpr("id div 3 as doc_id", "id % 3 as turn_id", "'It is fine and I will come.' as text")
    got = evaluate.with_traits(rows, F.col("doc_id") % 2 == 0).toPandas()
    ours, theirs = got[got.doc_id % 2 == 0], got[got.doc_id % 2 == 1]
    for t in evaluate.TRAITS:
        assert abs(ours.planted.map(lambda x, t=t: t.name in x).mean() - t.share) < 0.05, t
    assert not theirs.planted.map(len).any() and abs(theirs.text.str.endswith("!").mean() - evaluate.NOISE.share) < 0.05
    every = ours[ours.planted.map(len) == len(evaluate.TRAITS)].iloc[0]
    assert re.fullmatch(r"<PERSON_\d>! i think that it's fine and i'll come. anything else that you need\? 🙂", every.text)


def test_fidelity_and_curve(spark):
    model = scorer.fit(scorer_frame(spark), cross_validate=False)
    replies = spark.createDataFrame([("baseline", "Yes. That is fine."), ("voiced", "hey <PERSON_1>! that's fine 🙂"), ("real", "hey <PERSON_1>! yes that's fine 🙂 anything else?")], "kind string, text string")
    got = {r.kind: r for r in evaluate.fidelity(replies, model).collect()}
    assert got["voiced"].score > got["baseline"].score and got["real"].style == pytest.approx(1, abs=1e-6)


def test_session_windows(spark):
    from timbre.streaming.scoring import sessions

    rows = spark.createDataFrame([("a", "2025-01-01 00:00:00"), ("a", "2025-01-01 00:02:00"), ("a", "2025-01-01 01:00:00")], "speaker string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.length for r in sessions(rows).collect()) == [1, 2]


def test_backends(spark):
    import pandas as pd

    from timbre import backends

    df = spark.createDataFrame([("Can you not go?",)], "text string")
    row = backends.lexical(df).first()
    assert row.lex_modal == 0.25 and row.lex_negation == 0.25 and row.lex_question_start == 1
    made = backends.with_model(df, lambda s: pd.DataFrame({"sentiment": s.str.len()}), ["sentiment", "missing"]).first()
    assert made.sentiment == 15 and made.missing is None
    assert backends.without_model(df, ["tree_depth_mean"]).first().tree_depth_mean is None


def test_model_outputs(spark):
    import pandas as pd

    from timbre import backends

    long = "One sentence here. " * 200
    parts = backends.chunks(long)
    assert all(len(x) <= backends.CHUNK for x in parts) and " ".join(parts) == long.strip() and backends.chunks("") == [""]
    assert all(len(x) <= 10 for x in backends.chunks("x" * 35, 10))
    share = backends.chunked(lambda s: pd.DataFrame({"a": s.str.count("a") / s.str.len().clip(lower=1)}), 8)(pd.Series(["aaaa bbbb cccc", "", None]))
    assert share["a"].tolist() == pytest.approx([4 / 13, 0, 0], abs=0.05)
    df = spark.createDataFrame([(0.7, 0.1, 0.3, 1.0, 0.0, 0.2, 0.9)], "social_offer_p double, social_greet_p double, emotion_joy_p double, cue_greet double, cue_offer double, ask_p double, say_p double")
    row = backends.one_act(backends.flags(backends.social_acts(df, ["offer", "greet"]), "emotion_"), ["ask", "say"]).first()
    assert (row.social_offer, row.social_greet, row.emotion_joy, row.act_ask, row.act_say, row.act_confidence) == (1, 1, 1, 0, 1, 0.9)


def test_attribution(spark):
    got = evaluate.attribution(evaluate.planted_turns(spark, 90).drop("planted"), n_speakers=3, least=30, most=80, exclude=("guest_0",))
    assert got["speakers"] == 3 and got["surface"]["per_turn"] > got["chance"] and got["surface"]["chunks"] > 0
    assert 0 <= got["style"]["per_turn"] <= 1 and got["full"]["per_10_turns"] >= got["chance"]
