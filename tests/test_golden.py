"""Golden cases of single texts and rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from timbre.functions import lexicons as L
from timbre.functions import surface as S
from timbre.functions import text as T
from timbre.operators import context, corpus, privacy, rules, stats
from timbre.sources import readers

_GOLDEN = [
    ("Hey <PERSON_1>! I'm so happy you're coming 🙂", "standard", 1, "end", False, True),
    ("sure, anything else you need?", "all_lower", 0, "none", True, False),
    ("anything else you need? 🙂", "all_lower", 1, "end", True, False),
    ("Sam! the room's free. anything else?", "all_lower", 0, "none", True, False),
    ("the flat is near Camden, see you soon", "all_lower", 0, "none", False, True),
    ("hey there. Really good", "standard", 0, "none", False, True),
    ("Yes. That is fine.", "standard", 0, "none", False, False),
    ("hi <PERSON_1>, all good", "all_lower", 0, "none", False, True),
    ("LOUD MESSAGE HERE", "shouting", 0, "none", False, True),
    ("👍🏽", "none", 1, "standalone", False, False),
    ("🇬🇧 hello", "all_lower", 1, "lead", False, True),
    ("well 🎉 done folks", "all_lower", 1, "inline", False, True),
]
_CONTRACTED = [("I'm here, don't worry", 2.0), ("we’ll see it's fine", 2.0), ("nothing here", 0.0), ("CAN'T STOP", 1.0)]
_SIGNED = [("We'd love to help. ^TN", "We'd love to help."), ("Keep us posted /LS <URL>", "Keep us posted"), ("Thanks! -SLM", "Thanks!"), ("Would you like us to? ^Jane 2/2", "Would you like us to?"), ("Kind words! #AATeam", "Kind words! #AATeam"), ("Go to Settings > General > About.", "Go to Settings > General > About.")]
_CUED = [("Hi there, thank you so much", "greet,thank"), ("sorry, unfortunately we can't", "apologise,offer,refuse"), ("no worries, let me check", "offer,reassure"), ("have a great day!", "close"), ("what great news", "praise"), ("that sounds hard, could you wait", "empathise,request"), ("plain words", "")]
_FISHER = [(2, 24, 0, 24, 0.244681), (12, 150, 0, 150, 0.000194), (3, 10, 1, 10, 0.291022), (3, 48, 0, 48, 0.121053)]
_DECISIONS = [
    ("usually", 1.0, 0.0, 0.0001, True, "usually"), ("usually", 0.6, 0.1, 0.001, True, "usually"), ("usually", 0.55, 0.1, 0.001, True, "often"), ("always", 0.2, 0.02, 0.01, True, "sometimes"),
    ("often", 0.5, 0.48, 0.4, False, "often"), ("often", 0.03, 0.0, 0.01, False, "often"), ("rarely", 0.1, 0.4, 0.01, True, "rarely"), ("never", 0.3, 0.5, 0.01, False, "never"), ("usually", 0.9, None, None, True, "usually"), ("sometimes", 0.2, 0.1, 0.2, False, "sometimes"),
]
_MASKED = [
    ("a", 0, "hi @sam_b, mail me at x.y@z.org", "hi <PERSON_1>, mail me at <EMAIL_ADDRESS>"), ("a", 1, "thanks @Sam_B and @other1", "thanks <PERSON_1> and <PERSON_2>"), ("b", 0, "@other1 see https://x.org/a", "<PERSON_1> see <URL>"),
    ("b", 1, "card 4111 1111 1111 1111 from 10.0.0.1", "card <CREDIT_CARD> from <IP_ADDRESS>"), ("b", 2, "SW1A 1AA, order no. AB-12345", "<UK_POSTCODE>, <REFERENCE>"), ("b", 3, "on 12/03/2025 we met", "on <DATE_TIME> we met"),
]
_TWEETS = [(1, None), (2, 1), (3, 2), (4, None), (5, 99), (6, 5), (7, 3), (8, 4), (9, 7), (10, 9), (11, 12), (12, 11)]
_CHAT = "12/03/2025, 10:01 - Sam: hi there\ncontinued\n12/03/2025, 10:02 pm - Ella: hey!\n12/03/2025, 10:03 - Ella: <Media omitted>\n[13/3/25, 9:05:07] Sam: bye"
_BOOK = "head\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n\nCHAPTER I.\n\nHe walked home slowly, “Come in,” she said to him.\n\nThe rain fell\nall night long.\n\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\ntail"
_PLAIN = [("mail x.y@z.org now", "mail <EMAIL_ADDRESS> now"), ("see https://x.org/a b", "see <URL> b"), ("from 10.0.0.1 on", "from <IP_ADDRESS> on"), ("at SW1A 1AA", "at <UK_POSTCODE>"), ("nothing", "nothing")]


def texts(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "i int, text string").coalesce(1)


def test_casing_and_emoji(spark):
    tail = S.strip_tail(F.col("text"))
    got = texts(spark, [r[0] for r in _GOLDEN]).select("text", S.casing(F.col("text")), T.count(F.col("text"), L.EMOJI), S.emoji_position(F.col("text")), tail.endswith("?"), tail.rlike(r"[\p{L}\p{N}]$"))
    assert [tuple(r) for r in got.collect()] == _GOLDEN


def test_contractions_and_signatures(spark):
    rows = S.surface(texts(spark, [t for t, _ in _CONTRACTED]), ["contraction_rate", "words"])
    assert [round(r.contraction_rate * r.words, 6) for r in rows.collect()] == [n for _, n in _CONTRACTED]
    assert [r[0] for r in texts(spark, [t for t, _ in _SIGNED]).select(T.strip_signature(F.col("text"))).collect()] == [t for _, t in _SIGNED]


def test_reply_to(spark):
    rows = [("d", 0, "a", "hi", None), ("d", 1, "b", "hello", None), ("d", 2, "b", "how are you", None), ("d", 3, "a", "good", 0), ("d", 4, "b", "ok", 9)]
    got = context.previous_turn(spark.createDataFrame(rows, "doc_id string, turn_id int, speaker string, text string, reply_to int")).orderBy("turn_id")
    assert [r.prev_text for r in got.collect()] == [None, "hi", "hi", "hi", "good"]


def test_cues(spark):
    rows = context.social_cues(texts(spark, [t for t, _ in _CUED])).collect()
    assert [",".join(sorted(a for a in L.SOCIAL_CUES if r[f"cue_{a}"] == 1)) for r in rows] == [a for _, a in _CUED]


def test_fisher_and_decisions(spark):
    rows = spark.createDataFrame([r[:4] for r in _FISHER], "a int, b int, c int, e int").coalesce(1)
    got = rows.select(stats.fisher_p(*map(F.col, "abce"))).collect()
    assert [r[0] for r in got] == pytest.approx([r[4] for r in _FISHER], abs=1e-6)
    rows = spark.createDataFrame([r[:4] for r in _DECISIONS], "s string, t double, r double, p double").coalesce(1)
    kept, strength = rules.decide(*map(F.col, "strp"))
    assert [tuple(r) for r in rows.select(kept, strength).collect()] == [r[4:] for r in _DECISIONS]


def test_replacements(spark):
    rows = spark.createDataFrame([r[:3] for r in _MASKED], "doc_id string, turn_id int, text string")
    assert [r.text for r in privacy.anonymise(rows).orderBy("doc_id", "turn_id").collect()] == [r[3] for r in _MASKED]
    assert [r[0] for r in texts(spark, [t for t, _ in _PLAIN]).select(privacy.pii_replaced(F.col("text"))).collect()] == [m for _, m in _PLAIN]


def test_threads(spark):
    got = {r.id: r.root for r in readers.thread_roots(spark.createDataFrame(_TWEETS, "id long, parent long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 1, 8: 4, 9: 1, 10: 1, 11: 11, 12: 11}


def test_chat_and_book(spark):
    rows = readers.whatsapp_turns(spark.createDataFrame([("chat", _CHAT)], "stem string, value string")).orderBy("turn_id")
    assert [(r.turn_id, r.speaker, r.text, r.ts and f"{r.ts:%H:%M}") for r in rows.collect()] == [(0, "Sam", "hi there\ncontinued", "10:01"), (1, "Ella", "hey!", "22:02"), (2, "Sam", "bye", None)]
    rows = readers.prose_turns(spark.createDataFrame([("ann__1", _BOOK)], "stem string, value string")).orderBy("turn_id")
    assert [(r.speaker, r.text) for r in rows.collect()] == [("ann:narration", "He walked home slowly, she said to him"), ("ann:dialogue", "Come in,"), ("ann:narration", "The rain fell all night long")]


def test_phrases_equal_a_plain_pattern(spark):
    """Tries over folded text count what alternations without regard to case count, over all of Unicode."""
    items = ["so", "so far", "so far as", "i mean", "kind of", "kinda", "don't", "sort"]
    plain = r"(?iU)\b(?:" + "|".join(re.escape(p).replace(r"\ ", " ") for p in sorted(items, key=len, reverse=True)) + r")\b"
    odd = ["So far as I mean", "so\u0307 far so", "\u017fo \u212aind of KINDA", "\u0130 mean \u0131 mean", "don't don’t DON'T sorts sort-of", "éso soé so_ so1 so", ""]
    got = texts(spark, odd).select(T.phrases(T.folded(F.col("text")), items).alias("a"), T.count(F.col("text"), plain).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and sum(r.a for r in got) > 8


def test_syllables_equal_word_by_word(spark):
    def of(w):
        groups = len(re.findall("[aeiouy]+", w))
        return max(groups - (bool(re.search("[^aeiouyl]e$", w)) and groups > 1), 1)

    random.seed(2)
    rows = ["", "the", "eye bee table make 12,5 rhythm e e", *(" ".join("".join(random.choices("aeioulbc'e", k=random.randint(1, 9))) for _ in range(8)) for _ in range(300)), "ba" * 30_000]
    got = texts(spark, rows).select(T.syllables(F.col("text")).alias("n"), T.long_words(F.col("text")).alias("m")).collect()
    assert [(r.n, r.m) for r in got] == [(sum(map(of, x.split())), sum(of(w) >= 3 for w in x.split())) for x in rows]


def test_leaks_equal_rare_spans_in_outputs(spark, monkeypatch):
    rows = [(f"d{i % 7}", i, " ".join(f"word{(i * 3 + j) % 11}" for j in range(9))) for i in range(20)] + [("x", 1, "an odd phrase of six plain words"), ("y", 1, None)]
    turns = spark.createDataFrame(rows, "doc_id string, turn_id int, text string")
    outputs = spark.createDataFrame([(0, "so an odd phrase of six plain words it is"), (1, rows[4][2]), (2, "nothing"), (3, None)], "key int, text string")
    want = sorted(map(tuple, privacy.memorisation(outputs, privacy.rare_spans(turns, 4, 3), ["it is"], 4).collect()))
    assert want and sorted(map(tuple, privacy.leaks(outputs, turns, ["it is"], 4, 3).collect())) == want
    monkeypatch.setattr(privacy, "FILTER_ROWS", 0)
    assert sorted(map(tuple, privacy.leaks(outputs, turns, ["it is"], 4, 3).collect())) == want


def test_running_totals_of_a_heavy_tail(spark):
    """One value of 10^9 among small ones: classes stay even, totals exact."""
    values = [i / 7 for i in range(2000)] + [1e9]
    rows = spark.createDataFrame([("f", v, 1 + i % 3) for i, v in enumerate(values)], "feature string, value double, n long").repartition(4)
    got = {r.value: r.upto for r in stats.upto(rows, "feature", "value", "n", "upto", 16).collect()}
    total = 0
    for i, v in enumerate(values):
        total += 1 + i % 3
        assert got[v] == total
    spread = rows.join(rows.groupBy("feature").agg(F.percentile_approx("value", [k / 16 for k in range(1, 16)], 320).alias("b")), "feature")
    assert max(r[1] for r in spread.groupBy(F.size(F.filter("b", lambda b: b < F.col("value")))).count().collect()) < 200


def test_numbers_in_order(spark):
    rows = spark.createDataFrame([(i * 37 % 101, "x") for i in range(101)], "k int, t string").repartition(5)
    assert all(r.n == r.k for r in corpus.numbered(rows, "n", "k").collect())
    few = spark.createDataFrame([(f"d{i % 2}", i, "x") for i in range(60)], "doc_id string, turn_id int, text string").repartition(3)
    held = corpus.split_docs(few).where("held").count()
    assert held == 12
