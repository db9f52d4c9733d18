import hashlib
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from timbre.llm import pii


def brute(text):
    """The contract's patterns as they are."""

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span())] if 13 <= len(d) <= 19 and luhn(d) else []
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZ@@..-+%0123456789   ()é\n"), max_size=50))
def test_base_equals_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_cards():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("0123456789") + rng.choice(["", "", " ", "-"]) for _ in range(rng.randrange(10, 22)))
        assert pii.base_spans("+" + text) == brute("+" + text)


DISGUISED = [
    ("mail john [at] example (dot) com now", "email", "john [at] example (dot) com"),
    ("mail jane at mail dot example dot org now", "email", "jane at mail dot example dot org"),
    ("ｊоhn@ехample.com!", "email", "ｊоhn@ехample.com"),
    ("x a​b@c​d.org", "email", "a​b@c​d.org"),
    ("at 10 dot 0 dot 0 dot 1 it is", "ip", "10 dot 0 dot 0 dot 1"),
    ("١٠.0.0.1", "ip", "١٠.0.0.1"),
    ("call plus four nine three one two three four five six seven", "phone", "plus four nine three one two three four five six seven"),
    ("card four one one one one one one one one one one one one one one one.", "card", "four one one one one one one one one one one one one one one one"),
    ("4111 1111 1111 1111", "card", "4111 1111 1111 1111"),
]


def test_disguises_map_back_to_source_characters():
    for text, kind, what in DISGUISED:
        base, every = pii.all_spans(text)
        assert not base and [(k, text[a:b]) for k, a, b in every] == [(kind, what)]
    text = " | ".join(t for t, _, _ in DISGUISED) + " | real@mail.org"
    base, every = pii.all_spans(text)
    assert [text[a:b] for _, a, b in base] == ["real@mail.org"] and set(base) < set(every)
    assert sorted(text[a:b] for _, a, b in every) == sorted([w for _, _, w in DISGUISED] + ["real@mail.org"])


def test_partly_plain_identifiers_are_found_whole():
    for kind, plain in (("email", "john.doe@example.com"), ("phone", "+493012345678"), ("ip", "10.20.30.40"), ("card", "4111111111111111")):
        for i, c in enumerate(plain):
            for hidden in (plain[:i] + chr(ord(c) + 0xFEE0) + plain[i + 1 :], *([plain[:i] + "\u200b" + plain[i:]] if i else [])):
                base, every = pii.all_spans(f"to {hidden}; now")
                assert (kind, 3, 3 + len(hidden)) in every and set(base) <= set(every), hidden
    for hidden in ("john.d\u043ee@example.com", "m\u0430ry.smith@mail.org", "jo\u200bhn@example.com", "bob@example.c\u043em", "bob@mail.ex\u0430mple.com"):
        assert ("email", 0, len(hidden)) in pii.all_spans(hidden)[1]


SPELLED = [
    ("go to one nine two dot one six eight dot zero dot one now", "ip", "one nine two dot one six eight dot zero dot one"),
    ("go to one nine two.one six eight.zero.one", "ip", "one nine two.one six eight.zero.one"),
    ("10 dot zero dot 0 dot 1", "ip", "10 dot zero dot 0 dot 1"),
    ("room nine two one nine two dot one six eight dot 0 dot 1", "ip", "one nine two dot one six eight dot 0 dot 1"),
    ("eins neun zwei Punkt eins sechs acht Punkt null Punkt eins", "ip", "eins neun zwei Punkt eins sechs acht Punkt null Punkt eins"),
    ("4111 1111 1111 one one one one", "card", "4111 1111 1111 one one one one"),
    ("card four one 11 1111 - 1111, 1111", "card", "four one 11 1111 - 1111, 1111"),
    ("+1 415 555 one two three four", "phone", "+1 415 555 one two three four"),
    ("+1 (four one five) 555 1234", "phone", "+1 (four one five) 555 1234"),
    ("call plus five 5 one 2 six 6 seven 7 eight", "phone", "plus five 5 one 2 six 6 seven 7 eight"),
]


def test_spelled_digits_in_groups():
    for text, kind, what in SPELLED:
        base, every = pii.all_spans(text)
        assert (kind, what) in [(k, text[a:b]) for k, a, b in every] and set(base) <= set(every), (text, every)
    for text in ("one two dot three four", "on two 3 dot four dot five", "three hundred dot one dot two dot three", "nine nine nine dot one dot nine nine nine dot one", "4111 1111 1111 one one one two"):
        assert pii.all_spans(text) == ([], []), text


def test_ordinary_words_stay():
    for text in ("we met at noon", "look at the dot", "one two three", "he is at home dot", "sieben acht neun", "version 1.2.3", "look at bbc.co.uk", "we met at amazon.com", "meet at noon dot com", "ask me at example.com", "see it at news dot example dot com"):
        assert pii.all_spans(text) == ([], [])


def test_spoken_addresses():
    for text, what in (
        ("reach j.doe at example.com", "j.doe at example.com"), ("mail: jane at example.org", "jane at example.org"), ("jane at example dot com", "jane at example dot com"),
        ("a line\tbob7   at \t mail.example dot net.", "bob7   at \t mail.example dot net"), ("x@mail dot example dot de", "x@mail dot example dot de"),
        ("a.b  ( at )  example.org", "a.b  ( at )  example.org"),
    ):
        assert ("email", what) in [(k, text[a:b]) for k, a, b in pii.all_spans(text)[1]], text


def test_long_texts_take_linear_time():
    n = 250_000
    units = ["a.", " ", "\t", "a at ", "a dot ", "( ", "( at", "one ", "one  ", "1 ", "+1 ", "1.", "a@", "@", "-", "x at y dot ", "one two dot ", "а", "\u200b", "1 dot ", "+1(", "at ", "."]
    for unit in units:
        text = unit * (n // len(unit)) + " at x dot one two"
        began = time.time()
        pii.all_spans(text)
        assert time.time() - began < 12, unit  # in quadratic time hours


def test_query(spark):
    rows = [None, "", "a@b.co +1 (555) 123-4567 1.2.3.4", "tie@x.org", "tie@x.org", "1" * 30_000, "a" * 50_000 + "@", DISGUISED[0][0]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, spans string")
    for r in pii.find(docs).collect():
        text = rows[r.doc_id] or ""
        base, every = (",".join(f"{k}:{a}:{b}" for k, a, b in x) for x in pii.all_spans(text))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans == every
        if len(text) < 1000:
            assert base == ",".join(f"{k}:{a}:{b}" for k, a, b in brute(text))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(base.count(k + ":") for k in pii.KINDS)
    assert pii.find(docs.limit(0)).count() == 0
