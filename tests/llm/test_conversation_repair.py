import hashlib
import heapq
import random
import re
import zlib
from pathlib import Path

import duckdb
import pytest

from timbre.llm import conversation_repair as C

LETTERS = [chr(65 + i) for i in range(16)]


def cheapest(word):
    """(cost, audit) by a best-first search over whole edit sequences, told apart by what they give."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(word) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        if (i, roles[:1], len(roles), audit) in done or not re.fullmatch("s?(ua)*u?", roles):
            continue
        done.add((i, roles[:1], len(roles), audit))
        for x in "ua":
            if len(audit) < 2 * len(word) + 3:
                heapq.heappush(heap, (cost + 3, audit + "I", i, roles + x))
        if i < len(word):
            kind, fault = divmod(ord(word[i]) - 65, 4)
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles))
            if fault in (0, 3):
                extra = 3 if fault == 3 else 0
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, roles + "suax"[kind]))
                for x in "ua":
                    heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, roles + x))


def test_programme_equals_search():
    random.seed(3)
    words = sorted({"".join(random.choices(LETTERS, k=random.randint(0, 5))) for _ in range(250)} | {"", "I", "A", "AEI"})
    programme = C.SharedProgramme()
    for word in words:
        assert programme.answer(word) == cheapest(word), word
    assert programme.layers_made < sum(map(len, words))


def test_layers_are_made_once_a_shared_prefix():
    programme, words = C.SharedProgramme(), ["EI" * 50 + x for x in "ABEI"]
    for word in words:
        programme.answer(word)
    assert programme.layers_made == 104
    assert C._common("abc", "abd") == 2 and C._common("", "x") == 0 and C._common("xyz", "x") == 1


def plain(rows):
    """The report of (conv_id, turn, role, text), a row at a time, with the audits of single searches."""
    found = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            shown = [" " if x is None else str(x) for x in (conv, turn)]
            role, text = (" " if x is None else x for x in (role, text))
            h = zlib.crc32(":".join(shown).encode()) % 20
            row = (turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
            kept += [row] * (0 if h == 0 else 2 if h == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        word, seen = "", set()
        for _, role, text in kept:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0
            seen.add((role, text))
            word += LETTERS["sua".find(role[:1]) % 4 * 4 + fault] if role[:1] in ("s", "u", "a") else LETTERS[12 + fault]
        cost, audit = C.SharedProgramme().answer(word)
        lines, i, state = [], 0, 0
        for edit in audit:
            i += edit != "I"
            if edit != "D":
                own = kept[i - 1] if edit != "I" else (None, None, "")
                state = 1 if edit == "K" and own[1][:1] == "s" else {0: 2, 1: 2, 2: 3, 3: 2}[state]
                lines.append(f"{own[1] if edit == 'K' else 'user' if state == 2 else 'assistant'}:{own[2]}")
        turns = [r[0] for r in kept if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        kinds = ["suax"[(ord(x) - 65) // 4] for x in word]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False))
        counts = [sum((ord(x) - 65) % 4 == k for x in word) for k in (1, 2, 3)]
        found[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


ROWS = [
    *[(c, t, ["user", "assistant", "system", "tool", "", None][(c * 7 + t) % (3 if c % 2 else 6)], ["Yes.", None, "", "what?! \n", "no end", "Same.", "é" * 40_000 + "."][(c + t * t) % 7]) for c in range(40) for t in range(c % 9)],
    *[(50, 3, "user", "Tie.")] * 4, (50, 3, "assistant", "Tie."), (50, None, "user", "Tie."), (50, -2, None, "a"),
    (None, 1, "user", "Hello."), (None, None, "assistant", "x"), (51, None, "user", "Hi."), (52, 1 << 40, "user", "Hi."),
    *[(60, t, "user" if t % 2 else "assistant", f"{t % 50}.") for t in range(300)],
]


@pytest.mark.parametrize("piece,hot", [(C.PIECE, C.HOT), (7, 2)])
def test_equals_plain_version(spark, monkeypatch, piece, hot):
    monkeypatch.setattr(C, "PIECE", piece)
    monkeypatch.setattr(C, "HOT", hot)
    turns = spark.createDataFrame([(*r, 1, "z") for r in ROWS], "conv_id long, turn long, role string, text string, id int, c string").repartition(5)
    got = C.report(turns).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == plain(ROWS) and len(got) == len({r[0] for r in ROWS})


def test_repaired_turns(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", "Yes?"), (1, 2, "tool", "Run."), (2, 0, "user", "")], "k long, n int, who string, body string")
    summary, repaired = C.examined(turns, "k", "n", "who", "body")
    assert {r.k: (r.cost, r.audit) for r in summary.collect()} == {1: (6, "IKKR"), 2: (4, "D")}
    lines = [(r.place, r.role, r.text) for r in repaired.orderBy("place").collect()]
    assert [x[0] for x in lines] == list(range(len(lines))) and [x[1] for x in lines] == ["user", "assistant"] * (len(lines) // 2)


def test_empty(spark):
    assert C.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert C.report(spark.createDataFrame([(5, 1, "user", "")], "conv_id long, turn long, role string, text string")).count() == 1


def test_equals_sql(spark):
    path = Path("/root/testdata/sf0.001/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as from '{path}'")
    got = C.report(spark.read.parquet(str(path)))
    names = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"select {names} from ({C.ORACLE})").fetchall())
