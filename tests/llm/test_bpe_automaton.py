import hashlib
import random

import numpy as np
import pytest

from timbre.llm import bpe_automaton as B
from timbre.llm.registry import tokenizer_path
from timbre.llm.vocab import BYTE_PIECES, tokenizer

PATH = tokenizer_path("byte_bpe_50k.json")


def merged(piece, ranks):
    """Ids by merging the pair of least rank, again and again."""
    ids = list(piece)
    while True:
        found = [(ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in ranks]
        if not found:
            return ids
        rank, at = min(found)
        pair, new = (ids[at], ids[at + 1]), ranks[ids[at], ids[at + 1]][1]
        out, i = [], 0
        while i < len(ids):
            if tuple(ids[i : i + 2]) == pair:
                out.append(new)
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out


def small(seed, merges=40):
    """A vocabulary of random merges over few letters, equal halves among them."""
    random.seed(seed)
    labels, made, known = [bytes([b]) for b in range(256)], [], set()
    usable = [ord(c) for c in "abc"]
    while len(made) < merges:
        u, v = random.choice(usable), random.choice(usable)
        if labels[u] + labels[v] in known or len(labels[u] + labels[v]) > 9:
            continue
        known.add(labels[u] + labels[v])
        made.append((u, v, len(labels)))
        labels.append(labels[u] + labels[v])
        usable.append(len(labels) - 1)
    return B.Vocabulary(labels, np.array(made, np.int64), {})


@pytest.mark.parametrize("seed", range(12))
def test_equals_merging(seed, monkeypatch):
    words = small(seed)
    automaton, ranks = B.Automaton(words), {(u, v): (k, new) for k, (u, v, new) in enumerate(words.merges.tolist())}
    pieces = ["".join(random.choices("aabc", k=random.randint(1, 24))).encode() for _ in range(300)] + [b"a" * n for n in range(1, 40)]
    want = [merged(p, ranks) for p in pieces]
    assert [np.frombuffer(x, "<u4").tolist() for x in automaton.encode(pieces)] == want
    monkeypatch.setattr(B, "LONG", 0)
    monkeypatch.setattr(B, "BLOCK", 5)
    monkeypatch.setattr(B, "SLOTS", 64)
    again = B.Automaton(words)
    assert [np.frombuffer(x, "<u4").tolist() for x in again.encode(pieces)] == want
    assert [again.decode(x).encode() for x in want] == pieces


@pytest.mark.parametrize("seed", range(3))
def test_records_equal_the_gadgets_written_out(seed):
    """Arcs of every state as sets, gadget by gadget."""
    words = small(seed, 25)
    arcs, target = [{i: 0 for i in range(256)}], dict.fromkeys(range(256), 0)
    for u, v, new in words.merges.tolist():
        copied = target[u]
        led = target[v]
        arcs.append({x: t for x, t in arcs[copied].items() if x != v})
        target[u] = len(arcs) - 1
        for state in arcs:
            if u in state:
                state[new] = led
        target[new] = led
    automaton, n = B.Automaton(words), len(words.labels)
    states, labels = (x.reshape(-1) for x in np.meshgrid(np.arange(len(arcs)), np.arange(n), indexing="ij"))
    assert automaton.target.tolist()[:256] == [target[i] for i in range(256)]
    for _ in range(2):  # from the records, then from the table
        assert automaton.has(states, labels).tolist() == [x in arcs[s] for s, x in zip(states.tolist(), labels.tolist(), strict=True)]


def test_unfit_vocabularies():
    words = small(1)
    with pytest.raises(ValueError):
        B.Automaton(B.Vocabulary(words.labels[1:], words.merges[:0], {}))


TEXTS = [None, "", "a", "Hello world, it's 2024!", " <|endoftext|>x<|endoftext|>", "<|endoftext|", "漢字 🙂‍ \x85 é\n\n\t", "the " * 4000, "x" * 30_000, "=" * 700 + "   ٣٤", "tie", "tie", "I'LL we'll \r\n  ok"]


def test_equals_library(spark):
    library = tokenizer(PATH)
    docs = spark.createDataFrame([(i, t, 0, b"z") for i, t in enumerate(TEXTS)] + [(None, "tie", 1, b"")], "doc_id long, text string, n_tokens int, ids binary").repartition(3)
    want = {}
    for i, t in [*enumerate(TEXTS), (None, "tie")]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i] = np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)
    got = {r.doc_id: (bytes(r.ids), r.decoded) for r in B.recode(docs, PATH).collect()}
    assert got == want
    sha = lambda x: hashlib.sha256(x).hexdigest()
    told = {r.doc_id: tuple(r)[1:] for r in B.digests(docs, PATH).collect()}
    assert told == {i: (len(a) // 4, sha(a), sha(t.encode())) for i, (a, t) in want.items()}
    assert B.digests(docs.limit(0), PATH).count() == 0 and B.digests(docs.select("text", "doc_id"), PATH, "doc_id", "text").count() == len(want)


def test_round_trip_of_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    library = tokenizer(PATH)
    got = {r.doc_id: r for r in B.recode(docs, PATH).collect()}
    for r in docs.collect():
        assert got[r.doc_id].decoded == (r.text or "")
        assert bytes(got[r.doc_id].ids) == np.array(library.encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_new_pieces_of_the_corpus(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    pieces = sorted({p for t in texts for p in BYTE_PIECES.findall(t)})
    automaton, library = B.Automaton(B.vocabulary(PATH)), tokenizer(PATH)
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(pieces, add_special_tokens=False)]
    assert automaton.encode([p.encode() for p in pieces]) == want
