"""Byte-pair encoding by a tokenization automaton, and decoding by the labels of its arcs.

The automaton reads tokens: a sequence of tokens is accepted exactly if it is what the merges make of its
bytes. It starts as one state with an arc for each byte, and each merge (u, v), in order, applies a gadget:

* the state that arcs u lead to is copied without its arc v, and arcs u lead to the copy from now on;
* every state with an arc u gets an arc for the new token, which leads where v led in the state copied.

So an arc's target depends on its label alone, a state lacks what the one it was copied from lacks and one
label more, and a new label's arcs leave from where its left half's did at the time. These records (for each
state: its label and birth; for each label: halves, birth, target) are the automaton in full,
in some numbers a merge; all arcs written out would be billions. Arcs that texts ask for are looked up
in them and kept in a table of bounded size.

To encode a piece, the automaton runs over the tokens that its bytes spell (found in a trie of labels). Each prefix
of a piece has one accepted sequence, so each position has one state, and the run is a table-driven
step for each token that starts there. Pieces are run through many at a time, and remembered. To decode,
the bytes of the arcs' labels are written one behind the other.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from timbre.llm.common import bounded, only, schema, slices, texts
from timbre.llm.vocab import BYTE_PIECES, PieceCache, le_bytes

#: Slots of the table of arcs (9 bytes each), new pieces that run together, the length from which a piece runs alone,
#: and bytes of such a one that are looked up at once.
SLOTS, TOGETHER, LONG = 1 << 20, 20_000, 512
BLOCK = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the
    other bytes, in order, for the characters from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """Bytes of each label by its number, the merges as numbers (left, right, merged), special strings."""

    labels: list[bytes]
    merges: np.ndarray
    special: dict[str, int]


def vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, of = told["model"], byte_characters()
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    numbers = model["vocab"]
    labels = [b""] * (max([*numbers.values(), *special.values()], default=-1) + 1)
    for text, i in numbers.items():
        labels[i] = bytes(of[c] for c in text)
    for text, i in special.items():
        labels[i] = text.encode()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = np.array([(numbers[u], numbers[v], numbers[u + v]) for u, v in pairs], np.int64).reshape(-1, 3)
    return Vocabulary(labels, merges, special)


class Automaton:
    """The automaton after all merges, its trie of labels and its table of arcs."""

    def __init__(self, words: Vocabulary) -> None:
        n, merges = len(words.labels), words.merges.tolist()
        made = [new for _, _, new in merges]
        bytes_ = {i for i, x in enumerate(words.labels) if len(x) == 1 and i not in set(made) | set(words.special.values())}
        if len(set(made)) < len(made) or {words.labels[i][0] for i in bytes_} != set(range(256)):
            raise ValueError("a label for each byte and one merge for each other label are needed")
        #: For each label: its halves, birth (0: a byte) and the state that its arcs lead to.
        left, right, birth, target = [0] * n, [0] * n, [0] * n, [0] * n
        #: For each state but the first, which has all arcs: the label whose arcs lead to it and its birth. What it was
        #: copied from is the label's target until then, what it lost the merge of that time.
        owner, born = [0], [0]
        for time, (u, v, new) in enumerate(merges, 1):
            left[new], right[new], birth[new], target[new] = u, v, time, target[v]  # also where u is v: before the copy
            target[u] = len(owner)
            owner.append(u)
            born.append(time)
        self.left, self.right, self.birth, self.target, self.owner, self.born = (np.array(x, np.int64) for x in (left, right, birth, target, owner, born))
        #: (u, v) of the merges in order, and their times: what a state lost.
        keys = words.merges[:, 0] * n + words.merges[:, 1]
        order = np.argsort(keys)
        self.lost, self.lost_at = np.append(keys[order], np.iinfo(np.int64).max), np.append(order + 1, 0)
        self.labels, self.special = words.labels, words.special
        self.sizes = np.array([len(x) for x in words.labels], np.int64)
        self._trie([(self.labels[i], i) for i in [*bytes_, *made]])
        self.table: tuple[np.ndarray, np.ndarray] | None = None

    def _trie(self, labels: list[tuple[bytes, int]]) -> None:
        """Edges by (node * 256 + byte) in order, and the label that ends at each node."""
        edges, ends = {}, [-1]
        for text, i in labels:
            node = 0
            for b in text:
                after = edges.setdefault(node << 8 | b, len(ends))
                if after == len(ends):
                    ends.append(-1)
                node = after
            ends[node] = i
        self.edges = edges
        self.edge_keys = np.array(sorted(edges), np.int64)
        self.edge_nodes = np.array([edges[k] for k in self.edge_keys.tolist()], np.int64)
        self.ends = np.array(ends, np.int64)

    # ── arcs ──

    def has(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Whether each state has an arc of each label: from the table, else from the records, then kept."""
        if self.table is None:
            self.table = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        keys, held = self.table
        key = states * len(self.labels) + labels
        slot = ((key.astype(np.uint64) * _MIX) >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)
        found = held[slot]
        new = np.flatnonzero(keys[slot] != key)
        if len(new):
            found[new] = self._has(states[new], labels[new])
            keys[slot[new]], held[slot[new]] = key[new], found[new]
        return found

    def _has(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """From the gadgets' records, with a state as the target of ``u`` at a time.

        The target lost v by a merge (u, v) up to that time. Otherwise the younger of the two tells: an arc of a
        younger label is there if that of the label's left half was; a younger u led at its birth to where its
        right half led just before.
        """
        found = np.ones(len(states), bool)
        at = np.flatnonzero(states > 0)
        u, time, v, n = self.owner[states[at]], self.born[states[at]], labels[at], len(self.labels)
        while len(at):
            key = u * n + v
            i = np.searchsorted(self.lost, key)
            gone = (self.lost[i] == key) & (self.lost_at[i] <= time)
            found[at[gone]] = False
            first, second = self.birth[u], self.birth[v]
            on = np.flatnonzero(~gone & ((first > 0) | (second > 0)))
            at, u, v, time, first, second = at[on], u[on], v[on], time[on], first[on], second[on]
            label = second >= first
            time = np.where(label, np.minimum(time, second), first - 1)
            u, v = np.where(label, u, self.right[u]), np.where(label, self.left[v], v)
        return found

    # ── encoding ──

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = [b""] * len(pieces)
        short = [i for i, p in enumerate(pieces) if 0 < len(p) <= LONG]
        for k in range(0, len(short), TOGETHER):
            some = short[k : k + TOGETHER]
            for i, ids in zip(some, self._together([pieces[i] for i in some]), strict=True):
                out[i] = ids
        for i, p in enumerate(pieces):
            if len(p) > LONG:
                out[i] = self._alone(p)
        return out

    def _spelled(self, data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, label) of the labels that start at each position; ``left``: bytes from there to the piece's end."""
        at, node, found, depth = np.arange(len(data)), np.zeros(len(data), np.int64), [], 0
        while len(at):
            key = node << 8 | data[at + depth]
            i = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
            there = self.edge_keys[i] == key
            at, node, depth = at[there], self.edge_nodes[i[there]], depth + 1
            label = self.ends[node]
            found.append((at[label >= 0], label[label >= 0]))
            more = left[at] > depth
            at, node = at[more], node[more]
        return np.concatenate([a for a, _ in found]), np.concatenate([x for _, x in found])

    def _together(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces step by step: at each offset, the steps of all pieces that are so long."""
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        lengths = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        offset = np.arange(len(data)) - np.repeat(begins, lengths)
        at, label = self._spelled(data, np.repeat(lengths, lengths) - offset)
        order = np.argsort(offset[at], kind="stable")
        at, label = at[order], label[order]
        # one place more a piece than bytes: place p + piece is before byte p
        piece = np.repeat(np.arange(len(pieces)), lengths)
        place = at + piece[at]
        state, came = np.zeros(len(data) + len(pieces), np.int64), np.full(len(data) + len(pieces), -1, np.int64)
        steps = np.searchsorted(offset[at], np.arange(lengths.max() + 1))
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            p, x = place[a:b], label[a:b]
            ok = self.has(state[p], x)
            p, x = p[ok], x[ok]
            p = p + self.sizes[x]
            state[p], came[p] = self.target[x], x
        now, whose, labels, owners = ends + np.arange(len(pieces)), np.arange(len(pieces)), [], []
        while len(now):
            x = came[now]
            labels.append(x)
            owners.append(whose)
            now = now - self.sizes[x]
            more = now > begins[whose] + whose
            now, whose = now[more], whose[more]
        labels, owners = np.concatenate(labels[::-1]), np.concatenate(owners[::-1])
        order = np.argsort(owners, kind="stable")
        ids, cuts = labels[order].astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(owners, minlength=len(pieces)))).tolist()
        return [ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _alone(self, piece: bytes) -> bytes:
        """A very long piece: the same steps, BLOCK bytes of labels looked up at once."""
        data, n = np.frombuffer(piece, np.uint8).astype(np.int64), len(piece)
        state, came = [-1] * (n + 1), [-1] * (n + 1)
        state[0], known = 0, {}
        for start in range(0, n, BLOCK):
            end = min(start + BLOCK, n)
            at, label = self._spelled_from(data, start, end)
            order = np.argsort(at, kind="stable")
            for p, x in zip((at[order] + start).tolist(), label[order].tolist(), strict=True):
                key = state[p], x
                if key not in known:
                    if len(known) >= SLOTS // 8:
                        known.clear()
                    known[key] = bool(self._has(np.array([key[0]]), np.array([x]))[0])
                if known[key]:
                    size = len(self.labels[x])
                    state[p + size], came[p + size] = int(self.target[x]), x
        ids, p = [], n
        while p:
            ids.append(came[p])
            p -= len(self.labels[came[p]])
        return le_bytes(ids[::-1])

    def _spelled_from(self, data: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`_spelled` for the positions start..end, relative to start."""
        most = int(self.sizes.max())
        some = data[start : end + most]
        at, label = self._spelled(some, np.arange(len(some), 0, -1))
        return at[at < end - start], label[at < end - start]

    # ── decoding ──

    def decode(self, ids: Iterable[int]) -> str:
        """The labels one behind the other; what is no UTF-8 becomes U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


class AutomatonCache(PieceCache):
    """Ids of pieces from the automaton. A text with characters of uncertain class is cut by the library's
    pre-tokeniser, after its special strings were taken out; its pieces run through the automaton too."""

    def __init__(self, path: str, automaton: Automaton) -> None:
        super().__init__(path, BYTE_PIECES, False, le_bytes)
        self.automaton = automaton
        self.marks = re.compile("|".join(map(re.escape, sorted(automaton.special, key=len, reverse=True))) or "(?!)")
        self.bytes_of = byte_characters()

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        return self.automaton.encode([p.encode() for p in pieces])

    def _odd(self, text: str) -> list[bytes]:
        out, at = [], 0
        for m in [*self.marks.finditer(text), None]:
            between = text[at : m.start() if m else None]
            cut = [bytes(map(self.bytes_of.__getitem__, p)) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(between)] if between else []
            out += self.automaton.encode(cut)
            if m:
                out.append(le_bytes([self.automaton.special[m[0]]]))
                at = m.end()
        return out


_caches: dict = {}


def recode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``ids`` (binary: little-endian unsigned 32-bit numbers) and ``decoded``, the text that they give.

    ``path``: a byte-level BPE file of the tokenizers library with a label for each byte and one merge for each other
    label. Special strings inside texts are their ids. A null text counts as empty: no ids, an empty text.
    Repeated rows are coded each on their own; a text of any length is whole in one worker; other columns play no
    part; an empty table gives an empty result.
    """
    return _coded(docs, path, id_col, text_col, "ids binary, decoded string", lambda ids, text: (ids, text))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`recode`, but id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` (lowercase hex)."""
    told = lambda ids, text: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    return _coded(docs, path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", told)


def _coded(docs: DataFrame, path: str, id_col: str, text_col: str, columns: str, told: Callable[[bytes, str], tuple]) -> DataFrame:
    rows = only(docs, **{id_col: id_col, "text": text_col})
    out = schema(rows, [id_col], columns)
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(vocabulary(path)))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _caches:
            _caches[path] = AutomatonCache(path, shared.value)
        cache, kinds = _caches[path], to_arrow_schema(out)
        for batch in slices(batches):
            rows = []
            for values in cache.values(texts(batch.column(1))):
                ids = b"".join(values)
                rows.append(told(ids, cache.automaton.decode(np.frombuffer(ids, "<u4").tolist())))
            made = [pa.array(column, kinds.field(k).type) for k, column in enumerate(zip(*rows, strict=True), 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=out.names)

    return bounded(rows).mapInArrow(run, out)
