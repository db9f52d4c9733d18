"""Whole-text tokenisation through the tokenizers library, at the speed of dictionary look-ups.

Pre-tokenisers cut a text into pieces that the model then encodes one by one, so the encoding of a
piece can be remembered. A text is cut here by an equivalent ``re`` pattern only if it consists of
characters whose class is certain (:data:`PLAIN`); any other text, and any text with a special
string in it, goes to the library whole. Results are the library's in either case.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Latin-1 without control characters other than common white space, and punctuation of U+20xx.
ODD = re.compile("[^\t\n\v\f\r -~\xa1-\xff‐-‧‰-⁞]")
L, N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
CONTRACTIONS = "'(?:s|t|re|ve|m|ll|d)"
#: The pieces of the two pre-tokenisers for texts without odd characters; only contractions and other
#: punctuation can start alike, so letters, the commonest, are tried first.
WORD_PIECES = re.compile(f"[{L}]+|{CONTRACTIONS}|[{N}]|[^ \t-\r{L}{N}]+")
BYTE_PIECES = re.compile(f" ?[{L}]+|{CONTRACTIONS}| ?[{N}]+| ?[^ \t-\r{L}{N}]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
#: A worker forgets the pieces it has met beyond so many.
CACHE_LIMIT = 400_000

_tokenizers: dict = {}


def tokenizer(path: str):
    """The library's tokenizer, loaded once a process."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


class PieceCache:
    """value(ids) of each piece: from ``known``, else remembered, else encoded now."""

    def __init__(self, path: str, pieces: re.Pattern, lower: bool, value: Callable, known: dict | None = None):
        self.library, self.cut, self.lower, self.value = tokenizer(path), pieces.findall, lower, value
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.known = known or {}
        self.memo = dict(self.known)

    def plain(self, text: str) -> bool:
        return not ODD.search(text) and not any(x in text for x in self.special)

    def values(self, texts: Iterable[str]) -> list:
        """For each text: the list of its pieces' values, or of one value for an odd text."""
        if len(self.memo) > CACHE_LIMIT + len(self.known):
            self.memo = dict(self.known)
        memo, cut = self.memo, self.cut
        get, out, unknown = memo.get, [], []
        for text in texts:
            if not self.plain(text):
                out.append(self._odd(text))
                continue
            pieces = cut(text.lower() if self.lower else text)
            values = list(map(get, pieces))
            if None in values:
                unknown += [(values, i, pieces[i]) for i, x in enumerate(values) if x is None]
            out.append(values)
        if unknown:
            new = list({piece for _, _, piece in unknown})
            memo.update(zip(new, self._encoded(new), strict=True))
            for values, i, piece in unknown:
                values[i] = memo[piece]
        return out

    def _odd(self, text: str) -> list:
        return [self.value(self.library.encode(text, add_special_tokens=False).ids)]

    def _encoded(self, pieces: list[str]) -> Iterable:
        return (self.value(x.ids) for x in self.library.encode_batch_fast(pieces, add_special_tokens=False))


class WordEndCache(PieceCache):
    """For models that mark the last token of each piece and pre-tokenisers that drop white space.

    New pieces are encoded many at a time, as one text, and told apart by the marks. Values are the
    pieces' ids as little-endian unsigned 32-bit numbers.
    """

    def __init__(self, path: str, pieces: re.Pattern, lower: bool, mark: str = "</w>"):
        super().__init__(path, pieces, lower, le_bytes)
        self.last = np.zeros(self.library.get_vocab_size(), bool)
        self.last[[i for piece, i in self.library.get_vocab().items() if piece.endswith(mark)]] = True

    def _encoded(self, pieces: list[str]) -> Iterable:
        ids = np.array(self.library.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces):  # a piece whose last token has no mark
            return super()._encoded(pieces)
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return (data[a:b] for a, b in zip([0, *ends], ends, strict=False))


def le_bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()
