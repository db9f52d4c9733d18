"""Personal data, also where it is disguised, at its place in the source text.

Base identifiers are found in the text as it is. Then a transducer rewrites what disguises them
(letters that look like others, invisible characters, spelled digits, spelled at and dot) into the
plain form and keeps, for every stretch of its output, the stretch of the source it came from. What
is found in the plain form only is mapped back to source characters and added.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from timbre.llm.common import bounded, only, schema, slices, texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is entered at its start only: from inside, no more can match.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign with the longest run of local characters before it, in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Plain identifiers by kind as listed, then start; ends are exclusive, counts are code points."""
    found: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    if _DOTTED.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return found


# Letters of other scripts that look like Latin ones, and the Latin ones.
_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ⅼ": "l", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "。": ".", "․": ".",
}
# Characters without width.
_INVISIBLE = "­​‌‍⁠﻿"
# Digits as words in English, German, French and Spanish.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}


def _same_width() -> dict[int, str]:
    """Characters that stand for one ASCII character: compatibility forms (by Unicode's own rule, but
    for super- and subscripts), decimal digits of any script, and the look-alikes."""
    table = {}
    for i in range(128, sys.maxunicode + 1):
        c = chr(i)
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and plain.isascii() and not unicodedata.decomposition(c).startswith(("<super>", "<sub>")):
            table[i] = plain
        elif unicodedata.category(c) == "Nd":
            table[i] = str(unicodedata.digit(c))
    return table | {ord(k): v for k, v in _LOOKALIKES.items()}


_table: dict[int, str] = {}
#: Of Latin-1, only the no-break space and the soft hyphen are rewritten.
_BEYOND = re.compile("[\xa0\xad\u0100-\U0010ffff]")
_WORD = "|".join(sorted(_SPELLED, key=len, reverse=True))
_GAP = r"(?:[ \t]*[-,.][ \t]*|[ \t]+)"
_LOOSE = r"[ \t,.()-]{1,4}"
_DOT = r"(?:[ \t]*\.[ \t]*|[ \t]+(?:dot|punkt|point|punto)[ \t]+)"
#: Stretches of digits: spelled and single ones, or spelled ones among groups, their gaps to be left out.
_NUMBER = re.compile(rf"(?i)(?:\bplus{_GAP})?\b(?:(?:{_WORD})\b|[0-9]\b)(?:{_GAP}(?:(?:{_WORD})\b|[0-9]\b))+")
_GROUPS = re.compile(rf"(?i)(?:\bplus{_LOOSE})?\b(?:(?:{_WORD})|[0-9]+)\b(?:{_LOOSE}(?:(?:{_WORD})|[0-9]+)\b)+")
#: Long stretches alone, so that shorter ones beside them don't lengthen what they say; then all.
_STRETCHES = ((_NUMBER, 7, 3), (_NUMBER, 2, 2), (_GROUPS, 2, 2))
_PART = rf"(?:(?:{_WORD})|[0-9]{{1,3}})\b(?:[ \t-]{{1,2}}(?:(?:{_WORD})|[0-9]{{1,3}})\b){{0,2}}"
_PARTS = re.compile(rf"(?i)\b{_PART}(?:{_DOT}{_PART}){{3}}")
_DOTS = re.compile(rf"(?i){_DOT}")
_TOKEN = re.compile(rf"(?i)\b(?:plus|{_WORD}|[0-9]+)\b")
#: Brackets are entered at the opening one; blanks around them are taken by hand, each run once.
_BRACKETED = re.compile(r"(?i)[\[({<][ \t]*(?:(at|@|arroba|arobase)|dot|\.|punkt|point|punto)[ \t]*[\])}>]")
#: A spoken at is entered at the start of the blanks before it, and what follows is read from there.
_AT = re.compile(r"(?i)(?<![ \t])[ \t]+at[ \t]+|@")
_HOST = re.compile(r"(?i)[A-Za-z0-9-]+(?:(?:[ \t]+dot[ \t]+|\.)[A-Za-z0-9-]+)+")
_SPOKEN_DOT = re.compile(r"(?i)(?<![ \t])[ \t]+dot[ \t]+")
_NUMBERS_DOT = re.compile(r"(?i)(?<![0-9])[0-9]{1,3}(?:[ \t]+dot[ \t]+[0-9]{1,3}){3}(?![0-9])")
# Words before a name that say that an address follows.
_CUES = frozenset("mail email e-mail mailto contact write address addresse adresse correo courriel reach".split())
# Words that stand before an ordinary at.
_ORDINARY = frozenset(
    "a about all also am and anyone are arrive arrived available based be been book buy call chat check click come data day download eat everyone find found get go going good guess here him her hosted i in information is it join jump just later left live lives located look looked looking looks me meet meeting met more new news not now off on once one online only order out page people point pointed read registered run see sell shop shown sign site sold someone speak start started stay stayed stop store talk team that them there these this those time today tomorrow up us visit was we web were what work worked working works you yours".split()
)
#: Ends of hosts that count after a spoken at: two letters or one of these.
_ENDS = frozenset("com org net edu gov info biz".split())
_HINT = re.compile(r"[\[({<][ \t]*(?:[aA]|[dD]|[pP]|@|\.)|[ \t](?:dot|DOT|Dot|at|AT|At)[ \t]")
_DOT_HINT = re.compile(r"[\[({<][ \t]*(?:[dD]|[pP]|\.)|[ \t](?:dot|DOT|Dot)[ \t]")
_invisible = re.compile(f"[{_INVISIBLE}]")


class Plain:
    """The plain form of a text and the way back."""

    def __init__(self, text: str):
        self.text, self.starts, self.source = text, [0], [(0, len(text), True)]

    def rewrite(self, edits: Iterable[tuple[int, int, str]]) -> Plain:
        """Stretches of the plain form replaced; edits are in order and apart."""
        out, starts, source, done, size = [], [], [], 0, 0

        def keep(upto):
            nonlocal done, size
            for a, b, (s, e, same) in self._parts(done, upto):
                starts.append(size)
                source.append((s, e, same))
                out.append(self.text[a:b])
                size += b - a

        for a, b, new in edits:
            keep(a)
            if new:
                starts.append(size)
                source.append((self.back(a, b)) + (False,))
                out.append(new)
                size += len(new)
            done = b
        keep(len(self.text))
        made = Plain("".join(out))
        made.starts, made.source = starts or [0], source or [(0, 0, True)]
        return made

    def _parts(self, a: int, b: int):
        """The stretch from a to b as (start, end, its source)."""
        i = bisect_right(self.starts, a) - 1
        while a < b:
            end = min(b, self.starts[i + 1] if i + 1 < len(self.starts) else len(self.text))
            s, e, same = self.source[i]
            if end > a:
                yield a, end, (s + a - self.starts[i], s + end - self.starts[i], True) if same else (s, e, False)
            a, i = max(a, end), i + 1

    def back(self, a: int, b: int) -> tuple[int, int]:
        """Source span of a span of the plain form."""
        i, j = bisect_right(self.starts, a) - 1, bisect_right(self.starts, b - 1) - 1
        s, e = self.source[i], self.source[j]
        return (s[0] + a - self.starts[i] if s[2] else s[0]), (e[0] + b - self.starts[j] if e[2] else e[1])


def normalised(text: str) -> list[Plain]:
    """The plain forms, none for a text that has no disguise: without what is spelled, then with spelled
    digits rewritten, in turn, as parts of an address, next to each other, and among groups of digits."""
    plain, changed = Plain(text), False
    if _BEYOND.search(text):
        if not _table:
            _table.update(_same_width())
        same = text.translate(_table)
        if same != text:
            plain.text, changed = same, True
        if _invisible.search(same):
            plain, changed = plain.rewrite([(*m.span(), "") for m in _invisible.finditer(same)]), True
    hint = _HINT.search(plain.text)
    dotted = hint and _DOT_HINT.search(plain.text)
    worded = plain
    if hint:
        if edits := _bracketed(plain.text):
            plain, changed = plain.rewrite(edits), True
        worded = plain
        for found in (_spoken, _dotted):
            if edits := found(plain.text):
                plain, changed = plain.rewrite(edits), True
    forms = [plain] if changed else []
    spelled = _PAIR.search(plain.text) or _FIRST.match(plain.text)
    if (spelled or dotted) and (edits := _addresses(worded.text)):
        forms.append(worded.rewrite(edits))
    if spelled:
        forms += [plain.rewrite(edits) for pattern, least, few in _STRETCHES if (edits := _digits(pattern, plain.text, least, few))]
    return forms


def _bracketed(text: str) -> list[tuple[int, int, str]]:
    """Edits that write an at or dot in brackets, with the blanks around, as such."""
    edits, done = [], 0
    for m in _BRACKETED.finditer(text):
        a, b = m.span()
        while a > done and text[a - 1] in " \t":
            a -= 1
        while b < len(text) and text[b] in " \t":
            b += 1
        edits.append((a, b, "@" if m[1] else "."))
        done = b
    return edits


def _spoken(text: str) -> list[tuple[int, int, str]]:
    """Edits that write an address with a spoken at or dot plainly.

    A spoken at stands in many ordinary sentences, so more must speak for an address: a cue before the name
    or a name with a digit or mark in it; or else a host with a spoken dot and a name that is no ordinary
    word before an at.
    """
    edits, done = [], 0
    for m in _AT.finditer(text):
        if m.start() < done or not (host := _HOST.match(text, m.end())):
            continue
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        name, dots = text[start : m.start()], [d.span() for d in _SPOKEN_DOT.finditer(text, *host.span())]
        spoken = m.group() != "@"
        end = host.group().rsplit(None, 1)[-1].rsplit(".", 1)[-1].lower()
        if not name or not (dots or spoken) or not (end in _ENDS or len(end) == 2) or not end.isalpha():
            continue
        if spoken:
            plain_word = name.isalpha()
            if plain_word and name.lower() in _ORDINARY or not (dots or not plain_word or _cue(text, start)):
                continue
            edits.append((*m.span(), "@"))
        edits += [(*d, ".") for d in dots]
        done = host.end()
    return edits


def _cue(text: str, start: int) -> bool:
    """Whether the word before ``start`` says that an address follows."""
    before = text[max(0, start - 16) : start].rstrip(" \t:=,").lower()
    return before.rsplit(None, 1)[-1].strip("(\"'") in _CUES if before else False


def _dotted(text: str) -> list[tuple[int, int, str]]:
    """Edits that write the spoken dots of four numbers as such."""
    return [(*d.span(), ".") for whole in _NUMBERS_DOT.finditer(text) for d in _SPOKEN_DOT.finditer(text, *whole.span())]


#: A spelled digit before another digit: cheap to look for, and rare.
_PAIR = re.compile(rf"(?i)[\s,.():;-](?:{_WORD})[ \t,.()-]+(?:(?:{_WORD})\b|[0-9])")
_FIRST = re.compile(rf"(?i)(?:{_WORD})[ \t,.()-]+(?:(?:{_WORD})\b|[0-9])")


def _digits(pattern: re.Pattern, text: str, least: int, few: int) -> list[tuple[int, int, str]]:
    """Edits that write stretches of at least so many tokens and spelled digits as digits without gaps."""
    edits = []
    for whole in pattern.finditer(text):
        tokens = list(_TOKEN.finditer(text, *whole.span()))
        if len(tokens) >= least and sum(m.group().lower() in _SPELLED for m in tokens) >= few:
            edits += _written(tokens)
    return edits


def _written(tokens: list[re.Match]) -> list[tuple[int, int, str]]:
    """Edits that write tokens as digits and leave out what is between them."""
    edits, at = [], tokens[0].start()
    for m in tokens:
        if m.start() > at:
            edits.append((at, m.start(), ""))
        word = m.group().lower()
        edits.append((*m.span(), "+" if word == "plus" else _SPELLED.get(word, word)))
        at = m.end()
    return edits


def _addresses(text: str) -> list[tuple[int, int, str]]:
    """Edits that write four parts with spelled digits, and dots as such or as words, as an address."""
    edits = []
    for whole in _PARTS.finditer(text):
        dots = list(_DOTS.finditer(text, *whole.span()))
        cuts = [whole.start(), *(x for d in dots for x in d.span()), whole.end()]
        parts = [list(_TOKEN.finditer(text, a, b)) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        # what stands around the address may look like more of it
        while len(parts[0]) > 1 and not _byte(parts[0]):
            parts[0].pop(0)
        while len(parts[3]) > 1 and not _byte(parts[3]):
            parts[3].pop()
        if any(m.group().lower() in _SPELLED for part in parts for m in part):
            for part, dot in zip(parts, [*dots, None], strict=True):
                edits += _written(part) + ([(*dot.span(), ".")] if dot else [])
    return edits


def _byte(part: list[re.Match]) -> bool:
    digits = "".join(_SPELLED.get(m.group().lower(), m.group()) for m in part)
    return len(digits) <= 3 and int(digits) <= 255


def _reach(spans: list[Span]) -> dict[str, tuple[list[int], list[int]]]:
    """Of each kind the starts in order, and how far spans reach that start there or before."""
    out: dict[str, tuple[list[int], list[int]]] = {k: ([], []) for k in KINDS}
    for kind, start, end in sorted(spans, key=lambda x: x[1]):
        starts, ends = out[kind]
        starts.append(start)
        ends.append(max(end, ends[-1]) if ends else end)
    return out


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): a disguised identifier is added unless it lies inside a base span of its kind."""
    base = base_spans(text)
    added: list[Span] = []
    for plain in normalised(text):
        known = _reach(base + added)
        for kind, a, b in base_spans(plain.text):
            start, end = plain.back(a, b)
            starts, ends = known[kind]
            i = bisect_right(starts, start)
            if not i or ends[i - 1] < end:
                added.append((kind, start, end))
    return base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1], x[2])) if added else base


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, numbers of base identifiers, ``base_sha256`` of their spans, and ``spans`` of all.

    Null and empty texts have none (the digest is that of an empty string). Repeated rows are searched
    each on their own; other columns play no part; an empty table gives an empty result.
    """
    rows = only(docs, **{id_col: id_col, "text": text_col})
    out = schema(rows, [id_col], ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
    types = [to_arrow_type(f.dataType) for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for text in texts(batch.column(1)):
                base, every = all_spans(text)
                kinds = [k for k, _, _ in base]
                found.append((*map(kinds.count, KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            columns = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types[1:], strict=True))], names=out.names)

    return bounded(rows).mapInArrow(run, out)
