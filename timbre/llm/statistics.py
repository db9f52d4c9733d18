"""Counts over whole texts, a batch of texts at a time.

Bytes are counted by class in one pass over the batch; words are the runs without ASCII white
space, which is how ``bytes.split`` cuts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from timbre.llm.common import bounded, release, schema, slices

SYMBOLS = b"#*$%&|<>"
BLANK = b" \t\n\v\f\r"
_CLASSES = {
    "space": BLANK,
    "symbol": SYMBOLS,
    "exclaim": b"!",
    "stop": b".,;:?",
    "digit": b"0123456789",
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "inner": bytes(range(0x80, 0xC0)),
    "lead": bytes(range(0xC0, 0x100)),
    "bracket": b"()[]{}\"'`",
}
CLASSES = [*_CLASSES, "other"]
_LUT = np.full(256, len(CLASSES) - 1, np.int64)
for _i, _members in enumerate(_CLASSES.values()):
    _LUT[list(_members)] = _i

#: What :func:`counts` gives for each text.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_echo", "n_short", "n_upper", "n_letters", "n_exclaim", "n_digits", "n_stops", "n_brackets", "n_other", "longest_word"]
WINDOW = 8


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the list, the first included."""
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    often, total, covered = Counter(grams), 0, 0
    for i, gram in enumerate(grams):
        if often[gram] > 1:
            total += i + window - max(covered, i)
            covered = i + window
    return total


def counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The :data:`COUNTS` of each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    k = len(CLASSES)
    by = np.bincount(np.repeat(np.arange(len(texts)) * k, sizes) + _LUT[data], minlength=k * len(texts)).reshape(-1, k)
    of = {c: by[:, i] for i, c in enumerate(CLASSES)}
    rows = []
    for text in texts:
        words, lines, dup = text.split(), 1, 0
        if b"\n" in text:
            full = [x for x in text.split(b"\n") if x.strip(BLANK)]
            lines, dup = len(full), len(full) - len(set(full))
        n = len(words)
        lengths = list(map(len, words))
        rows.append((n, dup, repeated_words(words) if n > WINDOW else 0, lines, len(set(words)), sum(map(eq, words, words[1:])), sum(x <= 3 for x in lengths), max(lengths, default=0)))
    own = np.array(rows, np.int64).reshape(-1, 8).T
    return {
        "n_words": own[0], "word_chars": sizes - of["space"] - of["inner"], "n_symbols": of["symbol"], "n_dup_lines": own[1], "n_repeat_words": own[2], "n_lines": own[3],
        "n_distinct": own[4], "n_echo": own[5], "n_short": own[6], "n_upper": of["upper"], "n_letters": of["upper"] + of["lower"] + of["lead"],
        "n_exclaim": of["exclaim"], "n_digits": of["digit"], "n_stops": of["stop"], "n_brackets": of["bracket"], "n_other": of["other"], "longest_word": own[7],
    }


def measured(df: DataFrame, keep: list[str], text_col: str = "text", prefix: str = "") -> DataFrame:
    """``keep`` and the :data:`COUNTS` of each row's text (null: as empty), their names after ``prefix``."""
    rows = df.select(*keep, *([] if text_col in keep else [text_col]))
    out = schema(rows, keep, ", ".join(f"{prefix}{c} long" for c in COUNTS))
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            found = counts([x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], names=out.names)
        release()

    return bounded(rows).mapInArrow(run, out)
