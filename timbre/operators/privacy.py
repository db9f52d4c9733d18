"""Anonymisation, quarantine, rare spans and memorisation."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbre.functions import text as T
from timbre.session import checkpointed

# Recognisers by entity; of two that find the same span, the first listed names it.
RECOGNISERS = {
    "HANDLE": r"(?<![\w@])@[A-Za-z0-9_.]{2,30}\b",
    "UK_PHONE": r"(?:(?:\+44\s?|0044\s?|\(?0)(?:\d\s?){9,10})",
    "UK_POSTCODE": r"\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b",
    "REFERENCE": r"\b(?:order|booking|ref|reference|ticket|case)\s*(?:no\.?|number|#|:)?\s*[A-Z0-9-]{5,}\b",
    "EMAIL_ADDRESS": r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b",
    "URL": r"https?://\S+|www\.\S+",
    "CREDIT_CARD": r"\b\d(?:[ -]?\d){12,18}\b",
    "IBAN_CODE": r"\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,3})?\b",
    "IP_ADDRESS": r"\b(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}\b",
    "PHONE_NUMBER": r"\+\d[\d ().-]{7,}\d",
    "DATE_TIME": r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b",
    "LONG_NUMBER": r"\b\d[\d\s-]{7,}\d\b",
}
# What must not be left after replacement.
HIGH_RISK = (r"[\w.+-]+@[\w-]+\.[\w.]+", r"\b[0-9]{10,}\b", r"\b[0-9]{4}[\s-][0-9]{4}[\s-][0-9]{4}[\s-][0-9]{4}\b")
# How a location or a date identifies someone.
SPECIFIC = {
    "LOCATION": r"\d|\b(street|st|road|rd|avenue|ave|lane|flat|apt|close|drive)\b",
    "DATE_TIME": r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b|\b(19|20)\d{2}\b.*\b\d{1,2}\b",
}
RENAMED = {"HANDLE": "PERSON", "PHONE_NUMBER": "PHONE", "UK_PHONE": "PHONE"}
#: entity, start, end
Found = tuple[str, int, int]
#: A backend finds further entities (names, places) in a text; it is loaded on the workers.
Backend = Callable[[str], Iterable[Found]]

_compiled = {k: re.compile(v, re.I if k in ("REFERENCE",) else 0) for k, v in RECOGNISERS.items()}
_specific = {k: re.compile(v, re.I if k == "LOCATION" else 0) for k, v in SPECIFIC.items()}


def _luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def entities(text: str, backend: Backend | None = None) -> list[Found]:
    """Entities from left to right without overlaps: of those that overlap, the earliest and longest."""
    found = [(k, *m.span()) for k, p in _compiled.items() for m in p.finditer(text) if k != "CREDIT_CARD" or _luhn(m.group())]
    found += list(backend(text)) if backend else []
    found = [x for x in found if x[0] not in _specific or _specific[x[0]].search(text[x[1] : x[2]])]
    out: list[Found] = []
    for x in sorted(found, key=lambda x: (x[1], x[1] - x[2], list(RECOGNISERS).index(x[0]) if x[0] in RECOGNISERS else -1)):
        if not out or x[1] >= out[-1][2]:
            out.append(x)
    return out


class _Conversation:
    """Placeholders of one conversation: a person has the same number wherever they are named in it, in
    the order of first mention."""

    def __init__(self, backend: Backend | None = None):
        self.backend, self.people = backend, {}

    def replaced(self, text: str) -> tuple[str, dict[str, int]]:
        """A turn's text with placeholders, and how many of each kind."""
        parts, done, n = [], 0, defaultdict(int)
        for entity, start, end in entities(text, self.backend):
            kind = RENAMED.get(entity, entity)
            place = f"<{kind}>"
            if kind == "PERSON":
                place = self.people.setdefault(text[start:end].strip().lower().lstrip("@"), f"<PERSON_{len(self.people) + 1}>")
            parts += [text[done:start], place]
            done = end
            n[kind] += 1
        return "".join([*parts, text[done:]]), dict(n)


def anonymise(turns: DataFrame, backend: Backend | None = None) -> DataFrame:
    """``turns`` with placeholders in ``text`` and ``replaced`` (map of counts by kind).

    Numbering follows a conversation, so conversations are read whole, one after the other, from
    partitions sorted by conversation and turn; memory holds one turn and a conversation's people.
    """
    columns = turns.columns
    ddl = turns.withColumn("replaced", F.expr("map('', 0)")).schema
    text_at, doc_at = columns.index("text"), columns.index("doc_id")

    def run(frames: Iterator) -> Iterator:
        doc, here = object(), _Conversation(backend)
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                if row[doc_at] != doc:
                    doc, here = row[doc_at], _Conversation(backend)
                text, n = here.replaced(row[text_at]) if isinstance(row[text_at], str) else (None, {})
                out.append((*row[:text_at], text, *row[text_at + 1 :], n))
            yield pd.DataFrame(out, columns=[*columns, "replaced"])

    ordered = turns.repartition("doc_id").sortWithinPartitions("doc_id", "turn_id")
    return ordered.mapInPandas(run, ddl)


def pii_replaced(text: Column) -> Column:
    """JVM-only replacement of the patterns that need no numbering, in a fixed order."""
    out = text
    for kind in ("EMAIL_ADDRESS", "URL", "IP_ADDRESS", "CREDIT_CARD", "UK_PHONE", "PHONE_NUMBER", "LONG_NUMBER", "UK_POSTCODE"):
        out = F.regexp_replace(out, "(?U)" + RECOGNISERS[kind], f"<{RENAMED.get(kind, kind)}>")
    return out


def at_risk(text: Column) -> Column:
    """Whether an e-mail address, ten or more digits or a card number is left."""
    found = F.lit(False)
    for p in HIGH_RISK:
        found |= text.rlike("(?iU)" + p)
    return found


def quarantined(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns to keep, turns to drop)."""
    return turns.where(~at_risk(F.col("text"))), turns.where(at_risk(F.col("text")))


def report(anonymised: DataFrame) -> dict:
    """Of the result of :func:`anonymise`, before quarantine: rows, rows at risk, and replacements by kind. One
    pass counts them; what comes back is a row a kind."""
    kinds = anonymised.select(at_risk(F.col("text")).alias("risk"), F.explode(F.concat(F.array(F.struct(F.lit("").alias("key"), F.lit(1).alias("value"))), F.transform(F.map_entries("replaced"), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("int").alias("value"))))).alias("e"))
    rows = kinds.groupBy("e.key").agg(F.sum("e.value").alias("n"), F.sum(F.when(F.col("risk"), F.col("e.value"))).alias("at_risk")).collect()
    found = {r.key: r for r in rows}
    whole = found.pop("", None)
    return {"rows": whole.n if whole else 0, "rows_at_risk": (whole.at_risk or 0) if whole else 0, "replacements": {k: r.n for k, r in sorted(found.items())}}


def rare_spans(turns: DataFrame, n: int = 5, k: int = 3, doc: str = "doc_id") -> DataFrame:
    """ngram, n_docs of n-grams that fewer than k conversations have, but for those of short tokens only.

    Nearly all n-grams are met once, so tasks don't gather them before the one shuffle: they would hold, and spill, all
    of theirs to join next to none. A table of one row a conversation has each n-gram of a conversation once, and
    rows are counted; else pairs of conversation and n-gram are made distinct where the n-gram lies.
    """
    tokens = turns.select(F.col(doc).alias("doc"), T.privacy_tokens(F.col("text")).alias("_tokens"))
    runs = tokens.select("doc", F.inline(_distinct_runs(F.col("_tokens"), n))).where(_long_token(n))
    grams = runs.select("doc", F.concat_ws(" ", *_words(n)).alias("ngram"))
    if turns.groupBy(doc).count().where("count > 1").limit(1).count():
        grams = grams.repartition("ngram").distinct()
    else:
        grams = grams.select("ngram").repartition("ngram")
    return grams.groupBy("ngram").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") < k)


def _words(n: int) -> list[str]:
    return [f"w{i}" for i in range(n)]


def _distinct_runs(tokens: Column, n: int) -> Column:
    """Each run of n tokens of a text once, as in :func:`timbre.functions.text.runs`. In the few texts that repeat a run,
    telling runs are compared as n-grams, and stand whole in w0."""
    whole = F.filter(F.array_distinct(T.ngrams(tokens, n)), _telling)
    nothing = [F.lit(None).cast("string").alias(w) for w in _words(n)[1:]]
    each = F.size(F.array_distinct(T.gram_hashes(tokens, n))) == F.greatest(F.size(tokens) - n + 1, F.lit(0))
    return F.when(each, T.runs(tokens, n)).otherwise(F.transform(whole, lambda g: F.struct(g.alias("w0"), *nothing)))


def _long_token(n: int) -> Column:
    """Whether one of a run's tokens has three letters or more."""
    return F.greatest(*(F.length(w) for w in _words(n)), F.lit(0)) >= 3


def _telling(ngram: Column) -> Column:
    """Whether a token has three letters or more."""
    return ngram.rlike("[^ ]{3}")


#: A class of n-grams that is counted first, of so many.
CLASSES = 16


def clear(turns: DataFrame, n: int = 5, k: int = 3, doc: str = "doc_id") -> DataFrame:
    """The turns of texts without rare spans: what :func:`quotable` finds with the :func:`rare_spans` of the same turns,
    where each has a conversation of its own.

    A text with one rare span goes, so most are told by few of their n-grams. Those of one class of 64-bit hashes are
    counted over all texts; a hash that fewer than k have stands for rare n-grams only. All n-grams of the texts that
    are left are then looked for in all texts, and counted and compared as text: the first count decides how many
    these are, never what is found.
    """
    tokens = turns.select(F.col(doc).alias("doc"), T.privacy_tokens(F.col("text")).alias("_tokens"))
    runs = tokens.select("doc", F.inline(T.runs(F.col("_tokens"), n))).where(_long_token(n)).withColumn("_h", F.xxhash64(*_words(n)))
    some = runs.where(F.pmod("_h", F.lit(CLASSES)) == 0).select("doc", "_h").repartition("_h").distinct()
    gone = some.withColumn("n_docs", F.count("*").over(Window.partitionBy("_h"))).where(F.col("n_docs") < k).select("doc").distinct()
    ids = checkpointed(turns.select(F.col(doc).alias("doc")).join(gone, "doc", "left_anti"))
    left = F.broadcast(ids) if ids.count() <= FILTER_ROWS else ids
    gram = F.concat_ws(" ", *_words(n)).alias("ngram")
    said = checkpointed(runs.join(left, "doc", "left_semi").select("doc", "_h", gram).distinct())
    hashes = checkpointed(said.select("_h").distinct())
    hashes = F.broadcast(hashes) if hashes.count() <= FILTER_ROWS else hashes
    met = runs.join(hashes, "_h", "left_semi").select("doc", gram).repartition("ngram").distinct()
    rare = met.groupBy("ngram").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") < k).select("ngram")
    bad = said.join(rare, "ngram", "left_semi").select("doc").distinct()
    kept = checkpointed(ids.join(bad, "doc", "left_anti")).withColumnRenamed("doc", doc)
    return turns.join(F.broadcast(kept) if kept.count() <= FILTER_ROWS else kept, doc, "left_semi")


#: n-grams of outputs by which the corpus is filtered in memory (8 bytes each); beyond, by a shuffle.
FILTER_ROWS = 2_000_000


def leaks(outputs: DataFrame, turns: DataFrame, allowed: list[str] | None = None, n: int = 8, k: int = 3, key: str = "key", doc: str = "doc_id") -> DataFrame:
    """key, pos, ngram: n-grams of outputs, outside the allowed passages, that the conversations of some turns have but fewer
    than k of them; what :func:`memorisation` finds with their :func:`rare_spans`.

    The outputs, the smaller side, become a filter of 64-bit hashes. A turn's n-grams are hashed where it lies, and
    only those that pass are written out as text, counted by conversation, and compared as text.
    """
    said = outputs.withColumn("text", _without(F.col("text"), allowed)).select(key, T.privacy_tokens(F.col("text")).alias("_tokens"))
    said = checkpointed(said.select(key, F.posexplode(T.ngrams(F.col("_tokens"), n)).alias("pos", "ngram")).where(_telling(F.col("ngram"))).withColumn("_h", F.get(T.gram_hashes(F.split("ngram", " "), n), 0)))
    hashes = said.select("_h").distinct()
    hashes = F.broadcast(hashes) if said.count() <= FILTER_ROWS else hashes
    texts = turns.select(F.col(doc).alias("doc"), "text")
    hits = texts.select("doc", F.explode(T.gram_hashes(T.privacy_tokens(F.col("text")), n)).alias("_h")).join(hashes, "_h", "left_semi")
    docs = checkpointed(hits.select("doc").distinct())
    docs = F.broadcast(docs) if docs.count() <= FILTER_ROWS else docs
    some = texts.join(docs, "doc", "left_semi")  # a conversation's tokens go along with each of its n-grams only here
    tokens = some.select("doc", T.privacy_tokens(F.col("text")).alias("_tokens")).where(F.size("_tokens") >= n)
    met = tokens.select("doc", "_tokens", F.posexplode(T.gram_hashes(F.col("_tokens"), n)).alias("_at", "_h")).join(hashes, "_h", "left_semi")
    found = met.select("doc", F.array_join(F.slice("_tokens", F.col("_at") + 1, F.lit(n)), " ").alias("ngram")).distinct()
    rare = found.groupBy("ngram").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") < k)
    return said.join(rare.select("ngram"), "ngram", "left_semi").select(key, "pos", "ngram")


def violations(texts: DataFrame, rare: DataFrame, n: int = 5, key: str = "key") -> DataFrame:
    """key, pos, ngram: the rare spans of each text, in order, repeats kept."""
    tokens = texts.select(key, T.privacy_tokens(F.col("text")).alias("_tokens"))
    grams = tokens.select(key, F.posexplode(T.ngrams(F.col("_tokens"), n)).alias("pos", "ngram"))
    return grams.join(rare.select("ngram"), "ngram", "left_semi").select(key, "pos", "ngram")


def quotable(texts: DataFrame, rare: DataFrame, n: int = 5, key: str = "key") -> DataFrame:
    """The texts without rare spans."""
    return texts.join(violations(texts, rare, n, key).select(key).distinct(), key, "left_anti")


def memorisation(outputs: DataFrame, rare: DataFrame, allowed: list[str] | None = None, n: int = 8, key: str = "key") -> DataFrame:
    """Leaks: rare spans in outputs, outside the allowed passages (longest first)."""
    return violations(outputs.withColumn("text", _without(F.col("text"), allowed)), rare, n, key)


def _without(text: Column, allowed: list[str] | None) -> Column:
    for a in sorted({x for x in allowed or () if x}, key=lambda x: (-len(x), x)):
        text = F.replace(text, F.lit(a), F.lit(" "))
    return text
