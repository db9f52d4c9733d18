"""Backends for what needs a model: parsers, classifiers, name finders. None is bundled.

Without a backend, closed word classes and small lists stand in, under names of their own
(``lex_*``), and what only a parser or a model can say is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbre.functions import lexicons as L
from timbre.functions import text as T

#: Gets batches of texts and gives as many rows with a column for each feature.
TextModel = Callable[[pd.Series], pd.DataFrame]

PARSER_FEATURES = [
    *(f"pos_{p}" for p in "noun propn verb aux adj adv pron det adp intj cconj sconj num part".split()), "opens_with_name", "lexical_density", "formality_fscore", "tree_depth_mean", "tree_depth_max",
    "clauses_per_sentence", "subordination_rate", "coordination_rate", "passive_sentence_rate", "imperative_sentence_rate", "interrogative_sentence_rate", "exclamative_sentence_rate", "modal_rate", "negation_rate",
    "past_tense_share", "starts_with_conjunction", "named_entities_rate",
]
LEXICAL = [*(f"lex_{c}" for c in L.CLOSED_CLASSES), "lex_modal", "lex_negation", "lex_starts_with_conjunction", "lex_question_start", "lex_positive", "lex_negative", "lex_sentiment", "lex_formality"]


def lexical(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``df`` with shares of closed word classes, modals, negations and polarity words (JVM only)."""
    lower = F.transform(T.words(F.col("text")), F.lower)
    rows = df.withColumn("_l", lower).withColumn("_n", F.greatest(F.size("_l"), F.lit(1)).cast("double"))
    share = lambda items: T.share_in(F.col("_l"), items, F.col("_n"))
    first = F.coalesce(F.get("_l", 0), F.lit(""))
    made = {f"lex_{c}": share(items) for c, items in L.CLOSED_CLASSES.items()}
    made |= {
        "lex_modal": share(L.MODALS),
        "lex_negation": share(L.NEGATIONS),
        "lex_starts_with_conjunction": first.isin("and", "but", "or", "so", "because").cast("double"),
        "lex_question_start": first.isin(*L.QUESTION_STARTS).cast("double"),
        "lex_positive": share(L.POSITIVE),
        "lex_negative": share(L.NEGATIVE),
        "lex_sentiment": share(L.POSITIVE) - share(L.NEGATIVE),
        "lex_formality": share(L.CLOSED_CLASSES["det"]) + share(L.CLOSED_CLASSES["adp"]) - share(L.CLOSED_CLASSES["pron"]) - share(L.CLOSED_CLASSES["intj"]),
    }
    return rows.select(*df.columns, *(made[n].alias(n) for n in names or LEXICAL))


def with_model(df: DataFrame, model: TextModel, features: list[str]) -> DataFrame:
    """``df`` with the features of a model, batch by batch on the workers; one that is missing is null."""
    ddl = ", ".join(f"`{f}` double" for f in features)

    @F.pandas_udf(ddl)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield model(texts).reindex(columns=features).astype("float64")

    return df.withColumn("_m", run("text")).select(*df.columns, *(F.col(f"_m.`{f}`").alias(f) for f in features))


def without_model(df: DataFrame, features: list[str]) -> DataFrame:
    return df.select(*df.columns, *(F.lit(None).cast("double").alias(f) for f in features))


# ── what the outputs of models become ──

#: Longest piece of a text that a model gets, in characters.
CHUNK = 1200
EMOTION_AT, ACT_AT, ACT_WITH_CUE_AT = 0.3, 0.6, 0.25


def chunks(text: str, limit: int = CHUNK) -> list[str]:
    """A text in pieces of at most ``limit`` characters, cut after a sentence where one ends in the piece's
    second half, else at a blank, else anywhere."""
    out, rest = [], text.strip()
    while len(rest) > limit:
        head = rest[:limit]
        at = max(head.rfind(m) + 1 for m in (". ", "! ", "? ", "\n"))
        if at <= limit // 2:
            at = max(head.rfind(" "), 0) or limit
        out.append(rest[:at].strip())
        rest = rest[at:].strip()
    return [x for x in [*out, rest] if x] or [""]


def chunked(model: TextModel, limit: int = CHUNK) -> TextModel:
    """The model over whole texts of any length: means of its outputs over a text's pieces, by their length."""

    def run(texts: pd.Series) -> pd.DataFrame:
        pieces = [(i, p) for i, t in enumerate(texts) for p in chunks(t or "", limit)]
        made = model(pd.Series([p for _, p in pieces])).astype("float64").reset_index(drop=True)
        weight = pd.Series([max(len(p), 1) for _, p in pieces], dtype="float64")
        of = [i for i, _ in pieces]
        return made.mul(weight, axis=0).groupby(of).sum().div(weight.groupby(of).sum(), axis=0)

    return run


def flags(df: DataFrame, prefix: str, at: float = EMOTION_AT) -> DataFrame:
    """``df`` with ``<prefix>x`` for each probability ``<prefix>x_p``: 1 from the limit on."""
    names = [c for c in df.columns if c.startswith(prefix) and c.endswith("_p")]
    return df.select("*", *((F.col(c) >= at).cast("double").alias(c.removesuffix("_p")) for c in names))


def one_act(df: DataFrame, labels: list[str], prefix: str = "act_") -> DataFrame:
    """``df`` with ``act_<label>`` 1 for the likeliest of ``<label>_p`` columns, and ``act_confidence``."""
    best = F.array_max(F.array(*(F.struct(F.coalesce(F.col(f"{x}_p"), F.lit(0.0)).alias("p"), F.lit(x).alias("x")) for x in labels)))
    rows = df.withColumn("_best", best)
    return rows.select(*df.columns, *((F.col("_best.x") == x).cast("double").alias(f"{prefix}{x}") for x in labels), F.col("_best.p").alias(f"{prefix}confidence"))


def social_acts(df: DataFrame, acts: list[str]) -> DataFrame:
    """``df`` with ``social_<act>`` from entailment (``social_<act>_p``) and cues (``cue_<act>``): present if
    the model is sure, or a cue is there and is enough by itself or the model doesn't deny it."""
    out = []
    for act in acts:
        p = F.coalesce(F.col(f"social_{act}_p"), F.lit(0.0))
        cue = F.col(f"cue_{act}") == 1 if f"cue_{act}" in df.columns else F.lit(False)
        enough = F.lit(act in L.CUE_IS_ENOUGH) | (p >= ACT_WITH_CUE_AT)
        out.append(((p >= ACT_AT) | (cue & enough)).cast("double").alias(f"social_{act}"))
    return df.select("*", *out)
