"""Surface features of a turn, from its text alone, as column expressions.

:func:`prepared` adds what many features share (words, sentences, ...) as columns of their own, so
that it is computed once; :data:`FEATURES` are expressions over these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbre.functions import lexicons as L
from timbre.functions import text as T

PREFIX = "__s_"


def _c(name: str) -> Column:
    return F.col(PREFIX + name)


def emoji_position(text: Column) -> Column:
    """lead, end, inline, standalone or none."""
    e = L.EMOJI
    return (
        F.when(~text.rlike(e), F.lit("none"))
        .when(text.rlike(rf"(?U)^(?:{e}|\s)+$"), F.lit("standalone"))
        .when(text.rlike(rf"(?sU)^\s*+.?{e}"), F.lit("lead"))
        .when(text.rlike(rf"(?sU){e}(?:[ .!?]*|\s*.?\s*)$"), F.lit("end"))
        .otherwise(F.lit("inline"))
    )


def strip_tail(text: Column) -> Column:
    """A text without emoji and trailing blanks; if an emoticon is among its last four characters, only
    those, without the emoticon: enough to tell how the text ends."""
    plain = T.rstrip(F.regexp_replace(text, L.EMOJI, ""))
    tail = F.right(plain, F.lit(4))
    return F.when(tail.rlike(L.EMOTICON), T.rstrip(F.regexp_replace(tail, L.EMOTICON, ""))).otherwise(plain)


def casing(text: Column) -> Column:
    """none, all_lower, shouting, lower_starts or standard. Placeholders are not the writer's casing."""
    plain = F.regexp_replace(text, L.PLACEHOLDER, " ")
    letters, upper, lower = (T.count(plain, p) for p in (r"\p{L}", r"\p{Lu}", r"\p{Ll}"))
    head = r"(?U)^\W*([A-Za-z][\w']*)([!,])?\s*(\w)?"

    def start(s: Column) -> Column:
        word, mark, after = (F.regexp_extract(s, head, i) for i in (1, 2, 3))
        vocative = (mark != "") & word.rlike("^[A-Z]") & (after != "")
        return F.when(vocative, after).otherwise(F.substring(word, 1, 1))

    starts = F.filter(F.transform(T.sentences(plain), start), lambda c: c != "")
    low = (F.size(starts) > 0) & F.forall(starts, lambda c: ~c.rlike(r"\p{L}") | c.rlike(r"\p{Ll}"))
    names_only = (T.count(plain, r"(?U)\b[A-Z][a-z']*") <= 1) & ~plain.rlike(r"(?U)^\W*[A-Z][a-z']*\s+[a-z]")
    return (
        F.when(letters == 0, F.lit("none"))
        .when(lower == letters, F.lit("all_lower"))
        .when((upper / letters > 0.7) & (letters > 6), F.lit("shouting"))
        .when(low & names_only, F.lit("all_lower"))
        .when(low, F.lit("lower_starts"))
        .otherwise(F.lit("standard"))
    )


def prepared(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the columns that features share, in steps that are each computed once."""
    t = F.col(text)
    df = df.withColumns(
        {
            PREFIX + "text": t, PREFIX + "words": T.words(t), PREFIX + "sents": F.size(T.sentences(t)), PREFIX + "tail": strip_tail(t),
            PREFIX + "emoji": T.count(t, L.EMOJI), PREFIX + "emoji_at": emoji_position(t), PREFIX + "casing": casing(t),
        }
    )
    df = df.withColumns({PREFIX + "lower": F.transform(_c("words"), F.lower), PREFIX + "size": F.size(_c("words")), PREFIX + "low": T.folded(t)})
    df = df.withColumn(PREFIX + "joined", F.array_join(_c("lower"), " "))
    return df.withColumns({PREFIX + "nw": F.greatest(_c("size"), F.lit(1)).cast("double"), PREFIX + "ns": F.greatest(_c("sents"), F.lit(1)).cast("double")})


def _words_that(condition) -> Column:
    return F.size(F.filter(_c("words"), condition))


def _built() -> dict[str, Column]:
    t, words, lower, nw, ns, tail = (_c(x) for x in ("text", "words", "lower", "nw", "ns", "tail"))
    chars = F.aggregate(words, F.lit(0), lambda a, w: a + F.char_length(w))
    low, sounds, complex_words = _c("low"), T.syllables(_c("joined")), T.long_words(_c("joined"))
    enough = _c("size") >= 5
    out = {
        # size and rhythm
        "words": _c("size"),
        "chars": F.char_length(t),
        "sentences": ns,
        "words_per_sentence": _c("size") / ns,
        "mean_word_length": chars / nw,
        "long_word_rate": _words_that(lambda w: F.char_length(w) >= 7) / nw,
        "line_breaks": T.occurrences(t, "\n"),
        "is_fragment": T.flag((_c("size") <= 3) & ~T.strip(t).rlike("[.!?]$")),
        # punctuation
        "exclamations_per_sentence": T.occurrences(t, "!") / ns,
        "questions_per_sentence": T.occurrences(t, "?") / ns,
        "ends_with_question": T.flag(tail.endswith("?")),
        "ends_with_exclamation": T.flag(tail.endswith("!")),
        "ends_without_punctuation": T.flag(tail.rlike(r"[\p{L}\p{N}]$")),
        "ellipses_per_sentence": (T.count(t, r"\.\.\.") + T.occurrences(t, "…")) / ns,
        "multi_exclamation": T.flag(t.rlike("!{2,}")),
        "multi_question": T.flag(t.rlike(r"\?{2,}")),
        "commas_per_sentence": T.occurrences(t, ",") / ns,
        "dashes_per_sentence": (T.count(t, " - ") + T.occurrences(t, "—") + T.occurrences(t, "–")) / ns,
        "parentheses": T.flag(t.contains("(")),
        "semicolons_colons": (T.occurrences(t, ";") + T.occurrences(t, ":")) / ns,
        "quotes": T.flag(t.rlike('["“”]')),
        # emoji and emoticons
        "emoji_count": _c("emoji"),
        "has_emoji": T.flag(_c("emoji") > 0),
        **{f"emoji_{at}": T.flag(_c("emoji_at") == at) for at in ("lead", "end", "inline", "standalone")},
        "emoticons": T.count(t, L.EMOTICON),
        # casing
        "all_lowercase": T.flag(_c("casing") == "all_lower"),
        "lowercase_sentence_starts": T.flag(_c("casing") == "lower_starts"),
        "shouting": T.flag(_c("casing") == "shouting"),
        "capitalised_words_rate": _words_that(lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.char_length(w) > 1)) / nw,
        # words and register
        "contraction_rate": T.count(t, "(?iU)" + L.CONTRACTION) / nw,
        "uncontracted_forms": T.phrases(low, L.EXPANDABLE) / nw,
        "hedge_rate": T.phrases(low, L.HEDGES) / nw,
        "booster_rate": T.phrases(low, L.BOOSTERS) / nw,
        "intensifier_rate": T.phrases(low, L.INTENSIFIERS) / nw,
        "discourse_marker_rate": T.phrases(low, L.DISCOURSE_MARKERS) / nw,
        "textese_rate": T.phrases(low, L.TEXTESE) / nw,
        "profanity_rate": T.phrases(low, L.PROFANITY) / nw,
        "uk_spelling": T.phrases(low, L.UK),
        "us_spelling": T.phrases(low, L.US),
        "numbers_rate": _words_that(lambda w: w.rlike("^[0-9]")) / nw,
        "placeholder_names": T.count(t, "<PERSON_[0-9]+>"),
        "urls": T.count(t, T.U + L.URLISH),
        **{f"pronoun_{k}": T.share_in(lower, v, nw) for k, v in L.PRONOUNS.items()},
        "addresses_by_name_first": T.flag(t.rlike("(?iU)" + L.NAMED_FIRST)),
        # readability: published formulae over vowel-group syllables; null under five words
        "flesch_reading_ease": F.when(enough, 206.835 - 1.015 * _c("size") / ns - 84.6 * sounds / nw),
        "flesch_kincaid_grade": F.when(enough, 0.39 * _c("size") / ns + 11.8 * sounds / nw - 15.59),
        "gunning_fog": F.when(enough, 0.4 * (_c("size") / ns + 100 * complex_words / nw)),
    }
    return {k: v.cast("double") for k, v in out.items()}


NAMES = [
    "words", "chars", "sentences", "words_per_sentence", "mean_word_length", "long_word_rate", "line_breaks", "is_fragment", "exclamations_per_sentence", "questions_per_sentence", "ends_with_question",
    "ends_with_exclamation", "ends_without_punctuation", "ellipses_per_sentence", "multi_exclamation", "multi_question", "commas_per_sentence", "dashes_per_sentence", "parentheses", "semicolons_colons", "quotes",
    "emoji_count", "has_emoji", "emoji_lead", "emoji_end", "emoji_inline", "emoji_standalone", "emoticons", "all_lowercase", "lowercase_sentence_starts", "shouting", "capitalised_words_rate", "contraction_rate",
    "uncontracted_forms", "hedge_rate", "booster_rate", "intensifier_rate", "discourse_marker_rate", "textese_rate", "profanity_rate", "uk_spelling", "us_spelling", "numbers_rate", "placeholder_names", "urls",
    "pronoun_first_singular", "pronoun_first_plural", "pronoun_second", "pronoun_third", "addresses_by_name_first", "flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog",
]


def surface(df: DataFrame, names: list[str] | None = None, text: str = "text") -> DataFrame:
    """``df`` with the named features (all if none are named) as doubles."""
    made = _built()
    ready = prepared(df, text)
    return ready.select(*df.columns, *(made[n].alias(n) for n in names or NAMES))
