"""DuckDB SQL of features and statistics, from the same fixed values as the Spark side: what the
queries are checked against."""

from __future__ import annotations

import re

from timbre.functions import lexicons as L


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def items(values: list[str]) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def rx_count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


def words(text: str) -> str:
    return f"regexp_extract_all(regexp_replace(regexp_replace({text}, {q(L.URLISH)}, ' URL ', 'g'), {q(L.PLACEHOLDER)}, ' NAME ', 'g'), {q(L.WORD)})"


def sentences(text: str) -> str:
    """RE2 has no look-around: breaks are marked by a character that texts don't have."""
    marked = f"regexp_replace(regexp_replace({text}, '\\n+', chr(1), 'g'), '([.!?…])\\s+([A-Z0-9\"“''(<])', '\\1' || chr(1) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def phrases(text: str, values: list[str]) -> str:
    """Whole phrases between Unicode word bounds: separators are doubled so that neighbours don't share one."""
    one = lambda p: re.sub(r"([^\w])", r"\1\1", p)
    alternatives = "|".join(re.escape(one(p)).replace(r"\ ", " ").replace("'", "'") for p in sorted(values, key=len, reverse=True))
    doubled = f"regexp_replace({text}, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g')"
    return rx_count(doubled, rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{alternatives})(?:$|[^\p{{L}}\p{{N}}_])")


def share(words_: str, values: list[str], n: str) -> str:
    return f"len(list_filter({words_}, lambda x: list_contains({items(values)}, x))) / {n}"


def syllables(word: str) -> str:
    groups = f"len(regexp_extract_all({word}, '[aeiouy]+'))"
    return f"greatest({groups} - (CASE WHEN regexp_matches({word}, '[^aeiouyl]e$') AND {groups} > 1 THEN 1 ELSE 0 END), 1)"


def _count(piece: str) -> str:
    return f"((length(t) - length(replace(t, {q(piece)}, ''))) / {len(piece)})"


def _flag(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 1.0 ELSE 0.0 END)"


TAIL = "rtrim(t)"
FEATURES = {
    "words": "len(w)",
    "chars": "length(t)",
    "sentences": "ns",
    "words_per_sentence": "len(w) / ns",
    "mean_word_length": "coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / nw",
    "long_word_rate": "len(list_filter(w, lambda x: length(x) >= 7)) / nw",
    "line_breaks": _count("\n"),
    "is_fragment": _flag("len(w) <= 3 AND NOT regexp_matches(trim(t), '[.!?]$')"),
    "exclamations_per_sentence": f"{_count('!')} / ns",
    "questions_per_sentence": f"{_count('?')} / ns",
    "ends_with_question": _flag(f"{TAIL} LIKE '%?'"),
    "ends_with_exclamation": _flag(f"{TAIL} LIKE '%!'"),
    "ends_without_punctuation": _flag(f"regexp_matches({TAIL}, '[\\p{{L}}\\p{{N}}]$')"),
    "ellipses_per_sentence": f"({rx_count('t', r'[.][.][.]')} + {_count('…')}) / ns",
    "multi_exclamation": _flag("regexp_matches(t, '!{2,}')"),
    "multi_question": _flag("regexp_matches(t, '[?]{2,}')"),
    "commas_per_sentence": f"{_count(',')} / ns",
    "dashes_per_sentence": f"({rx_count('t', ' - ')} + {_count('—')} + {_count('–')}) / ns",
    "parentheses": _flag("contains(t, '(')"),
    "semicolons_colons": f"({_count(';')} + {_count(':')}) / ns",
    "quotes": _flag("regexp_matches(t, '[\"“”]')"),
    "emoticons": rx_count("t", L.EMOTICON),
    "capitalised_words_rate": "len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x) AND length(x) > 1)) / nw",
    "uncontracted_forms": f"{phrases('t', L.EXPANDABLE)} / nw",
    "hedge_rate": f"{phrases('t', L.HEDGES)} / nw",
    "booster_rate": f"{phrases('t', L.BOOSTERS)} / nw",
    "intensifier_rate": f"{phrases('t', L.INTENSIFIERS)} / nw",
    "discourse_marker_rate": f"{phrases('t', L.DISCOURSE_MARKERS)} / nw",
    "textese_rate": f"{phrases('t', L.TEXTESE)} / nw",
    "profanity_rate": f"{phrases('t', L.PROFANITY)} / nw",
    "uk_spelling": phrases("t", L.UK),
    "us_spelling": phrases("t", L.US),
    "numbers_rate": "len(list_filter(w, lambda x: regexp_matches(x, '^[0-9]'))) / nw",
    "placeholder_names": rx_count("t", "<PERSON_[0-9]+>"),
    "urls": rx_count("t", L.URLISH),
    **{f"pronoun_{k}": share("lw", v, "nw") for k, v in L.PRONOUNS.items()},
    "addresses_by_name_first": _flag(r"regexp_matches(t, '(?i)^[^\p{L}\p{N}_]*(hi|hey|hello|dear|thanks|thank you)?[^\p{L}\p{N}_]*<PERSON_[0-9]+>')"),
    "flesch_reading_ease": f"CASE WHEN len(w) >= 5 THEN 206.835 - 1.015 * len(w) / ns - 84.6 * list_sum(list_transform(lw, lambda x: {syllables('x')})) / nw END",
    "flesch_kincaid_grade": f"CASE WHEN len(w) >= 5 THEN 0.39 * len(w) / ns + 11.8 * list_sum(list_transform(lw, lambda x: {syllables('x')})) / nw - 15.59 END",
    "gunning_fog": f"CASE WHEN len(w) >= 5 THEN 0.4 * (len(w) / ns + 100 * len(list_filter(lw, lambda x: {syllables('x')} >= 3)) / nw) END",
}


def features(names: list[str], source: str, keys: str, rounded: bool = True) -> str:
    """``keys`` and features of a table with a column t."""
    made = ", ".join((f"round(({FEATURES[n]})::DOUBLE, 6) AS {n}" if rounded else f"({FEATURES[n]})::DOUBLE AS {n}") for n in names)
    return f"""SELECT {keys}, {made} FROM (
  SELECT *, list_transform(w, lambda x: lower(x)) AS lw, greatest(len(w), 1)::DOUBLE AS nw, greatest(len(s), 1)::DOUBLE AS ns
  FROM (SELECT *, {words("t")} AS w, {sentences("t")} AS s FROM ({source})))"""


TURNS = "SELECT conv_id AS doc_id, turn AS turn_id, role AS speaker, text AS t FROM conversations"
DOCUMENTS = "SELECT doc_id, coalesce(text, '') AS t FROM documents"

#: Turns with what they answer, by a correlated look-up: the latest earlier turn by someone else.
CONTEXT = """SELECT a.conv_id AS doc_id, a.turn AS turn_id, a.role AS speaker, a.text AS t, b.turn AS prev_turn_id, b.role AS prev_speaker, b.text AS p
FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = (SELECT max(c.turn) FROM conversations c WHERE c.conv_id = a.conv_id AND c.turn < a.turn AND c.role <> a.role)"""

#: The features that statistics are checked on.
STAT_FEATURES = ["words", "words_per_sentence", "mean_word_length", "long_word_rate", "commas_per_sentence", "is_fragment", "hedge_rate", "discourse_marker_rate"]
SIDED = features(STAT_FEATURES, TURNS, "doc_id, turn_id, CASE WHEN speaker = 'assistant' THEN 'target' ELSE 'reference' END AS grp", rounded=False)
LONG = " UNION ALL ".join(f"SELECT doc_id, grp, '{n}' AS feature, {n} AS value FROM sided" for n in STAT_FEATURES)
WITH_LONG = f"WITH sided AS ({SIDED}), vals AS ({LONG})"


def bootstrap(draws: int, seed: int) -> str:
    """CTEs after ``vals``: interval of the target's mean."""
    return f""", tv AS (SELECT * FROM vals WHERE grp = 'target'),
docs AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS cl FROM (SELECT DISTINCT doc_id FROM tv)),
size AS (SELECT count(*) AS nd FROM docs),
sums AS (SELECT feature, cl, sum(value) AS s, count(*) AS c FROM tv JOIN docs USING (doc_id) GROUP BY ALL),
picks AS (SELECT b, ('0x' || substr(md5(concat_ws(':', '{seed}', b, i)), 1, 8))::BIGINT % nd AS cl FROM size, range({draws}) r(b), (SELECT unnest(range((SELECT nd FROM size))) AS i)),
means AS (SELECT feature, b, sum(s) / greatest(sum(c), 1) AS m FROM picks JOIN sums USING (cl) GROUP BY ALL),
ci AS (SELECT feature, CASE WHEN (SELECT count(*) FROM tv WHERE tv.feature = means.feature) >= 3 THEN quantile_cont(m, 0.025) END AS ci_lo, quantile_cont(m, 0.975) AS ci_hi FROM means GROUP BY feature)"""


G = """g AS (SELECT feature, CASE WHEN sp = 0 THEN CASE WHEN ma = mb THEN 0.0 ELSE sign(ma - mb) * 3.0 END ELSE (ma - mb) / sp * (1 - 3 / (4 * (na + nb) - 9)) END AS hedges_g FROM (
  SELECT *, sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS sp FROM (
    SELECT feature, count(*) FILTER (grp = 'target') AS na, count(*) FILTER (grp = 'reference') AS nb, avg(value) FILTER (grp = 'target') AS ma, avg(value) FILTER (grp = 'reference') AS mb,
           var_samp(value) FILTER (grp = 'target') AS va, var_samp(value) FILTER (grp = 'reference') AS vb FROM vals GROUP BY feature)))"""
#: By all pairs of distinct values.
DELTA = """counts AS (SELECT feature, value, count(*) FILTER (grp = 'target') AS a, count(*) FILTER (grp = 'reference') AS b FROM vals GROUP BY ALL),
delta AS (SELECT x.feature, sum(x.a * y.b * sign(x.value - y.value)) / (sum(x.a * y.b)) AS cliffs_delta FROM counts x JOIN counts y USING (feature) GROUP BY x.feature)"""


def contrast(with_long: str, draws: int, seed: int) -> str:
    return f"""{with_long}{bootstrap(draws, seed)}, {G}, {DELTA},
m AS (SELECT feature, avg(value) FILTER (grp = 'target') AS tm, avg(value) FILTER (grp = 'reference') AS rm, avg((value <> 0)::INT) FILTER (grp = 'target') AS tp, avg((value <> 0)::INT) FILTER (grp = 'reference') AS rp,
             count(*) FILTER (grp = 'target') AS nt, count(*) FILTER (grp = 'reference') AS nr FROM vals GROUP BY feature),
j AS (SELECT *, coalesce(rm < ci_lo OR rm > ci_hi, false) AS separated FROM m JOIN ci USING (feature) JOIN g USING (feature) JOIN delta USING (feature))
SELECT feature, round(tm, 6) AS target_mean, round(ci_lo, 6) AS target_ci_lo, round(ci_hi, 6) AS target_ci_hi, round(tp, 6) AS target_present, round(rm, 6) AS reference_mean, round(rp, 6) AS reference_present,
       round(hedges_g, 6) AS hedges_g, round(cliffs_delta, 6) AS cliffs_delta, separated, nt AS n_target, nr AS n_reference,
       round((0.6 * least(coalesce(abs(hedges_g), 0), 3) + 0.8 * coalesce(abs(cliffs_delta), 0)) * separated::INT, 6) AS distinctiveness FROM j"""


def ngrams(tokens: str, n: int) -> str:
    return f"CASE WHEN len({tokens}) >= {n} THEN list_transform(range(1, len({tokens}) - {n} + 2), lambda i: array_to_string({tokens}[i:i + {n - 1}], ' ')) ELSE [] END"


def privacy_tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {q(L.PRIVACY_TOKEN)})"


def rare(n: int, k: int) -> str:
    return f"""SELECT ngram, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({ngrams("p", n)}) AS ngram FROM (SELECT doc_id, {privacy_tokens("coalesce(text, '')")} AS p FROM documents))
GROUP BY ngram HAVING count(DISTINCT doc_id) < {k} AND len(list_filter(string_split(ngram, ' '), lambda x: length(x) >= 3)) > 0"""


def values(columns: str, rows: list[tuple]) -> str:
    """A table of constants: the expected results of golden cases."""

    def literal(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).lower()
        return q(x) if isinstance(x, str) else (f"{x!r}::DOUBLE" if isinstance(x, float) else f"{x}::INTEGER")

    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({columns})"
