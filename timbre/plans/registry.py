"""The queries of the library, over whole tables, and the SQL that checks them.

Queries without SQL are those that fit models or fold over an order; they are tested otherwise.
What the tables don't show is in rows derived from them (:mod:`timbre.plans.derived`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbre import backends
from timbre.functions import lexicons as L
from timbre.functions import surface as S
from timbre.functions import text as T
from timbre.operators import context, corpus, density, diversity, exports, privacy, rules, scorer, situations, stats
from timbre.plans import derived
from timbre.plans import duck as D
from timbre.plans import evaluate
from timbre.session import table

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "contrast"
DRAWS, SEED = 200, 7


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def turns(spark: SparkSession, d: str) -> DataFrame:
    return turns_of(table(spark, d, "conversations"))


def turns_of(c: DataFrame) -> DataFrame:
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("turn_id"), F.col("role").alias("speaker"), "text")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def event_turns(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("turn_id"), F.col("event_type").alias("speaker"), F.lit("").alias("text"), "ts")


def r6(df: DataFrame) -> DataFrame:
    """Doubles to six places."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def sided(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d).withColumn("grp", F.when(F.col("speaker") == "assistant", "target").otherwise("reference"))
    return S.surface(rows, D.STAT_FEATURES)


def sided_values(spark: SparkSession, d: str) -> DataFrame:
    return stats.long(sided(spark, d), D.STAT_FEATURES)


# ── surface features ──


def _surface(name: str, features: list[str], source=documents, keys: tuple[str, ...] = ("doc_id",)):
    sql = {documents: D.DOCUMENTS, turns: D.TURNS}[source]

    def run(spark, d):
        return r6(S.surface(source(spark, d), features).select(*keys, *features))

    run.__name__ = name
    query(D.features(features, sql, ", ".join(keys)))(run)


_surface("surface_size", ["words", "chars", "sentences", "words_per_sentence", "mean_word_length", "long_word_rate", "line_breaks", "is_fragment"])
_surface("surface_punct", ["exclamations_per_sentence", "questions_per_sentence", "ellipses_per_sentence", "multi_exclamation", "multi_question", "commas_per_sentence", "dashes_per_sentence", "parentheses", "semicolons_colons", "quotes"])
_surface("surface_endings", ["ends_with_question", "ends_with_exclamation", "ends_without_punctuation", "emoticons"], turns, ("doc_id", "turn_id"))
_surface("surface_lexicon", ["uncontracted_forms", "hedge_rate", "booster_rate", "intensifier_rate", "discourse_marker_rate", "textese_rate", "profanity_rate", "uk_spelling", "us_spelling"])
_surface("surface_words", ["capitalised_words_rate", "numbers_rate", "placeholder_names", "urls", "addresses_by_name_first"])
_surface("surface_pronouns", [f"pronoun_{k}" for k in L.PRONOUNS])
_surface("readability", ["flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog"])


def _texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string")


@query(f"""SELECT speaker, sum(c)::BIGINT AS tokens, count(*)::BIGINT AS types, round(CASE WHEN sum(c) >= 42 THEN sum(1 - CASE WHEN n - c >= 42 THEN list_product(list_transform(range(0, 42), lambda j: (n - c - j)::DOUBLE / (n - j))) ELSE 0 END) END, 6) AS hdd
FROM (SELECT *, sum(c) OVER (PARTITION BY speaker) AS n FROM (SELECT role AS speaker, lower(x) AS term, count(*) AS c FROM (SELECT role, unnest({D.words("text")}) AS x FROM conversations) GROUP BY ALL)) GROUP BY speaker""")
def hdd_richness(spark, d):
    return r6(stats.style_richness(turns(spark, d)))


@query()
def mtld(spark, d):
    return r6(diversity.mtld(turns(spark, d)))


_LATIN = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]"
_LATIN_SQL = f"(CASE WHEN {D.rx_count('t', r'\p{L}')} = 0 THEN 1.0 ELSE {D.rx_count('t', _LATIN)} / {D.rx_count('t', r'\p{L}')} END)"
_FOUND = "regexp_extract_all(lower(t), '[a-z'']+')"


@query(f"SELECT doc_id, round({_LATIN_SQL}::DOUBLE, 6) AS latin FROM ({D.DOCUMENTS})")
def latin_share(spark, d):
    return documents(spark, d).select("doc_id", F.round(T.latin_share(F.col("text")), 6).alias("latin"))


@query(f"SELECT doc_id, latin >= 0.9 AND CASE WHEN n < 6 THEN hits > 0 OR n < 2 ELSE hits / n >= 0.15 END AS english FROM (SELECT doc_id, {_LATIN_SQL} AS latin, len({_FOUND}) AS n, len(list_filter({_FOUND}, lambda x: list_contains({D.items(L.ENGLISH_MARKERS)}, x))) AS hits FROM ({D.DOCUMENTS}))")
def is_english(spark, d):
    return documents(spark, d).select("doc_id", T.is_english(F.col("text")).alias("english"))


@query(f"SELECT lang, count(*)::BIGINT AS n FROM (SELECT lang, {_LATIN_SQL} AS latin, len({_FOUND}) AS n, len(list_filter({_FOUND}, lambda x: list_contains({D.items(L.ENGLISH_MARKERS)}, x))) AS hits FROM (SELECT lang, coalesce(text, '') AS t FROM documents)) WHERE latin >= 0.9 AND CASE WHEN n < 6 THEN hits > 0 OR n < 2 ELSE hits / n >= 0.15 END GROUP BY lang")
def english_only(spark, d):
    return corpus.english_only(documents(spark, d)).groupBy("lang").agg(F.count("*").alias("n"))


# ── corpus ──


@query("SELECT role AS speaker, count(*)::BIGINT AS n FROM conversations GROUP BY role")
def speakers(spark, d):
    return corpus.speakers(turns(spark, d))


@query("SELECT conv_id AS doc_id, turn AS turn_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::BIGINT AS n FROM conversations WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) >= 5")
def at_least_words(spark, d):
    n = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    return corpus.at_least_words(turns(spark, d), 5).select("doc_id", "turn_id", n.cast("long").alias("n"))


@query(f"SELECT conv_id AS doc_id, count(*)::BIGINT AS turns, any_value(r <= greatest(1, round_even(n * 0.2, 0))) AS held FROM conversations JOIN (SELECT conv_id, row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', conv_id)), conv_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations)) USING (conv_id) GROUP BY conv_id")
def split_docs(spark, d):
    return corpus.split_docs(turns(spark, d), 0.2, SEED).groupBy("doc_id").agg(F.count("*").alias("turns"), F.first("held").alias("held"))


@query(f"SELECT conv_id AS doc_id, turn AS turn_id FROM (SELECT conv_id, turn, upto - n + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations JOIN (SELECT conv_id, n, sum(n) OVER (ORDER BY md5(concat_ws(':', '{SEED}', conv_id)), conv_id) AS upto FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)) USING (conv_id) WHERE upto - n < 150) WHERE place <= 150")
def cap_target_docs(spark, d):
    return corpus.cap_target_docs(turns(spark, d), 150, SEED).select("doc_id", "turn_id")


@query(f"SELECT conv_id AS doc_id, turn AS turn_id FROM conversations ORDER BY md5(concat_ws(':', '{SEED}', concat_ws('#', conv_id, turn))), 1, 2 LIMIT 100")
def sample_turns(spark, d):
    return corpus.sample_turns(turns(spark, d), 100, SEED).select("doc_id", "turn_id")


# ── context and dialogue ──


@query(f"SELECT doc_id, turn_id, prev_turn_id, prev_speaker, p AS prev_text FROM ({D.CONTEXT})")
def previous_turn(spark, d):
    return context.previous_turn(turns(spark, d)).select("doc_id", "turn_id", "prev_turn_id", "prev_speaker", "prev_text")


_TW, _PW = D.words("t"), D.words("p")
_LONG = lambda w: f"list_filter(list_transform({w}, lambda x: lower(x)), lambda x: length(x) > 3)"
_RATE = lambda w, v: f"(len(list_filter(list_transform({w}, lambda x: lower(x)), lambda x: list_contains({D.items(v)}, x))) / greatest(len({w}), 1))"
_LSM = "(" + " + ".join(f"(1 - abs({_RATE('tw', v)} - {_RATE('pw', v)}) / ({_RATE('tw', v)} + {_RATE('pw', v)} + 1e-4))" for v in L.STYLE_CATEGORIES.values()) + f") / {len(L.STYLE_CATEGORIES)}"


@query(f"""SELECT doc_id, turn_id, (prev_turn_id IS NOT NULL)::INT::DOUBLE AS has_context, round(CASE WHEN p IS NOT NULL THEN (len(tw) + 1) / (len(pw) + 1) END, 6) AS length_ratio, round(CASE WHEN p IS NOT NULL THEN {_LSM} END, 6) AS lsm,
CASE WHEN p IS NOT NULL THEN contains(p, '?')::INT::DOUBLE END AS answers_question, CASE WHEN p IS NOT NULL THEN (contains(p, '?') AND contains(t, '?'))::INT::DOUBLE END AS asks_back,
round(CASE WHEN p IS NOT NULL THEN len(list_filter({_LONG('tw')}, lambda x: list_contains({_LONG('pw')}, x))) / greatest(len({_LONG('tw')}), 1) END, 6) AS lexical_echo
FROM (SELECT *, {_TW} AS tw, {_PW} AS pw FROM ({D.CONTEXT}))""")
def dialogue_features(spark, d):
    names = [n for n in context.DIALOGUE if n != "reply_latency_s"]
    return r6(context.dialogue(context.previous_turn(turns(spark, d)), names).select("doc_id", "turn_id", *names))


@query("""SELECT a.user_id AS doc_id, a.event_id AS turn_id, round(CASE WHEN b.ts IS NOT NULL THEN greatest((epoch_us(a.ts) - epoch_us(b.ts)) / 1e6, 0) END, 6) AS latency FROM events a
LEFT JOIN (SELECT x.user_id, x.event_id, max(y.event_id) AS prev FROM events x JOIN events y ON y.user_id = x.user_id AND y.event_id < x.event_id AND y.event_type <> x.event_type GROUP BY ALL) p ON p.user_id = a.user_id AND p.event_id = a.event_id
LEFT JOIN events b ON b.event_id = p.prev AND b.user_id = a.user_id""")
def reply_latency(spark, d):
    rows = context.dialogue(context.previous_turn(event_turns(spark, d)), ["reply_latency_s"])
    return rows.select("doc_id", "turn_id", F.round("reply_latency_s", 6).alias("latency"))


_ISLANDS = "SELECT conv_id, turn, role, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS burst FROM (SELECT *, CASE WHEN (lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'user') IS NOT DISTINCT FROM (role = 'user') THEN 0 ELSE 1 END AS new FROM conversations)"


@query(f"SELECT conv_id AS doc_id, burst::BIGINT AS burst, count(*)::BIGINT AS length FROM ({_ISLANDS}) WHERE role = 'user' GROUP BY ALL")
def bursts(spark, d):
    return context.bursts(turns(spark, d), ["user"])


@query(f"""WITH b AS (SELECT count(*) AS n FROM ({_ISLANDS}) WHERE role = 'user' GROUP BY conv_id, burst),
e AS (SELECT conv_id, arg_min(role, turn) = 'user' AS s, arg_max(role, turn) = 'user' AS e FROM conversations GROUP BY conv_id HAVING bool_or(role = 'user'))
SELECT (SELECT count(*) FROM e)::BIGINT AS conversations, (SELECT round(avg(s::INT), 6) FROM e) AS starts_conversation_rate, (SELECT round(avg(e::INT), 6) FROM e) AS ends_conversation_rate,
(SELECT round(avg(n), 6) FROM b) AS mean_burst, (SELECT round(avg((n > 1)::INT), 6) FROM b) AS multi_message_turn_rate""")
def dialogue_summary(spark, d):
    return r6(context.summary(turns(spark, d), ["user"]))


_EDGE = lambda t, last: f"(CASE WHEN len({t}) = 0 THEN '∅' ELSE array_to_string(list_transform({t}[{'-2:' if last else '1:2'}], lambda x: CASE WHEN x LIKE '<%' THEN x ELSE lower(x) END), ' ') END)"
_TOK = f"regexp_extract_all(x, {D.q(L.OPENING_TOKEN)})"


@query(f"""WITH m AS (SELECT conv_id, arg_min(text, turn) AS first, arg_max(text, turn) AS last FROM conversations WHERE role = 'user' GROUP BY conv_id),
p AS (SELECT 'opener' AS side, {_EDGE(_TOK, False)} AS phrase FROM (SELECT first AS x FROM m) UNION ALL SELECT 'closer', {_EDGE(_TOK, True)} FROM (SELECT last AS x FROM m))
SELECT side, phrase, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n DESC, phrase)::INT AS rank FROM (SELECT side, phrase, count(*)::BIGINT AS n FROM p GROUP BY side, phrase)) WHERE rank <= 12""")
def openers_closers(spark, d):
    return context.openers_closers(turns(spark, d), ["user"])


@query(f"""SELECT prev_act, act, n, round(n / sum(n) OVER (PARTITION BY prev_act), 6) AS p FROM (SELECT prev_speaker AS prev_act, speaker AS act, count(*)::BIGINT AS n FROM ({D.CONTEXT}) WHERE prev_speaker IS NOT NULL GROUP BY prev_speaker, speaker)""")
def role_transitions(spark, d):
    rows = context.previous_turn(turns(spark, d)).select(F.col("speaker").alias("act"), F.col("prev_speaker").alias("prev_act"))
    return r6(context.transitions(rows))


def _cue_sql(patterns: list[str]) -> str:
    """RE2's word bounds are ASCII, so they are spelled out at the ends of each pattern."""
    letter = r"[^\p{L}\p{N}_]"

    def bounded(p: str) -> str:
        p = rf"(?:^|{letter}){p[2:]}" if p.startswith(r"\b") else p
        return rf"{p[:-2]}(?:$|{letter})" if p.endswith(r"\b") else p

    return "(" + " OR ".join(f"regexp_matches(t, {D.q('(?i)' + bounded(p))})" for p in patterns) + ")::INT::DOUBLE"


@query(f"SELECT doc_id, turn_id, {', '.join(f'{_cue_sql(p)} AS cue_{a}' for a, p in L.SOCIAL_CUES.items())} FROM ({D.TURNS})")
def social_cues(spark, d):
    return context.social_cues(turns(spark, d)).select("doc_id", "turn_id", *(f"cue_{a}" for a in L.SOCIAL_CUES))


@query(f"SELECT act, round(share, 6) AS share FROM (UNPIVOT (SELECT {', '.join(f'avg({_cue_sql(p)}) AS {a}' for a, p in L.SOCIAL_CUES.items())} FROM ({D.TURNS})) ON COLUMNS(*) INTO NAME act VALUE share)")
def act_profile(spark, d):
    return r6(stats.act_profile(context.social_cues(turns(spark, d)), "cue_"))


@query(f"SELECT doc_id, turn_id, {', '.join(f'round({D.share('lw', v, 'nw')}, 6) AS lex_{c}' for c, v in L.CLOSED_CLASSES.items())} FROM (SELECT *, list_transform(w, lambda x: lower(x)) AS lw, greatest(len(w), 1)::DOUBLE AS nw FROM (SELECT *, {D.words('t')} AS w FROM ({D.TURNS})))")
def lexical_shares(spark, d):
    names = [f"lex_{c}" for c in L.CLOSED_CLASSES]
    return r6(backends.lexical(turns(spark, d), names).select("doc_id", "turn_id", *names))


# ── statistics ──


@query(f"{D.WITH_LONG} SELECT feature, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90, round(avg((value <> 0)::INT), 6) AS present, count(*)::BIGINT AS n FROM vals GROUP BY feature")
def describe(spark, d):
    return r6(stats.describe(sided_values(spark, d)))


@query(f"{D.WITH_LONG}{D.bootstrap(DRAWS, SEED)} SELECT feature, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi FROM ci")
def bootstrap_ci(spark, d):
    return r6(stats.bootstrap_ci(sided_values(spark, d).where("grp = 'target'"), DRAWS, SEED))


@query(f"{D.WITH_LONG}, {D.G} SELECT feature, round(hedges_g, 6) AS hedges_g FROM g")
def hedges_g(spark, d):
    return r6(stats.hedges_g(sided_values(spark, d)))


@query(f"{D.WITH_LONG}, {D.DELTA} SELECT feature, round(cliffs_delta, 6) AS cliffs_delta FROM delta")
def cliffs_delta(spark, d):
    return r6(stats.cliffs_delta(sided_values(spark, d)))


@query(D.contrast(D.WITH_LONG, DRAWS, SEED))
def contrast(spark, d):
    return r6(stats.contrast(sided(spark, d), D.STAT_FEATURES, DRAWS, SEED))


_LABEL_FEATURES = ["words", "mean_word_length", "long_word_rate", "numbers_rate", "exclamations_per_sentence"]
_LABELLED = D.features(_LABEL_FEATURES, "SELECT documents.doc_id, CASE WHEN quality = 1 THEN 'target' ELSE 'reference' END AS grp, text AS t FROM documents JOIN labels USING (doc_id)", "doc_id, grp", rounded=False)
_LABEL_LONG = f"WITH sided AS ({_LABELLED}), vals AS ({' UNION ALL '.join(f'SELECT doc_id, grp, {D.q(n)} AS feature, {n} AS value FROM sided' for n in _LABEL_FEATURES)})"


def labelled(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id")
    return S.surface(rows.withColumn("grp", F.when(F.col("quality") == 1, "target").otherwise("reference")), _LABEL_FEATURES)


@query(f"{_LABEL_LONG}, {D.G}, {D.DELTA} SELECT feature, round(hedges_g, 6) AS hedges_g, round(cliffs_delta, 6) AS cliffs_delta FROM g JOIN delta USING (feature)")
def contrast_labels(spark, d):
    values = stats.long(labelled(spark, d), _LABEL_FEATURES)
    return r6(stats.hedges_g(values).join(stats.cliffs_delta(values), "feature"))


_TERMS = f"SELECT grp, unnest(list_concat(lw, {D.ngrams('lw', 2)})) AS term FROM (SELECT CASE WHEN role = 'assistant' THEN 'target' ELSE 'reference' END AS grp, list_transform({D.words('text')}, lambda x: lower(x)) AS lw FROM conversations)"


@query(f"""WITH c AS (SELECT term, count(*) FILTER (grp = 'target') AS ct, count(*) FILTER (grp = 'reference') AS cr FROM ({_TERMS}) GROUP BY term),
n AS (SELECT sum(ct) AS nt, sum(cr) AS nr FROM c), a AS (SELECT *, (ct + cr) * (500 / (nt + nr)) AS p FROM c, n WHERE ct + cr >= 3 AND term NOT IN ('name', 'url')),
z AS (SELECT *, (ln((ct + p) / (nt + 500 - ct - p)) - ln((cr + p) / (nr + 500 - cr - p))) / sqrt(1 / (ct + p) + 1 / (cr + p)) AS z FROM a),
s AS (SELECT *, CASE WHEN z > 0 THEN 'over' ELSE 'under' END AS side FROM z WHERE abs(z) > 1.96)
SELECT side, rank, term, round(z, 2) AS z, ct::BIGINT AS target, cr::BIGINT AS reference FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY abs(z) DESC, term)::INT AS rank FROM s) WHERE rank <= 40""")
def keyness(spark, d):
    return stats.keyness(turns(spark, d).withColumn("grp", F.when(F.col("speaker") == "assistant", "target").otherwise("reference")))


_PAIRS = [(a, b) for i, a in enumerate(D.STAT_FEATURES) for b in D.STAT_FEATURES[i + 1 :]]


@query(f"WITH sided AS ({D.SIDED}), m AS (SELECT {', '.join(f'{f} - avg({f}) OVER (PARTITION BY grp) AS {f}' for f in D.STAT_FEATURES)} FROM sided) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(CASE WHEN isnan(coalesce(corr({a}, {b}), 0)) THEN 0 ELSE coalesce(corr({a}, {b}), 0) END, 6) AS r FROM m" for a, b in _PAIRS))
def feature_correlation(spark, d):
    return r6(stats.within_correlation(sided(spark, d), D.STAT_FEATURES))


@query()
def prune_redundant(spark, d):
    frame = sided(spark, d)
    kept = rules.prune_redundant(frame, D.STAT_FEATURES, 0.5)
    return spark.createDataFrame(list(kept.items()), "folded string, kept string")


_PHRASES = [r for r in rules.PHRASES if r[0] in D.STAT_FEATURES]


@query(f"""WITH c AS ({D.contrast(D.WITH_LONG, DRAWS, SEED)}), ph AS ({D.values("feature, more, category, statement", _PHRASES)})
SELECT feature, more, category, statement, CASE WHEN abs(target_mean - target_present) < 1e-9 THEN CASE WHEN share >= 0.7 THEN 'usually' WHEN share >= 0.45 THEN 'often' WHEN share >= 0.2 THEN 'sometimes' ELSE 'rarely' END
ELSE CASE WHEN abs(cliffs_delta) >= 0.5 THEN 'usually' WHEN abs(cliffs_delta) >= 0.3 THEN 'often' ELSE 'sometimes' END END AS strength
FROM (SELECT *, target_mean > reference_mean AS more, CASE WHEN target_mean > reference_mean THEN target_present ELSE 1 - target_present END AS share FROM c) JOIN ph USING (feature, more)
WHERE separated AND NOT (abs(coalesce(hedges_g, 0)) < 0.05 AND abs(coalesce(cliffs_delta, 0)) < 0.15)
AND NOT (target_mean BETWEEN 0 AND 1 AND reference_mean BETWEEN 0 AND 1 AND abs(target_mean - reference_mean) < 0.05 AND feature NOT LIKE '%\\_rate' ESCAPE '\\')""")
def statistical_rules(spark, d):
    table_ = r6(stats.contrast(sided(spark, d), D.STAT_FEATURES, DRAWS, SEED))
    return rules.candidates(table_, least_effect=0.05).select("feature", "more", "category", "statement", "strength")


_HELD = f"SELECT conv_id AS doc_id FROM (SELECT conv_id, row_number() OVER (ORDER BY md5(concat_ws(':', '{SEED}', conv_id)), conv_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations)) WHERE r <= greatest(1, round_even(n * 0.2, 0))"
_MEANS = lambda where, p: f"SELECT feature, avg(value) FILTER (grp = 'target') AS {p}t, avg(value) FILTER (grp = 'reference') AS {p}r FROM vals WHERE doc_id {where} ({_HELD}) GROUP BY feature"


@query(f"{D.WITH_LONG}, h AS ({_MEANS('IN', 'h')}), a AS ({_MEANS('NOT IN', 'a')}) SELECT feature, round(ht, 6) AS heldout_target_mean, round(hr, 6) AS heldout_reference_mean, coalesce((ht > hr) = (at_ > ar), false) AS kept FROM h JOIN (SELECT feature, \"at\" AS at_, ar FROM a) USING (feature)")
def heldout_direction(spark, d):
    rows = corpus.split_docs(sided(spark, d), 0.2, SEED)
    means = stats.long(rows.where("not held"), D.STAT_FEATURES).groupBy("feature").agg(F.avg(F.when(F.col("grp") == "target", F.col("value"))).alias("target_mean"), F.avg(F.when(F.col("grp") == "reference", F.col("value"))).alias("reference_mean"))
    return r6(rules.heldout_direction(rows.where("held"), means, D.STAT_FEATURES))


@query("""WITH c AS (SELECT source, count(*) FILTER (toxic = 1) AS h, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source), a AS (SELECT sum(h) AS ah, sum(n) AS an FROM c),
x AS (SELECT *, ah - h AS rh, an - n AS rn FROM c, a)
SELECT source, h::BIGINT AS hits, n::BIGINT AS n, round(least(list_sum(list_transform(range(h, least(h + rh, n)::BIGINT + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + lgamma(rn + 1) - lgamma(h + rh - k + 1) - lgamma(rn - h - rh + k + 1) - lgamma(n + rn + 1) + lgamma(h + rh + 1) + lgamma(n + rn - h - rh + 1)))), 1), 6) AS p FROM x""")
def fisher(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    c = rows.groupBy("source").agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("hits"), F.count("*").alias("n"))
    total = c.agg(F.sum("hits").alias("ah"), F.sum("n").alias("an"))
    x = c.join(F.broadcast(total))
    return r6(x.select("source", "hits", "n", stats.fisher_p(F.col("hits"), F.col("n"), F.col("ah") - F.col("hits"), F.col("an") - F.col("n")).alias("p")))


# ── privacy ──


@query(D.rare(5, 3))
def rare_spans(spark, d):
    return privacy.rare_spans(documents(spark, d), 5, 3)


@query(f"WITH rare AS ({D.rare(5, 3)}), g AS (SELECT doc_id, unnest({D.ngrams('p', 5)}) AS ngram FROM (SELECT doc_id, {D.privacy_tokens('coalesce(text, NULL)')} AS p FROM documents)) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g JOIN rare USING (ngram))")
def quotable(spark, d):
    return privacy.clear(documents(spark, d), 5, 3).select("doc_id")


@query(f"WITH rare AS ({D.rare(8, 3)}), g AS (SELECT item_id, i - 1 AS pos, l[i] AS ngram FROM (SELECT item_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT item_id, {D.ngrams('p', 8)} AS l FROM (SELECT item_id, {D.privacy_tokens('text')} AS p FROM benchmark)))) SELECT item_id, pos::INT AS pos, ngram FROM g WHERE ngram IN (SELECT ngram FROM rare)")
def memorisation(spark, d):
    return privacy.leaks(table(spark, d, "benchmark"), documents(spark, d), None, 8, 3, "item_id")


@query(f"SELECT doc_id FROM ({D.DOCUMENTS}) WHERE NOT (" + " OR ".join(f"regexp_matches(t, {D.q(p)})" for p in (r"(?i)[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.]+", r"(?:^|[^\p{L}\p{N}_])[0-9]{10,}(?:$|[^\p{L}\p{N}_])", r"(?:^|[^\p{L}\p{N}_])[0-9]{4}[\s-][0-9]{4}[\s-][0-9]{4}[\s-][0-9]{4}(?:$|[^\p{L}\p{N}_])")) + ")")
def quarantine(spark, d):
    return privacy.quarantined(documents(spark, d))[0].select("doc_id")


# ── situations, vectors, scorer ──


@query(f"""WITH tf AS (SELECT source, lower(x) AS term, count(*) AS v FROM (SELECT source, unnest({D.words("coalesce(text, '')")}) AS x FROM documents) WHERE length(x) > 2 AND NOT list_contains({D.items(L.FUNCTION_WORDS + L.EXTRA_STOP_WORDS)}, lower(x)) GROUP BY ALL),
s AS (SELECT source, sum(v) AS n, count(*) AS terms FROM tf GROUP BY source), t AS (SELECT term, sum(v) AS total FROM tf GROUP BY term),
z AS (SELECT source, term, v / n * ln(1 + (SELECT avg(n) FROM s) / total) AS score FROM tf JOIN s USING (source) JOIN t USING (term) WHERE v >= 2 OR terms < 30)
SELECT source, rank, term, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, term)::INT AS rank FROM z) WHERE rank <= 8""")
def ctfidf_by_source(spark, d):
    return r6(situations.keywords(documents(spark, d), by="source"))


@query()
def kmeans_situations(spark, d):
    return situations.find(context.previous_turn(turns(spark, d)).where("speaker = 'assistant'"), SEED)[1]


@query()
def density_clusters(spark, d):
    """Clusters of the vectors by density; SQL has no spanning tree, a plain version in the tests has."""
    return density.clusters(table(spark, d, "embeddings"), "vec_id", "embedding", least=10)


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


@query(f"SELECT vec_id, arg_max(m, p) AS match, round(max(p), 6) AS product FROM (SELECT a.vec_id, b.vec_id AS m, {_DOT.format(a='a.embedding', b='b.embedding')} AS p FROM embeddings a, embeddings b WHERE a.label = 0 AND b.label <> 0) GROUP BY vec_id")
def nn_pairs(spark, d):
    e = table(spark, d, "embeddings")
    return r6(situations.nearest(e.where("label = 0"), e.where("label <> 0")))


_CENTS = "SELECT label, list(x / norm ORDER BY i) AS c FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY label)) AS norm FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY ALL)) GROUP BY label"


@query(f"SELECT vec_id, arg_max(c.label, {_DOT.format(a='embedding', b='c')})::INT AS predicted FROM embeddings e, ({_CENTS}) c GROUP BY vec_id")
def style_centroid_classify(spark, d):
    e = table(spark, d, "embeddings")
    return scorer.nearest_centroid(e, scorer.centroids(e)).select("vec_id", F.col("predicted").cast("int").alias("predicted"))


def _two_sides(e: DataFrame) -> DataFrame:
    return scorer.centroids(e.withColumn("grp", F.when(F.col("label") == 0, "target").otherwise("reference")), "grp")


@query(f"""WITH g AS (SELECT CASE WHEN label = 0 THEN 'target' ELSE 'reference' END AS label, embedding FROM embeddings), c AS ({_CENTS.replace("FROM embeddings", "FROM g")})
SELECT vec_id, round({_DOT.format(a='embedding', b="(SELECT c FROM c WHERE label = 'target')")} - {_DOT.format(a='embedding', b="(SELECT c FROM c WHERE label = 'reference')")}, 6) AS style FROM embeddings""")
def style_score(spark, d):
    e = table(spark, d, "embeddings")
    return r6(scorer.style_score(e, _two_sides(e)))


_FIXED = {"features": D.STAT_FEATURES, "log1p": ["words"], "mean": [2.5, 9.0, 4.9, 0.2, 0.4, 0.1, 0.01, 0.02], "scale": [0.8, 4.0, 0.6, 0.1, 0.5, 0.3, 0.05, 0.05], "coef": [0.4, -0.2, 0.3, 0.1, -0.5, -0.3, 0.2, 0.1], "intercept": -0.1}


@query(f"SELECT doc_id, turn_id, round({scorer.to_sql(_FIXED)}, 6) AS score FROM ({D.features(D.STAT_FEATURES, D.TURNS, 'doc_id, turn_id', rounded=False)})")
def scorer_apply(spark, d):
    return r6(scorer.score_texts(turns(spark, d), _FIXED).select("doc_id", "turn_id", "score"))


@query()
def scorer_fit(spark, d):
    model = scorer.fit(sided(spark, d), SEED)
    return spark.createDataFrame(list(zip(model["features"], model["coef"], strict=True)), "feature string, coef double")


@query("""WITH x AS (SELECT quality AS y, length(text) / greatest(length(text) - length(replace(text, ' ', '')), 1) AS s FROM documents JOIN labels USING (doc_id)), r AS (SELECT y, avg(k) OVER (PARTITION BY s) AS k FROM (SELECT *, row_number() OVER (ORDER BY s) AS k FROM x))
SELECT round((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y <> 1)), 6) AS auc, count(*) FILTER (y = 1)::BIGINT AS positives, count(*) FILTER (y <> 1)::BIGINT AS negatives FROM r""")
def auc_rank(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id")
    score = F.char_length("text") / F.greatest(T.occurrences(F.col("text"), " "), F.lit(1.0))
    return r6(stats.auc(rows.select(score.alias("score"), F.col("quality").alias("label"))))


@query()
def attribution_surface(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("turn_id"), F.col("lang").alias("speaker"), "text")
    held = rows.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(10)) < 3).withColumn("key", corpus.key())
    names = ["words", "mean_word_length", "long_word_rate", "commas_per_sentence", "words_per_sentence", "capitalised_words_rate"]
    scores = evaluate.logistic_scores(S.surface(held, names), names)
    found = evaluate.accuracy(scores, SEED)
    return spark.createDataFrame([(float(found["per_turn"]), float(found["per_10_turns"]), int(found["chunks"]))], "per_turn double, per_10_turns double, chunks int")


@query("SELECT round(max(n) / sum(n), 6) AS majority, round(1 / count(*), 6) AS chance FROM (SELECT role, count(*) AS n FROM conversations GROUP BY role)")
def majority_chance(spark, d):
    n = corpus.speakers(turns(spark, d))
    return r6(n.agg((F.max("n") / F.sum("n")).alias("majority"), (1 / F.count("*")).alias("chance")))


def _effects(spark, d, sides: DataFrame) -> dict[str, float]:
    return {r.feature: r.hedges_g for r in stats.hedges_g(stats.long(sides, D.STAT_FEATURES)).collect()}


@query(f"""{D.WITH_LONG}, f AS (WITH {D.G} SELECT * FROM g), h AS (WITH vals2 AS (SELECT * FROM vals WHERE doc_id % 2 = 0), {D.G.replace("FROM vals", "FROM vals2")} SELECT * FROM g)
SELECT round(corr(a, b), 6) AS rho FROM (SELECT (rank() OVER (ORDER BY f.hedges_g) + (count(*) OVER (PARTITION BY f.hedges_g) - 1) / 2) AS a, (rank() OVER (ORDER BY h.hedges_g) + (count(*) OVER (PARTITION BY h.hedges_g) - 1) / 2) AS b FROM f JOIN h USING (feature))""")
def spearman_curve(spark, d):
    sides = sided(spark, d)
    full, half = _effects(spark, d, sides), _effects(spark, d, sides.where("doc_id % 2 = 0"))
    rho = stats.spearman([full[f] for f in D.STAT_FEATURES], [half[f] for f in D.STAT_FEATURES])
    return spark.createDataFrame([(None if rho is None else round(rho, 6),)], "rho double")


# ── exports and sources ──


@query(f"SELECT doc_id, turn_id, CASE WHEN p IS NULL THEN to_json([{{'role': 'assistant', 'content': t}}]) ELSE to_json([{{'role': 'user', 'content': p}}, {{'role': 'assistant', 'content': t}}]) END::VARCHAR AS messages FROM ({D.CONTEXT}) WHERE speaker = 'assistant'")
def sft_pairs(spark, d):
    return exports.sft(context.previous_turn(turns(spark, d)).where("speaker = 'assistant'"))


@query()
def dpo_pairs(spark, d):
    rows = context.previous_turn(turns(spark, d)).withColumn("id", F.xxhash64("doc_id", "turn_id"))
    return exports.dpo(rows.where("speaker = 'assistant'"), rows.where("speaker = 'user'"), situations.hashed_embedder())


_NORM = "trim(regexp_replace(lower(t), '[^\\p{L}\\p{N}_]+', ' ', 'g'))"
_CONV_RARE = D.rare(5, 3).replace("FROM documents", "FROM (SELECT conv_id AS doc_id, text FROM conversations)")


@query(f"""WITH rare AS ({_CONV_RARE}), c AS (SELECT *, len(list_filter(regexp_split_to_array(trim(t), '\\s+'), lambda x: x <> '')) AS n FROM ({D.CONTEXT})),
ok AS (SELECT * FROM c WHERE n BETWEEN 6 AND 90 AND NOT regexp_matches(trim(t), '\\b[2-9]/[0-9]\\b') AND NOT regexp_matches(trim(t), '^\\p{{Ll}}')),
g AS (SELECT doc_id, turn_id, unnest(list_concat({D.ngrams(D.privacy_tokens("t"), 5)}, {D.ngrams(D.privacy_tokens("coalesce(p, '')"), 5)})) AS ngram FROM ok),
clean AS (SELECT * FROM ok WHERE (doc_id, turn_id) NOT IN (SELECT (doc_id, turn_id) FROM g JOIN rare USING (ngram))),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_NORM} ORDER BY length(t) DESC, concat_ws('#', doc_id, turn_id)) AS i FROM clean) WHERE i = 1)
SELECT cluster, rank, key, context, text FROM (SELECT speaker AS cluster, row_number() OVER (PARTITION BY speaker ORDER BY length(t) DESC, concat_ws('#', doc_id, turn_id))::INT AS rank, concat_ws('#', doc_id, turn_id) AS key, p AS context, t AS text FROM once) WHERE rank <= 8""")
def exemplars(spark, d):
    rows = context.previous_turn(turns(spark, d)).withColumns({"key": corpus.key(), "score": F.char_length("text").cast("double"), "cluster": F.col("speaker")})
    return exports.exemplars(rows, privacy.rare_spans(turns(spark, d), 5, 3), n=5).select("cluster", "rank", "key", "context", "text")


@query(f"""WITH a AS (SELECT doc_id, turn_id, {scorer.to_sql(_FIXED)} AS score FROM ({D.features(D.STAT_FEATURES, D.TURNS, 'doc_id, turn_id', rounded=False)})),
b AS (WITH g AS (SELECT CASE WHEN label = 0 THEN 'target' ELSE 'reference' END AS label, embedding FROM embeddings), c AS ({_CENTS.replace("FROM embeddings", "FROM g")})
SELECT vec_id, {_DOT.format(a='embedding', b="(SELECT c FROM c WHERE label = 'target')")} - {_DOT.format(a='embedding', b="(SELECT c FROM c WHERE label = 'reference')")} AS style FROM embeddings)
SELECT doc_id, turn_id, round(0.5 * score + 0.5 / (1 + exp(-20 * style)), 6) AS score FROM a JOIN b ON b.vec_id = a.doc_id""")
def combined_score(spark, d):
    """Turns' surface scores with the style of the vector of their conversation's number."""
    e = table(spark, d, "embeddings")
    style = scorer.style_score(e, _two_sides(e)).select(F.col("vec_id").alias("doc_id"), "style")
    both = scorer.score_texts(turns(spark, d), _FIXED).join(style, "doc_id")
    return r6(both.select("doc_id", "turn_id", scorer.combined(F.col("score"), F.col("style")).alias("score")))


def _plant_sql() -> str:
    """The traits planted in assistants' turns, edit by edit; Java's $1 is RE2's \\1."""
    draw = lambda *parts: f"('0x' || substr(md5(concat_ws(':', '{SEED}', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296"
    has = lambda t: f"{draw(D.q(t.name), 'doc_id', 'turn_id')} < {t.share}"
    steps = f"SELECT *, '<PERSON_' || (1 + floor({draw(D.q('person'), 'doc_id')} * {evaluate.PEOPLE}))::INT || '>' AS person FROM (SELECT conv_id AS doc_id, turn AS turn_id, text, {draw(D.q('host'), 'conv_id')} < {evaluate.TARGET_SHARE} AS ours FROM conversations WHERE role = 'assistant')"
    for t, side in [(evaluate.NOISE, "NOT ours"), *((t, "ours") for t in evaluate.TRAITS)]:
        text = "lower(text)" if t.lower else "text"
        for pattern, replacement in t.edits:
            text = f"regexp_replace({text}, {D.q(pattern)}, replace({D.q(replacement.replace('$1', chr(92) + '1'))}, '{{person}}', person), 'g')"
        steps = f"SELECT * REPLACE (CASE WHEN {side} AND {has(t)} THEN {text} ELSE text END AS text) FROM ({steps})"
    names = ", ".join(f"CASE WHEN ours AND {has(t)} THEN {D.q(t.name)} END" for t in evaluate.TRAITS)
    return f"SELECT doc_id, turn_id, text, concat_ws(',', {names}) AS planted FROM ({steps})"


def _planted(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d).where("speaker = 'assistant'")
    ours = evaluate._draw(SEED, "host", F.col("doc_id").cast("string")) < evaluate.TARGET_SHARE
    return evaluate.with_traits(rows.withColumn("ours", ours), F.col("ours"), SEED)


@query(_plant_sql())
def planted_texts(spark, d):
    """Assistants' turns of a third of the conversations with traits planted in them."""
    return _planted(spark, d).select("doc_id", "turn_id", "text", F.array_join("planted", ",").alias("planted"))


@query()
def planted_traits(spark, d):
    """The features of the planted traits, in conversations with them and others."""
    names = sorted({f for t in evaluate.TRAITS for f in t.features if f in S.NAMES})
    rows = _planted(spark, d).withColumn("grp", F.when(F.col("ours"), "target").otherwise("reference"))
    return r6(stats.contrast(S.surface(rows, names), names, DRAWS, SEED))


@query(ORACLES["scorer_apply"])
def stream_score(spark, d):
    """The scorer over a stream of conversations, written as files to its end and read again."""
    from timbre.session import shared_folder
    from timbre.streaming.scoring import scored

    batch = table(spark, d, "conversations")
    stream = spark.readStream.schema(batch.schema).parquet(f"{d.rstrip('/')}/conversations.parque[t]")
    rows = scored(turns_of(stream), _FIXED).select("doc_id", "turn_id", "score")
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return r6(spark.read.schema(rows.schema).parquet(f"{out}/rows"))


derived.ORACLES["social_cues_golden"] = derived._cued_sql(_cue_sql)
QUERIES |= derived.QUERIES | {"social_cues_golden": derived.social_cues_golden}
ORACLES |= derived.ORACLES
