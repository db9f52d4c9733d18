"""From turns to a voice profile: features, contrast, rules, scorer, exemplars and training pairs."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbre import backends
from timbre.config import Config
from timbre.functions.surface import surface
from timbre.judge import Judge, RuleWriter, heldout_sample, verify
from timbre.operators import context, corpus, exports, privacy, rules, scorer, situations, stats
from timbre.session import checkpointed


class MemorisationError(RuntimeError):
    """Rare spans of a corpus that isn't public would have been published."""


@dataclass
class Result:
    data: dict
    features: DataFrame
    exemplars: list[dict] = field(default_factory=list)
    sft: DataFrame | None = None
    dpo: DataFrame | None = None

    def write(self, out: str) -> None:
        exports.write_all(out, self.data["name"], self.data, self.exemplars, self.sft, self.dpo)


def features(turns: DataFrame, extra: list[tuple[backends.TextModel, list[str]]] = ()) -> DataFrame:
    """Turns with context and all features: surface, dialogue, cue acts, lexical stand-ins, and those of
    the given models. Everything but the models is one pass of column expressions."""
    rows = turns if "prev_text" in turns.columns else context.previous_turn(turns)
    rows = surface(backends.lexical(context.social_flags(context.dialogue(rows))))
    for model, names in extra:
        rows = backends.with_model(rows, model, names)
    return rows


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def leak_count(leaks: DataFrame, shown: int = 10) -> tuple[int, list[str]]:
    """How many leaks there are, and the first ones as examples."""
    leaks = checkpointed(leaks)
    return leaks.count(), [r.ngram for r in leaks.orderBy("key", "pos").limit(shown).collect()]


def run(turns: DataFrame, cfg: Config = Config(), *, targets: list[str] | None = None, reference: list[str] | None = None, max_target: int | None = None, public: bool = False, heldout: float = 0.2, max_reference: int = 20_000, judge: Judge | None = None, writer: RuleWriter | None = None, backend: privacy.Backend | None = None, pairs: bool = True) -> Result:
    """A profile of the target speakers against the reference; see :class:`Result`.

    Only tables of about as many rows as there are features, terms, rules or exemplars reach the driver.
    """
    began, report = time.time(), None
    spark = turns.sparkSession
    targets = list(targets or cfg.target_speakers) or [corpus.most_frequent_speaker(turns)]
    n_turns = turns.count()
    if cfg.privacy.enabled and not public:
        masked = checkpointed(privacy.anonymise(turns, backend))
        report = privacy.report(masked)
        turns = privacy.quarantined(masked)[0].drop("replaced")
    rare = privacy.rare_spans(turns, cfg.privacy.min_ngram, cfg.privacy.k_anonymity)

    linked = context.previous_turn(turns)
    sides = corpus.grouped(linked, targets, reference)
    ours, theirs = (sides.where(F.col("grp") == g) for g in ("target", "reference"))
    if max_target:
        ours = corpus.cap_target_docs(ours, max_target, cfg.seed)
    ours = checkpointed(corpus.split_docs(ours, heldout, cfg.seed))
    theirs = checkpointed(corpus.split_docs(theirs, heldout, cfg.seed + 1))
    n_train, n_held = (ours.where(F.col("held") == h).count() for h in (False, True))
    most_train, most_held = corpus.reference_caps(n_train, n_held, max_reference)
    theirs = corpus.sample_turns(theirs.where("not held"), most_train, cfg.seed).unionByName(corpus.sample_turns(theirs.where("held"), most_held, cfg.seed))
    table = checkpointed(features(ours.unionByName(theirs)).withColumn("key", corpus.key()))
    train, held = table.where("not held"), table.where("held")
    has_reference = bool(train.where("grp = 'reference'").take(1))

    names = [c for c in stats.numeric_columns(table) if not c.startswith("lex_")]
    compared = checkpointed(stats.contrast(train, names, cfg.bootstrap, cfg.seed)) if has_reference else None
    keyness = _rows(stats.keyness(train.select("text", "grp")).orderBy("side", "rank")) if has_reference else []
    summary = _rows(context.summary(turns, targets))[0]
    openers = [(r.phrase, r.n) for r in context.openers_closers(turns, targets).where("side = 'opener'").orderBy("rank").collect()]
    placed, kinds = situations.find(train.where("grp = 'target'"), cfg.seed)
    placed = checkpointed(placed)

    found = rules.statistical_rules(compared, train.select("grp", *names)) if has_reference else []
    if found:
        checked = {r.feature: r for r in rules.heldout_direction(held, compared, [r["feature"] for r in found]).collect()}
        for r in found:
            if c := checked.get(r["feature"]):
                r["kept"] = bool(c.kept)
                r["verification"] |= {"heldout_target_mean": round(c.heldout_target_mean or 0, 4), "heldout_reference_mean": round(c.heldout_reference_mean or 0, 4)}
    written: list[dict] = []
    if writer is not None and judge is not None and has_reference:
        told = exports.voice_summary({"name": ", ".join(targets), "contrast": _rows(compared), "keyness": keyness, "dialogue": summary, "situations": _rows(kinds)})
        drawn = train.where("grp = 'target'").orderBy(corpus.draw(cfg.seed, F.col("key"))).limit(cfg.sample_for_rules).select("prev_text", "text").collect()
        some = [(r.prev_text, r.text) for r in drawn]
        drafts = [d for at in range(0, len(some), 60) for d in writer.induce(told, some[at : at + 60])]
        written = verify(spark, judge, writer.merge(told, drafts), heldout_sample(held, seed=cfg.seed))
    all_rules = sorted(written, key=lambda r: not r["kept"]) + found

    model, evaluation = None, {}
    if has_reference:
        model = scorer.fit(train, cfg.seed)
        if held.select("grp").distinct().count() == 2:
            evaluation["heldout_auc_surface"] = scorer.heldout_auc(held.withColumn("score", scorer.score(model)))
    scored = placed.withColumn("score", scorer.score(model) if model else F.lit(0.0))
    chosen = exports.exemplars(scored, rare, cfg.exemplars_per_situation, cfg.privacy.min_ngram).orderBy("cluster", "rank")
    title = {r.cluster: r.name for r in kinds.collect()}
    shots = [{"situation": title.get(r.cluster) or r.cluster, "context": r.context, "text": r.text} for r in chosen.collect()]
    dpo = None
    if pairs and has_reference:
        numbered = train.where("prev_text is not null").withColumn("id", F.xxhash64("key"))
        dpo = exports.dpo(numbered.where("grp = 'target'"), numbered.where("grp = 'reference'"), situations.hashed_embedder())

    data = {
        "name": ", ".join(targets), "corpus": {"turns": n_turns, "train_target": n_train, "heldout_target": n_held}, "rules": all_rules, "contrast": _rows(compared) if has_reference else [], "keyness": keyness,
        "target_profile": _rows(stats.describe(stats.long(train.where("grp = 'target'"), names))),
        "dialogue": summary, "openers": openers, "social_acts": _rows(stats.act_profile(train.where("grp = 'target'"), "social_")), "richness": _rows(stats.style_richness(train.select("text", F.col("grp").alias("speaker")))),
        "situations": _rows(kinds), "scorer": model, "scorer_eval": evaluation, "privacy": report,
        "manifest": {"tier": cfg.tier, "targets": targets, "public_corpus": public, "seed": cfg.seed, "judge": judge.label if judge else None, "config": cfg.as_dict()},
    }
    texts = [*exports.prompt_pack(data["name"], all_rules, openers, shots).values(), exports.voice_md(data["name"], data)]
    outputs = spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    allowed = [x for s in shots for x in (s["text"], s["context"]) if x]
    n_leaks, shown = leak_count(privacy.leaks(outputs, turns, allowed, cfg.privacy.memorisation_ngram, cfg.privacy.k_anonymity))
    data["manifest"] |= {"memorisation_leaks": n_leaks, "memorisation_leak_spans": shown, "total_s": round(time.time() - began, 1)}
    if n_leaks and not public:
        raise MemorisationError(f"{n_leaks} rare spans in what would be written, e.g. {shown[0]!r}")
    return Result(data, table, shots, exports.sft(train.where("grp = 'target'")), dpo)
