"""The optional judge and rule writer: a driver-side client, injected; nothing here reaches a network.

Spark samples the turns, adds up verdicts and tests them; the judge only says, for shuffled texts,
whether each follows a rule.
"""

from __future__ import annotations

import hashlib
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbre.operators.corpus import draw, key
from timbre.operators.rules import decide
from timbre.operators.stats import fisher_p


class Judge(Protocol):
    label: str

    def follows(self, statements: list[str], texts: list[str]) -> list[list[bool] | None]:
        """For each statement whether each text follows it; None if it could not be judged."""


class RuleWriter(Protocol):
    def induce(self, summary: str, pairs: list[tuple[str | None, str]]) -> list[dict]: ...

    def merge(self, summary: str, drafts: list[dict]) -> list[dict]: ...


def heldout_sample(turns: DataFrame, n: int = 48, seed: int = 7) -> list[tuple[str, str]]:
    """(grp, text) of n held-out turns of each side, in a random order that hides the sides."""
    drawn = turns.select("grp", F.substring("text", 1, 400).alias("text"), draw(seed, F.col("grp"), key()).alias("o"))
    rows = [r for g in ("target", "reference") for r in drawn.where(F.col("grp") == g).orderBy("o").limit(n).collect()]
    return [(r.grp, r.text) for r in sorted(rows, key=lambda r: hashlib.md5(r.o.encode()).hexdigest())]


def verify(spark: SparkSession, judge: Judge, rules: list[dict], sample: list[tuple[str, str]], per_call: int = 8, least: float = 0.05, alpha: float = 0.05) -> list[dict]:
    """Rules with held-out rates, Fisher p and the decision. Labels that are missing or of a wrong number
    drop a rule."""
    verdicts, out = [], [dict(r, verification=dict(r.get("verification", {}))) for r in rules]
    for at in range(0, len(out), per_call):
        group = out[at : at + per_call]
        for i, flags in enumerate(judge.follows([r["statement"] for r in group], [t for _, t in sample])):
            rule = group[i]
            if flags is None or len(flags) != len(sample):
                rule["kept"] = False
                rule["verification"]["error"] = "no or malformed labels"
                continue
            sides = {g: [bool(f) for f, (s, _) in zip(flags, sample, strict=True) if s == g] for g in ("target", "reference")}
            verdicts.append((at + i, rule["strength"], sum(sides["target"]), len(sides["target"]), sum(sides["reference"]), len(sides["reference"])))
    if not verdicts:
        return out
    df = spark.createDataFrame(verdicts, "i int, strength string, th int, tn int, rh int, rn int")
    c = F.col
    p = F.when(c("rn") > 0, F.when(c("strength").isin("rarely", "never"), fisher_p(c("th"), c("tn"), c("rh"), c("rn"), greater=False)).otherwise(fisher_p(c("th"), c("tn"), c("rh"), c("rn"))))
    t_rate, r_rate = c("th") / F.greatest("tn", F.lit(1)), F.when(c("rn") > 0, c("rh") / c("rn"))
    rates = df.select("*", p.alias("p"), t_rate.alias("t_rate"), r_rate.alias("r_rate"))
    kept, strength = decide(c("strength"), c("t_rate"), c("r_rate"), c("p"), least, alpha)
    for r in rates.select("*", kept.alias("kept"), strength.alias("new")).collect():  # a row a rule
        rule = out[r.i]
        rule["kept"] = bool(r.kept)
        if r.new != r.strength:
            rule["verification"]["strength_claimed"], rule["strength"] = r.strength, r.new
        rule["verification"] |= {"target_compliance": round(r.t_rate, 3), "reference_compliance": None if r.r_rate is None else round(r.r_rate, 3), "n_target": r.tn, "n_reference": r.rn, "fisher_p": None if r.p is None else round(r.p, 4), "judge": judge.label}
    return out
