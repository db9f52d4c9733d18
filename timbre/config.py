"""Settings of a run, from keywords or a YAML file."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

TIERS = ("local-only", "local-first", "hybrid", "frontier-direct")


@dataclass(frozen=True)
class PrivacyConfig:
    enabled: bool = True
    k_anonymity: int = 3
    min_ngram: int = 5
    memorisation_ngram: int = 8


@dataclass(frozen=True)
class Config:
    tier: str = "local-first"
    target_speakers: tuple[str, ...] = ()
    privacy: PrivacyConfig = field(default_factory=PrivacyConfig)
    seed: int = 7
    bootstrap: int = 400
    sample_for_rules: int = 240
    exemplars_per_situation: int = 8
    acknowledge_raw_text: bool = False

    def __post_init__(self):
        if self.tier not in TIERS:
            raise ValueError(f"tier must be one of {TIERS}")
        if self.tier == "frontier-direct" and not self.acknowledge_raw_text:
            raise ValueError("frontier-direct sends raw text: set acknowledge_raw_text")

    @classmethod
    def load(cls, path: str | Path) -> Config:
        import yaml

        raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        if unknown := set(raw) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        if "privacy" in raw:
            raw["privacy"] = PrivacyConfig(**raw["privacy"])
        if "target_speakers" in raw:
            raw["target_speakers"] = tuple(raw["target_speakers"])
        return cls(**raw)

    def as_dict(self) -> dict:
        return asdict(self)
