"""Typed parameters from TOML or JSON, checked before any stage runs."""

from __future__ import annotations

import json
import math
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints

from tessera.operators.dedup import check_threshold
from tessera.operators.split import check_ratios


def whole(value: Any, name: str, least: int) -> int:
    """An integer, not a truth value, of at least ``least``."""
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} is an integer of at least {least}, not {value!r}")
    return value


def share(value: Any, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value) or not 0 <= value <= 1:
        raise ValueError(f"{name} is a number in 0..1, not {value!r}")
    return float(value)


@dataclass(frozen=True)
class Clean:
    min_user_chars: int = 30
    max_user_chars: int = 4000
    min_assistant_chars: int = 2
    shingle_words: int = 4
    permutations: int = 64
    threshold: float = 0.85


@dataclass(frozen=True)
class Split:
    ratios: dict = field(default_factory=lambda: {"train": 0.8, "val": 0.1, "test": 0.1})
    seed: int = 42
    search_attempts: int = 512
    max_total_variation: float = 0.10


@dataclass(frozen=True)
class Contamination:
    threshold: float = 0.85


@dataclass(frozen=True)
class Config:
    clean: Clean = Clean()
    split: Split = Split()
    contamination: Contamination = Contamination()

    def __post_init__(self):
        c = self.clean
        for name in ("min_user_chars", "min_assistant_chars"):
            whole(getattr(c, name), f"clean.{name}", 0)
        whole(c.max_user_chars, "clean.max_user_chars", c.min_user_chars)
        whole(c.shingle_words, "clean.shingle_words", 1)
        whole(c.permutations, "clean.permutations", 1)
        check_threshold(c.threshold)
        check_ratios(self.split.ratios)
        whole(self.split.seed, "split.seed", 0)
        whole(self.split.search_attempts, "split.search_attempts", 1)
        share(self.split.max_total_variation, "split.max_total_variation")
        check_threshold(self.contamination.threshold)
        if self.contamination.threshold != c.threshold:
            raise ValueError("cleaning and the contamination check need one similarity threshold")


def build(kind: type, values: Any, path: str = "") -> Any:
    """A dataclass from nested dictionaries; unknown keys are errors."""
    if not isinstance(values, dict):
        raise ValueError(f"{path or 'parameters'} is no table")
    hints = get_type_hints(kind)
    if unknown := sorted(set(values) - {f.name for f in fields(kind)}):
        raise ValueError(f"unknown parameter {path}{unknown[0]}")
    return kind(**{k: build(hints[k], v, f"{path}{k}.") if is_dataclass(hints[k]) else v for k, v in values.items()})


def load(path: str) -> Config:
    with open(path, "rb") as f:
        content = f.read()
    return build(Config, tomllib.loads(content.decode()) if path.endswith(".toml") else json.loads(content))
