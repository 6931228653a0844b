"""Settings of an experiment's data side, from the command line or a dictionary."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace


# Other names of settings, and the text that stands for all of a list.
OTHER_NAMES = {"datasets_to_run": "datasets", "strategies_to_run": "strategies", "validation_fraction_of_train": "validation_fraction", "sampling": "sample_docs"}
ALL = "all"


@dataclass(frozen=True)
class ExperimentConfig:
    datasets: tuple[str, ...] = ()  # empty: all
    strategies: tuple[str, ...] = ()  # empty: all
    n_folds: int = 10
    split_seed: int = 42
    validation_fraction: float = 0.1
    max_length: int = 512
    word_window_size: int = 0
    word_window_stride: int = 0
    tokenizer_stride: int = 0
    sample_docs: int = 0  # 0: all
    tokenizer: str = ""  # a tokenizer's JSON file; empty: a piece for every four characters
    focal_gamma: float = 2.0
    focal_alpha: float = 0.75
    extra: dict[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.n_folds < 2 or not 0 < self.validation_fraction < 1:
            raise ValueError("n_folds must be 2 or more and validation_fraction between 0 and 1")
        if self.word_window_size and not 0 <= self.word_window_stride < self.word_window_size:
            raise ValueError("word_window_stride must be below word_window_size")

    def with_settings(self, settings: list[str]) -> ExperimentConfig:
        """``key=value`` texts; names in any case and older ones too, values as JSON, else text, lists with commas as well and ``all``
        for everything; names that aren't fields go to extra."""
        names = {f.name for f in fields(self)} - {"extra"}
        known, extra = {}, dict(self.extra)
        for s in settings:
            key, _, raw = s.partition("=")
            try:
                value = json.loads(raw)
            except ValueError:
                value = raw
            key = key.strip().lower().replace("-", "_")
            key = OTHER_NAMES.get(key, key)
            if key in ("datasets", "strategies") and isinstance(value, str):
                value = [] if value.strip().lower() == ALL else [v.strip() for v in value.split(",") if v.strip()]
            value = tuple(value) if isinstance(value, list) else value
            (known if key in names else extra)[key] = value
        return replace(self, **known, extra=extra)
