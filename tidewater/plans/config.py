"""Forecast and detection configurations, with JSON both ways."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any


def overlay(defaults: dict, changes: dict | None, allow_unknown: bool = False) -> dict:
    """Defaults with changes on top; unknown keys are an error unless allowed."""
    unknown = set(changes or {}) - set(defaults)
    if unknown and not allow_unknown:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    return defaults | (changes or {})


def as_grid(params: dict[str, Any]) -> dict[str, list]:
    """Every value as a list of choices."""
    return {k: v if isinstance(v, list) else [v] for k, v in params.items()}


@dataclass
class Metadata:
    time_col: str = "ts"
    value_col: str = "y"
    freq: str | None = None
    train_end: str | None = None
    keys: list[str] = field(default_factory=list)


@dataclass
class Evaluation:
    """How configurations are compared: rolling origins, and a test part at the end."""

    metric: str = "MAPE"
    cv_horizon: int | None = None
    cv_max_splits: int = 3
    cv_min_train: int | None = None
    cv_expanding: bool = True
    periods_between_splits: int | None = None
    periods_between_train_test: int = 0
    test_horizon: int | None = None
    agg_periods: int | None = None


@dataclass
class ModelComponents:
    growth: dict = field(default_factory=dict)
    changepoints: dict = field(default_factory=dict)
    seasonality: dict = field(default_factory=dict)
    events: dict = field(default_factory=dict)
    autoregression: dict = field(default_factory=dict)
    regressors: dict = field(default_factory=dict)
    lagged_regressors: dict = field(default_factory=dict)
    uncertainty: dict = field(default_factory=dict)
    custom: dict = field(default_factory=dict)


@dataclass
class ForecastConfig:
    template: str = "AUTO"
    horizon: int | None = None
    coverage: float | None = 0.95
    metadata: Metadata = field(default_factory=Metadata)
    evaluation: Evaluation = field(default_factory=Evaluation)
    components: ModelComponents = field(default_factory=ModelComponents)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))

    @staticmethod
    def from_dict(d: dict) -> ForecastConfig:
        known = {f.name for f in dataclasses.fields(ForecastConfig)}
        if extra := set(d) - known:
            raise ValueError(f"unknown keys: {sorted(extra)}")
        parts = {"metadata": Metadata, "evaluation": Evaluation, "components": ModelComponents}
        return ForecastConfig(**{k: parts[k](**v) if k in parts and isinstance(v, dict) else v for k, v in d.items()})

    @staticmethod
    def from_json(text: str) -> ForecastConfig:
        return ForecastConfig.from_dict(json.loads(text))


@dataclass
class DetectionConfig:
    """Detector settings: slices, error thresholds, and what the reward asks for."""

    volatility_features: list[list[str]] = field(default_factory=lambda: [[]])
    coverage_grid: list[float] | None = None
    ape_thresholds: list[float] = field(default_factory=lambda: [0.0])
    sape_thresholds: list[float] = field(default_factory=lambda: [0.0])
    objective: str | None = "F1"
    target_percent: float | None = None
    min_precision: float | None = None
    min_recall: float | None = None

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self))

    @staticmethod
    def from_json(text: str) -> DetectionConfig:
        return DetectionConfig(**json.loads(text))
