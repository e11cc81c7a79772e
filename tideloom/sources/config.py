"""Job parameters: typed, checked on the driver before any data is read."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
from dataclasses import dataclass

from ..models import registry
from ..operators.selection import METHODS

# The choices of the enumerated keys.
CHOICES = {
    "forecast_frequency": ("d", "m", "q", "y"),
    "frequency": ("d", "m", "q", "y"),
    "forecast_ensemble": ("mean", "median"),
    "error_ensemble": ("mean", "median"),
    "error_display": ("mae", "mape"),
    "model_name": tuple(METHODS),
}


class ConfigError(ValueError):
    """Names every key that failed."""

    def __init__(self, keys: list[str]):
        super().__init__(f"invalid configuration: {', '.join(keys)}")
        self.keys = keys


@dataclass(frozen=True)
class InitConfig:
    test_start: dt.date
    test_end: dt.date
    test_model: list
    forecast_period: int
    forecast_frequency: str = "m"
    period_start: int = 0
    top_model: int = 3
    test_back: int = 6
    forecast_ensemble: str = "mean"
    error_ensemble: str = "mean"
    error_display: str = "mape"

    def __post_init__(self):
        _check(self)


@dataclass(frozen=True)
class ProdConfig:
    forecast_start: dt.date
    forecast_period: int
    forecast_frequency: str = "m"
    period_start: int = 0
    top_model: int = 3
    test_back: int = 6
    forecast_ensemble: str = "mean"
    error_ensemble: str = "mean"
    error_display: str = "mape"

    def __post_init__(self):
        _check(self)


@dataclass(frozen=True)
class SelectConfig:
    model_name: str = "aicc01"
    frequency: str = "m"
    growth: bool = True
    min_data_points: int = 72
    min_lag: int = 2
    max_lag: int = 23
    max_features: int = 10

    def __post_init__(self):
        _check(self)


CONFIGS = {"forecast-init": InitConfig, "forecast-prod": ProdConfig, "feat-selection": SelectConfig}
TYPES = {"dt.date": dt.date, "list": list, "int": int, "bool": bool, "str": str}


def _check(conf) -> None:
    wrong = []
    for f in dataclasses.fields(conf):
        v = getattr(conf, f.name)
        if f.name in CHOICES:
            ok = v in CHOICES[f.name]
        else:
            ok = type(v) is TYPES[f.type]  # exact type: True is not an int
        if f.name == "test_model" and ok:
            ok = bool(v) and all(m in registry.MODELS for m in v)
        if not ok:
            wrong.append(f.name)
    if wrong:
        raise ConfigError(wrong)


def parse_config(job: str, text: str):
    """JSON to the typed parameters of a job; every key is required, dates become ``date``."""
    cls = CONFIGS[job]
    try:
        raw = json.loads(text)
    except json.JSONDecodeError as e:
        raise ConfigError(["JSON format"]) from e
    values, wrong = {}, []
    for f in dataclasses.fields(cls):
        if f.name not in raw:
            wrong.append(f.name)
            continue
        v = raw[f.name]
        if f.type == "dt.date":
            try:
                v = dt.datetime.strptime(v, "%Y-%m-%d").date()
            except (TypeError, ValueError):
                wrong.append(f.name)
        values[f.name] = v
    if wrong:
        raise ConfigError(wrong)
    return cls(**values)
