"""The three jobs: rolling back-test, production forecast, feature selection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..models import registry
from ..operators import accuracy, panel, selection
from ..session import cut_lineage
from ..sources.config import InitConfig, ProdConfig, SelectConfig
from ..sources.io import union_log
from ..sources.roles import check_files


MOST_SKIPPED = 100


@dataclass(frozen=True)
class InitResult:
    forecastlog: DataFrame
    forecast: DataFrame
    evaluate: DataFrame
    errors: DataFrame  # (id, dsr, model, text): what got no forecast


@dataclass(frozen=True)
class ProdResult:
    forecastlog: DataFrame
    forecast: DataFrame
    skipped: tuple[str, ...]  # the first MOST_SKIPPED models of the log that are not available here
    errors: DataFrame  # (id, dsr, model, text): what got no forecast


def _given(**tables: DataFrame | None) -> list[str]:
    return [k for k, v in tables.items() if v is not None]


def _summed(y: DataFrame, origins, models, freq: str) -> DataFrame:
    """Bucket sums of the raw panel, written once: histories and actuals both come from them."""
    return cut_lineage(panel.compact(y, origins, registry.input_freq(models, freq), later=True))


def forecast_init(
    y: DataFrame, conf: InitConfig, x: DataFrame | None = None, lag: DataFrame | None = None
) -> InitResult:
    """Rolling back-test of every model over every series and origin.

    The raw panel is read once and its bucket sums are written. The log is written once to the shared folder: rank, ensemble and evaluation all read it,
    and losing an executor does not repeat the model fits.
    """
    check_files("forecast-init", _given(y=y, x=x, lag=lag))
    freq = conf.forecast_frequency
    origins = tuple(cal.rolling_origins(conf.test_start, conf.test_end, freq))
    y = _summed(y, origins, conf.test_model, freq)
    req = registry.Request(y, origins, freq, conf.forecast_period, conf.period_start, x, lag)
    log = cut_lineage(registry.forecast(req, conf.test_model))
    actual = panel.actuals(y, freq)
    rank = accuracy.rank_models(
        log, actual, freq, conf.test_back, conf.error_ensemble, conf.error_display
    )
    ens = accuracy.ensemble_log(
        log, rank, top_model=conf.top_model,
        fcst_ens=conf.forecast_ensemble, error_ens=conf.error_ensemble,
    )
    return InitResult(log, ens, accuracy.evaluate(log, ens, actual, conf.top_model), registry.errors(req, conf.test_model, log))


def forecast_prod(
    y: DataFrame,
    log: DataFrame,
    conf: ProdConfig,
    x: DataFrame | None = None,
    lag: DataFrame | None = None,
) -> ProdResult:
    """Forecast from one origin with the models of the log, combined by their past error."""
    check_files("forecast-prod", _given(y=y, forecastlog=log, x=x, lag=lag))
    freq = conf.forecast_frequency
    past = log.filter(F.col("dsr") < F.lit(conf.forecast_start))
    # names that exist here are at most the size of the registry; of others only so many are reported
    names, ours = past.select("model").distinct(), F.col("model").isin(*registry.MODELS)
    models = sorted(r["model"] for r in names.filter(ours).collect())
    others = names.filter(~ours).orderBy("model").limit(MOST_SKIPPED).collect()
    y = _summed(y, (conf.forecast_start,), models, freq)
    rank = accuracy.rank_models(
        past, panel.actuals(y, freq), freq,
        conf.test_back, conf.error_ensemble, conf.error_display, only=conf.forecast_start,
    )
    req = registry.Request(
        y, (conf.forecast_start,), freq, conf.forecast_period, conf.period_start, x, lag
    )
    new = cut_lineage(registry.forecast(req, models))
    ens = accuracy.ensemble(
        new, rank, top_model=conf.top_model,
        fcst_ens=conf.forecast_ensemble, error_ens=conf.error_ensemble,
    )
    return ProdResult(union_log(new, past, conf.forecast_start), ens, tuple(r["model"] for r in others), registry.errors(req, models, new))


def feat_selection(y: DataFrame, x: DataFrame, conf: SelectConfig) -> DataFrame:
    """External series and lag per target: ``id_y, id_x, lag``, the ``lag`` table of the forecasts."""
    check_files("feat-selection", _given(y=y, x=x))
    yp = cut_lineage(selection.prepare_y(y, conf.frequency, conf.growth))
    xp = cut_lineage(selection.prepare_x(x, conf.frequency, conf.growth, conf.min_data_points))
    lags = selection.best_lag(yp, xp, conf.min_lag, conf.max_lag)
    chosen = selection.fit(conf.model_name, yp, xp, lags, conf.max_features)
    return chosen.select("id_y", "id_x", "lag")
