"""From a landed call log to audit, daily series, forecast, alerts and scores, written as tables.

The log is read once for the daily series and once for the audit; everything
after the daily series works on one row per day and call type.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callstrata.operators import alerts, audit, calendar, cleaning, ensemble, mapping, models, scoring, segment
from callstrata.session import checkpointed
from callstrata.sources import runs, sinks
from callstrata.sources.calls import typed_calls
from callstrata.sources.holidays import holiday_dim


MODELS = ("arima", "prophet", "random_forest", "gradient_boosting", "ridge")


@dataclass
class Outcome:
    """The tables of a run."""

    audit: DataFrame
    daily: DataFrame
    metrics: DataFrame
    weights: DataFrame
    forecast: DataFrame
    alerts: DataFrame
    performance: DataFrame
    skipped: DataFrame


def analyse(raw: DataFrame, as_of: str, names: dict[str, str] | None = None, hol: DataFrame | None = None,
            model_names: Iterable[str] = MODELS, days: int = 28, business: bool = False,
            min_rows: int = 30) -> Outcome:
    """Run every stage over a text log; ``names`` maps canonical fields to its columns.

    Series of fewer than ``min_rows`` days are not forecast; ``skipped`` lists them with their length.
    """
    spark: SparkSession = raw.sparkSession
    hol = holiday_dim(spark) if hol is None else hol
    model_names = list(model_names)
    calls = typed_calls(mapping.apply_mapping(raw, names or {})).where(F.col("FECHA").isNotNull())
    calls = cleaning.drop_future(calls, as_of)

    every = checkpointed(calendar.complete_calendar(segment.daily_calls(calls)))
    daily = checkpointed(cleaning.min_rows(every, min_rows).drop("n_filas"))
    skipped = every.groupBy("serie").agg(F.count(F.lit(1)).alias("dias")).where(F.col("dias") < min_rows)
    train = checkpointed(calendar.training_mask(daily, hol).select("serie", "ds", "y", models.MASK))

    pairs = checkpointed(models.fold_pairs(train, model_names))
    metrics = checkpointed(models.temporal_cv(pairs))
    weights = checkpointed(ensemble.ensemble_weights(metrics))
    ahead = calendar.future_days(daily, days, business)
    preds = checkpointed(models.predictions(train, ahead, models=model_names))
    forecast = checkpointed(ensemble.forecast_table(preds, weights, model_names))
    found = checkpointed(alerts.demand_alerts(forecast, daily))
    return Outcome(audit.audit_summary(calls), daily, metrics, weights, forecast, found,
                   scoring.performance(weights, forecast, found), skipped)


def commit(out: Outcome, root: str, run: str) -> DataFrame:
    """The tables of a run behind the commit log of a results folder; its rows of the log."""
    tables = {"diario": out.daily, "pronostico": out.forecast, "auditoria": out.audit, "metricas": out.metrics, "pesos": out.weights,
              "alertas": out.alerts, "performance": out.performance, "omitidas": out.skipped}
    return runs.write_run(out.daily.sparkSession, root, run, tables)


def write(out: Outcome, root: str) -> str:
    """The tables of a run under one folder: series and forecast as CSV by call type, the rest as JSON."""
    sinks.write_csv(out.daily, f"{root}/diario", by="serie")
    sinks.write_csv(out.forecast, f"{root}/pronostico", by="serie")
    for name, table in (("auditoria", out.audit), ("metricas", out.metrics), ("pesos", out.weights), ("alertas", out.alerts),
                        ("performance", out.performance), ("omitidas", out.skipped)):
        sinks.write_report(table, f"{root}/{name}")
    return root
