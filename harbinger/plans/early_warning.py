"""Forecasts of one or all entities side by side over the horizons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbinger import fixed_values as V
from harbinger.functions.scalars import trend_label
from harbinger.functions.text import percent_text
from harbinger.operators.horizon import HORIZONS
from harbinger.plans.risk import scored_records


def by_horizon(scored: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """One row per key with ``<column>_h1 .. _h3``: conditional maxima, one shuffle."""
    return scored.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("horizon_months") == h, F.col(c))).alias(f"{c}_h{h}")
            for c in columns
            for h in HORIZONS
        ]
    )


def _trend():
    probs = [F.col(f"risk_probability_h{h}") for h in HORIZONS]
    return trend_label(F.coalesce(*probs), F.coalesce(*reversed(probs)))


def entity_forecast(scored: DataFrame, entity: str, period: str | None = None) -> DataFrame:
    """The three records of one entity at a period (its newest by default) with the trend."""
    rows = scored.where(F.col("county_name") == entity)
    if period is None:
        newest = rows.agg(F.max("observation_period").alias("p")).scalar()
        rows = rows.where(F.col("observation_period") == newest)
    else:
        rows = rows.where(F.col("observation_period") == period)
    records = scored_records(rows)
    trend = by_horizon(
        records.withColumnRenamed("forecast_horizon_months", "horizon_months"),
        ["risk_probability"],
        ["county"],
    ).select("county", _trend().alias("trend"))
    return records.join(trend, "county")


def early_warning_matrix(scored: DataFrame, period: str | None = None) -> DataFrame:
    """All entities at one period: risk per horizon, trend, signals, alert status.

    One scan, one grouping by entity and one sort of one row per entity.
    """
    if period is None:
        newest = scored.agg(F.max("observation_period").alias("p")).scalar()
        rows = scored.where(F.col("observation_period") == newest)
    else:
        rows = scored.where(F.col("observation_period") == period)
    records = scored_records(rows)
    wide = records.groupBy("county").agg(
        *[
            F.max(F.when(F.col("forecast_horizon_months") == h, F.col("risk_probability"))).alias(
                f"risk_probability_h{h}"
            )
            for h in HORIZONS
        ],
        F.max("predicted_crisis_alert").alias("_alert"),
        F.max(
            F.when(
                F.col("forecast_horizon_months") == 1,
                F.concat_ws("; ", F.slice("top_risk_signals", 1, 2)),
            )
        ).alias("_signals"),
    )
    p1, p2, p3 = (F.col(f"risk_probability_h{h}") for h in HORIZONS)
    return wide.select(
        F.col("county").alias("County"),
        percent_text(p1).alias("1M Risk (t+1)"),
        percent_text(p2).alias("2M Risk (t+2)"),
        percent_text(p3).alias("3M Risk (t+3)"),
        _trend().alias("Trend"),
        F.coalesce("_signals", F.lit(V.NO_SIGNAL_MATRIX)).alias("Main Signals"),
        F.when(F.col("_alert"), V.ALERT_ON).otherwise(V.ALERT_OFF).alias("Early-Warning Signal"),
        F.coalesce(F.greatest(p1, p2, p3), F.lit(0.0)).alias("_max_prob"),
    ).orderBy(F.desc("_max_prob"), "County").drop("_max_prob")


def trajectory(scored: DataFrame, entity: str) -> DataFrame:
    """Probability in percent per period and horizon of one entity."""
    return (
        scored.where(F.col("county_name") == entity)
        .select(
            "horizon_months", "observation_date", "observation_period",
            (F.col("risk_probability") * 100).alias("risk_pct"),
        )
        .orderBy("horizon_months", "observation_date")
    )
