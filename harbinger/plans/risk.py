"""Latest risk, one entity's risk, data status, and scored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger import fixed_values as V
from harbinger.functions.scalars import action_text, proxy_bounds, rainfall_proxy_score, risk_band
from harbinger.functions.signals import buffering_factors, elevating_factors, top_signals
from harbinger.operators.keys import at_latest, last_per_entity, same_entity


def _risk_columns(base_action: str) -> list[Column]:
    score = rainfall_proxy_score(F.col("rainfall_rolling_3m"))
    low, high = proxy_bounds(score)
    return [
        F.col("county_name").alias("county"),
        F.col("observation_date").alias("date"),
        F.lit(1).alias("horizon_months"),
        F.round(score, 3).alias("calibrated_probability"),
        F.array(F.round(low, 2), F.round(high, 2)).alias("confidence_interval"),
        risk_band(score).alias("risk_band"),
        action_text(score, base_action).alias("action_trigger"),
    ]


def latest_risk(long: DataFrame, horizon: int | None = 1) -> DataFrame:
    """Proxy risk of every entity at the newest observation date.

    The long table repeats an entity once per horizon; ``horizon=None`` keeps the
    repeats.
    """
    rows = at_latest(long, "observation_date")
    if horizon is not None:
        rows = rows.where(F.col("horizon_months") == horizon)
    return rows.select(*_risk_columns(V.ACTION_BASE_LIST))


def entity_risk(long: DataFrame, entity: str) -> DataFrame:
    """Proxy risk of one entity at its own newest date, name matched without case."""
    rows = last_per_entity(same_entity(long, entity), order=("observation_date", "horizon_months"))
    return rows.select(*_risk_columns(V.ACTION_BASE_SINGLE))


def available_entities(df: DataFrame) -> DataFrame:
    """Names that :func:`require_entity` accepts, in order."""
    return df.select("county_name").distinct().orderBy("county_name")


def require_entity(df: DataFrame, entity: str) -> DataFrame:
    """The entity's rows, or an error; :func:`available_entities` lists what there is."""
    rows = same_entity(df, entity)
    if rows.isEmpty():
        raise LookupError(f"'{entity}' is not monitored; available_entities() lists the names")
    return rows


def data_status(feeds: dict[str, DataFrame], date: str = "observation_date") -> DataFrame:
    """Newest date per source."""
    out = None
    for name, df in feeds.items():
        one = df.agg(F.max(date).alias("latest_date")).select(F.lit(name).alias("source"), "latest_date")
        out = one if out is None else out.unionByName(one)
    return out


def scored_records(
    scored: DataFrame, prob: str = "risk_probability", threshold: str = "decision_threshold",
    model: str = "random_forest",
) -> DataFrame:
    """Standard forecast record of each row: band, alert, version and signals."""
    p = F.col(prob)
    return scored.select(
        F.col("county_name").alias("county"),
        F.col("observation_period").alias("observation_date"),
        F.col("horizon_months").alias("forecast_horizon_months"),
        F.col("target_period").alias("target_date"),
        F.round(p, 4).alias("risk_probability"),
        risk_band(p).alias("risk_band"),
        F.col(threshold).alias("decision_threshold"),
        (p >= F.col(threshold)).alias("predicted_crisis_alert"),
        F.concat(F.lit(f"v1.0-{model}-h"), F.col("horizon_months").cast("string")).alias("model_version"),
        top_signals().alias("top_risk_signals"),
    )


def local_attribution(scored: DataFrame, prob: str = "risk_probability", k: int = 4) -> DataFrame:
    return scored.select(
        "county_name",
        "observation_date",
        "horizon_months",
        F.round(prob, 4).alias("model_risk_probability"),
        elevating_factors(k).alias("risk_elevating_factors"),
        buffering_factors(k).alias("risk_buffering_factors"),
        F.lit(V.ATTRIBUTION_NOTE).alias("interpretation_disclaimer"),
    )
