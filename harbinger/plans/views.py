"""Overview, explorer, driver and chart tables of a scored panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbinger import fixed_values as V
from harbinger.functions.calendar import month_start, period_text
from harbinger.functions.scalars import risk_band
from harbinger.functions.signals import indicator_flags, narrative
from harbinger.functions.text import integer_text, percent_text, signed_text
from harbinger.operators.keys import at_latest, between_periods, fill_back_then_forward, last_per_entity
from harbinger.operators.names import missing_from


def with_period(panel: DataFrame) -> DataFrame:
    start = month_start(F.col("year"), F.col("month"))
    return panel.withColumns({"period": period_text(start), "period_dt": start})


def scored_panel(panel: DataFrame, score) -> DataFrame:
    """Panel with period, probability and band.

    ``score`` maps a gap-filled panel to a probability column: an expression for a
    rule, or a fitted pipeline through :func:`harbinger.operators.learn.probability`.
    """
    filled = fill_back_then_forward(panel, V.PANEL_FEATURES)
    scored = with_period(filled).withColumn("model_risk_prob", score)
    return scored.withColumn("risk_band", risk_band(F.col("model_risk_prob")))


def latest_snapshot(scored: DataFrame) -> DataFrame:
    return at_latest(scored, "period")


def latest_per_entity(scored: DataFrame) -> DataFrame:
    return last_per_entity(scored, "county_name", ("period_dt",))


def overview_kpis(snapshot: DataFrame) -> DataFrame:
    """Snapshot indicators in one row; zeros for an empty snapshot."""
    def band(name: str):
        return F.count_if(F.col("risk_band") == name)

    return snapshot.agg(
        F.count(F.lit(1)).alias("counties_monitored"),
        (band("High") + band("Elevated")).alias("elevated_or_high_count"),
        F.coalesce(F.max("period"), F.lit("N/A")).alias("latest_period"),
        F.coalesce(F.avg("model_risk_prob"), F.lit(0.0)).alias("average_risk_prob"),
        band("High").alias("high_risk_count"),
        band("Elevated").alias("elevated_risk_count"),
        band("Moderate").alias("moderate_risk_count"),
        band("Low").alias("low_risk_count"),
    )


def ranking_table(snapshot: DataFrame) -> DataFrame:
    labels = [(c, label) for c, label in V.RANKING_LABELS if c in snapshot.columns]
    return snapshot.orderBy(F.desc("model_risk_prob"), "county_name").select(
        *[F.col(c).alias(label) for c, label in labels]
    )


def map_table(snapshot: DataFrame, dim: DataFrame) -> DataFrame:
    """Every dimension member, monitored or not, with display columns."""
    monitored = F.col("_seen").isNotNull()
    joined = dim.select(F.col("canonical_name").alias("county_name")).join(
        snapshot.withColumn("_seen", F.lit(True)), "county_name", "left"
    )
    return joined.select(
        "county_name",
        monitored.alias("is_monitored"),
        F.coalesce("risk_band", F.lit(V.NOT_MONITORED)).alias("risk_band"),
        percent_text(F.col("model_risk_prob"), V.NOT_MONITORED).alias("risk_prob_display"),
        integer_text(F.col("previous_ipc_phase")).alias("ipc_display"),
        signed_text(F.col("rainfall_anomaly_3m"), 1, "%").alias("rain_anom_display"),
        signed_text(F.col("ndvi_anomaly_3m"), 1, "%").alias("ndvi_anom_display"),
        signed_text(F.col("maize_price_zscore"), 2, " σ").alias("price_z_display"),
    )


def unmapped(snapshot: DataFrame, dim: DataFrame) -> DataFrame:
    geo = dim.select(F.col("canonical_name").alias("county_name"))
    return missing_from(snapshot, geo)


def explorer(scored: DataFrame, entity: str, start: str | None, end: str | None) -> DataFrame:
    """Slice of one entity with a marker on its newest row."""
    rows = between_periods(scored, entity, start, end)
    newest = rows.agg(F.max("period").alias("p")).scalar()
    return rows.withColumn("is_latest", F.col("period") == newest)


def indicator_rows(scored: DataFrame, entity: str | None = None, period: str | None = None) -> DataFrame:
    rows = scored
    if entity is not None:
        rows = rows.where(F.col("county_name") == entity)
    if period is not None:
        rows = rows.where(F.col("period") == period)
    return rows.select("county_name", "period", F.inline(indicator_flags()))


def narratives(scored: DataFrame) -> DataFrame:
    return scored.select(
        "county_name",
        "period",
        narrative(
            F.col("county_name"), F.col("period"), F.col("risk_band"), F.col("model_risk_prob")
        ).alias("narrative"),
    )


def chart_series(scored: DataFrame, entity: str | None = None) -> DataFrame:
    """Timelines of one entity (or all) as rows ``(series, period, value, colour)``."""
    rows = scored if entity is None else scored.where(F.col("county_name") == entity)
    sign = F.when(F.coalesce("rainfall_anomaly_1m", F.lit(0.0)) < 0, V.COLOUR_DEFICIT).otherwise(
        V.COLOUR_SURPLUS
    )
    series = [
        ("risk_pct", F.col("model_risk_prob") * 100, F.lit(None).cast("string")),
        ("rainfall_anomaly_1m", F.col("rainfall_anomaly_1m"), sign),
        ("rainfall_anomaly_3m", F.col("rainfall_anomaly_3m"), F.lit(None).cast("string")),
        ("ndvi_anomaly_1m", F.col("ndvi_anomaly_1m"), F.lit(None).cast("string")),
        ("ndvi_anomaly_3m", F.col("ndvi_anomaly_3m"), F.lit(None).cast("string")),
        ("maize_price_zscore", F.col("maize_price_zscore"), F.lit(None).cast("string")),
        ("previous_ipc_phase", F.col("previous_ipc_phase").cast("double"), F.lit(None).cast("string")),
    ]
    entries = F.array(
        *[
            F.struct(F.lit(n).alias("series"), v.cast("double").alias("value"), c.alias("colour"))
            for n, v, c in series
        ]
    )
    return rows.select("county_name", "period", F.inline(entries))


def top_features(importance: DataFrame, n: int = 10, by: str = "importance") -> DataFrame:
    return importance.orderBy(F.desc(by), "feature").limit(n)


def registry_slice(
    registry: DataFrame, horizon: int, fold: str, feature_set: str = "all_features"
) -> DataFrame:
    return registry.where(
        (F.col("forecast_horizon") == horizon)
        & (F.col("fold_name") == fold)
        & (F.col("feature_set") == feature_set)
    )


def best_registry_row(registry: DataFrame, by: Sequence[str] = ("f1_score",)) -> DataFrame:
    return registry.orderBy(*[F.desc(c) for c in by], "model_name").limit(1)


def select_model(candidates: DataFrame, keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """Winner per key: best F1; on equal F1 a later candidate with recall 0.8 replaces.

    ``candidates`` has ``model``, ``position`` (candidate order), ``f1_score`` and
    ``recall``. Among the rows with the best F1 the first stands unless later ones
    qualify, in which case the last of those wins.
    """
    rank = F.struct(
        F.col("f1_score"),
        (F.col("recall") >= 0.8).cast("int"),
        F.when(F.col("recall") >= 0.8, F.col("position")).otherwise(-F.col("position")),
    )
    return candidates.groupBy(*keys).agg(
        F.max_by(F.struct("model", "f1_score", "recall"), rank).alias("_w")
    ).select(*keys, "_w.*")
