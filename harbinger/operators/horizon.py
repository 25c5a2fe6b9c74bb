"""Second-order lags and the one-row-per-horizon long table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbinger import fixed_values as V
from harbinger.functions.calendar import month_start, period_text, quarter_of, season_flag
from harbinger.operators.keys import entity_months

HORIZONS = (1, 2, 3)


def second_order_lags(panel: DataFrame) -> DataFrame:
    """Lags of the panel's already lagged columns.

    ``rainfall_anomaly_lag1`` is therefore two months behind the raw feed, and
    ``rainfall_rolling_6m`` is a sum of two three-month means; the names are kept
    because models and reports refer to them.
    """
    w = entity_months()

    def lag(c: str, n: int):
        return F.lag(c, n).over(w)

    rain, ndvi = "rainfall_anomaly_1m", "ndvi_anomaly_1m"
    mean3, change3, phase = "rainfall_rolling_3m", "maize_price_change_3m", "previous_ipc_phase"
    return panel.withColumns(
        {
            "rainfall_anomaly_lag1": lag(rain, 1),
            "rainfall_anomaly_lag2": lag(rain, 2),
            "rainfall_anomaly_lag3": lag(rain, 3),
            "rainfall_rolling_6m": F.col(mean3) + lag(mean3, 3),
            "ndvi_anomaly_lag1": lag(ndvi, 1),
            "ndvi_anomaly_lag2": lag(ndvi, 2),
            "ndvi_anomaly_lag3": lag(ndvi, 3),
            "ndvi_trend_6m": F.col(ndvi) - lag(ndvi, 6),
            "maize_price_change_6m": F.col(change3) + lag(change3, 3),
            "ipc_phase_lag2": lag(phase, 1),
            "ipc_phase_lag3": lag(phase, 2),
        }
    )


def lead_targets(panel: DataFrame, label: str = "target_phase3plus") -> DataFrame:
    w = entity_months()
    return panel.withColumns({f"{label}_t{h}": F.lead(label, h).over(w) for h in HORIZONS})


def seasonal_context(panel: DataFrame, dim: DataFrame) -> DataFrame:
    """Quarter, rain-season flags and the aridity flag (1 for an unknown entity)."""
    arid = dim.select(
        F.col("canonical_name").alias("county_name"),
        (F.col("asal_category") == "Arid").cast("int").alias("_arid"),
    )
    return (
        panel.join(arid, "county_name", "left")
        .withColumns(
            {
                "quarter": quarter_of(F.col("month")),
                "is_long_rains": season_flag(F.col("month"), "MAM"),
                "is_short_rains": season_flag(F.col("month"), "OND"),
                "is_arid": F.coalesce("_arid", F.lit(1)),
            }
        )
        .drop("_arid")
    )


def fan_out(wide: DataFrame, carried: list[str], label: str = "target_phase3plus") -> DataFrame:
    """One row per horizon with its target date and label.

    Runs inside the scan's stage (an in-place ``explode`` of a three-entry array).
    """
    observed = month_start(F.col("year"), F.col("month"))
    branches = F.array(
        *[
            F.struct(F.lit(h).alias("horizon_months"), F.col(f"{label}_t{h}").alias("label"))
            for h in HORIZONS
        ]
    )
    long = wide.withColumn("observation_date", observed).select(
        "county_name", "observation_date", F.explode(branches).alias("_h"), *carried
    )
    target = F.add_months("observation_date", F.col("_h.horizon_months"))
    guarded = F.when(target > F.col("observation_date"), target).otherwise(
        F.raise_error(F.lit("target date is not after the observation date")).cast("date")
    )
    return long.select(
        "county_name",
        "observation_date",
        period_text(F.col("observation_date")).alias("observation_period"),
        F.col("_h.horizon_months").alias("horizon_months"),
        guarded.alias("target_date"),
        period_text(target).alias("target_period"),
        F.col("_h.label").alias(label),
        *carried,
    )


def build_long_table(
    panel: DataFrame, dim: DataFrame, edges: DataFrame | None = None
) -> DataFrame:
    """Panel to the labelled multi-horizon table.

    Neighbour means are taken on the panel, before the fan-out, so the graph join
    handles a third of the rows it would see afterwards.
    """
    from harbinger.operators.neighbours import neighbour_features

    wide = lead_targets(second_order_lags(seasonal_context(panel, dim)))
    features = [f for f in V.LONG_FEATURES if f not in V.NEIGHBOUR_COLUMNS]
    if edges is not None:
        wide = neighbour_features(wide, edges, date=["year", "month"])
        features = V.LONG_FEATURES
    return fan_out(wide, features)
