"""Joining the monthly feeds and deriving the panel features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harbinger import fixed_values as V
from harbinger.functions.calendar import month_index
from harbinger.functions.scalars import percent_change
from harbinger.operators.keys import entity_months

KEY = ["county_name", "year", "month"]


def join_feeds(
    rainfall: DataFrame, vegetation: DataFrame, market: DataFrame, assessments: DataFrame
) -> DataFrame:
    """Inner equi-join of the four monthly feeds on entity and month."""
    return (
        rainfall.select(*KEY, "rainfall_mm", "rainfall_anomaly")
        .join(vegetation.select(*KEY, "ndvi_mean", "ndvi_anomaly"), KEY)
        .join(market.select(*KEY, "price"), KEY)
        .join(assessments.select(*KEY, "ipc_phase", "target_phase3plus"), KEY)
    )


def shifted(column: str, rows: int, calendar: bool = False) -> Column:
    """Value ``rows`` earlier: by position, or by calendar month when ``calendar``.

    The positional form skips over missing months; the calendar form gives NULL.
    """
    w = entity_months()
    if not calendar:
        return F.lag(column, rows).over(w)
    by_month = Window.partitionBy("county_name").orderBy(month_index(F.col("year"), F.col("month")))
    return F.first(column).over(by_month.rangeBetween(-rows, -rows))


def rolling_mean(column: str, rows: int = 3) -> Column:
    return F.avg(column).over(entity_months().rowsBetween(-(rows - 1), Window.currentRow))


def dry_streak(anomaly: str = "rainfall_anomaly", row: str = "_row") -> Column:
    """Unbroken run of negative anomalies ending on the row before this one.

    The row number (column ``row``) minus the number of the last row that broke the
    run; a missing or non-negative anomaly breaks it.
    """
    w = entity_months()
    breaks = F.col(anomaly).isNull() | (F.col(anomaly) >= 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    broken_at = F.max(F.when(breaks, F.col(row))).over(before)
    return (F.col(row) - 1 - F.coalesce(broken_at, F.lit(0))).cast("int")


def zscore(column: str, expanding: bool = False) -> Column:
    """Distance from the entity mean in sample deviations; a zero deviation counts as 1.

    The default uses the whole history of the entity (it looks ahead);
    ``expanding`` uses only rows up to the current one.
    """
    w = Window.partitionBy("county_name")
    if expanding:
        w = entity_months().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    std = F.stddev_samp(column).over(w)
    return (F.col(column) - F.avg(column).over(w)) / F.when(std == 0, 1.0).otherwise(std)


def panel_features(
    joined: DataFrame, calendar: bool = False, expanding_zscore: bool = False
) -> DataFrame:
    """The 15-column panel from the joined feeds, one exchange for every window."""
    w = entity_months()
    numbered = joined.withColumn("_row", F.row_number().over(w))
    out = numbered.withColumns(
        {
            "rainfall_anomaly_1m": shifted("rainfall_anomaly", 1, calendar),
            "rainfall_anomaly_3m": shifted("rainfall_anomaly", 3, calendar),
            "rainfall_rolling_3m": rolling_mean("rainfall_mm"),
            "consecutive_dry_months": dry_streak(),
            "ndvi_anomaly_1m": shifted("ndvi_anomaly", 1, calendar),
            "ndvi_anomaly_3m": shifted("ndvi_anomaly", 3, calendar),
            "ndvi_trend_3m": F.col("ndvi_mean") - shifted("ndvi_mean", 3, calendar),
            "maize_price_change_1m": percent_change(F.col("price"), shifted("price", 1, calendar)),
            "maize_price_change_3m": percent_change(F.col("price"), shifted("price", 3, calendar)),
            "maize_price_zscore": zscore("price", expanding_zscore),
            "previous_ipc_phase": shifted("ipc_phase", 1, calendar),
        }
    )
    return out.select(*V.PANEL_COLUMNS)


def build_panel(
    rainfall: DataFrame,
    vegetation: DataFrame,
    market: DataFrame,
    assessments_monthly: DataFrame,
    **options: bool,
) -> DataFrame:
    return panel_features(
        join_feeds(rainfall, vegetation, market, assessments_monthly), **options
    )
