"""Keep-last de-duplication, interval expansion, fills and latest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(df: DataFrame, key: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """Last row of each key in ``sequence`` order; a hash of the row settles ties.

    An aggregate, not a window: duplicates are combined before the shuffle, so a
    key that holds a large share of the rows never reaches one task whole.
    """
    rest = [c for c in df.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*sequence, F.xxhash64(*rest).alias("_tie")))
    return df.groupBy(*key).agg(last.alias("_last")).select(*key, "_last.*").select(*df.columns)


def expand_to_months(
    df: DataFrame,
    start: str = "period_start",
    end: str = "period_end",
    sequence: Sequence[str] | None = None,
    key: Sequence[str] = ("county_name",),
) -> DataFrame:
    """One row per month start inside ``[start, end]``; later intervals win overlaps."""
    first = F.when(F.dayofmonth(start) == 1, F.col(start)).otherwise(
        F.add_months(F.trunc(F.col(start), "MM"), 1)
    )
    months = F.when(first <= F.col(end), F.sequence(first, F.col(end), F.expr("interval 1 month")))
    out = (
        df.withColumn("_month", F.explode(months))
        .withColumn("year", F.year("_month"))
        .withColumn("month", F.month("_month"))
    )
    order = list(sequence or [start, end])
    out = keep_last(out, [*key, "year", "month"], order)
    carried = [c for c in df.columns if c not in key and c not in (start, end) and c not in order]
    return out.select(*key, "year", "month", *carried)


def entity_months(partition: str = "county_name", order: Sequence[str] = ("year", "month")):
    """The one window every panel feature shares.

    A partition holds one row per month of one entity, so its size is bounded by
    the calendar and not by the volume of the raw feeds.
    """
    return Window.partitionBy(partition).orderBy(*order)


def fill_back_then_forward(
    df: DataFrame,
    columns: Sequence[str],
    partition: str = "county_name",
    order: Sequence[str] = ("year", "month"),
    residual: float = 0.0,
) -> DataFrame:
    """Next known value, else the previous one, else ``residual``."""
    w = entity_months(partition, order)
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    behind = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = {
        c: F.coalesce(
            F.first(c, ignorenulls=True).over(ahead),
            F.last(c, ignorenulls=True).over(behind),
            F.lit(residual),
        )
        for c in columns
    }
    return df.withColumns(filled)


def fill_forward(
    df: DataFrame,
    columns: Sequence[str],
    partition: str = "county_name",
    order: Sequence[str] = ("year", "month"),
    residual: float = 0.0,
) -> DataFrame:
    """Leak-free variant: only earlier rows of the entity may fill a gap."""
    behind = entity_months(partition, order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return df.withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(behind), F.lit(residual)) for c in columns}
    )


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(0.0, subset=list(columns))


def at_latest(df: DataFrame, period: str = "period") -> DataFrame:
    """Rows at the newest period of the whole table (a scalar sub-query filter)."""
    newest = df.agg(F.max(period).alias("newest"))
    return df.where(F.col(period) == newest.scalar())


def last_per_entity(
    df: DataFrame, entity: str | Sequence[str] = "county_name", order: Sequence[str] = ("period",)
) -> DataFrame:
    """Newest row of each entity, by aggregation."""
    keys = [entity] if isinstance(entity, str) else list(entity)
    return keep_last(df, keys, list(order))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def between_periods(
    df: DataFrame,
    entity: str | None = None,
    start: str | None = None,
    end: str | None = None,
    everything: str = "All Counties",
) -> DataFrame:
    """Slice by entity and inclusive period range; each bound is optional."""
    out = df
    if entity and entity != everything:
        out = out.where(F.col("county_name") == entity)
    if start:
        out = out.where(F.col("period") >= start)
    if end:
        out = out.where(F.col("period") <= end)
    return out


def years_between(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Date-range filter at year granularity (only the year of each bound counts)."""
    out = df
    if start:
        out = out.where(F.col("year") >= int(start[:4]))
    if end:
        out = out.where(F.col("year") <= int(end[:4]))
    return out


def same_entity(df: DataFrame, entity: str) -> DataFrame:
    """Case-insensitive entity filter."""
    return df.where(F.lower("county_name") == entity.lower())


def members(df: DataFrame, column: str, values: Sequence[str], rename: dict[str, str]) -> DataFrame:
    """Rows whose column is one of ``values``, with display names."""
    return df.where(F.col(column).isin(list(values))).withColumnsRenamed(rename)


def top_rows(df: DataFrame, by: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*by).limit(n)
