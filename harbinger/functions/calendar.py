"""Month keys, seasons and freshness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def month_index(year: Column, month: Column) -> Column:
    """Months since year 0: consecutive months differ by one."""
    return (year * 12 + month - 1).cast("int")


def period_text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def season_code(month: Column) -> Column:
    """MAM long rains, OND short rains, JF and JJAS the dry spells after them."""
    return (
        F.when(month.isin(3, 4, 5), "MAM")
        .when(month.isin(10, 11, 12), "OND")
        .when(month.isin(1, 2), "JF")
        .otherwise("JJAS")
    )


def season_flag(month: Column, code: str) -> Column:
    return (season_code(month) == code).cast("int")


def quarter_of(month: Column) -> Column:
    return F.ceil(month / 3).cast("int")


def staleness_days(latest: Column, as_of: Column) -> Column:
    """Whole days from ``YYYY-MM`` or ``YYYY-MM-DD`` to ``as_of``; 0 for bad text."""
    text = F.when(F.length(latest) == 7, F.concat(latest, F.lit("-01"))).otherwise(
        F.substring(latest, 1, 10)
    )
    day = F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")
    return F.coalesce(F.greatest(F.lit(0), F.datediff(as_of, day)), F.lit(0))


def is_stale(days: Column, limit: Column) -> Column:
    return F.coalesce(days > limit, F.lit(False))
