"""Simple reference forecasts: persistence, entity frequency, seasonal rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbinger.functions.scalars import clip

LOW, HIGH = 0.001, 0.999


def persistence(df: DataFrame, phase: str = "previous_ipc_phase", threshold: float = 3.0) -> DataFrame:
    """1 when the last known phase was an event, else 0; 0.5 without the column."""
    if phase not in df.columns:
        return df.withColumn("p", F.lit(0.5))
    return df.withColumn("p", F.when(F.col(phase) >= threshold, 1.0).otherwise(0.0))


def event_rates(train: DataFrame, label: str = "target_phase3plus") -> DataFrame:
    """Label rates by (entity, month), entity, month and overall, from one pass.

    ``level`` says which keys count: ``entity_month``, ``entity``, ``month``, ``all``.
    """
    rows = _counts(train, label)
    level = (
        F.when(F.grouping_id() == 0, "entity_month")
        .when(F.grouping_id() == 1, "entity")
        .when(F.grouping_id() == 2, "month")
        .otherwise("all")
    )
    return rows.groupingSets(
        [["county_name", "month"], ["county_name"], ["month"], []], "county_name", "month"
    ).agg(level.alias("level"), (F.sum("s") / F.sum("n")).alias("rate"), F.sum("n").alias("n"))


def _counts(train: DataFrame, label: str) -> DataFrame:
    """Events and rows per (entity, month): the one pass over training.

    Every rate below sums this table and reads both of its measures.
    """
    return train.groupBy("county_name", "month").agg(
        F.sum(F.col(label).cast("double")).alias("s"), F.count(label).alias("n")
    )


def _rate():
    return F.sum("s") / F.sum("n")


def historical_frequency(
    train: DataFrame, df: DataFrame, label: str = "target_phase3plus", use_entity: bool = True
) -> DataFrame:
    """Event rate of the entity in training, else the overall rate.

    ``use_entity=False`` drops the key, as a fit on feature columns alone would.
    """
    counts = _counts(train, label)
    overall = counts.agg(F.coalesce(_rate(), F.lit(0.5)).alias("rate")).scalar()
    if not use_entity:
        return df.withColumn("p", clip(overall, LOW, HIGH))
    by_entity = counts.groupBy("county_name").agg(_rate().alias("_rate"))
    joined = df.join(by_entity, "county_name", "left")
    return joined.select(
        *df.columns, clip(F.coalesce("_rate", overall), LOW, HIGH).alias("p")
    )


def seasonal_rate(
    train: DataFrame, df: DataFrame, label: str = "target_phase3plus", use_entity: bool = True
) -> DataFrame:
    """Event rate by (entity, month), else by month, else overall."""
    counts = _counts(train, label)
    overall = counts.agg(F.coalesce(_rate(), F.lit(0.5)).alias("rate")).scalar()
    by_month = counts.groupBy("month").agg(_rate().alias("_by_month"))
    joined = df.join(by_month, "month", "left")
    best = [F.col("_by_month"), overall]
    if use_entity:
        both = counts.select("county_name", "month", (F.col("s") / F.col("n")).alias("_by_both"))
        joined = joined.join(both, ["county_name", "month"], "left")
        best.insert(0, F.col("_by_both"))
    return joined.select(*df.columns, clip(F.coalesce(*best), LOW, HIGH).alias("p"))
