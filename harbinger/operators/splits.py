"""Chronological splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbinger import fixed_values as V


def split_by_year(
    panel: DataFrame,
    train: Sequence[int] = V.TRAIN_YEARS,
    validation: Sequence[int] = V.VALIDATION_YEARS,
    test: Sequence[int] = V.TEST_YEARS,
    features: Sequence[str] = tuple(V.PANEL_FEATURES),
    label: str = "target_phase3plus",
) -> DataFrame:
    """Complete rows with a ``split`` column; years in no list are left out."""
    split = (
        F.when(F.col("year").isin(*train), "train")
        .when(F.col("year").isin(*validation), "val")
        .when(F.col("year").isin(*test), "test")
    )
    return (
        panel.dropna(subset=[*features, label])
        .withColumn("split", split)
        .where(F.col("split").isNotNull())
    )


def _fold_array(folds: Sequence[tuple], purge: bool):
    observed, target = F.col("observation_date"), F.col("target_date")
    entries = []
    for name, t0, t1, e0, e1, kind in folds:
        train = observed <= F.lit(t1).cast("date")
        if t0 is not None:
            train = train & (observed >= F.lit(t0).cast("date"))
        if purge:
            train = train & (target < F.lit(e0).cast("date"))
        held_out = observed.between(F.lit(e0).cast("date"), F.lit(e1).cast("date"))
        for role, test in (("train", train), ("eval", held_out)):
            entries.append(
                F.when(
                    test,
                    F.struct(
                        F.lit(name).alias("fold_name"),
                        F.lit(kind).alias("split_type"),
                        F.lit(role).alias("role"),
                    ),
                )
            )
    return F.array_compact(F.array(*entries))


def rolling_origin(
    long: DataFrame,
    folds: Sequence[tuple] = tuple(V.ROLLING_FOLDS),
    horizon: int | None = None,
    purge: bool = False,
    label: str = "target_phase3plus",
) -> DataFrame:
    """Rows of each expanding fold with ``fold_name``, ``split_type`` and ``role``.

    Fold bounds are constants of the plan, so membership is a per-row expression
    and needs no join. ``purge`` also drops training rows whose target date reaches
    into the evaluation window.
    """
    known = long.where(F.col(label).isNotNull())
    if horizon is not None:
        known = known.where(F.col("horizon_months") == horizon)
    return known.withColumn("_fold", F.explode(_fold_array(folds, purge))).select(
        *long.columns, "_fold.*"
    )


def fold_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("fold_name", "split_type", "horizon_months").agg(
        F.count_if(F.col("role") == "train").alias("train_count"),
        F.count_if(F.col("role") == "eval").alias("eval_count"),
    )
