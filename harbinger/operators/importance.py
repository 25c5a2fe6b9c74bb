"""Feature importance: stability over horizons and permutation drop."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harbinger import fixed_values as V
from harbinger.operators.metrics import ranking_areas, score_counts
from harbinger.sources.shared import settle


def rank_features(importance: DataFrame, by: str = "importance") -> DataFrame:
    """Rank of each feature inside its horizon (one row per feature and horizon)."""
    w = Window.partitionBy("horizon").orderBy(F.desc(by), "feature")
    return importance.withColumn("rank", F.row_number().over(w))


def feature_stability(
    importance: DataFrame, by: str = "importance", horizons: Sequence[int] = (1, 2, 3),
    absent_rank: int = 99,
) -> DataFrame:
    """Mean and spread of a feature's rank over the horizons, with a class."""
    ranked = rank_features(importance, by)
    wide = ranked.groupBy("feature").agg(
        *[F.max(F.when(F.col("horizon") == h, F.col("rank"))).alias(f"r{h}") for h in horizons],
        *[F.max(F.when(F.col("horizon") == h, F.col(by))).alias(f"s{h}") for h in horizons],
    )
    ranks = [F.coalesce(f"r{h}", F.lit(absent_rank)).cast("int") for h in horizons]
    scores = [F.coalesce(f"s{h}", F.lit(0.0)) for h in horizons]
    n = len(horizons)
    mean = sum(ranks[1:], ranks[0]) / F.lit(float(n))
    staged = wide.select(
        "feature",
        (sum(scores[1:], scores[0]) / n).alias("_score"),
        mean.alias("_mean"),
        *[r.alias(f"rank_h{h}") for h, r in zip(horizons, ranks, strict=True)],
    )
    spread = sum(
        (F.pow(F.col(f"rank_h{h}") - F.col("_mean"), 2) for h in horizons), F.lit(0.0)
    ) / n
    staged = staged.withColumn("_std", F.sqrt(spread))
    steady, moderate, varying, low = V.STABILITY_CLASSES
    category = (
        F.when((F.col("_mean") <= 5) & (F.col("_std") <= 2.0), steady)
        .when(F.col("_mean") <= 10, moderate)
        .when(F.col("_std") > 3.0, varying)
        .otherwise(low)
    )
    return staged.select(
        "feature",
        F.round("_score", 5).alias("mean_importance_score"),
        F.round("_mean", 1).alias("mean_rank"),
        F.round("_std", 2).alias("rank_std"),
        *[f"rank_h{h}" for h in horizons],
        category.alias("stability_category"),
    )


ROWS_PER_BUCKET = 50_000


def successors(base: DataFrame, row_id: Sequence[str], repeats: int, seed: int, buckets: int) -> DataFrame:
    """``base`` once for each repeat, with the vector ``_other`` of the next row by hash."""
    ident = F.concat_ws("-", F.lit(str(seed)), F.col("_repeat").cast("string"), *[F.col(c).cast("string") for c in row_id])
    repeated = base.withColumn("_repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    hashed = repeated.withColumn("_key", F.md5(ident.cast("binary")))
    place = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    hashed = hashed.withColumn("_bucket", F.floor(place * F.lit(buckets) / F.lit(float(1 << 32))).cast("int"))
    inside = Window.partitionBy("_repeat", "_bucket").orderBy("_key")
    led = hashed.withColumn("_next", F.lead("_own").over(inside))
    # one row for each repeat and range
    firsts = hashed.groupBy("_repeat", "_bucket").agg(F.min_by("_own", "_key").alias("_first"))
    around = Window.partitionBy("_repeat").orderBy("_bucket")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("_first").over(around), F.first("_first").over(whole))
    ends = firsts.select("_repeat", "_bucket", after.alias("_after"))
    joined = led.join(ends, ["_repeat", "_bucket"])
    return joined.withColumn("_other", F.coalesce("_next", "_after")).drop("_next", "_after", "_key", "_bucket")


def permutation_importance(
    score: Callable[[DataFrame], DataFrame], held_out: DataFrame, features: Sequence[str],
    row_id: Sequence[str], label: str = "target_phase3plus", repeats: int = 10, seed: int = 42,
    buckets: int | None = None, decimals: int = 5,
) -> DataFrame:
    """Drop in ROC area when one feature is shuffled, for all features in one job.

    In each repeat the rows are put in the order of a hash of their id and every row takes
    the feature vector of its successor, the last that of the first, which permutes each
    column over the whole table. The order is cut into ``buckets`` equal ranges of the hash
    (by default one for about ROWS_PER_BUCKET rows): inside a range the successor is the
    next row, and the last row of a range takes the first of the next range that has rows.
    The permutation is therefore the same for any number of buckets. Each row then fans
    out, in place, to one variant per feature with only that entry borrowed, and scores
    leave the task as counts.

    ``score`` turns a frame with a ``features`` vector into one with ``p``.
    """
    features = list(features)
    values = F.array(*[F.col(c).cast("double") for c in features])
    base = settle(held_out.select(*row_id, F.col(label).cast("int").alias("y"), values.alias("_own")))
    if buckets is None:
        buckets = max(1, -(-base.count() // ROWS_PER_BUCKET))
    paired = successors(base, row_id, repeats, seed, buckets)
    variants = paired.select(
        "y", "_repeat", "_own", "_other",
        F.posexplode(F.array(*[F.lit(f) for f in features])).alias("_i", "feature"),
    ).withColumn(
        "_mixed",
        F.transform("_own", lambda v, i: F.when(i == F.col("_i"), F.get("_other", i)).otherwise(v)),
    )
    shuffled = score(variants.withColumn("features", array_to_vector("_mixed")))
    areas = ranking_areas(
        score_counts(shuffled, ["feature", "_repeat"]), ["feature", "_repeat"]
    )
    plain = score(base.withColumn("features", array_to_vector("_own")))
    reference = ranking_areas(score_counts(plain)).select("roc_auc").scalar()
    return (
        areas.withColumn("_drop", reference - F.col("roc_auc"))
        .groupBy("feature")
        .agg(
            F.round(F.avg("_drop"), decimals).alias("permutation_importance_mean"),
            F.round(F.stddev_pop("_drop"), decimals).alias("permutation_importance_std"),
        )
    )
