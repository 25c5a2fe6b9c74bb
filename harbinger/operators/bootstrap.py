"""Block-bootstrap confidence intervals for the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger.operators import ranks
from harbinger.operators.metrics import ranked_metrics, rates, score_counts

METRICS = [
    "recall", "precision", "f1", "roc_auc", "pr_auc", "brier_score", "false_negative_rate",
]


def drawn_slot(seed: int, replicate: Column, slot: Column, blocks: Column) -> Column:
    """Block number 1..``blocks`` for one draw: a hash, so any engine can repeat it."""
    text = F.concat_ws("-", F.lit(str(seed)), replicate.cast("string"), slot.cast("string"))
    value = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return F.pmod(value, blocks) + 1


def block_multiplicity(blocks: DataFrame, block: str, n: int, seed: int) -> DataFrame:
    """How often each block is drawn in each replicate; replicate 0 is the data itself.

    Blocks, one row each, are numbered by ranges, so there may be very many of them.
    """
    known = ranks.numbered(blocks.select(block).where(F.col(block).isNotNull()), [block], "_no")
    total = known.agg(F.count(F.lit(1)).alias("k")).scalar()
    draws = (
        blocks.sparkSession.range(1, n + 1)
        .select(F.col("id").alias("replicate"), total.alias("_k"))
        .where(F.col("_k") > 0)
        .withColumn("_slot", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k"))))
        .withColumn("_no", drawn_slot(seed, F.col("replicate"), F.col("_slot"), F.col("_k")))
        .groupBy("replicate", "_no")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    drawn = draws.join(known, "_no").select("replicate", block, "times")
    itself = known.select(
        F.lit(0).cast("long").alias("replicate"), block, F.lit(1).cast("long").alias("times")
    )
    return drawn.unionByName(itself)


def replicate_metrics(
    scored: DataFrame, block: str, n: int = 500, seed: int = 42, threshold: float = 0.5,
    label: str = "y", prob: str = "p", salts: int = 8,
) -> DataFrame:
    """All metrics of every replicate in one job.

    Rows shrink to positives and negatives per (block, distinct score) before any
    resampling; a replicate is a weighting of those cells. The cells carry a salt
    taken from the score, and the multiplicities are repeated per salt, so one
    dominant block spreads over several tasks.
    """
    clean = scored.dropna(subset=[label, prob, block])
    cells = score_counts(clean, [block], label, prob)
    times = block_multiplicity(clean.select(block).distinct(), block, n, seed)
    salted = cells.withColumn("_salt", F.pmod(F.xxhash64("p"), F.lit(salts)).cast("int"))
    spread = times.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    counts = (
        salted.join(spread, [block, "_salt"])
        .groupBy("replicate", "p")
        .agg(
            F.sum(F.col("times") * F.col("pos")).alias("pos"),
            F.sum(F.col("times") * F.col("neg")).alias("neg"),
        )
    )
    r = rates()
    return ranked_metrics(counts, ["replicate"], threshold).select(
        "replicate",
        r["recall"].alias("recall"),
        r["precision"].alias("precision"),
        r["f1_score"].alias("f1"),
        F.coalesce("roc_auc", F.lit(0.5)).alias("roc_auc"),
        F.coalesce("pr_auc", F.lit(0.0)).alias("pr_auc"),
        "brier_score",
        (1 - r["recall"]).alias("false_negative_rate"),
        ((F.col("tp") + F.col("fn") > 0) & (F.col("fp") + F.col("tn") > 0)).alias("two_classes"),
    )


def block_bootstrap(
    scored: DataFrame, block: str, n: int = 500, seed: int = 42, threshold: float = 0.5,
    label: str = "y", prob: str = "p", decimals: int = 4,
) -> DataFrame:
    """Estimate, 95 % interval and deviation of each metric over date blocks.

    Replicates with one class are skipped; with fewer than 10 usable replicates the
    interval is the estimate itself. A single block makes every replicate equal to
    the data, which gives the same answer.
    """
    long = replicate_metrics(scored, block, n, seed, threshold, label, prob).unpivot(
        ["replicate", "two_classes"], METRICS, "metric", "value"
    )
    drawn = F.when((F.col("replicate") > 0) & F.col("two_classes"), F.col("value"))
    ends = F.percentile(drawn, F.array(F.lit(0.025), F.lit(0.975)))
    out = long.groupBy("metric").agg(
        F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("estimate"),
        F.count(drawn).alias("_valid"),
        ends.alias("_ends"),
        F.stddev_pop(drawn).alias("_std"),
    )
    enough = F.col("_valid") >= 10
    return out.select(
        "metric",
        F.round("estimate", decimals).alias("estimate"),
        F.round(F.when(enough, F.get("_ends", F.lit(0))).otherwise(F.col("estimate")), decimals).alias("ci_lower"),
        F.round(F.when(enough, F.get("_ends", F.lit(1))).otherwise(F.col("estimate")), decimals).alias("ci_upper"),
        F.round(F.when(enough, F.col("_std")).otherwise(0.0), decimals).alias("std"),
    )
