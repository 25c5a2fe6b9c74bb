"""Positions of rows in one order over the whole table, without one task seeing all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harbinger.sources.shared import settle

IN_PARTITION = (1 << 33) - 1  # the part of a row id that counts inside a partition


def numbered(df: DataFrame, order: Sequence[str], out: str = "_no") -> DataFrame:
    """``df`` with the position 1, 2, ... of every row in the order of the columns.

    Rows are dealt by ranges of the order and counted inside them; a range then begins
    where the rows of the earlier ranges end. The order should be total: equal rows are
    numbered in any way among themselves.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settle(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    # one row a partition
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    joined = placed.withColumn("_part", part).join(starts, "_part")
    return joined.withColumn(out, F.col("_start") + F.col("_id").bitwiseAND(F.lit(IN_PARTITION)) + 1).drop("_id", "_part", "_start")
