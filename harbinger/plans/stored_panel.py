"""A panel kept on disk by month and by entity, and rebuilt only where a landing changed it.

Four Parquet tables in one folder:

* ``rows``: the joined feed rows, by year and month;
* ``months``: the panel features of those rows, by year and month;
* ``entities``: the same features by entity bucket and year, for questions about one entity;
* ``moments``: count, mean and squared deviations of the price, by year.

The price z-score looks at the whole history of an entity, so every new month changes it in
every row. It is therefore not stored: it is finished on reading, from the price of the row
and the moments of its entity, which are one small row a year.

Landing the same rows again changes nothing, and a landing that was interrupted is repaired
by repeating it. One landing runs at a time.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harbinger import fixed_values as V
from harbinger.functions.calendar import month_index, month_start
from harbinger.operators.keys import entity_months, same_entity
from harbinger.operators.panel import KEY, panel_features
from harbinger.sources.shared import settle
from harbinger.sources.storage import drop_folder, newest_partition, oldest_partition, path_exists, write_partitions

RAW = ["rainfall_mm", "rainfall_anomaly", "ndvi_mean", "ndvi_anomaly", "price", "ipc_phase", "target_phase3plus"]
LOOK_BACK = 3  # rows that the lags and rolling means of a row reach back
FIRST_SPAN = 6  # months read at first on either side of a landing
STORED = [c for c in V.PANEL_COLUMNS if c != "maize_price_zscore"] + ["price"]


def _index() -> Column:
    return month_index(F.col("year"), F.col("month"))


class StoredPanel:
    """The stored panel in ``folder``; an absent folder is an empty panel."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 8):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    # -- reading -----------------------------------------------------------------------

    def exists(self) -> bool:
        return path_exists(self.spark, f"{self.folder}/months")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def rows(self) -> DataFrame:
        """The joined feed rows behind the panel."""
        return self._table("rows").select(*KEY, *RAW)

    def _price_scale(self) -> DataFrame:
        """Mean and sample deviation of the price of each entity, from its yearly moments."""
        years = self._table("moments").groupBy("county_name").agg(
            F.collect_list(F.struct("n", "mean", "m2")).alias("y"), F.sum("n").alias("n"),
            (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"),
        )
        spread = F.aggregate(
            "y", F.lit(0.0), lambda a, y: a + y["m2"] + y["n"] * (y["mean"] - F.col("mean")) * (y["mean"] - F.col("mean"))
        )
        return years.select(
            "county_name", F.col("mean").alias("_mean"), F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1))).alias("_std")
        )

    def _finished(self, stored: DataFrame) -> DataFrame:
        scale = F.when(F.col("_std") == 0, 1.0).otherwise(F.col("_std"))
        with_score = stored.join(self._price_scale(), "county_name", "left").withColumn(
            "maize_price_zscore", (F.col("price") - F.col("_mean")) / scale
        )
        return with_score.select(*V.PANEL_COLUMNS)

    def panel(self) -> DataFrame:
        """All rows with all panel columns."""
        return self._finished(self._table("months"))

    def entity(self, name: str) -> DataFrame:
        """The panel rows of one entity, case aside: one bucket is read."""
        bucket = zlib.crc32(name.lower().encode()) % self.buckets
        return self._finished(same_entity(self._table("entities").where(F.col("bucket") == bucket), name))

    def newest(self) -> tuple[int, int]:
        return newest_partition(self.spark, f"{self.folder}/months", "year", "month")

    def latest(self) -> DataFrame:
        """The rows of the newest month: one partition is read."""
        year, month = self.newest()
        return self._finished(self._table("months").where((F.col("year") == year) & (F.col("month") == month)))

    def latest_filled(self) -> DataFrame:
        """The rows of the newest month, gaps filled with the last known value, else 0.

        Earlier months are read only when a row of the newest has a gap, and as far back as
        the gaps ask for.
        """
        year, month = self.newest()
        at, first, span = year * 12 + month - 1, self._edge(oldest_partition), 0
        newest = (F.col("year") == year) & (F.col("month") == month)
        while True:
            recent = self._table("months").where(_index() >= max(first, at - span)) if span else self._table("months").where(newest)
            behind = entity_months().rowsBetween(Window.unboundedPreceding, Window.currentRow)
            known = {c: F.last(c, ignorenulls=True).over(behind) for c in V.PANEL_FEATURES}
            filled = self._finished(recent)
            filled = filled.withColumns(known).where(newest) if span else filled
            gaps = F.exists(F.array(*[F.col(c).isNull() for c in V.PANEL_FEATURES]), lambda x: x)
            if at - span <= first or filled.where(gaps).isEmpty():
                return filled.fillna(0, subset=V.PANEL_FEATURES)
            span = max(FIRST_SPAN, 2 * span)

    # -- landing -----------------------------------------------------------------------

    def _edge(self, which) -> int:
        year, month = which(self.spark, f"{self.folder}/rows", "year", "month")
        return year * 12 + month - 1

    def changed(self, rows: DataFrame) -> DataFrame:
        """The rows that the panel does not hold as they are."""
        rows = rows.select(*KEY, *RAW)
        return rows.subtract(self.rows()) if self.exists() else rows

    def replace(self, rows: DataFrame) -> list[tuple[int, int]]:
        """Make the panel that of ``rows``: changed rows are landed, vanished ones start it anew."""
        rows = settle(rows.select(*KEY, *RAW))
        if self.exists() and not self.rows().join(rows, KEY, "left_anti").isEmpty():
            drop_folder(self.spark, self.folder)
        return self.land(self.changed(rows))

    def land(self, rows: DataFrame) -> list[tuple[int, int]]:
        """Take in new and corrected rows (KEY and RAW); returns the months rewritten.

        A landed row replaces the stored one of its key. Only the landed months and the
        later ones that still depend on them are computed again, from stored rows that
        reach back as far as the lags of their first month do.
        """
        landed = settle(rows.select(*KEY, *RAW))
        # one row a month of the calendar
        months = [(r.year, r.month) for r in landed.select("year", "month").distinct().collect()]
        if not months:
            return []
        merged, known = landed, path_exists(self.spark, f"{self.folder}/rows")
        if known:
            same = self.rows().where(_index().isin([y * 12 + m - 1 for y, m in months]))
            merged = same.join(landed.select(*KEY), KEY, "left_anti").unionByName(landed)
        write_partitions(settle(merged), f"{self.folder}/rows", "year", "month")

        first = min(y * 12 + m - 1 for y, m in months)
        start, last = first, max(y * 12 + m - 1 for y, m in months)
        if known:
            last = self._settled_by(landed.groupBy("county_name").agg(F.max(_index()).alias("_landed")))
            start = self._look_back(first, last)
        fresh = settle(self._features(start, first, last))
        write_partitions(fresh, f"{self.folder}/months", "year", "month")
        years = sorted({i // 12 for i in range(first, last + 1)})
        bucket = F.pmod(F.crc32(F.lower("county_name").cast("binary")), F.lit(self.buckets)).cast("int")
        by_entity = self._table("months").where(F.col("year").isin(years)).select(*STORED, bucket.alias("bucket"))
        write_partitions(by_entity, f"{self.folder}/entities", "bucket", "year")
        price = self.rows().where(F.col("year").isin(years)).groupBy("county_name", "year").agg(
            F.count("price").alias("n"), F.avg("price").alias("mean"), (F.var_pop("price") * F.count("price")).alias("m2")
        )
        write_partitions(price.where("n > 0"), f"{self.folder}/moments", "year")
        return sorted((r.year, r.month) for r in fresh.select("year", "month").distinct().collect())

    def _settled_by(self, landed: DataFrame) -> int:
        """The last month whose features a landing can change.

        A row reaches back LOOK_BACK rows, and a dry streak to the last row that broke it:
        beyond both, nothing of the landed rows is left. ``landed`` holds the last landed
        month of each entity.
        """
        end, span = self._edge(newest_partition), FIRST_SPAN
        newest = landed.agg(F.max("_landed").alias("m")).first()["m"]
        breaks = F.col("rainfall_anomaly").isNull() | (F.col("rainfall_anomaly") >= 0)
        while True:
            until = min(end, newest + span)
            after = self.rows().select(*KEY, "rainfall_anomaly").withColumn("_i", _index()).where(F.col("_i") <= until)
            after = after.join(landed, "county_name").where(F.col("_i") > F.col("_landed"))
            nth = after.withColumn("_n", F.row_number().over(Window.partitionBy("county_name").orderBy("_i")))
            reach = nth.groupBy("county_name").agg(
                F.min(F.when(F.col("_n") == LOOK_BACK, F.col("_i"))).alias("_lags"),
                F.min(F.when(breaks, F.col("_i"))).alias("_streak"), F.max("_i").alias("_seen"),
            )
            settled = F.when(F.col("_lags").isNotNull() & F.col("_streak").isNotNull(), F.greatest("_lags", "_streak"))
            found = landed.join(reach, "county_name", "left").agg(
                F.max(F.coalesce(settled, F.col("_seen"), F.col("_landed"))).alias("last"),
                F.count_if(settled.isNull()).alias("open"),
            ).first()
            if until == end or not found["open"]:
                return max(newest, found["last"])
            span *= 2

    def _look_back(self, first: int, last: int) -> int:
        """The month from which every entity has LOOK_BACK rows before ``first``, or all it has."""
        oldest, span = self._edge(oldest_partition), FIRST_SPAN
        while True:
            start = max(oldest, first - span)
            seen = self.rows().select(*KEY).withColumn("_i", _index()).where(F.col("_i").between(start, last))
            before = seen.groupBy("county_name").agg(F.count_if(F.col("_i") < first).alias("n"), F.max("_i").alias("m"))
            if start == oldest or before.where((F.col("m") >= first) & (F.col("n") < LOOK_BACK)).isEmpty():
                return start
            span *= 2

    def _features(self, start: int, first: int, last: int) -> DataFrame:
        """Panel features of the months from ``first`` to ``last``.

        Rows from ``start`` give the lags; the dry streak goes on from the one stored with
        the last earlier row of the entity, unless a break lies between.
        """
        raw = self.rows().withColumn("_i", _index()).where(F.col("_i").between(start, last))
        by_entity = Window.partitionBy("county_name")
        numbered = raw.withColumn("_row", F.row_number().over(entity_months()))
        breaks = F.col("rainfall_anomaly").isNull() | (F.col("rainfall_anomaly") >= 0)
        marked = numbered.withColumns(
            {
                "_from": F.max(F.when(F.col("_i") < first, F.col("_row"))).over(by_entity),
                "_broken": F.max(F.when(breaks, F.col("_row"))).over(entity_months().rowsBetween(Window.unboundedPreceding, -1)),
            }
        )
        if start < first:
            stored = self._table("months").where(_index().between(start, first - 1))
            last_stored = stored.groupBy("county_name").agg(F.max_by("consecutive_dry_months", _index()).alias("_streak"))
            marked = marked.join(last_stored, "county_name", "left")
        else:
            marked = marked.withColumn("_streak", F.lit(0))
        known = F.coalesce("_from", F.lit(1))
        going_on = F.coalesce("_streak", F.lit(0)) + F.col("_row") - known
        streak = F.when(F.col("_broken") >= known, F.col("_row") - 1 - F.col("_broken")).otherwise(going_on).cast("int")
        streaks = marked.where(F.col("_i") >= first).select(*KEY, streak.alias("_dry"), "price")
        features = panel_features(raw).drop("maize_price_zscore", "consecutive_dry_months")
        return features.join(streaks, KEY).withColumnRenamed("_dry", "consecutive_dry_months").select(*STORED)


def with_observation(panel: DataFrame, horizon: int = 1) -> DataFrame:
    """Panel rows under the date and horizon that the risk tables name."""
    return panel.withColumns(
        {"observation_date": month_start(F.col("year"), F.col("month")), "horizon_months": F.lit(horizon)}
    )
