"""Source registry and the append-only asset manifest.

A record is known by data set, checksum and status. Committing one that the manifest holds
adds nothing, and a batch of records appears whole, by one rename, or not at all: a job that
is retried or run again leaves the manifest as one run would.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harbinger import fixed_values as V
from harbinger.functions.calendar import is_stale, staleness_days
from harbinger.operators.keys import keep_last
from harbinger.operators.names import coverage_summary
from harbinger.sources.feeds import coverage_dates, normalise, read_csv
from harbinger.sources.shared import settle
from harbinger.sources.storage import drop_folder, fingerprint, has_files, move_folder, path_exists, pick_snapshot

REGISTRY_SCHEMA = (
    "source_key string, name string, provider string, url string, update_frequency string, "
    "staleness_warning_days int, local_raw_dir string, default_filename string, "
    "expected_columns array<string>"
)
MANIFEST_SCHEMA = (
    "asset_id string, dataset_name string, source_provider string, source_url string, "
    "retrieval_timestamp timestamp, file_path string, file_size_bytes bigint, "
    "sha256_checksum string, date_coverage_start string, date_coverage_end string, "
    "geographic_coverage array<string>, row_count bigint, schema_version string, "
    "ingestion_status string, staleness_days int, is_stale boolean, error_message string"
)
MANIFEST_COLUMNS = [part.strip().split(" ")[0] for part in MANIFEST_SCHEMA.split(", ")]
FEED_OF_SOURCE = {
    "rainfall_chirps": "rainfall", "vegetation_modis": "vegetation",
    "market_prices": "market", "ipc_food_security": "assessments",
}


def source_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.SOURCES, REGISTRY_SCHEMA)


def latest_assets(manifest: DataFrame, order: str = "retrieval_timestamp") -> DataFrame:
    """Newest record of each data set."""
    return keep_last(manifest, ["dataset_name"], [order, "asset_id"])


def already_ingested(candidates: DataFrame, manifest: DataFrame) -> DataFrame:
    """Candidates whose checksum was already ingested with success."""
    done = manifest.where(F.col("ingestion_status") == "success").select(
        "dataset_name", "sha256_checksum"
    )
    return candidates.join(done, ["dataset_name", "sha256_checksum"], "left_semi")


def with_staleness(df: DataFrame, registry: DataFrame, as_of) -> DataFrame:
    """Staleness days and flag of ``(source_key, date_coverage_end)`` rows."""
    limits = registry.select("source_key", "staleness_warning_days")
    days = staleness_days(F.col("date_coverage_end"), as_of)
    return (
        df.join(limits, "source_key", "left")
        .withColumn("staleness_days", days)
        .withColumn("is_stale", is_stale(F.col("staleness_days"), F.col("staleness_warning_days")))
        .drop("staleness_warning_days")
    )


def ingest(
    spark: SparkSession, source_key: str, folder: str, dim: DataFrame, as_of: str,
    retrieved_at: str, default: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fetch, check, audit and normalise one source: (data, manifest record, coverage).

    Nothing is written: :func:`append_manifest` stores the record.
    """
    row = next(s for s in V.SOURCES if s[0] == source_key)
    path, status = pick_snapshot(spark, folder, default or row[7])
    raw = read_csv(spark, path, row[8])
    data = normalise(raw, FEED_OF_SOURCE[source_key], dim)
    coverage = coverage_summary(raw, dim)
    # each is one row; as scalar sub-queries they need no join
    dates, counties = coverage_dates(raw), coverage.select("matched_counties")
    file = fingerprint(spark, path)
    facts = data.agg(F.count(F.lit(1)).alias("row_count")).withColumns(
        {
            "_dates": dates.select(F.struct("date_coverage_start", "date_coverage_end")).scalar(),
            "_file": file.select(F.struct("file_size_bytes", "sha256_checksum")).scalar(),
            "geographic_coverage": counties.scalar(),
        }
    ).select("row_count", "geographic_coverage", "_dates.*", "_file.*")
    days = staleness_days(F.col("date_coverage_end"), F.lit(as_of).cast("date"))
    when = F.lit(retrieved_at).cast("timestamp")
    record = facts.select(
        F.concat_ws(
            "-", F.lit(source_key), F.date_format(when, "yyyyMMddHHmmss"),
            F.substring("sha256_checksum", 1, 8),
        ).alias("asset_id"),
        F.lit(source_key).alias("dataset_name"),
        F.lit(row[2]).alias("source_provider"),
        F.lit(row[3]).alias("source_url"),
        when.alias("retrieval_timestamp"),
        F.lit(path).alias("file_path"),
        "file_size_bytes",
        "sha256_checksum",
        "date_coverage_start",
        "date_coverage_end",
        "geographic_coverage",
        "row_count",
        F.lit("1.0").alias("schema_version"),
        F.lit(status).alias("ingestion_status"),
        days.cast("int").alias("staleness_days"),
        ((days > row[5]) | F.lit(status == "stale_fallback")).alias("is_stale"),
        F.lit(None).cast("string").alias("error_message"),
    )
    return data, record, coverage


def failed_record(spark: SparkSession, source_key: str, error: str, retrieved_at: str, path: str | None = None) -> DataFrame:
    """The record of a source whose file could not be taken in."""
    row = next(s for s in V.SOURCES if s[0] == source_key)
    told = {
        "asset_id": F.concat_ws("-", F.lit(source_key), F.date_format(F.lit(retrieved_at).cast("timestamp"), "yyyyMMddHHmmss"), F.lit("failed")),
        "dataset_name": F.lit(source_key), "source_provider": F.lit(row[2]), "source_url": F.lit(row[3]),
        "retrieval_timestamp": F.lit(retrieved_at).cast("timestamp"), "file_path": F.lit(path),
        "ingestion_status": F.lit("failed"), "error_message": F.lit(error),
    }
    kinds = dict(part.strip().split(" ", 1) for part in MANIFEST_SCHEMA.split(", "))
    return spark.range(1).select(*[told.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in MANIFEST_COLUMNS])


# a failed source may have no checksum; its message stands for it
RECORD_KEY = ["dataset_name", "_content", "ingestion_status"]


def _keyed(records: DataFrame) -> DataFrame:
    content = F.coalesce("sha256_checksum", "error_message", F.lit(""))
    return records.select(*MANIFEST_COLUMNS).withColumn("_content", content)


def commit_records(records: DataFrame, path: str) -> int:
    """Add the records that the manifest does not hold; returns how many.

    They are written beside the manifest, under a name that readers pass over, and renamed
    to one that follows from their keys: of two jobs that commit the same records one wins
    and the other finds the work done.
    """
    spark = records.sparkSession
    first = keep_last(_keyed(records), RECORD_KEY, ["retrieval_timestamp", "asset_id"])
    held = _keyed(read_manifest(spark, path)).select(*RECORD_KEY)
    new = settle(first.join(held, RECORD_KEY, "left_anti"))
    key = F.concat_ws("|", *RECORD_KEY)
    # one row a file of this landing
    batch = new.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(key))), 256).alias("id")).first()
    if not batch["n"]:
        return 0
    staged, target = f"{path}/_staged-{uuid.uuid4().hex}", f"{path}/batch-{batch['id']}"
    new.select(*MANIFEST_COLUMNS).write.parquet(staged)
    if path_exists(spark, target):
        drop_folder(spark, staged)
        return 0
    move_folder(spark, staged, target)
    return batch["n"]


def append_manifest(record: DataFrame, path: str) -> int:
    return commit_records(record, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """All committed records; those of a write under way are not seen."""
    if path_exists(spark, path) and has_files(spark, path, "batch-"):
        return spark.read.schema(MANIFEST_SCHEMA).option("recursiveFileLookup", True).parquet(path)
    return spark.createDataFrame([], MANIFEST_SCHEMA)
