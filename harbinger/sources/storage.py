"""Snapshot choice, dated landing, tables and JSON reports."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def drop_folder(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def move_folder(spark: SparkSession, path: str, target: str) -> None:
    """One rename; an error where the target is there already."""
    fs, where = _file_system(spark, path)
    _, there = _file_system(spark, target)
    if fs.exists(there) or not fs.rename(where, there):
        raise FileExistsError(f"could not rename to {target}")


def has_files(spark: SparkSession, path: str, prefix: str) -> bool:
    """Whether some entry of a folder begins with the prefix."""
    fs, where = _file_system(spark, path)
    return any(s.getPath().getName().startswith(prefix) for s in fs.listStatus(where))


def first_existing(spark: SparkSession, *paths: str) -> str:
    for path in paths:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"none of these exist: {', '.join(paths)}")


def read_table(spark: SparkSession, primary: str, *fallbacks: str) -> DataFrame:
    """Parquet (or header CSV) table at the first path that exists."""
    path = first_existing(spark, primary, *fallbacks)
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return spark.read.parquet(path)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """File paths, names, sizes and times of a folder; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime")
    )


def pick_snapshot(spark: SparkSession, folder: str, default: str, pattern: str = "*.csv") -> tuple[str, str]:
    """The default file, else the newest snapshot by name, with the matching status."""
    wanted = f"{folder.rstrip('/')}/{default}"
    if path_exists(spark, wanted):
        return wanted, "success"
    if path_exists(spark, folder):
        newest = list_files(spark, folder, pattern).agg(F.max_by("path", "name").alias("path")).first()
        if newest is not None and newest["path"] is not None:
            return newest["path"], "stale_fallback"
    raise FileNotFoundError(f"no snapshot matching {pattern} in {folder}")


def land_raw(df: DataFrame, folder: str, day: str) -> str:
    """Write a dated copy once; a completed landing of the same day is kept as it is.

    A folder without its success marker is an interrupted write and is redone.
    """
    spark = df.sparkSession
    target = f"{folder.rstrip('/')}/ingest_date={day}"
    if not path_exists(spark, f"{target}/_SUCCESS"):
        df.write.mode("overwrite").parquet(target)
    return target


def fingerprint(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256 and size of each file, read in blocks in the task that owns the file.

    The listing comes from the binary reader, whose content column is never read, so a
    file of any size is hashed in constant memory. Paths must open through Arrow's file
    systems (local, HDFS, S3, GCS), as the scheme says.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    )

    @F.pandas_udf("string")
    def digest(paths: pd.Series) -> pd.Series:
        return pd.Series([_sha256(p) for p in paths], dtype=object)

    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("length").alias("file_size_bytes"),
        digest("path").alias("sha256_checksum"),
    )


BLOCK_BYTES = 1 << 20


def _sha256(uri: str) -> str:
    system, name = arrow_fs.FileSystem.from_uri(_local_uri(uri))
    sha = hashlib.sha256()
    with system.open_input_stream(name) as stream:
        while block := stream.read(BLOCK_BYTES):
            sha.update(block)
    return sha.hexdigest()


def _local_uri(uri: str) -> str:
    """``file:/x`` as ``file:///x``, which is how Arrow spells it."""
    return "file:///" + uri[len("file:"):].lstrip("/") if uri.startswith("file:") else uri


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Overwrite a Parquet table and return it read back, which ends its lineage."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Replace the partitions that ``df`` has rows for; all others stay as they are."""
    ordered = df.repartition(*columns).sortWithinPartitions(*columns)
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def _edge_partition(spark: SparkSession, path: str, columns: tuple[str, ...], pick) -> tuple[int, ...]:
    values = []
    for column in columns:
        fs, where = _file_system(spark, path)
        names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
        values.append(pick(int(n.split("=", 1)[1]) for n in names if n.startswith(f"{column}=")))
        path = f"{path}/{column}={values[-1]}"
    return tuple(values)


def newest_partition(spark: SparkSession, path: str, *columns: str) -> tuple[int, ...]:
    """The greatest values of whole-number partition columns, from folder names alone."""
    return _edge_partition(spark, path, columns, max)


def oldest_partition(spark: SparkSession, path: str, *columns: str) -> tuple[int, ...]:
    return _edge_partition(spark, path, columns, min)


def reload_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """Stored table if its write completed, else build, store and reload it."""
    if path_exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path)
    return write_table(build(), path)


def write_report(df: DataFrame, path: str, mode: str = "append", partition_by: str | None = None) -> None:
    """JSON report rows (run log, quality report, metrics, experiment registry)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.json(path)


def replace_report(df: DataFrame, path: str, key: str = "experiment_id") -> None:
    """Store report rows under their key: those of an earlier run with the same key are replaced."""
    spread = df.repartition(key).sortWithinPartitions(key)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def read_report(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.json(path) if path_exists(spark, path) else None


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)
