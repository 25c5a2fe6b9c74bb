"""The folder that driver and executors share, and frames settled there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, from ``spark.checkpoint.dir``.

    Where the setting is absent a single-process (local) session gets a folder of its
    own, since all its tasks see that disk; any other session must name one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith(("local[", "local")) or context.master.startswith("local-cluster"):
                raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
            folder = tempfile.mkdtemp(prefix="harbinger-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write a frame once to the shared folder and end its lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
