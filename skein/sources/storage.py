"""Shared storage for results that loops reuse: written tables survive lost executors and cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, a local session gets one of its own and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a shared folder")
        found = f"file://{tempfile.gettempdir()}/skein_checkpoints"  # one machine: its own folder is shared
    return found.rstrip("/")


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """`df`, written to the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{label}_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """`df` over all cores by the hash of these columns: a table of few bytes is one split, but its rows may each take a core's time."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)
