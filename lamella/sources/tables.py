"""Tables on shared storage: reading the provided ones, writing intermediate and cache tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share and a cluster must name; under /tmp where it is unset on a local master, as in tests."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """df from a table in the shared folder: its lineage ends there and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/lamella/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_ops(ops: DataFrame, path: str) -> None:
    """A commit appended to the log; revisions of a file are sorted, so that ranges prune row groups."""
    ops.sortWithinPartitions("revision", "seq").write.mode("append").parquet(path)


def compact(spark: SparkSession, source: str, target: str, partitions: int) -> None:
    """The log rewritten in fewer files, ranged by revision."""
    spark.read.parquet(source).repartitionByRange(partitions, "revision").sortWithinPartitions("revision", "seq").write.mode("overwrite").parquet(target)
