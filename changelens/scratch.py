"""Shared scratch space: reliable checkpoints and interchange files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settled tables hold many hexadecimal ids, which the default compression leaves as they are.
COMPRESSION = "zstd"


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    A session that names none gets a fresh local folder if all of it runs in one
    process on one machine; elsewhere that is an error, since executors would
    not see each other's files.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    in_use = context.getCheckpointDir()
    if in_use is None and not configured and not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if in_use is None:
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="changelens-"))
        in_use = context.getCheckpointDir()
    return (configured or in_use).rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def settle_at(df: DataFrame) -> str:
    """Write ``df`` as a Parquet table in the shared folder and tell where."""
    path = fresh_path(df.sparkSession, "settled")
    df.write.option("compression", COMPRESSION).parquet(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and go on from there.

    Cuts lineage like a reliable checkpoint; lost executors cost no
    recomputation, and later steps read only the columns they need.
    """
    return df.sparkSession.read.schema(df.schema).parquet(settle_at(df))


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in as many partitions as :func:`settle_by` has buckets, so that it is not shuffled again to be written there."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def settle_by(df: DataFrame, *keys: str) -> str:
    """Write ``df`` in the shared folder as a table bucketed by ``keys`` and tell its name.

    Joins and aggregates by these keys read it without a shuffle.  There are as many buckets as a shuffle has
    partitions, so that the other side of a join is dealt out likewise.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"settled_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    dealt.option("compression", COMPRESSION).option("path", fresh_path(spark, "settled")).saveAsTable(name, format="parquet")
    return name
