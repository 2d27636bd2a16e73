"""Helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from veritally.sources.stage import shared_folder


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def exchange_sizes(spark: SparkSession) -> tuple[int, int]:
    """Groups of documents and buckets of keys. Both follow the session's shuffle partitions,
    which whoever submits sets by the size of the data; results do not depend on them."""
    n = partitions(spark)
    return 4 * n, n


def bounded_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Lets a Python worker see at most so many rows at a time: rows hold whole texts, and Spark's
    own bound of 10,000 of them would not bound the memory of a worker. A lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows as a parquet table in the shared folder, read back: lineage is cut there."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
