"""Results that several branches of one job read, written once to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of a query are removed at its end.
LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Where that is unset, a local session (tests on one machine) gets a temporary one; on a cluster
    it is an error, since executors could not see each other's files there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows as a parquet table in the shared folder: lineage is cut, lost executors do not
    matter, and every later branch reads only the columns it needs.

    What the job shuffled is let go as soon as the table is there.
    """
    path = fresh_path(df.sparkSession, name)
    written(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, path: str, mode: str = "error") -> None:
    """Writes the rows; the shuffle files of the job go at its end, not when the driver happens to collect garbage."""
    conf = df.sparkSession.conf
    before = conf.get(LET_GO, None)
    conf.set(LET_GO, "true")
    try:
        df.write.mode(mode).option("compression", "zstd").parquet(path)
    finally:
        conf.unset(LET_GO) if before is None else conf.set(LET_GO, before)
