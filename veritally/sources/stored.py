"""Tables that stay: rows in buckets by a key, of which an update writes only those it touches.

A folder holds several tables under one key. An update writes the new rows of the touched buckets as
parquet folders of a new version, and then one manifest file that says for every table which version of
which bucket counts. Readers follow the newest manifest, so an update is there as a whole or not at all;
one that died leaves files that no manifest names, and the next update of the same version replaces them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


#: Rows of an update that a task writes, once there are more than the usual number of tasks would hold.
TASK_ROWS = 20_000


class StoredTables:
    """Tables of one folder, cut into `buckets` by the hash of their key column.

    The number of buckets belongs to the folder: open it with the same one. Each should hold what a few
    tasks write in one go; a large bucket is written by several tasks.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets

    def bucket(self, key: Column | str | None = None) -> Column:
        return F.pmod(F.xxhash64(self.key if key is None else key), F.lit(self.buckets)).cast("int")

    def manifest(self) -> list[tuple[str, int, int]]:
        """(table, bucket, version) of what counts now, at most tables times buckets rows. Notes of an
        update stand as tables of their own, see commit()."""
        try:
            rows = self.spark.read.schema("name string, bucket int, version long, manifest long").parquet(f"{self.folder}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        newest = rows.agg(F.max("manifest")).first()[0]
        return [] if newest is None else [(r["name"], r["bucket"], r["version"]) for r in rows.where(F.col("manifest") == newest).collect()]

    def version(self) -> int:
        """Number of the newest update, 0 before the first."""
        return max((v for n, _, v in self.manifest() if n == "#update"), default=0)

    def note(self, name: str) -> int | None:
        return next((v for n, _, v in self.manifest() if n == f"#{name}"), None)

    def read(self, name: str, schema: str, only: list[int] | None = None) -> DataFrame:
        """The rows of a table as they are now, all or of some buckets."""
        paths = [f"{self.folder}/{name}/version={v}/bucket={b}" for n, b, v in self.manifest() if n == name and (only is None or b in set(only))]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*paths).select(*[f"`{c}`" for c in self.spark.createDataFrame([], schema).columns])

    def commit(self, tables: dict[str, DataFrame], touched: list[int], notes: dict[str, int] | None = None,
               finish: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> int:
        """Replaces the touched buckets of the tables by the given rows; returns the update's number.

        Rows must lie in touched buckets. `notes` are numbers to remember with the update; others stay.
        `finish` makes the rows of a table from the given ones where these have been dealt, all of a key
        in one task, so that what is large is not shuffled; the column `bucket` has to stay.
        """
        now = self.manifest()
        number = max((v for n, _, v in now if n == "#update"), default=0) + 1
        gone = {(n, b) for n in tables for b in touched}
        kept = [r for r in now if (r[0], r[1]) not in gone and r[0] != "#update" and r[0] not in {f"#{n}" for n in notes or {}}]
        for name, rows in tables.items():
            path = f"{self.folder}/{name}/version={number}"
            # ranges of (bucket, key): few buckets a task, and large buckets over several tasks
            many = -(-rows.count() // TASK_ROWS)
            tasks = [many] if many > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else []
            dealt = rows.withColumn("bucket", self.bucket()).repartitionByRange(*tasks, "bucket", self.key)
            dealt = (finish or {}).get(name, lambda d: d)(dealt)
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)
            there = self.spark.read.schema("bucket int").parquet(path).select("bucket").distinct().collect() if touched else []
            if not {r["bucket"] for r in there} <= set(touched):
                raise ValueError("rows outside the touched buckets")
            kept += [(name, r["bucket"], number) for r in there]
        kept += [(f"#{n}", 0, v) for n, v in (notes or {}).items()] + [("#update", 0, number)]
        # one file appears by one rename
        self.spark.createDataFrame(kept, "name string, bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/manifest={number}")
        return number
