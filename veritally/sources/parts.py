"""Documents and paths: text files as parts, path sets, lists kept on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veritally.functions import fixed as X
from veritally.functions.text import base_name, document_kind, extension, strip
from veritally.sources.stage import staged
from veritally.sources.stored import StoredTables


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """Whole text files under folders and files: path, text; broken bytes are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    files = files.where(extension(F.col("path")).isin(*X.KIND_BY_EXTENSION["text"]))
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def parts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, parts) of files(doc_id, path, text): kind and error per file, one trimmed part."""
    kind = document_kind(F.col("path"))
    docs = files.select("doc_id", "path", kind.alias("kind"), F.when(kind.isNull(), X.UNSUPPORTED_ERROR).alias("error"))
    body = files.where(kind == "text").select(
        "doc_id", F.lit(0).alias("part_no"), F.lit(X.BODY_LABEL).alias("label"), strip(F.col("text")).alias("text"))
    return docs, body.where("text <> ''")


def normal_path(path: Column) -> Column:
    """One separator, no dot steps, no trailing separator."""
    p = F.regexp_replace(path, r"[\\/]+", "/")
    p = F.regexp_replace(p, r"(?<=/)(?:\./)+|/\.$", "")
    return F.when(p == "/", p).otherwise(F.rtrim(p, F.lit("/")))


def path_set(paths: DataFrame, folder_rule: bool = True) -> DataFrame:
    """Distinct supported paths with the ordinal they were first seen at: path, first_no."""
    name = base_name(F.col("path"))
    rows = paths.select(normal_path(F.col("path")).alias("path"), "ordinal")
    rows = rows.where(extension(F.col("path")).isin(*X.ARCHIVE_EXTENSIONS, "xls"))
    if folder_rule:
        rows = rows.where(~F.startswith(name, F.lit("~$")) & ~F.startswith(name, F.lit("_test")))
    return rows.groupBy("path").agg(F.min("ordinal").alias("first_no"))


def upsert_ignored(stored: DataFrame, added: DataFrame) -> DataFrame:
    """The ignore list after additions: raw, ordinal of its first appearance."""
    both = stored.select("raw", F.lit(0).alias("_s"), "ordinal").unionByName(
        added.select("raw", F.lit(1).alias("_s"), "ordinal"))
    return both.groupBy("raw").agg(F.min(F.struct("_s", "ordinal")).alias("_f")).select(
        "raw", (F.col("_f._s") == 0).alias("was_stored"), F.col("_f.ordinal").alias("ordinal"))


IGNORED_ROW = "raw string, added long, ordinal long"


def keep_ignored(store: StoredTables, added: DataFrame) -> int:
    """Appends values (raw, ordinal) that a kept ignore list does not have; returns how many.

    The list is the table `ignored` of a store keyed by `raw`, in the order of (added, ordinal): the
    update that brought a value, and its smallest ordinal there. Null values are not kept. Only buckets
    that get a value are written, and nothing if all are there.
    """
    new = added.where("raw is not null").groupBy("raw").agg(F.min("ordinal").cast("long").alias("ordinal"))
    new = new.join(store.read("ignored", IGNORED_ROW).select("raw"), "raw", "left_anti").withColumn("_b", store.bucket("raw"))
    new = staged(new, "ignored")
    touched = {r["_b"]: r["count"] for r in new.groupBy("_b").count().collect()}
    if touched:
        rows = new.select("raw", F.lit(store.version() + 1).cast("long").alias("added"), "ordinal")
        store.commit({"ignored": store.read("ignored", IGNORED_ROW, list(touched)).unionByName(rows)}, list(touched))
    return sum(touched.values())


def outdated(files: DataFrame, keys: list[str], keep: int = X.PREVIEWS_KEPT) -> DataFrame:
    """Files beyond the newest `keep` of each folder.

    Only the newest few of a folder are ranked (the rank filter runs before the shuffle); the
    rest is what is not among them.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("mtime"), F.desc("path"))
    newest = files.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).select("path")
    return files.join(newest, "path", "left_anti")


def merge_templates(values: DataFrame, templates: DataFrame, fields: list[str], key: str = "template_id") -> DataFrame:
    """Template text with every {{field}} replaced by the row's value, '' if missing."""
    text = F.col("template")
    for name in fields:
        text = F.replace(text, F.lit("{{" + name + "}}"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    return values.join(templates, key).withColumn("text", text).drop("template")
