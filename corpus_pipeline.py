"""The corpus pipeline: language ID, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame; run() writes it as Parquet and reads it again as the next stage's docs. All stages but the
last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veritally.llm import decontaminate, jaccard, language, packing, substring
from veritally.llm.common import staged, table
from veritally.llm.tokens import vocabulary

#: A text counts as none of the languages if its best one has less than so many times the even share
#: 1 / languages, which is the score of a text that says nothing about any.
MIN_LANGUAGE_LIFT = 1.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or text, and those that are like no language of the corpus.

    The classifier learns from the rows that have a language. Of one language there is nothing to tell
    apart, so only documents without letters go. Rows are otherwise unchanged.
    """
    names = docs.columns
    model = language.fit(docs)
    known = language.predict(docs, model, F.struct(*names))
    if not model.languages:  # nothing to learn from: only texts without letters go
        return docs.where(F.col("text").rlike(r"\p{L}"))
    least = MIN_LANGUAGE_LIFT / len(model.languages) if len(model.languages) > 1 else 0.0
    return known.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= least)).select("id.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by five-word shingles at 0.8.

    Of rows with one id the one with the smallest text hash stays; rows with a null id all stay.
    """
    names = docs.columns
    groups = jaccard.jaccard_components(docs, k=5, percent=80)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").join(first, "doc_id", "left_semi")
    rows = kept.select("doc_id", F.struct(F.xxhash64("text").alias("hash"), F.struct(*names).alias("row")).alias("best"))
    one = rows.groupBy("doc_id").agg(F.min("best").alias("best"))
    return one.select("best.row.*").unionByName(docs.where("doc_id is null"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words covered by 13-word windows that start in a document with a smaller id too.

    n_chars follows the new text. A document of which nothing is left goes.
    """
    names = docs.columns
    place = {c: f"column{i}" for i, c in enumerate(names) if c != "text"}  # whatever they are called
    rows = docs.select(F.col("doc_id"), F.col("text"), *[F.col(f"`{c}`").alias(p) for c, p in place.items()])
    out = substring.substring_dedup(rows, window=13, carry=tuple(place.values()))
    out = out.where("n_words = 0 or n_removed < n_words")
    length = F.when(F.col("n_removed") > 0, F.char_length("cut").cast("long")).otherwise(F.col(f"carried.{place['n_chars']}"))
    value = {"text": F.col("cut"), "n_chars": length}
    return out.select(*[(value[c] if c in value else F.col(f"carried.{place[c]}")).alias(c) for c in names])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a whole or edited benchmark item, whatever their id.

    What a text holds does not depend on its row, so rows are known by the hash of their text.
    """
    keyed = docs.select(F.xxhash64("text").alias("text_key"), "text", F.struct(*docs.columns).alias("row"))
    leaks = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="text_key").select(F.col("doc_id").alias("text_key")).distinct()
    return keyed.join(leaks, "text_key", "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens; a row per piece."""
    return packing.best_fit_pack(docs, vocabulary("word_bpe_49k.json"), capacity=4096)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: Kernels, exact alignment and packing are beyond SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
