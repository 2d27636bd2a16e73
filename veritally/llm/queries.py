"""The registered queries: each applies its operator to the whole intended table."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritally.llm.alignment import alignment
from veritally.llm.common import table
from veritally.llm.registry import EXPECTED, QUERIES, query  # noqa: F401
from veritally.llm.decontaminate import contaminated
from veritally.llm.jaccard import jaccard_components
from veritally.llm.language import identify
from veritally.llm.licenses import license_labels
from veritally.llm.mainhtml import main_content
from veritally.llm.ngram import perplexity_scores
from veritally.llm.ordering import training_order
from veritally.llm.packing import best_fit_pack
from veritally.llm.privacy import personal_spans
from veritally.llm.quality import quality_verdicts
from veritally.llm.substring import substring_dedup
from veritally.llm.tokens import vocabulary
from veritally.llm.whitening import whitened


@query("op2_substring_dedup")
def op2(spark, sf_dir):
    out = substring_dedup(table(spark, sf_dir, "documents"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_best_fit_packing")
def op5(spark, sf_dir):
    return best_fit_pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096)


@query("op10_jaccard_join")
def op10(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


@query("op8_quality_rules")
def op8(spark, sf_dir):
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_ngram_scores")
def op1(spark, sf_dir):
    return perplexity_scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 != 2).drop("perplexity")


@query("op9_language_id")
def op9(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


@query("op6_decontamination")
def op6(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_license_scan")
def op3(spark, sf_dir):
    return license_labels(table(spark, sf_dir, "documents")).drop("spans")


@query("op7_main_text")
def op7(spark, sf_dir):
    return main_content(table(spark, sf_dir, "pages"))


@query("op4_training_order")
def op4(spark, sf_dir):
    return training_order(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op13_embedding_whitening")
def op13(spark, sf_dir):
    return whitened(table(spark, sf_dir, "embeddings"), components=16)


@query("op12_token_alignment")
def op12(spark, sf_dir):
    out = alignment(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return out.drop("a", "b", "times")


@query("op11_personal_data")
def op11(spark, sf_dir):
    out = personal_spans(table(spark, sf_dir, "documents"))
    return out.withColumn("base_spans", F.sha2("base_spans", 256)).withColumnRenamed("base_spans", "base_sha256")
