"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Null texts and texts without a letter go in the first stage. A row with a null doc_id is never found by
another row or by a benchmark, so it stays. Rows that repeat a doc_id are judged by their own text, except
that a benchmark passage in one of them takes all. An empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm import decontaminate, jaccard, langid, linededup, packing
from tickforge.llm.scratch import Scratch

#: SQL can't express the stages' models and hashes; tests hold them against brute force.
ORACLE_SQL = None
#: Share of the likelihood that the best language needs.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, without text, or of no language that is at least half sure."""
    out = langid.language_id(docs, langid.vocabulary_path())
    return out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring template lines; a document of which no word is left goes. n_chars follows the text."""
    out = linededup.drop_lines(docs)
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5 words, 0.8), the document with the smallest id stays. Links are exact, so recall is whole at this threshold."""
    gone = jaccard.near_groups(docs, 5, 80, tag=True).where("component_id <> doc_id").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_tag")), "left_anti").select(*docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 1024 tokens."""
    return packing.pack(docs.select("doc_id", "text"), packing.tokenizer_path())


STAGES = [("language_id", language), ("line_dedup", lines), ("ngram_jaccard", near_duplicates), ("decontamination", benchmarks), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the last one's rows."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
