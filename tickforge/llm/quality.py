"""Quality rules: counts on each text, and a hashed n-gram likelihood ratio, in DataFrame functions only.

Two multinomials over hashed words and word bigrams are counted, one over the trusted
documents and one over all; a document's score is the mean log ratio of these n-grams
(length-normalised). The threshold lies a fixed number of standard deviations below the
trusted mean, both taken over all trusted documents.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.llm.scratch import Scratch

WS = "\x20\x09\x0a\x0b\x0c\x0d"
BUCKETS = 1 << 14
DEVIATIONS = 4.0
SMOOTH = 1.0
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def bucketed() -> Column:
    """The buckets of the words, then of the word bigrams, from the words' hashes h."""
    m = F.greatest(F.size("h") - 1, F.lit(0))
    follow = F.zip_with(F.slice("h", F.lit(1), m), F.slice("h", F.lit(2), m), lambda a, b: F.xxhash64(a, b))
    return F.transform(F.concat("h", follow), lambda x: x.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("short"))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, and the bucket of each word and word bigram, for every document in one pass over its whole text.

    Repeated words: the hashes of all 3-word windows are sorted, equal neighbours
    are the repeated windows, and the gaps between their places (3 at most) add up
    to the words that they cover. Every array that a lambda looks into is a column.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", words_of(F.col("text")).alias("words"), F.translate(text, WS, "").alias("solid"), F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    d = d.select(
        "doc_id", F.transform("words", lambda w: F.xxhash64(w)).alias("h"), F.length("solid").alias("word_chars"),
        (F.length("solid") - F.length(F.translate("solid", "#*$%&|<>", ""))).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
    )
    m = F.greatest(F.size("h") - 2, F.lit(0))
    zipped = F.arrays_zip(F.slice("h", F.lit(1), m).alias("a"), F.slice("h", F.lit(2), m).alias("b"), F.slice("h", F.lit(3), m).alias("c"))
    windows = F.when(F.size("h") >= 3, F.transform(zipped, lambda z: F.xxhash64(z))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("t", windows).withColumn("s", F.sort_array("t"))
    twice = F.exists(F.zip_with(F.slice("s", F.lit(2), m), F.slice("s", F.lit(1), F.greatest(m - 1, F.lit(0))), lambda a, b: a == b), lambda x: x)
    d = d.withColumn("s2", F.when(twice, F.sort_array(F.transform("t", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, i: (x["h"] == F.get("s2", i - 1)["h"]) | (x["h"] == F.get("s2", i + 1)["h"])
    d = d.withColumn("p", F.sort_array(F.transform(F.filter("s2", same), lambda x: x["i"])))
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return d.select(
        "doc_id", F.size("h").cast("long").alias("n_words"), *(F.col(c).cast("long").alias(c) for c in COUNTS[1:4]),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        bucketed().alias("buckets"),
    )


def quality(docs: DataFrame, labels: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """doc_id, the counts, score, base_failed and kept for every document.

    labels: (doc_id, quality, toxic); trusted documents are those labelled
    quality 1 and never toxic. Null labels don't count. A null or empty text has no
    words, fails the base rules and scores null. Without any trusted document
    the base rules alone decide. Repeated rows are judged each; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    docs = docs.select("doc_id", "text")
    # buckets are made from the text twice: a table of them would be as large as the input
    hashed = docs.select("doc_id", words_of(F.col("text")).alias("words")).select("doc_id", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    trusted = labels.groupBy("doc_id").agg(F.max("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("x")).where("q = 1 AND x = 0").select(F.col("doc_id").alias("trusted_id")).hint("merge")
    by_doc = hashed.select("doc_id", bucketed().alias("buckets")).join(trusted, F.col("doc_id") == F.col("trusted_id"), "left")
    counted = by_doc.select(F.col("trusted_id").isNotNull().cast("long").alias("is"), F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("is").alias("target"))
    found = {r["bucket"]: (r["raw"], r["target"]) for r in counted.collect()}  # BUCKETS rows at most
    raw, target = (sum(v[k] for v in found.values()) + SMOOTH * BUCKETS for k in (0, 1))
    ratios = [math.log((found.get(b, (0, 0))[1] + SMOOTH) / target) - math.log((found.get(b, (0, 0))[0] + SMOOTH) / raw) for b in range(BUCKETS)]
    literal = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    total = F.aggregate("buckets", F.lit(0.0), lambda a, b: a + F.get(literal, b.cast("int")))
    score = F.when(F.col("n_words") > 0, F.round(total / F.size("buckets"), 9))
    scratch.drop()
    scored = scratch.save(features(docs).select("doc_id", *COUNTS, score.alias("score")), "scored")
    at = scored.join(trusted, F.col("doc_id") == F.col("trusted_id"), "left_semi").agg(F.avg("score"), F.stddev_pop("score")).first()
    least = round(at[0] - deviations * at[1], 6) if at[0] is not None else float("-inf")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.coalesce("score", F.lit(0.0)) >= least))


def quality_query(spark, sf_dir: str) -> DataFrame:
    """op6 over all documents, trusting those that labels names good and not toxic."""
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "score")
