"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Fixed masks pick some words of each short window, so a substituted word at an
ignored place doesn't hide a passage. Seeds of documents and of benchmark items
meet in a join; each diagonal that is hit is verified by aligning the item's
words with the document's and looking for a window with enough equal words.

The masks find every way to substitute 3 of 13 words (286 of 286), and every way to
substitute one word of an item of 8 to 12. Items of 5 to 7 words are found by masks without
ignored places, as they have to agree in whole; shorter ones are no evidence and match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.llm.quality import words_of
from tickforge.llm.scratch import Scratch, small

#: 1: the word counts; 0: it may differ.
MASKS = ("111011", "110111", "1100001011")
WINDOW, SHARE = 13, 75
#: Words of the shortest item, and of the shortest in which a word may differ.
SHORTEST, TOLERANT = 5, 8


def hashed(text: Column) -> Column:
    return F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, key: str, masks: list[str]) -> DataFrame:
    """(key, place, seed) of every window; rows: (key, h). All masks look at the same hashes."""
    none = F.array().cast("array<struct<place:int,seed:bigint>>")

    def under(mask: str) -> Column:
        picked = [k for k, c in enumerate(mask) if c == "1"]
        last = F.size("h") - len(mask)
        seed = lambda i: F.struct(i.alias("place"), F.xxhash64(F.lit(mask), *(F.get("h", i + k) for k in picked)).alias("seed"))
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), seed)).otherwise(none)

    out = rows.select(key, F.explode(F.concat(*map(under, masks))).alias("s"))
    return out.select(key, F.col("s.place").alias("place"), F.col("s.seed").alias("seed"))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """One row per contaminated document: doc_id, n_items, n_equal (most equal words in one window), item_ids (sorted).

    A document is contaminated if some item's words, aligned with its own, agree in
    at least share percent of some window of that many words. Of an item that is shorter, all words but
    one have to agree, and all if it has fewer than TOLERANT words; items of fewer than SHORTEST
    match nothing. Words are compared in lower case. Null and empty texts and items match nothing;
    rows of one doc_id are one document, found if any of its texts is; a row with a null doc_id is never found;
    other columns are ignored; an empty side gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    d = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    items = benchmark.where("text IS NOT NULL").select("item_id", hashed(F.col("text")).alias("h")).where(F.size("h") >= SHORTEST)
    items = scratch.save(items.dropDuplicates(), "items")
    lengths = [r[0] for r in items.where(F.size("h") < TOLERANT).select(F.size("h").alias("n")).distinct().collect()]  # a few numbers
    masks = [*MASKS, *("1" * n for n in sorted(lengths))]
    their = scratch.save(seeds(items, "item_id", masks).withColumnRenamed("place", "item_place").distinct(), "seeds")
    own = seeds(d.select("doc_id", hashed(F.col("text")).alias("h")), "doc_id", masks)
    hits = own.join(small(their), "seed").select("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    hits = scratch.save(hits, "hits")
    # only the texts that are hit are read into words again, each once
    wanted = hits.select("doc_id").distinct()
    words = d.join(small(wanted), "doc_id", "left_semi").select("doc_id", hashed(F.col("text")).alias("dw"))
    both = words.join(small(hits), "doc_id").join(small(items.withColumnRenamed("h", "iw")), "item_id")
    lead = F.greatest(-F.col("shift"), F.lit(0))
    opposite = F.slice("dw", F.greatest(F.col("shift"), F.lit(0)) + 1, F.greatest(F.size("iw") - lead, F.lit(0)))
    aligned = F.zip_with(F.slice("iw", lead + 1, F.size("iw")), opposite, lambda a, b: F.when(a == b, 1).otherwise(0))
    n = F.size("iw")
    least = F.when(n < TOLERANT, n).when(n < window, n - 1).otherwise(-(-window * share // 100))
    both = both.select("doc_id", "item_id", aligned.alias("eq"), F.least(F.lit(window), n).alias("w"), least.alias("least"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("eq") - F.col("w") + 1, F.lit(1)))
    best = F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice("eq", s, F.col("w")), F.lit(0), lambda a, x: a + x)))
    found = both.withColumn("n_equal", best).where(F.col("n_equal") >= F.col("least"))
    return found.groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.max("n_equal").alias("n_equal"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def decontamination_query(spark, sf_dir: str) -> DataFrame:
    """op9: the contaminated ones of all documents."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
