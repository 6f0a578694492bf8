"""Intermediate tables that outlive executors, and connected components over them.

Lineage is cut by writing Parquet below the shared folder that the session names
in spark.checkpoint.dir (a local one only where that is unset, as in tests).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a narrow side up to which it is broadcast; beyond, it is shuffled.
SMALL = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only a local session without one may use the machine's own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/scratch"
    return root.rstrip("/")


def small(df: DataFrame) -> DataFrame:
    """df, a table of a few short columns, with a hint: broadcast up to SMALL rows, a sorted merge beyond."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df.hint("merge")


class Scratch:
    """Tables of one operator call; drop() removes those that are used up."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")
        self.spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner delete shuffle files that nothing refers to

    def _remove(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is not None:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def components(scratch: Scratch, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps: hubs are joined, never
    collected, and each pass writes its edges. Nodes without edges and self-links
    are absent; an empty input gives an empty result.
    """
    tag = uuid.uuid4().hex[:8]
    now = scratch.save(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"cc-{tag}-0"
    )
    for k in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        after = scratch.save(small, f"cc-{tag}-{k}")
        # a star forest has no node on both sides, so it stays as it is
        chained = after.select("a").join(after.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()
        several = after.groupBy("a").count().where("count > 1").limit(1).count()
        scratch.drop(f"cc-{tag}-{k - 1}")
        now = after
        if not chained and not several:
            break
    else:
        raise RuntimeError("components have not settled")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
