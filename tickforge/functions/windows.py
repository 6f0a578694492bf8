"""Windows over tapes that split long symbols: rolling frames with a halo, running sums and carries by blocks.

A frame is ordered by a gapless `seq` (from 0 or 1) inside each symbol. Blocks of
`seq` are the unit of work, so one symbol with most of the rows still
spreads over many tasks; only block summaries meet in a window by symbol.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 1 << 16
#: The block of a time axis.
DAY_US = 86_400_000_000


def full(agg: Column, of: Column | str, w: WindowSpec, k: int) -> Column:
    """A rolling aggregate of k rows that is null until there are k values."""
    of = F.col(of) if isinstance(of, str) else of
    frame = w.rowsBetween(-(k - 1), 0)
    return F.when(F.count(of).over(frame) == k, agg.over(frame))


def block_of(seq: str, size: int) -> Column:
    return F.floor(F.col(seq) / size).cast("long")


def rolling(df: DataFrame, seq: str, halo: int, stages: list[Callable[[WindowSpec], dict[str, Column]]], size: int = BLOCK) -> DataFrame:
    """df with the columns of each stage, computed in blocks that also see the halo rows before them."""
    size = max(size, halo)
    last = F.floor((F.col(seq) + halo) / size).cast("long")
    out = df.withColumn("_own", block_of(seq, size)).withColumn("_blk", F.explode(F.sequence("_own", last)))
    w = Window.partitionBy("symbol", "_blk").orderBy(seq)
    for stage in stages:
        out = out.withColumns(stage(w))
    return out.where("_own = _blk").drop("_own", "_blk")


#: How running() aggregates, what it starts from, and how two results join.
HOW = {"sum": (F.sum, 0, lambda a, b: a + b), "product": (F.product, 1, lambda a, b: a * b), "max": (F.max, None, F.greatest)}


def running(df: DataFrame, seq: str, sums: dict[str, Column | str], size: int = BLOCK, how: str = "sum") -> DataFrame:
    """df with running sums (products, maxima), the own row included: of blocks, of the blocks before, then inside blocks."""
    agg, none, join = HOW[how]
    cols = {k: F.col(v) if isinstance(v, str) else v for k, v in sums.items()}
    df = df.withColumn("_blk", block_of(seq, size))
    before = Window.partitionBy("symbol").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    heads = df.groupBy("symbol", "_blk").agg(*(agg(c).alias(k) for k, c in cols.items()))
    heads = heads.select("symbol", "_blk", *(F.coalesce(agg(F.col(k)).over(before), F.lit(none)).alias(f"_{k}") for k in cols))
    w = Window.partitionBy("symbol", "_blk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(heads, ["symbol", "_blk"])
    return out.withColumns({k: join(F.coalesce(agg(c).over(w), F.lit(none)), F.col(f"_{k}")) for k, c in cols.items()}).drop("_blk", *(f"_{k}" for k in cols))


def carried(df: DataFrame, seq: str, name: str, value: Column, size: int = BLOCK, strict: bool = False) -> DataFrame:
    """df with the last non-null value up to each row (before it, if strict)."""
    df = df.withColumn("_v", value).withColumn("_blk", block_of(seq, size))
    heads = df.where("_v IS NOT NULL").groupBy("symbol", "_blk").agg(F.max_by("_v", seq).alias("_l"))
    every = df.select("symbol", "_blk").distinct().join(heads, ["symbol", "_blk"], "left")
    before = Window.partitionBy("symbol").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    every = every.select("symbol", "_blk", F.last("_l", True).over(before).alias("_h"))
    w = Window.partitionBy("symbol", "_blk").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    return df.join(every, ["symbol", "_blk"]).withColumn(name, F.coalesce(F.last("_v", True).over(w), F.col("_h"))).drop("_v", "_blk", "_h")


def numbered(df: DataFrame, name: str, order: list[str], bucket: Column, start: int = 1) -> DataFrame:
    """df with a gapless number by symbol in this order. bucket must not decrease along the order; it is what spreads a symbol."""
    df = df.withColumn("_bk", bucket)
    before = Window.partitionBy("symbol").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    heads = df.groupBy("symbol", "_bk").count().select("symbol", "_bk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_n"))
    rank = F.row_number().over(Window.partitionBy("symbol", "_bk").orderBy(*order))
    return df.join(heads, ["symbol", "_bk"]).withColumn(name, (rank + F.col("_n") + (start - 1)).cast("long")).drop("_bk", "_n")


def as_of(points: DataFrame, clock: DataFrame, value: list[str], forward: bool = False, exact: bool = True, size: int = DAY_US) -> DataFrame:
    """points (symbol, us, ...) with the clock's columns at the nearest us before (or after) them.

    Both sides meet in ordered blocks of time; what no block has inside comes from the
    nearest block that has a clock row. Ties count only if exact. Unmatched points get nulls.
    """
    whole = F.struct(*value)
    c = clock.select("symbol", "us", *value).withColumn("_blk", block_of("us", size))
    heads = c.groupBy("symbol", "_blk").agg((F.min_by if forward else F.max_by)(whole, F.col("us")).alias("_l"))
    every = points.select("symbol", block_of("us", size).alias("_blk")).distinct().join(heads, ["symbol", "_blk"], "full")
    edge = Window.partitionBy("symbol").orderBy(F.col("_blk").desc() if forward else F.col("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    every = every.select("symbol", "_blk", F.last("_l", True).over(edge).alias("_h"))
    a = points.withColumns({f"_c_{c}": F.lit(None).cast(clock.schema[c].dataType) for c in value}).withColumn("_p", F.lit(True))
    rest = [c for c in points.columns if c not in ("symbol", "us")]
    b = clock.select("symbol", "us", *(F.lit(None).cast(points.schema[c].dataType).alias(c) for c in rest), *(F.col(c).alias(f"_c_{c}") for c in value), F.lit(False).alias("_p"))
    order = [F.col("us").desc() if forward else F.col("us").asc(), F.col("_p").asc() if exact else F.col("_p").desc()]
    w = Window.partitionBy("symbol", "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_blk", block_of("us", size))
    inside = F.last(F.when(~F.col("_p"), F.struct(*(F.col(f"_c_{c}").alias(c) for c in value))), True).over(w)
    both = both.withColumn("_in", inside).where("_p").join(every, ["symbol", "_blk"])
    found = F.coalesce("_in", "_h")
    return both.withColumns({c: found[c] for c in value}).drop("_p", "_blk", "_in", "_h", *(f"_c_{c}" for c in value))
