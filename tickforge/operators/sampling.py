"""Concurrency, uniqueness, bootstrap and weights of overlapping labels.

Labels are (symbol, us, t1) with times on the bar clock. Counts are a sweep over
starts and ends; means over a label's span are differences of prefix sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.windows import DAY_US, block_of, numbered, running
from tickforge.operators.labeling import log_returns, ordinal


def spans(labels: DataFrame, bars: DataFrame) -> DataFrame:
    """labels with s and e, the bar_seq of start and end; an open end is the last bar."""
    last = bars.groupBy("symbol").agg(F.max("us").alias("_end"))
    e = labels.join(last, "symbol").withColumn("_t1", F.coalesce("t1", "_end"))
    return ordinal(ordinal(e, bars, "us", "s", True), bars, "_t1", "e", False).drop("_end", "_t1")


def num_co_events(labels: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, bar_seq, us, c): labels whose closed span holds the bar, 0 if none."""
    s = spans(labels, bars)
    edges = s.select("symbol", F.col("s").alias("bar_seq"), F.lit(1).alias("d")).unionByName(s.select("symbol", (F.col("e") + 1).alias("bar_seq"), F.lit(-1).alias("d")))
    step = edges.groupBy("symbol", "bar_seq").agg(F.sum("d").alias("d"))
    b = bars.select("symbol", "bar_seq", "us").join(step, ["symbol", "bar_seq"], "left")
    return running(b, "bar_seq", {"c": F.coalesce("d", F.lit(0))}).select("symbol", "bar_seq", "us", "c")


def _over_span(s: DataFrame, values: DataFrame, value: Column) -> DataFrame:
    """s with total, the sum of a value over bars s..e. values: (symbol, bar_seq, ...)."""
    # decimals: differences of long sums lose no digits
    exact = F.coalesce(value.cast("decimal(38,18)"), F.lit(0).cast("decimal(38,18)"))
    p = running(values.withColumn("_v", exact), "bar_seq", {"_sum": "_v"}).select("symbol", "bar_seq", "_sum", "_v")
    ends = p.select("symbol", F.col("bar_seq").alias("e"), F.col("_sum").alias("_hi"))
    starts = p.select("symbol", F.col("bar_seq").alias("s"), (F.col("_sum") - F.col("_v")).alias("_lo"))
    return s.join(ends, ["symbol", "e"]).join(starts, ["symbol", "s"]).withColumn("total", (F.col("_hi") - F.col("_lo")).cast("double")).drop("_hi", "_lo")


def avg_uniqueness(labels: DataFrame, bars: DataFrame, co: DataFrame | None = None) -> DataFrame:
    """(symbol, us, t1, tW): mean of 1/concurrency over each label's span."""
    co = num_co_events(labels, bars) if co is None else co
    t = _over_span(spans(labels, bars), co.select("symbol", "bar_seq", "c"), F.when(F.col("c") > 0, 1.0 / F.col("c")))
    return t.select("symbol", "us", "t1", (F.col("total") / (F.col("e") - F.col("s") + 1)).alias("tW"))


def indicator(labels: DataFrame, bars: DataFrame) -> DataFrame:
    """The label-by-bar indicator in long form: (symbol, us, bar_seq)."""
    return spans(labels, bars).select("symbol", "us", F.explode(F.sequence("s", "e")).alias("bar_seq"))


def indicator_uniqueness(ind: DataFrame) -> DataFrame:
    """(symbol, us, tW) from the long indicator."""
    c = ind.groupBy("symbol", "bar_seq").agg(F.count("*").alias("c"))
    return ind.join(c, ["symbol", "bar_seq"]).groupBy("symbol", "us").agg(F.avg(1.0 / F.col("c")).alias("tW"))


def draw_reference(start: np.ndarray, end: np.ndarray, n_bars: int, length: int, rng: np.random.Generator) -> np.ndarray:
    """Sequential bootstrap by its definition, one indicator row after the other; for tests."""
    ind = np.array([(np.arange(n_bars) >= a) & (np.arange(n_bars) <= b) for a, b in zip(start, end, strict=True)])
    taken: list[int] = []
    for _ in range(length):
        c = ind[taken].sum(0) if taken else np.zeros(n_bars)
        u = np.array([(1 / (c[row] + 1)).mean() for row in ind])
        taken.append(int(rng.choice(len(ind), p=u / u.sum())))
    return np.array(taken)


def draw(start: np.ndarray, end: np.ndarray, n_bars: int, length: int, rng: np.random.Generator) -> np.ndarray:
    """Sequential bootstrap that keeps every label's mean uniqueness: a draw changes those that overlap the drawn span, by what its bars lose.

    Labels are visited in order of their start. No label that ends before the span is
    behind the first one whose furthest end so far reaches it.
    """
    by = np.argsort(start, kind="stable")
    lo, hi = start[by], end[by]
    furthest = np.maximum.accumulate(hi)
    taken = np.zeros(n_bars, np.int64)
    uniqueness = np.ones(len(by))
    picks = []
    back = np.argsort(by)
    while len(picks) < length:
        mass = np.cumsum(uniqueness[back])
        label = int(np.searchsorted(mass, rng.random() * mass[-1], "right"))
        picks.append(label)
        a, b = int(start[label]), int(end[label]) + 1
        now = taken[a:b] + 1
        lost = np.concatenate([[0.0], np.cumsum(1 / now - 1 / (now + 1))])
        taken[a:b] = now
        near = slice(int(np.searchsorted(furthest, a)), int(np.searchsorted(lo, b)))
        left, right = np.maximum(lo[near], a) - a, np.minimum(hi[near] + 1, b) - a
        share = lost[np.maximum(right, left)] - lost[left]
        uniqueness[near] -= share / (hi[near] + 1 - lo[near])
    return np.array(picks, np.int64)


def seq_bootstrap(labels: DataFrame, bars: DataFrame, seeds: list[int], length: int | None = None, method: str = "fast") -> DataFrame:
    """(symbol, seed, draw, us): draws for each seed, bags in parallel. A bag needs its symbol's spans in one task."""
    if method not in ("fast", "reference"):
        raise ValueError(f"unknown method: {method}")
    s = spans(labels, bars).select("symbol", "us", "s", "e").withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    pick = draw if method == "fast" else draw_reference

    def bag(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("us")
        low = rows["s"].min()
        got = pick((rows["s"] - low).to_numpy(), (rows["e"] - low).to_numpy(), int(rows["e"].max() - low + 1), length or len(rows), np.random.default_rng(int(key[1])))
        return pd.DataFrame({"symbol": key[0], "seed": key[1], "draw": np.arange(len(got)), "us": rows["us"].to_numpy()[got]})

    return s.groupBy("symbol", "seed").applyInPandas(bag, "symbol string, seed long, draw long, us long")


def sample_weights(labels: DataFrame, bars: DataFrame, co: DataFrame | None = None, normalise: bool = True) -> DataFrame:
    """(symbol, us, t1, w): absolute sum of log return over concurrency, the return into the first bar included; mean 1 if normalised."""
    co = num_co_events(labels, bars) if co is None else co
    v = log_returns(bars).select("symbol", "bar_seq", "r").join(co.select("symbol", "bar_seq", "c"), ["symbol", "bar_seq"])
    t = _over_span(spans(labels, bars), v, F.when(F.col("c") > 0, F.col("r") / F.col("c")))
    w = t.select("symbol", "us", "t1", F.abs("total").alias("w"))
    return scaled(w, "w") if normalise else w


def scaled(df: DataFrame, column: str) -> DataFrame:
    """df with a column scaled to mean 1 by symbol."""
    total = df.groupBy("symbol").agg((F.count("*") / F.sum(column)).alias("_k"))
    return df.join(total, "symbol").withColumn(column, F.col(column) * F.col("_k")).drop("_k")


def time_decay(uniqueness: DataFrame, last_w: float = 1.0) -> DataFrame:
    """(symbol, us, w): linear in cumulative uniqueness; the newest has 1, the oldest last_w; negative last_w erases the oldest share."""
    if last_w <= -1:
        raise ValueError("last_w must be above -1")
    t = numbered(uniqueness, "_rank", ["us"], block_of("us", DAY_US)).withColumnRenamed("us", "_us")
    t = running(t, "_rank", {"_cum": "tW"}).withColumnRenamed("_us", "us")
    total = uniqueness.groupBy("symbol").agg(F.sum("tW").alias("_c"))
    slope = (1 - last_w) / F.col("_c") if last_w >= 0 else 1 / ((last_w + 1) * F.col("_c"))
    decay = F.greatest(F.lit(0.0), 1 - slope * F.col("_c") + slope * F.col("_cum"))
    return t.join(total, "symbol").select("symbol", "us", decay.alias("w"))


def combined_weights(weights: DataFrame, decay: DataFrame) -> DataFrame:
    """Return weights times decay, scaled to mean 1."""
    both = weights.select("symbol", "us", F.col("w").alias("_a")).join(decay, ["symbol", "us"])
    return scaled(both.select("symbol", "us", (F.col("_a") * F.col("w")).alias("w")), "w")
