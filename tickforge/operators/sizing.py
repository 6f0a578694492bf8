"""Bet sizing: probability to size, averaging of active bets, discretising."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.normal import cdf_column
from tickforge.functions.windows import DAY_US, running


def prob_to_size(p: Column, pred: Column | None = None, classes: int = 2) -> Column:
    """Size in [-1, 1] of a bet whose winning class has probability p."""
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    size = 2 * cdf_column((p - 1 / classes) / F.sqrt(p * (1 - p))) - 1
    return size if pred is None else size * pred


def avg_active_signals(signals: DataFrame) -> DataFrame:
    """(symbol, us, position) at every start and end: mean of the bets open there, from start up to, not at, the end; 0 without any.

    signals: (symbol, us, t1, signal), an open end being null. Signals are added as
    decimals of 18 places, so a bet that closes leaves nothing behind, whatever the order.
    """
    exact = F.col("signal").cast("double").cast("decimal(38,18)")
    start = signals.select("symbol", "us", exact.alias("v"), F.lit(1).alias("n"))
    end = signals.where("t1 IS NOT NULL").select("symbol", F.col("t1").alias("us"), -exact, F.lit(-1))
    step = start.union(end).groupBy("symbol", "us").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    ranked = step.withColumn("_at", F.col("us"))
    blocks = running(ranked, "_at", {"_v": "v", "_n": "n"}, DAY_US)
    return blocks.select("symbol", "us", F.when(F.col("_n") == 0, 0.0).otherwise(F.col("_v").cast("double") / F.col("_n")).alias("position"))


def discrete_signal(signal: Column, step: float) -> Column:
    """Rounded half-even to a grid, within [-1, 1]; a step of 0 or less only clips."""
    out = F.rint(signal / step) * step if step > 0 else signal
    return F.greatest(F.least(out, F.lit(1.0)), F.lit(-1.0))


def get_signal(events: DataFrame, classes: int = 2, step: float = 0.0, average: bool = True) -> DataFrame:
    """(symbol, us, position) from events (symbol, us, t1, p[, pred][, side]). No events give no rows."""
    size = prob_to_size(F.col("p"), F.col("pred") if "pred" in events.columns else None, classes)
    s = events.select("symbol", "us", "t1", (size * F.col("side") if "side" in events.columns else size).alias("signal"))
    out = avg_active_signals(s) if average else s.select("symbol", "us", F.col("signal").alias("position"))
    return out.withColumn("position", discrete_signal(F.col("position"), step))


def implied_precision(stop: float, profit: float, freq: float, target: float) -> float:
    """The precision that a strategy needs for a Sharpe ratio; NaN if none does."""
    gap = profit - stop
    a = (freq + target**2) * gap**2
    b = (2 * freq * stop - target**2 * gap) * gap
    c = freq * stop**2
    disc = b * b - 4 * a * c
    return (-b + math.sqrt(disc)) / (2 * a) if disc >= 0 else float("nan")
