"""Events and labels: volatility targets, CUSUM sampling, barriers, bins.

Close frames are (symbol, bar_seq, us, close) with gapless bar_seq; times are
epoch microseconds. Interval joins meet on blocks of bar_seq, never as nested loops.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.functions.windows import as_of, carried, rolling

#: Bars in a block of the interval join, about the span of a label.
SPAN = 64


def log_returns(bars: DataFrame) -> DataFrame:
    x = F.log(F.col("close").cast("double"))
    return rolling(bars, "bar_seq", 1, [lambda w: {"r": x - F.lag(x).over(w)}])


def horizon_returns(bars: DataFrame, horizon_us: int) -> DataFrame:
    """(symbol, bar_seq, us, ret): return since the last bar strictly before us - horizon; rows without one are left out."""
    close = F.col("close").cast("double")
    points = bars.select("symbol", (F.col("us") - horizon_us).alias("us"), F.col("us").alias("_us"), "bar_seq", close.alias("close"))
    base = as_of(points, bars.select("symbol", "us", close.alias("_from")), ["_from"], exact=False)
    return base.where("_from IS NOT NULL").select("symbol", "bar_seq", F.col("_us").alias("us"), (F.col("close") / F.col("_from") - 1).alias("ret"))


@dataclass
class EwmState:
    """Weighted sums of an adjusted, bias-corrected exponential standard deviation."""

    w: float = 0.0
    w2: float = 0.0
    x: float = 0.0
    x2: float = 0.0
    shift: float | None = None

    def step(self, value: float, keep: float) -> float | None:
        if self.shift is None:
            self.shift = value
        v = value - self.shift
        self.w, self.w2, self.x, self.x2 = self.w * keep + 1, self.w2 * keep * keep + 1, self.x * keep + v, self.x2 * keep + v * v
        rest = self.w * self.w - self.w2
        if rest <= 1e-12:
            return None
        mean = self.x / self.w
        return float(np.sqrt(max(self.x2 / self.w - mean * mean, 0.0) * self.w * self.w / rest))


def _by_symbol(df: DataFrame, order: str, step, start, schema: str) -> DataFrame:
    """Streams each symbol's rows in order through step(state, row) -> tuple or None; memory is one state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, state = None, None
        names = [c.split()[0] for c in schema.split(", ")]
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                if r.symbol != symbol:
                    symbol, state = r.symbol, start()
                got = step(state, r)
                if got is not None:
                    out.append(got)
            if out:
                yield pd.DataFrame(out, columns=names)

    return df.repartition("symbol").sortWithinPartitions("symbol", order).mapInPandas(run, schema)


def get_vol(bars: DataFrame, span: int = 100, horizon_us: int = 86_400_000_000) -> DataFrame:
    """(symbol, bar_seq, us, trgt): exponentially weighted deviation of horizon returns."""
    keep = 1 - 2 / (span + 1)

    def step(state: EwmState, r):
        return r.symbol, r.bar_seq, r.us, state.step(r.ret, keep)

    return _by_symbol(horizon_returns(bars, horizon_us), "bar_seq", step, EwmState, "symbol string, bar_seq long, us long, trgt double")


class Cusum:
    """Two running sums of log returns; the side that fires is reset. The same in batch and streaming."""

    def __init__(self):
        self.up = self.down = 0.0

    def step(self, r: float, h: float) -> bool:
        self.up, self.down = max(0.0, self.up + r), min(0.0, self.down + r)
        if self.down < -h:
            self.down = 0.0
            return True
        if self.up > h:
            self.up = 0.0
            return True
        return False


def cusum_filter(bars: DataFrame, h: float | DataFrame, backfill: bool = True) -> DataFrame:
    """(symbol, bar_seq, us) of events. h: a number, or (symbol, bar_seq, h) taken forward, and back at the start unless backfill is off."""
    r = log_returns(bars).where("r IS NOT NULL").select("symbol", "bar_seq", "us", "r")
    if isinstance(h, DataFrame):
        r = r.join(h.select("symbol", "bar_seq", F.col("h").cast("double").alias("_given")), ["symbol", "bar_seq"], "left")
        r = carried(r, "bar_seq", "h", F.col("_given")).drop("_given")
        first = h.where("h IS NOT NULL").groupBy("symbol").agg(F.min_by(F.col("h").cast("double"), "bar_seq").alias("_f"))
        r = r.join(first, "symbol").withColumn("h", F.coalesce("h", "_f") if backfill else F.col("h")).where("h IS NOT NULL").drop("_f")
    else:
        r = r.withColumn("h", F.lit(float(h)))

    def step(state: Cusum, row):
        return (row.symbol, row.bar_seq, row.us) if state.step(row.r, row.h) else None

    return _by_symbol(r, "bar_seq", step, Cusum, "symbol string, bar_seq long, us long")


def add_vertical_barrier(events: DataFrame, bars: DataFrame, holding_us: int) -> DataFrame:
    """events with t1, the first bar at or after us + holding; those past the end are dropped."""
    points = events.withColumn("_us", F.col("us")).withColumn("us", F.col("us") + holding_us)
    clock = bars.select("symbol", "us", F.col("us").alias("t1"))
    return as_of(points, clock, ["t1"], forward=True).where("t1 IS NOT NULL").withColumn("us", F.col("_us")).drop("_us")


def ordinal(events: DataFrame, bars: DataFrame, column: str, name: str, forward: bool) -> DataFrame:
    """events with the bar_seq at a time column: of the next bar at or after it, or of the last at or before."""
    points = events.withColumnRenamed("us", "_us").withColumn("us", F.col("_us" if column == "us" else column))
    out = as_of(points, bars.select("symbol", "us", F.col("bar_seq").alias(name)), [name], forward)
    return out.drop("us").withColumnRenamed("_us", "us")


def touches(bars: DataFrame, events: DataFrame, pt: float, sl: float) -> DataFrame:
    """events (symbol, us, t1, trgt, side) with pt_us and sl_us, the first times that each barrier is passed.

    The path runs over bars from us to t1 (the last bar, if null), ends included; a
    multiple of 0 or less disables its barrier.
    """
    ends = bars.groupBy("symbol").agg(F.max("us").alias("_end"))
    e = events.join(ends, "symbol").withColumn("_t1", F.coalesce("t1", "_end"))
    e = ordinal(ordinal(e, bars, "us", "_s", True), bars, "_t1", "_e", False)
    cut = e.select("symbol", "us", "trgt", "side", "_s", "_e", F.explode(F.sequence(F.floor(F.col("_s") / SPAN), F.floor(F.col("_e") / SPAN))).alias("_blk")).where("_e >= _s")
    path = bars.select("symbol", F.floor(F.col("bar_seq") / SPAN).alias("_blk"), "bar_seq", F.col("us").alias("_at"), F.col("close").cast("double").alias("_p"))
    start = e.join(bars.select("symbol", F.col("bar_seq").alias("_s"), F.col("close").cast("double").alias("_p0")), ["symbol", "_s"]).select("symbol", "us", "_p0")
    both = cut.join(start, ["symbol", "us"]).join(path, ["symbol", "_blk"]).where("bar_seq BETWEEN _s AND _e")
    move = (F.col("_p") / F.col("_p0") - 1) * F.col("side")
    up = F.when((F.lit(pt) > 0) & (move > pt * F.col("trgt")), F.col("_at"))
    down = F.when((F.lit(sl) > 0) & (move < -sl * F.col("trgt")), F.col("_at"))
    hit = both.groupBy("symbol", "us").agg(F.min(up).alias("pt_us"), F.min(down).alias("sl_us"))
    return events.join(hit, ["symbol", "us"], "left")


def get_events(bars: DataFrame, events: DataFrame, pt_sl: tuple[float, float], target: DataFrame, min_ret: float = 0.0, check: bool = False) -> DataFrame:
    """(symbol, us, t1, trgt[, side]): t1 is the earliest of the three barriers.

    events: (symbol, us[, t1][, side]); target: (symbol, us, trgt), kept above
    min_ret. Without a side both barriers take pt_sl[0]. check raises if nothing is left.
    """
    sided = "side" in events.columns
    e = events if "t1" in events.columns else events.withColumn("t1", F.lit(None).cast("long"))
    e = e.select("symbol", "us", "t1", *(["side"] if sided else [F.lit(1.0).alias("side")])).join(target.select("symbol", "us", "trgt"), ["symbol", "us"])
    e = e.where(F.col("trgt") > min_ret)
    if check and not e.take(1):
        raise ValueError("no target is above min_ret")
    t = touches(bars, e, pt_sl[0], pt_sl[1] if sided else pt_sl[0])
    return t.select("symbol", "us", F.least("t1", "pt_us", "sl_us").alias("t1"), "trgt", *(["side"] if sided else []))


def get_bins(events: DataFrame, bars: DataFrame, min_ret: float = 0.0) -> DataFrame:
    """(symbol, us, ret, t1, trgt[, side], bin) of the events with an end; prices are those of the next bar at or after each time."""
    price = bars.select("symbol", "us", F.col("close").cast("double").alias("_px"))
    e = events.where("t1 IS NOT NULL")
    e = as_of(e, price, ["_px"], True).withColumnRenamed("_px", "_p0").withColumnRenamed("us", "_us").withColumn("us", F.col("t1"))
    e = as_of(e, price, ["_px"], True).drop("us").withColumnRenamed("_us", "us")
    ret = F.col("_px") / F.col("_p0") - 1
    if "side" in events.columns:
        e = e.withColumn("ret", ret * F.col("side")).withColumn("bin", F.when((F.col("ret") > min_ret) & (F.col("ret") > 0), 1).otherwise(0))
        return e.select("symbol", "us", "ret", "t1", "trgt", "side", "bin")
    e = e.withColumn("ret", ret).withColumn("bin", F.when(F.col("ret") < 0, -1).otherwise(1))
    return e.select("symbol", "us", "ret", "t1", "trgt", "bin")


def drop_labels(labels: DataFrame, min_pct: float = 0.05) -> DataFrame:
    """labels without the classes that are rarer than min_pct, dropped one by one while more than two are left."""
    counts = {r["bin"]: r["count"] for r in labels.groupBy("bin").count().collect()}  # a row for each class
    while len(counts) > 2:
        rare = min(counts, key=lambda b: (counts[b], b))
        if counts[rare] / sum(counts.values()) > min_pct:
            break
        del counts[rare]
    return labels.where(F.col("bin").isin(list(counts)))


def primary_side(events: DataFrame, features: DataFrame, column: str = "ofi_5") -> DataFrame:
    """events that have features, with side: the sign of a feature, zeros being +1."""
    f = features.select("symbol", "us", F.signum(F.col(column)).alias("_s"))
    return events.join(f, ["symbol", "us"]).withColumn("side", F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))).drop("_s")
