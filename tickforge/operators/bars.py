"""Ticks to bars: the tick rule, standard bars in closed form, information-driven bars as a state machine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.windows import BLOCK, block_of, carried, numbered, running

BAR_COLUMNS = ["open", "high", "low", "close", "volume", "dollar", "n_ticks", "vwap", "buy_volume", "signed_dollar"]


def tick_rule(ticks: DataFrame, size: int = BLOCK) -> DataFrame:
    """ticks with `sign`: that of the price change; zeros inherit, the first is +1."""
    t = ticks.withColumn("_b", block_of("seq", size))
    ends = t.groupBy("symbol", "_b").agg(F.max_by("price", "seq").alias("_e"))
    ends = ends.select("symbol", (F.col("_b") + 1).alias("_b"), "_e")
    w = Window.partitionBy("symbol", "_b").orderBy("seq")
    t = t.join(ends, ["symbol", "_b"], "left").withColumn("_s", F.signum(F.col("price") - F.coalesce(F.lag("price").over(w), F.col("_e"))))
    moved = F.when(F.col("_s") != 0, F.col("_s").cast("int"))
    return carried(t.drop("_b", "_e"), "seq", "sign", moved, size).withColumn("sign", F.coalesce("sign", F.lit(1)).cast("int")).drop("_s")


def assemble(signed: DataFrame, key: str) -> DataFrame:
    """One bar for each (symbol, key), numbered bar_seq from 0 by its last tick; null keys are dropped."""
    g = signed.where(F.col(key).isNotNull()).groupBy("symbol", key).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"),
        F.sum("volume").alias("volume"), F.sum("dollar").alias("dollar"), F.count("*").alias("n_ticks"),
        F.sum(F.when(F.col("sign") > 0, F.col("volume")).otherwise(0)).alias("buy_volume"), F.sum(F.col("sign") * F.col("dollar")).alias("signed_dollar"),
        F.max("us").alias("us"), F.max("seq").alias("last_seq"), F.min("seq").alias("first_seq"),
    )
    g = g.withColumn("vwap", F.col("dollar") / F.col("volume")).withColumn("ts", F.timestamp_micros("us"))
    g = numbered(g, "bar_seq", ["last_seq"], block_of("last_seq", BLOCK * 64), 0)
    return g.select("symbol", "bar_seq", "ts", "us", *BAR_COLUMNS, "first_seq", "last_seq")


def bar_keys(ticks: DataFrame, threshold: float, kind: str) -> DataFrame:
    """ticks with `key`, the level at which each one's bar closes; null in the partial bar at the end."""
    weights = {"tick": F.lit(1), "volume": F.col("volume"), "dollar": F.col("dollar")}
    if kind not in weights:
        raise ValueError(f"unknown kind of bar: {kind}")
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    t = running(ticks.withColumn("_w", weights[kind]), "seq", {"_cum": "_w"})
    totals = ticks.groupBy("symbol").agg(F.floor(F.sum(weights[kind]) / threshold).alias("_levels"))
    key = F.floor((F.col("_cum") - F.col("_w")) / threshold)
    return t.join(totals, "symbol").withColumn("key", F.when(key < F.col("_levels"), key)).drop("_w", "_cum", "_levels")


def standard_bars(ticks: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Bars that close when a running total passes the next multiple of the threshold.

    A tick that passes several levels closes one bar. Symbols that never reach the
    threshold have none; raise_if_empty() turns a wholly empty result into an error.
    """
    return assemble(bar_keys(tick_rule(ticks), threshold, kind), "key")


def raise_if_empty(bars: DataFrame) -> DataFrame:
    if not bars.take(1):
        raise ValueError("the threshold is larger than the whole tape")
    return bars


def tick_bars(ticks: DataFrame, threshold: float) -> DataFrame:
    return standard_bars(ticks, threshold, "tick")


def volume_bars(ticks: DataFrame, threshold: float) -> DataFrame:
    return standard_bars(ticks, threshold, "volume")


def dollar_bars(ticks: DataFrame, threshold: float) -> DataFrame:
    return standard_bars(ticks, threshold, "dollar")


@dataclass
class InfoState:
    """What an information-driven bar builder remembers between ticks; the same in batch and streaming."""

    n: int = 0
    plus: float = 0.0
    minus: float = 0.0
    length: float = 0.0
    buy: float | None = None
    sell: float | None = None
    p: float | None = None
    bars: int = 0


@dataclass(frozen=True)
class InfoRule:
    mode: str  # imbalance or run
    kind: str = "dollar"
    length_span: int = 100
    flow_span: int = 100
    warm_up: int = 500
    least: int = 1
    most: int | None = None
    max_bars: int | None = None

    def start(self) -> InfoState:
        return InfoState(length=float(self.warm_up))

    def step(self, s: InfoState, sign: int, weight: float) -> bool:
        """Takes in a tick; whether it closes the bar. A bar can't close before both sides were seen."""
        if self.max_bars is not None and s.bars >= self.max_bars:
            return False
        flow, pace = 2 / (self.flow_span + 1), 2 / (self.length_span + 1)
        ewma = lambda old, new, rate: new if old is None else old + rate * (new - old)
        s.n += 1
        if sign > 0:
            s.plus += weight
            s.buy = ewma(s.buy, weight, flow)
        else:
            s.minus += weight
            s.sell = ewma(s.sell, weight, flow)
        s.p = ewma(s.p, 1.0 if sign > 0 else 0.0, flow)
        if s.buy is None or s.sell is None or s.n < self.least:
            return False
        if self.mode == "imbalance":
            mean = s.p * s.buy + (1 - s.p) * s.sell
            reached = abs(s.plus - s.minus) >= s.length * abs(2 * s.p * s.buy - mean)
        else:
            reached = max(s.plus, s.minus) >= s.length * max(s.p * s.buy, (1 - s.p) * s.sell)
        if not reached and not (self.most is not None and s.n >= self.most):
            return False
        s.length = ewma(s.length, float(s.n), pace)
        s.length = max(s.length, float(self.least))
        if self.most is not None:
            s.length = min(s.length, float(self.most))
        s.n, s.plus, s.minus = 0, 0.0, 0.0
        s.bars += 1
        return True


def _weights(kind: str) -> Column:
    return {"tick": F.lit(1.0), "volume": F.col("volume").cast("double"), "dollar": F.col("dollar").cast("double")}[kind]


def information_keys(ticks: DataFrame, rule: InfoRule) -> DataFrame:
    """Signed ticks with `key`, the number of the bar; null after the last one closed. One symbol is one state machine."""
    signed = tick_rule(ticks).withColumn("_w", _weights(rule.kind))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, state = None, None
        for df in batches:
            closes = []
            for who, sign, weight in zip(df["symbol"], df["sign"].tolist(), df["_w"].tolist(), strict=True):
                if who != symbol:
                    symbol, state = who, rule.start()
                closes.append(rule.step(state, sign, weight))
            yield df.loc[closes, ["symbol", "seq"]]

    ordered = signed.select("symbol", "seq", "sign", "_w").repartition("symbol").sortWithinPartitions("symbol", "seq")
    closes = ordered.mapInPandas(run, "symbol string, seq long")
    # streamed by symbol in order; the ends come back as a carry from the right
    marked = signed.drop("_w").join(closes.withColumn("_end", F.lit(1)), ["symbol", "seq"], "left")
    t = running(marked, "seq", {"_done": F.coalesce("_end", F.lit(0))})
    total = closes.groupBy("symbol").agg(F.count("*").alias("_all"))
    key = F.col("_done") - F.coalesce("_end", F.lit(0))
    return t.join(total, "symbol").withColumn("key", F.when(key < F.col("_all"), key)).drop("_end", "_done", "_all")


def imbalance_bars(ticks: DataFrame, kind: str = "dollar", **rule) -> DataFrame:
    return assemble(information_keys(ticks, InfoRule("imbalance", kind, **rule)), "key")


def run_bars(ticks: DataFrame, kind: str = "dollar", **rule) -> DataFrame:
    return assemble(information_keys(ticks, InfoRule("run", kind, **rule)), "key")
