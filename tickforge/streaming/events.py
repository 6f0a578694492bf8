"""Streams of ticks and bars through the same state machines as in batch: information-driven bars and CUSUM events.

State is kept by symbol. Rows of a symbol must arrive in order from one micro-batch to the next;
inside a micro-batch they are sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickforge.operators.bars import InfoRule, InfoState
from tickforge.operators.labeling import Cusum

#: What a bar builder and the tick rule remember; unknown numbers are NaN.
_BAR_STATE = "price double, sign int, n long, plus double, minus double, length double, buy double, sell double, p double, bars long"
_CUSUM_STATE = "log double, up double, down double"


def _known(x: float | None) -> float:
    return math.nan if x is None else float(x)


def _maybe(x: float) -> float | None:
    return None if math.isnan(x) else x


def information_bars(ticks: DataFrame, rule: InfoRule) -> DataFrame:
    """(symbol, bar_seq, us): the ends of bars of a stream (symbol, seq, us, price, volume, dollar)."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        price, sign, s = math.nan, 1, rule.start()
        if state.exists:
            price, sign, n, plus, minus, length, buy, sell, p, bars = state.get
            s = InfoState(n, plus, minus, length, _maybe(buy), _maybe(sell), _maybe(p), bars)
        rows = pd.concat(frames).sort_values("seq")
        weight = {"tick": 1.0, "volume": rows["volume"], "dollar": rows["dollar"]}[rule.kind]
        out = []
        for us, now, w in zip(rows["us"].tolist(), rows["price"].tolist(), pd.Series(weight, rows.index).astype(float).tolist(), strict=True):
            sign = 1 if now > price else -1 if now < price else sign
            price = now
            if rule.step(s, sign, w):
                out.append((key[0], s.bars - 1, us))
        state.update((float(price), int(sign), s.n, float(s.plus), float(s.minus), float(s.length), _known(s.buy), _known(s.sell), _known(s.p), s.bars))
        yield pd.DataFrame(out, columns=["symbol", "bar_seq", "us"]).astype({"bar_seq": "int64", "us": "int64"})

    return ticks.groupBy("symbol").applyInPandasWithState(step, "symbol string, bar_seq long, us long", _BAR_STATE, "append", GroupStateTimeout.NoTimeout)


def cusum_events(bars: DataFrame, h: float) -> DataFrame:
    """(symbol, bar_seq, us): the events of a stream of bars (symbol, bar_seq, us, close)."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, c = math.nan, Cusum()
        if state.exists:
            last, c.up, c.down = state.get
        rows, out = pd.concat(frames).sort_values("bar_seq"), []
        for seq, us, close in zip(rows["bar_seq"].tolist(), rows["us"].tolist(), rows["close"].tolist(), strict=True):
            now = math.log(close)
            if not math.isnan(last) and c.step(now - last, h):
                out.append((key[0], seq, us))
            last = now
        state.update((last, c.up, c.down))
        yield pd.DataFrame(out, columns=["symbol", "bar_seq", "us"]).astype({"bar_seq": "int64", "us": "int64"})

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, bar_seq long, us long", _CUSUM_STATE, "append", GroupStateTimeout.NoTimeout)
