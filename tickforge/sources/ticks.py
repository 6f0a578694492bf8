"""Tick sources: files, the events adapter, and a simulator with known truth; result sinks."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.windows import numbered


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """A file source by format: parquet, csv, json or orc."""
    return spark.read.format(kind).options(**options).load(path)


def from_events(events: DataFrame) -> DataFrame:
    """The events table as a tape in integers: symbol, seq, ts, us, price (cents), volume, dollar."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = events.select(
        F.col("event_type").alias("symbol"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        (F.round(F.col("value") * 100).cast("long") + 10000).alias("price"), (1 + k).alias("volume"),
    )
    e = e.withColumn("us", F.unix_micros("ts"))
    # days spread a symbol over tasks; only their counts meet
    e = numbered(e, "seq", ["us", "event_id"], F.floor(F.col("us") / 86_400_000_000))
    return e.select("symbol", "seq", "ts", "us", "price", "volume", (F.col("price") * F.col("volume")).alias("dollar"))


@dataclass(frozen=True)
class TickSimConfig:
    """Parameters of the simulator."""

    # The defaults that published results rest on.
    n_ticks: int = 4_000_000
    start: str = "2021-01-04 00:00:00"
    p0: float = 100.0
    phi: float = 0.995
    sigma_i: float = 1.0
    a: float = 0.030
    c: float = 0.22
    eps: float = 0.02
    mu_v: float = 4.0
    s_v: float = 0.85
    b_v: float = 0.12
    lam: float = 7.0e-6
    spread: float = 5.0e-4
    sigma_bar: float = 1.1e-4
    vol_phi: float = 0.9995
    vol_sigma: float = 0.012
    mean_interarrival: float = 26.0
    seed: int = 20211231

    def as_dict(self) -> dict:
        return asdict(self)


def _ar1(phi: float, noise: np.ndarray) -> np.ndarray:
    out = np.empty_like(noise)
    last = 0.0
    for i, e in enumerate(noise.tolist()):
        last = phi * last + e
        out[i] = last
    return out


def simulate_arrays(cfg: TickSimConfig) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(ticks, truth): information drives signs, signs move price by their impact, spread bounces it."""
    r = np.random.default_rng(cfg.seed)
    n = cfg.n_ticks
    info = _ar1(cfg.phi, r.normal(0.0, cfg.sigma_i, n))
    info /= info.std() or 1.0
    u = r.random(n)
    sign = np.empty(n, np.int8)
    previous = 0
    for i, (x, v) in enumerate(zip(info.tolist(), u.tolist(), strict=True)):
        buy = min(max(0.5 + cfg.a * x + cfg.c * previous, cfg.eps), 1 - cfg.eps)
        previous = 1 if v < (0.5 if i == 0 else buy) else -1
        sign[i] = previous
    volume = np.maximum(np.round(np.exp(cfg.mu_v + cfg.s_v * r.normal(size=n) + cfg.b_v * np.abs(info))), 1.0)
    log_vol = _ar1(cfg.vol_phi, r.normal(0.0, cfg.vol_sigma, n))
    sigma = cfg.sigma_bar * np.exp(log_vol - log_vol.mean() - log_vol.var() / 2)
    mid = math.log(cfg.p0) + np.cumsum(cfg.lam * sign * np.sqrt(volume) + sigma * r.normal(size=n))
    price = np.exp(mid + 0.5 * cfg.spread * sign)
    gaps = np.maximum(r.exponential(cfg.mean_interarrival, n) * np.exp(-0.25 * np.abs(info)), 1e-3)
    us = np.cumsum(np.floor(gaps * 1e6)).astype(np.int64) + pd.Timestamp(cfg.start, tz="UTC").value // 1000
    ticks = pd.DataFrame({"seq": np.arange(1, n + 1), "us": us, "price": price, "volume": volume, "dollar": price * volume})
    return ticks, pd.DataFrame({"seq": ticks["seq"], "us": us, "efficient_log_price": mid, "true_sign": sign, "information": info, "sigma": sigma})


def simulate(spark: SparkSession, configs: dict[str, TickSimConfig]) -> DataFrame:
    """One simulated tape for each symbol, made in parallel on the executors and emitted in pieces."""
    todo = spark.createDataFrame([(k, json.dumps(c.as_dict())) for k, c in configs.items()], "symbol string, config string")

    def make(batches):
        for rows in batches:
            for symbol, config in zip(rows["symbol"], rows["config"], strict=True):
                ticks, _ = simulate_arrays(TickSimConfig(**json.loads(config)))
                for lo in range(0, len(ticks), 1 << 17):
                    yield ticks.iloc[lo : lo + (1 << 17)].assign(symbol=symbol)[["symbol", "seq", "us", "price", "volume", "dollar"]]

    dealt = todo.repartition(len(configs), "symbol")
    out = dealt.mapInPandas(make, "symbol string, seq long, us long, price double, volume double, dollar double")
    return out.withColumn("ts", F.timestamp_micros("us")).select("symbol", "seq", "ts", "us", "price", "volume", "dollar")


def hourly_last(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """Time bars: the last price of each wall-clock interval that has one."""
    g = ticks.groupBy("symbol", F.window("ts", width).alias("w")).agg(F.max_by("price", "seq").alias("price"))
    return g.select("symbol", F.col("w.start").alias("ts"), "price")


def monthly_sum(returns: DataFrame, value: str) -> DataFrame:
    """Calendar-month sums of (symbol, ts, value)."""
    return returns.groupBy("symbol", F.date_trunc("month", "ts").alias("month")).agg(F.sum(value).alias(value))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_manifest(path: str, **entries) -> None:
    """A JSON run manifest on the driver."""
    Path(path).write_text(json.dumps(entries, indent=2, sort_keys=True, default=str))
