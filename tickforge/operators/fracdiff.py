"""Fractional differencing by weights, over blocks with a halo; the unit-root test from moment sums."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.normal import cdf
from tickforge.functions.windows import BLOCK


def get_weights(d: float, size: int) -> np.ndarray:
    """The first `size` binomial weights, oldest lag first."""
    k = np.arange(1, size)
    return np.concatenate([[1.0], np.cumprod((k - 1 - d) / k)])[::-1] if size else np.zeros(0)


def get_weights_ffd(d: float, threshold: float = 1e-5, max_size: int = 10_000) -> np.ndarray:
    """The weights before the first one below the threshold, oldest first."""
    w = get_weights(d, max_size)[::-1]
    small = np.flatnonzero(np.abs(w) < threshold)
    return w[: small[0] if len(small) else max_size][::-1]


def _series(series: DataFrame, value: str) -> DataFrame:
    return series.select("symbol", "seq", F.col(value).cast("double").alias("x")).where("x IS NOT NULL")


def frac_diff_ffd(series: DataFrame, value: str, ds: list[float], threshold: float = 1e-5, size: int = BLOCK) -> DataFrame:
    """(symbol, d, seq, value) for each order d: a convolution of fixed width.

    series: (symbol, seq, value), seq without gaps. Each block takes the rows
    before it that the widest window needs; rows without a full window are left out.
    """
    weights = {float(d): get_weights_ffd(d, threshold) for d in ds}
    halo = max(len(w) for w in weights.values()) - 1
    size = max(size, halo + 1)
    s = _series(series, value).withColumn("own", F.floor(F.col("seq") / size).cast("long"))
    s = s.withColumn("blk", F.explode(F.sequence("own", F.floor((F.col("seq") + halo) / size).cast("long"))))

    def convolve(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        x, seq, own = rows["x"].to_numpy(), rows["seq"].to_numpy(), (rows["own"] == key[1]).to_numpy()
        out = []
        for d, w in weights.items():
            if len(x) >= len(w):
                y = np.convolve(x, w[::-1], "valid")
                keep = own[len(w) - 1 :]
                out.append(pd.DataFrame({"symbol": key[0], "d": d, "seq": seq[len(w) - 1 :][keep], "value": y[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"symbol": pd.Series([], dtype=object), "d": [], "seq": [], "value": []})

    return s.groupBy("symbol", "blk").applyInPandas(convolve, "symbol string, d double, seq long, value double")


def frac_diff(series: DataFrame, value: str, d: float, threshold: float = 0.01) -> DataFrame:
    """(symbol, seq, value) of the expanding window; the first rows, whose lost weight is above the threshold, are skipped.

    One symbol is one task, as its cost grows with the square of the series; prefer frac_diff_ffd().
    """
    s = _series(series, value)

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("seq")
        n = len(x)
        w = get_weights(d, n)
        share = np.cumsum(np.abs(w))
        skip = int((share / share[-1] > threshold).sum())
        y = np.convolve(x["x"].to_numpy(), w[::-1])[:n]
        return pd.DataFrame({"symbol": key[0], "seq": x["seq"].to_numpy()[skip:], "value": y[skip:]})

    return s.groupBy("symbol").applyInPandas(run, "symbol string, seq long, value double")


#: Response-surface coefficients of the unit-root test with a constant.
_SMALL, _LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
_CRITICAL = (-2.86154, -2.8903, -4.234, -40.04)
_SPLIT, _LOW, _HIGH = -1.61, -18.83, 2.74


def adf_p(t: float) -> float:
    if t > _HIGH:
        return 1.0
    if t < _LOW:
        return 0.0
    return cdf(sum(c * t**k for k, c in enumerate(_SMALL if t <= _SPLIT else _LARGE)))


def adf_critical(n: int) -> float:
    return sum(c / n**k for k, c in enumerate(_CRITICAL))


def adf(series: DataFrame) -> DataFrame:
    """The test (constant, one lag) of each (symbol, d): (symbol, d, n_obs, adf_stat, p_value, crit_95) from moment sums.

    series: (symbol, d, seq, value), seq without gaps inside each. Values are centred before sums are taken.
    """
    mean = series.groupBy("symbol", "d").agg(F.avg("value").alias("_m"))
    w = Window.partitionBy("symbol", "d").orderBy("seq")
    y = series.join(mean, ["symbol", "d"]).select("symbol", "d", "seq", (F.col("value") - F.col("_m")).alias("y"))
    y = y.select("symbol", "d", "y", F.lag("y").over(w).alias("y1"), F.lag("y", 2).over(w).alias("y2"))
    y = y.where("y2 IS NOT NULL").select("symbol", "d", (F.col("y") - F.col("y1")).alias("t"), F.lit(1.0).alias("a"), F.col("y1").alias("b"), (F.col("y1") - F.col("y2")).alias("c"))
    names = ["a", "b", "c", "t"]
    pairs = [(p, q) for i, p in enumerate(names) for q in names[i:]]
    sums = y.groupBy("symbol", "d").agg(*(F.sum(F.col(p) * F.col(q)).alias(p + q) for p, q in pairs))

    def solve(batches):
        for df in batches:
            rows = []
            for r in df.to_dict("records"):
                m = np.array([[r["aa"], r["ab"], r["ac"]], [r["ab"], r["bb"], r["bc"]], [r["ac"], r["bc"], r["cc"]]])
                v = np.array([r["at"], r["bt"], r["ct"]])
                n = int(r["aa"])
                if n < 5 or abs(np.linalg.det(m)) < 1e-300:
                    rows.append((r["symbol"], r["d"], n + 2, None, None, None))
                    continue
                beta = np.linalg.solve(m, v)
                var = max(r["tt"] - beta @ v, 0.0) / (n - 3) * np.linalg.inv(m)[1, 1]
                t = float(beta[1] / math.sqrt(var)) if var > 0 else float("nan")
                rows.append((r["symbol"], r["d"], n + 2, t, adf_p(t), adf_critical(n)))
            yield pd.DataFrame(rows, columns=["symbol", "d", "n_obs", "adf_stat", "p_value", "crit_95"])

    return sums.mapInPandas(solve, "symbol string, d double, n_obs long, adf_stat double, p_value double, crit_95 double")


def min_ffd(series: DataFrame, value: str, grid=None, threshold: float = 1e-5, target: float = 0.05, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(d* by symbol, table by symbol and d): the least order whose series is stationary, with its correlation to the original.

    Correlations are over the rows that all orders have, or an order's own where these are too few.
    """
    grid = [round(float(x), 10) for x in (np.linspace(0, 1, 21) if grid is None else grid)]
    diffs = frac_diff_ffd(series, value, grid, threshold)
    sizes = diffs.groupBy("symbol", "d").agg(F.count("*").alias("k"), F.min("seq").alias("from"))
    good = sizes.where(F.col("k") >= least)
    common = good.groupBy("symbol").agg(F.max("from").alias("from"), F.min("k").alias("shared"))
    diffs = diffs.join(good.select("symbol", "d"), ["symbol", "d"], "left_semi")
    both = diffs.join(_series(series, value), ["symbol", "seq"]).join(common, "symbol")
    corr = both.where((F.col("shared") < least) | (F.col("seq") >= F.col("from"))).groupBy("symbol", "d").agg(F.corr("value", "x").alias("corr_with_original"))
    table = adf(diffs).join(corr, ["symbol", "d"], "left")
    best = table.groupBy("symbol").agg(F.min(F.when(F.col("p_value") < target, F.col("d"))).alias("d_star"))
    return best, table
