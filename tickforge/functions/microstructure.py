"""Bar-level and tick-level liquidity estimators as window expressions.

Each takes the window by symbol and returns columns, so that all estimators of a
frame share one sort. Denominators of zero give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickforge.functions.windows import BLOCK, block_of, full

_ROOT = 3 - 2 * math.sqrt(2)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def slope(y: Column, x: Column, w: WindowSpec, k: int) -> Column:
    """Rolling least squares through the origin."""
    both = x * y
    return ratio(full(F.sum(both), both, w, k), full(F.sum(x * x), both, w, k))


def roll_spread(dp: Column, before: Column, w: WindowSpec, k: int) -> Column:
    """Twice the root of minus the autocovariance of price changes, where it is negative."""
    both = dp * before
    cov = F.when(F.count(both).over(w.rowsBetween(-(k - 1), 0)) == k, F.covar_samp(dp, before).over(w.rowsBetween(-(k - 1), 0)))
    return 2 * F.sqrt(F.greatest(-cov, F.lit(0.0)))


def corwin_stages(k: int) -> list:
    """Stages for windows.rolling(): cs_spread and cs_sigma from high and low."""

    def pairs(w):
        two = w.rowsBetween(-1, 0)
        hl = F.pow(F.log(F.col("high") / F.col("low")), 2)
        g = F.pow(F.log(F.max("high").over(two) / F.min("low").over(two)), 2)
        return {"_b2": full(F.sum(hl), hl, w, 2), "_g": F.when(F.count("high").over(two) == 2, g)}

    def estimate(w):
        beta = full(F.avg("_b2"), "_b2", w, k)
        root = (math.sqrt(2) - 1) * F.sqrt(beta) / _ROOT
        alpha = F.when(beta.isNotNull() & F.col("_g").isNotNull(), F.greatest(root - F.sqrt(F.col("_g") / _ROOT), F.lit(0.0)))
        k2 = math.sqrt(8 / math.pi)
        sigma = F.when(beta.isNotNull() & F.col("_g").isNotNull(), F.greatest(root / k2 + F.sqrt(F.col("_g") / (k2 * k2 * _ROOT)), F.lit(0.0)))
        return {"cs_spread": 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha)), "cs_sigma": sigma}

    return [pairs, estimate]


def changes(w: WindowSpec) -> dict[str, Column]:
    """Price and log-price changes of bars, and their signs of flow (zeros inherit, first +1)."""
    price, log = F.col("close").cast("double"), F.log(F.col("close").cast("double"))
    return {"_dp": price - F.lag(price).over(w), "_r": log - F.lag(log).over(w)}


def lagged(w: WindowSpec) -> dict[str, Column]:
    return {"_r1": F.lag("_r").over(w)}


def kyle(w: WindowSpec, k: int) -> Column:
    """Price change on signed volume (bar level: in price, not log price)."""
    return slope(F.col("_dp"), (F.col("flow_sign") * F.col("volume")).cast("double"), w, k)


def amihud(w: WindowSpec, k: int) -> Column:
    return slope(F.abs("_r"), F.col("dollar").cast("double"), w, k)


def hasbrouck(w: WindowSpec, k: int) -> Column:
    return slope(F.col("_r"), F.col("flow_sign") * F.sqrt(F.col("dollar").cast("double")), w, k)


def vpin(w: WindowSpec, k: int) -> Column:
    """Sum of absolute order imbalance per bar over volume."""
    one_sided = F.abs(2 * F.col("buy_volume") - F.col("volume"))
    return ratio(full(F.sum(one_sided), one_sided, w, k), full(F.sum("volume"), "volume", w, k))


def order_flow_imbalance() -> Column:
    return ratio(F.col("signed_dollar"), F.col("dollar"))


SUMS = ["n", "dp", "dp_lag", "dp_dp_lag", "dp_bv", "bv2", "absdp_d", "d2", "dp_bsqd", "b2d", "buy_vol", "vol"]


def tick_sums(keyed: DataFrame, key: str, bars: DataFrame) -> DataFrame:
    """The twelve sufficient sums of each bar: (symbol, bar_seq, n, ...). keyed: signed ticks with the bar's key.

    Log-price changes; the first tick of a tape has none, and the second no lagged one.
    """
    # the two prices before a block come from its neighbour's end, so blocks need no wider window
    t = keyed.withColumn("_b", block_of("seq", BLOCK)).withColumn("_x", F.log(F.col("price").cast("double")))
    w = Window.partitionBy("symbol", "_b").orderBy("seq")
    # seq is gapless, so the last two rows of a block are known by their numbers
    place = F.col("seq") % BLOCK
    tails = t.where(place >= BLOCK - 2).groupBy("symbol", (F.col("_b") + 1).alias("_b")).agg(F.max(F.when(place == BLOCK - 1, F.col("_x"))).alias("_e1"), F.max(F.when(place == BLOCK - 2, F.col("_x"))).alias("_e2"))
    t = t.join(tails, ["symbol", "_b"], "left")
    one = F.coalesce(F.lag("_x").over(w), F.col("_e1"))
    two = F.coalesce(F.lag("_x", 2).over(w), F.when(F.lag("_x").over(w).isNotNull(), F.col("_e1")).otherwise(F.col("_e2")))
    t = t.withColumns({"dp": F.coalesce(F.col("_x") - one, F.lit(0.0)), "dp_lag": F.coalesce(one - two, F.lit(0.0))})
    b, v, d = F.col("sign"), F.col("volume").cast("double"), F.col("dollar").cast("double")
    each = {
        "n": F.lit(1), "dp": F.col("dp"), "dp_lag": F.col("dp_lag"), "dp_dp_lag": F.col("dp") * F.col("dp_lag"), "dp_bv": F.col("dp") * b * v, "bv2": v * v,
        "absdp_d": F.abs("dp") * d, "d2": d * d, "dp_bsqd": F.col("dp") * b * F.sqrt(d), "b2d": d, "buy_vol": F.when(b > 0, v).otherwise(0.0), "vol": v,
    }
    g = t.where(F.col(key).isNotNull()).groupBy("symbol", key).agg(*(F.sum(c).alias(k) for k, c in each.items()), F.max("seq").alias("last_seq"))
    return g.join(bars.select("symbol", "last_seq", "bar_seq"), ["symbol", "last_seq"]).select("symbol", "bar_seq", *SUMS)


def rolling_tick_columns(w: WindowSpec, windows: tuple[int, ...] = (20, 100)) -> dict[str, Column]:
    """Roll, Kyle, Amihud, Hasbrouck and VPIN of rolling windows from the tick sums."""
    out = {}
    for k in windows:
        s = {c: full(F.sum(c), c, w, k) for c in SUMS}
        cov = ratio(s["dp_dp_lag"] - ratio(s["dp"] * s["dp_lag"], s["n"]), s["n"] - 1)
        out |= {
            f"roll_cov_{k}": cov, f"roll_spread_{k}": 2 * F.sqrt(F.greatest(-cov, F.lit(0.0))), f"kyle_lambda_{k}": ratio(s["dp_bv"], s["bv2"]),
            f"amihud_lambda_{k}": ratio(s["absdp_d"], s["d2"]), f"hasbrouck_lambda_{k}": ratio(s["dp_bsqd"], s["b2d"]), f"vpin_{k}": ratio(F.abs(2 * s["buy_vol"] - s["vol"]), s["vol"]),
        }
    return out
