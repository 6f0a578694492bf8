"""The feature matrix: one chain of rolling stages over bars, in blocks with a halo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickforge.functions import microstructure as ms
from tickforge.functions.windows import carried, full, rolling
from tickforge.operators.fracdiff import frac_diff_ffd

ZSCORE = 250


def z(x: str, w: WindowSpec, k: int = ZSCORE) -> Column:
    sd = full(F.stddev_samp(x), x, w, k)
    return (F.col(x) - full(F.avg(x), x, w, k)) / F.when(sd > 0, sd)


def flow_signs(bars: DataFrame) -> DataFrame:
    """bars with flow_sign: the sign of signed_dollar, zeros inherit, +1 at first."""
    s = F.signum("signed_dollar")
    return carried(bars, "bar_seq", "flow_sign", F.when(s != 0, s)).withColumn("flow_sign", F.coalesce("flow_sign", F.lit(1.0)))


def build_features(bars: DataFrame, tick_sums: DataFrame | None = None, d_ffd: float = 0.4, windows: tuple[int, ...] = (5, 20, 50), micro: tuple[int, ...] = (20, 100), threshold: float = 1e-4, drop: bool = True) -> DataFrame:
    """(symbol, bar_seq, us, features...); rows with a null or infinite feature are dropped.

    tick_sums: the sums of each bar by microstructure.tick_sums(); without them
    the bar-level estimators stand in, and roll_impact joins.
    """
    log = F.log(F.col("close").cast("double"))
    b = flow_signs(bars).withColumn("_x", log)
    ffd = frac_diff_ffd(b.select("symbol", F.col("bar_seq").alias("seq"), "_x"), "_x", [d_ffd], threshold)
    b = b.join(ffd.select("symbol", F.col("seq").alias("bar_seq"), F.col("value").alias("ffd_price")), ["symbol", "bar_seq"], "left")
    if tick_sums is not None:
        b = b.join(tick_sums, ["symbol", "bar_seq"], "left")

    def first(w):
        gap = (F.col("us") - F.lag("us").over(w)) / 1e6
        return ms.changes(w) | {"ofi": ms.order_flow_imbalance(), "log_duration": F.log(F.greatest(gap, F.lit(1e-3))), "_buy": ms.ratio(F.col("buy_volume"), F.col("volume")), "log_n_ticks": F.log("n_ticks"), "_v": F.col("volume").cast("double")}

    def second(w):
        out = ms.lagged(w) | {"vol_50": full(F.stddev_samp("_r"), "_r", w, 50), "_vol10": full(F.stddev_samp("_r"), "_r", w, 10)}
        out |= {f"_m{k}": F.col("_x") - F.lag("_x", k).over(w) for k in windows}
        return out | {f"ofi_{k}": full(F.avg("ofi"), "ofi", w, k) for k in windows}

    def third(w):
        both = F.col("_r") * F.col("_r1")
        frame = w.rowsBetween(-49, 0)
        vol = F.when(F.col("vol_50") > 0, F.col("vol_50"))
        out = {"vol_ratio": F.col("_vol10") / vol, "autocorr_50": F.when(F.count(both).over(frame) == 50, F.corr("_r", "_r1").over(frame)), "buy_ratio_20": full(F.avg("_buy"), "_buy", w, 20)}
        out |= {f"mom_{k}": F.col(f"_m{k}") / (vol * F.sqrt(F.lit(float(k)))) for k in windows}
        return out | {"ffd_price_z": z("ffd_price", w), "duration_z": z("log_duration", w), "volume_z": z("_v", w)}

    def liquidity(w):
        if tick_sums is not None:
            return ms.rolling_tick_columns(w, micro)
        out = {}
        for k in micro:
            roll = ms.roll_spread(F.col("_dlog"), F.col("_dlog1"), w, k)
            out |= {f"roll_spread_{k}": roll, f"kyle_lambda_{k}": ms.kyle(w, k), f"amihud_lambda_{k}": ms.amihud(w, k), f"hasbrouck_lambda_{k}": ms.hasbrouck(w, k), f"vpin_{k}": ms.vpin(w, k)}
        out["roll_impact_20"] = ms.ratio(ms.roll_spread(F.col("_dlog"), F.col("_dlog1"), w, 20), F.col("dollar"))
        return out

    stages = [first, second, lambda w: {"_dlog": F.col("_r"), "_dlog1": F.col("_r1")}, third, *ms.corwin_stages(20), liquidity]
    out = rolling(b, "bar_seq", ZSCORE + 2 + max([*windows, *micro]), stages)
    names = feature_names(tick_sums is not None, windows, micro)
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c).cast("double"))
    out = out.select("symbol", "bar_seq", "us", *(finite(c).alias(c) for c in names))
    return out.dropna(subset=names) if drop else out


def feature_names(ticks: bool, windows: tuple[int, ...] = (5, 20, 50), micro: tuple[int, ...] = (20, 100)) -> list[str]:
    names = ["ffd_price", "ffd_price_z", "vol_50", "vol_ratio", *(f"mom_{k}" for k in windows), "autocorr_50", "ofi", *(f"ofi_{k}" for k in windows), "buy_ratio_20", "log_duration", "duration_z", "log_n_ticks", "volume_z", "cs_spread", "cs_sigma"]
    names += [f"{e}_{k}" for k in micro for e in ("roll_spread", "kyle_lambda", "amihud_lambda", "hasbrouck_lambda", "vpin")]
    return names if ticks else [*names, "roll_impact_20"]
