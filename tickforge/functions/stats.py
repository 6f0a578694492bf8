"""Performance and risk statistics, by symbol. Moments are one aggregation; scalars finish on the driver or in Arrow."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.normal import cdf, quantile
from tickforge.functions.windows import DAY_US, as_of, block_of, numbered, rolling, running

_EULER = 0.5772156649015329
YEAR_US = 365.25 * 86_400e6


def in_order(path: DataFrame) -> DataFrame:
    """path with bar_seq, its place in time order; blocks of it are what windows work on."""
    return path if "bar_seq" in path.columns else numbered(path, "bar_seq", ["us"], block_of("us", DAY_US), 0)


def periods_per_year(given: float | None = None) -> Column:
    """Rows a year over the span of us."""
    if given is not None:
        return F.lit(float(given))
    return F.try_divide(F.count("*"), (F.max("us") - F.min("us")) / F.lit(YEAR_US))


def sharpe_ratio(ret: str = "ret", periods: float = 252, rf: float = 0.0) -> Column:
    """Annualised Sharpe ratio; null for fewer than two rows or no variation."""
    x = F.col(ret) - rf / periods
    return F.try_divide(F.avg(x), F.when(F.stddev_samp(x) > 0, F.stddev_samp(x))) * math.sqrt(periods)


def moments(df: DataFrame, ret: str = "ret") -> DataFrame:
    """(symbol, n, mean, sd, g1, g2): sample skew and excess kurtosis, adjusted for bias."""
    m = df.groupBy("symbol").agg(F.count(ret).alias("n"), F.avg(ret).alias("mean"), F.stddev_samp(ret).alias("sd"), F.skewness(ret).alias("s"), F.kurtosis(ret).alias("k"))
    n = F.col("n")
    g1 = F.when(n > 2, F.col("s") * F.sqrt(n * (n - 1)) / (n - 2))
    g2 = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("k") + 6))
    return m.select("symbol", "n", "mean", "sd", g1.alias("g1"), g2.alias("g2"))


def psr_value(n: int, mean: float, sd: float, g1: float, g2: float, benchmark: float, periods: float) -> float:
    """Probability that the true Sharpe ratio is above an annualised benchmark."""
    if n is None or n < 3 or not sd or None in (g1, g2):
        return float("nan")
    sr = mean / sd
    den = 1 - g1 * sr + (g2 + 2) / 4 * sr * sr
    return cdf((sr - benchmark / math.sqrt(periods)) * math.sqrt(n - 1) / math.sqrt(den)) if den > 0 else float("nan")


def expected_max_sharpe(n_trials: int, variance: float) -> float:
    """Expected largest Sharpe ratio of unskilled trials."""
    if n_trials < 2:
        return 0.0
    return math.sqrt(variance) * ((1 - _EULER) * quantile(1 - 1 / n_trials) + _EULER * quantile(1 - 1 / (n_trials * math.e)))


def probabilistic_sharpe(df: DataFrame, ret: str = "ret", benchmark: float = 0.0, periods: float = 252) -> DataFrame:
    """(symbol, psr)."""

    def finish(batches):
        for b in batches:
            yield pd.DataFrame({"symbol": b["symbol"], "psr": [psr_value(r.n, r.mean, r.sd, r.g1, r.g2, benchmark, periods) for r in b.itertuples()]})

    return moments(df, ret).mapInPandas(finish, "symbol string, psr double")


def deflated_sharpe(df: DataFrame, n_trials: int, variance: float, ret: str = "ret", periods: float = 252) -> DataFrame:
    """(symbol, psr) against the expected largest of the trials; variance of annualised Sharpe ratios."""
    return probabilistic_sharpe(df, ret, expected_max_sharpe(n_trials, variance), periods)


def drawdowns(path: DataFrame, dollars: bool = False) -> DataFrame:
    """(symbol, us, drawdown, until_us) of each high-water mark that a loss follows.

    Depth is relative (or absolute); until_us is the next such mark's start, or the end
    of the path for the last one - not the recovery.
    """
    marked = running(in_order(path), "bar_seq", {"hwm": "equity"}, how="max")
    g = marked.groupBy("symbol", "hwm").agg(F.min("equity").alias("low"), F.min("us").alias("us")).where("hwm > low")
    end = path.groupBy("symbol").agg(F.max("us").alias("_end"))
    g = g.withColumn("_at", F.col("us"))
    d = as_of(g.withColumn("us", F.col("us") + 1), g.select("symbol", "us", F.col("_at").alias("_next")), ["_next"], forward=True).withColumn("us", F.col("_at"))
    d = d.join(end, "symbol").withColumn("until_us", F.coalesce("_next", "_end"))
    depth = F.col("hwm") - F.col("low") if dollars else 1 - F.col("low") / F.col("hwm")
    return d.select("symbol", "us", depth.alias("drawdown"), "until_us")


def bet_timing(path: DataFrame, first_flat: bool = True) -> DataFrame:
    """Rows where a bet ends: flat after a position, a change of sign, or the last row.

    first_flat: a flat first row counts as an end too, which bet counts rely on.
    """
    p = F.col("position")
    rows = rolling(in_order(path), "bar_seq", 1, [lambda w: {"_before": F.lag("position").over(w)}])
    ends = path.groupBy("symbol").agg(F.max("us").alias("_end"))
    rows = rows.join(ends, "symbol").withColumn("_last", F.col("us") == F.col("_end")).drop("_end")
    flat = (p == 0) & ((F.col("_before") != 0) | (F.col("_before").isNull() & F.lit(first_flat)))
    flip = p * F.col("_before") < 0
    return rows.where(F.coalesce(flat, F.lit(False)) | F.coalesce(flip, F.lit(False)) | F.col("_last")).select(*path.columns)


def holding_period(path: DataFrame) -> DataFrame:
    """(symbol, days): size-weighted holding time with an averaged entry; a state machine over the changes of position."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("us")
        t = (rows["us"].to_numpy() - rows["us"].iloc[0]) / 86_400e6
        entry = before = spent = weight = 0.0
        for now, pos in zip(t.tolist(), rows["position"].tolist(), strict=True):
            change = pos - before
            if change * before >= 0:
                if pos != 0:
                    entry = (entry * before + now * change) / pos
            elif pos * before < 0:
                spent, weight, entry = spent + (now - entry) * abs(before), weight + abs(before), now
            else:
                spent, weight = spent + (now - entry) * abs(change), weight + abs(change)
            before = pos
        return pd.DataFrame({"symbol": [key[0]], "days": [spent / weight if weight else None]})

    moved = rolling(in_order(path), "bar_seq", 1, [lambda w: {"_b": F.lag("position").over(w)}]).where("_b IS NULL OR position <> _b")
    return moved.select("symbol", "us", "position").groupBy("symbol").applyInPandas(run, "symbol string, days double")


def hhi(bets: DataFrame, name: str = "hhi") -> DataFrame:
    """(symbol, hhi): normalised concentration of returns; null for two rows or fewer, or a zero sum."""
    a = bets.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    value = (F.try_divide(F.col("q"), F.col("s") * F.col("s")) - 1 / F.col("n")) / (1 - 1 / F.col("n"))
    return a.select("symbol", F.when((F.col("n") > 2) & (F.col("s") != 0), value).alias(name))


def win_loss(bets: DataFrame) -> DataFrame:
    """(symbol, n, win, loss, precision): mean of the gains, of the rest, and the share of gains."""
    gain = F.col("ret") > 0
    a = bets.groupBy("symbol").agg(F.count("*").alias("n"), F.avg(F.when(gain, F.col("ret"))).alias("win"), F.avg(F.when(~gain, F.col("ret"))).alias("loss"), F.avg(gain.cast("double")).alias("precision"))
    return a


def failure(n: int, win: float, loss: float, precision: float, freq: float, target: float) -> tuple[float, float, float]:
    """(implied precision, precision, probability that the true precision is below it)."""
    from tickforge.operators.sizing import implied_precision

    if win is None or loss is None or pd.isna(win) or pd.isna(loss):
        return (float("nan"),) * 3
    need = implied_precision(loss, win, freq, target)
    sd = math.sqrt(max(precision * (1 - precision), 1e-12) / n)
    return need, precision, cdf((need - precision) / sd) if not math.isnan(need) else float("nan")


def prob_failure(bets: DataFrame, freq: float, target: float) -> DataFrame:
    """(symbol, implied_precision, precision, p_failure)."""

    def finish(batches):
        for b in batches:
            rows = [(r.symbol, *failure(r.n, r.win, r.loss, r.precision, freq, target)) for r in b.itertuples()]
            yield pd.DataFrame(rows, columns=["symbol", "implied_precision", "precision", "p_failure"])

    return win_loss(bets).mapInPandas(finish, "symbol string, implied_precision double, precision double, p_failure double")


def melted(wide: DataFrame) -> DataFrame:
    """(symbol, metric, value) of the other columns."""
    names = [c for c in wide.columns if c != "symbol"]
    return wide.select("symbol", *(F.col(c).cast("double").alias(c) for c in names)).unpivot("symbol", names, "metric", "value")


def performance_summary(path: DataFrame, bets: DataFrame, periods: float | None = None, n_trials: int = 1, var_trials: float = 0.0, target: float = 1.0) -> DataFrame:
    """(symbol, metric, value). path: (symbol, us, position, ret, equity); the bet block needs more than two bets."""
    n = F.col("n")
    base = path.groupBy("symbol").agg(
        F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), periods_per_year(periods).alias("ppy"),
        F.min_by("equity", "us").alias("e0"), F.max_by("equity", "us").alias("e1"), (F.max("us") - F.min("us")).alias("span"),
    )
    years = F.col("span") / F.lit(YEAR_US)
    base = base.select(
        "symbol", "ppy", n.alias("n_obs"), (F.col("e1") / F.col("e0") - 1).alias("total_return"), (F.pow(F.col("e1") / F.col("e0"), F.try_divide(F.lit(1.0), years)) - 1).alias("cagr"),
        (F.col("sd") * F.sqrt("ppy")).alias("annual_vol"), (F.try_divide(F.col("mean"), F.when(F.col("sd") > 0, F.col("sd"))) * F.sqrt("ppy")).alias("sharpe"), years.alias("years"),
    )
    down = drawdowns(path).groupBy("symbol").agg(F.max("drawdown").alias("max_drawdown"), (F.max(F.col("until_us") - F.col("us")) / 86_400e6).alias("longest_under_water_days"))
    month = path.select("symbol", F.timestamp_micros("us").alias("ts"), "ret").groupBy("symbol", F.date_trunc("month", "ts").alias("m")).agg(F.sum("ret").alias("ret")).where("ret > 0")
    b = bets.groupBy("symbol").agg(F.count("*").alias("n_bets"), F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate"), F.avg(F.when(F.col("ret") > 0, F.col("ret"))).alias("avg_hit"), F.avg(F.when(F.col("ret") <= 0, F.col("ret"))).alias("avg_miss"))
    sides = [hhi(bets.where("ret > 0"), "hhi_positive"), hhi(bets.where("ret <= 0"), "hhi_negative"), hhi(month, "hhi_months"), holding_period(path).withColumnRenamed("days", "avg_holding_days")]
    wide = base.join(down, "symbol", "left").join(b.where("n_bets > 2"), "symbol", "left")
    for s in sides:
        wide = wide.join(s, "symbol", "left")
    wide = wide.join(moments(path).select("symbol", F.col("n").alias("_n"), F.col("mean").alias("_mean"), F.col("sd").alias("_sd"), F.col("g1").alias("skew"), F.col("g2").alias("excess_kurtosis")), "symbol", "left")
    wide = wide.join(win_loss(bets).select("symbol", F.col("win").alias("_win"), F.col("loss").alias("_loss"), F.col("precision").alias("_p"), F.col("n").alias("_b")), "symbol", "left")
    wide = wide.withColumn("bets_per_year", F.try_divide(F.col("n_bets"), F.col("years")))
    names = [c for c in wide.columns if c[0] != "_" and c != "symbol"]

    def finish(batches):
        for df in batches:
            rows = []
            for r in df.to_dict("records"):
                out = {k: r[k] for k in names}
                n_obs = None if pd.isna(r["_n"]) else int(r["_n"])
                stat = (n_obs, r["_mean"], r["_sd"], r["skew"], r["excess_kurtosis"])
                out["psr"] = psr_value(*stat, 0.0, r["ppy"])
                if n_trials > 1:
                    out["dsr"] = psr_value(*stat, expected_max_sharpe(n_trials, var_trials), r["ppy"])
                if not pd.isna(r["n_bets"]):
                    need, p, fail = failure(r["_b"], r["_win"], r["_loss"], r["_p"], r["bets_per_year"], target)
                    out |= {f"implied_precision_sr{target:g}": need, "precision": p, "prob_failure": fail}
                rows += [(r["symbol"], k, None if pd.isna(v) else float(v)) for k, v in out.items()]
            yield pd.DataFrame(rows, columns=["symbol", "metric", "value"])

    return wide.mapInPandas(finish, "symbol string, metric string, value double")
