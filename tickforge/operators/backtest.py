"""Backtest: a position step function on the bar clock, costs, and the report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions import stats
from tickforge.functions.windows import as_of, carried, rolling, running


@dataclass(frozen=True)
class CostModel:
    """Linear costs of turnover plus a square-root slippage."""

    half_spread: float = 2.5e-4
    commission: float = 0.5e-4
    slippage_coef: float = 0.0

    def cost(self, turnover: Column) -> Column:
        return (self.half_spread + self.commission) * turnover + self.slippage_coef * F.sqrt(turnover)


@dataclass
class BacktestResult:
    """path: (symbol, us, position, gross, cost, ret, equity); bets: (symbol, us, ret); summary: (symbol, metric, value)."""

    path: DataFrame
    bets: DataFrame
    summary: DataFrame


def backtest_path(position: DataFrame, bars: DataFrame, costs: CostModel = CostModel(), initial: float = 1.0) -> DataFrame:  # noqa: B008
    """The position held over each bar is the one known at the bar before."""
    clock = stats.in_order(bars).select("symbol", "bar_seq", "us", F.col("close").cast("double").alias("close"))
    p = as_of(clock, position.select("symbol", "us", F.col("position").alias("position")), ["position"])
    p = p.withColumn("position", F.greatest(F.least(F.coalesce("position", F.lit(0.0)), F.lit(1.0)), F.lit(-1.0)))
    before = lambda c, w, k: F.coalesce(F.lag(c, k).over(w), F.lit(0.0))
    p = rolling(p, "bar_seq", 2, [lambda w: {"held": before("position", w, 1), "_earlier": before("position", w, 2), "_from": F.lag("close").over(w)}])
    p = p.withColumn("gross", F.coalesce(F.col("held") * (F.col("close") / F.col("_from") - 1), F.lit(0.0)))
    p = p.withColumn("turnover", F.abs(F.col("held") - F.col("_earlier"))).drop("_from", "_earlier")
    p = p.withColumn("cost", costs.cost(F.col("turnover"))).withColumn("ret", F.col("gross") - F.col("cost"))
    return running(p, "bar_seq", {"_grown": 1 + F.col("ret")}, how="product").withColumn("equity", initial * F.col("_grown")).drop("_grown")


def bet_returns(path: DataFrame) -> DataFrame:
    """(symbol, us, ret): change of equity between consecutive bet ends."""
    ends = stats.bet_timing(stats.in_order(path)).select("symbol", "bar_seq", "us", "equity")
    e = carried(ends, "bar_seq", "_from", F.col("equity"), strict=True)
    return e.withColumn("ret", F.col("equity") / F.col("_from") - 1).where("ret IS NOT NULL").select("symbol", "us", "ret")


def run_backtest(position: DataFrame, bars: DataFrame, costs: CostModel = CostModel(), periods: float | None = None, initial: float = 1.0, n_trials: int = 1, var_trials: float = 0.0, target: float = 1.0) -> BacktestResult:  # noqa: B008
    path = backtest_path(position, bars, costs, initial)
    bets = bet_returns(path)
    summary = stats.performance_summary(path, bets, periods, n_trials, var_trials, target)
    extra = path.groupBy("symbol").agg(
        stats.periods_per_year(periods).alias("_ppy"), (F.avg("gross") / F.stddev_samp("gross")).alias("_g"), F.sum("cost").alias("total_cost"),
        F.avg(F.abs("position")).alias("avg_abs_position"), F.sum("turnover").alias("_t"), F.count("*").alias("_n"),
    )
    extra = extra.select("symbol", (F.col("_g") * F.sqrt("_ppy")).alias("gross_sharpe"), "total_cost", "avg_abs_position", (F.col("_t") * F.col("_ppy") / F.col("_n")).alias("turnover_per_year"))
    return BacktestResult(path, bets, summary.unionByName(stats.melted(extra)))
