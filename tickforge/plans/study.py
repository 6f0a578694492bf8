"""The whole study of a tape: ticks to bars, features, meta-labels, weights, walk-forward bets, backtest and report.

Each step is a table in the shared folder, so no step is planned, or computed, twice, and a lost
executor costs tasks of one step only. Steps that are independent are plain functions of earlier tables.
"""

from __future__ import annotations

import statistics as st
import uuid
from dataclasses import asdict, dataclass, replace
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions import microstructure as ms
from tickforge.functions.tables import shared_folder
from tickforge.operators import bars as B
from tickforge.operators import cv, fracdiff, importance, sizing
from tickforge.operators import labeling as L
from tickforge.operators import sampling as S
from tickforge.operators.backtest import BacktestResult, CostModel, run_backtest
from tickforge.plans import features as fe

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000


@dataclass(frozen=True)
class Settings:
    """Parameters of a study."""

    # The defaults that published results rest on.
    bars_per_day: float = 50
    vol_horizon_h: float = 4
    cusum_mult: float = 0.5
    holding_h: float = 12
    pt: float = 1.0
    sl: float = 1.0
    min_ret: float = 0.0
    half_spread: float = 2.5e-4
    commission: float = 0.5e-4
    bet_step: float = 0.05
    wf_splits: int = 6
    embargo: float = 0.01
    min_train_frac: float = 0.40
    time_decay_last_w: float = 0.5
    trees: int = 250
    vol_span: int = 100

    @property
    def round_trip(self) -> float:
        return 2 * (self.half_spread + self.commission)


@dataclass
class Study:
    """Tables of a study, by name, and what was measured on the way."""

    settings: Settings
    tables: dict[str, DataFrame]
    facts: dict[str, float]
    result: BacktestResult | None = None


class Desk:
    """Writes the steps of one study below the shared folder and reads them back."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.tables = spark, f"{shared_folder(spark)}/study-{uuid.uuid4().hex}", {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.tables[name] = self.spark.read.schema(df.schema).parquet(path)
        return self.tables[name]

    def close(self) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def sampled(desk: Desk, ticks: DataFrame, s: Settings) -> dict[str, float]:
    """Writes bars and tick sums; the threshold gives so many bars a day on average."""
    spread = ticks.groupBy("symbol").agg(F.sum("dollar").alias("d"), ((F.max("us") - F.min("us")) / DAY_US).alias("days"))
    total = spread.agg(F.sum("d"), F.sum("days"), F.max("days")).first()
    threshold = total[0] / (total[1] * s.bars_per_day)
    keyed = desk.put("keyed", B.bar_keys(B.tick_rule(ticks), threshold, "dollar"))
    bars = desk.put("bars", B.raise_if_empty(B.assemble(keyed, "key")))
    desk.put("sums", ms.tick_sums(keyed, "key", bars))
    return {"threshold": float(threshold), "days": float(total[2]), "n_bars": bars.count()}


def least_order(desk: Desk, threshold: float = 1e-5, grid=None, least: int = 100) -> float:
    """The least order of differencing that makes every symbol's log close stationary; 1 if none does."""
    close = desk.tables["bars"].select("symbol", F.col("bar_seq").alias("seq"), F.log(F.col("close").cast("double")).alias("x"))
    best, table = fracdiff.min_ffd(close, "x", grid, threshold, least=least)
    desk.put("orders", table)
    found = desk.tables["orders"].where("p_value < 0.05").groupBy("symbol").agg(F.min("d").alias("d")).agg(F.max("d")).first()[0]
    return 1.0 if found is None else float(found)


def dataset(desk: Desk, s: Settings, tag: str = "") -> DataFrame:
    """Rows to learn from: (symbol, pos, us, t1, side, ret, y, weight, features...) of the primary rule's events."""
    t = desk.tables
    bars = t["bars"]
    vol = t.get("vol") or desk.put("vol", L.get_vol(bars, s.vol_span, int(s.vol_horizon_h * HOUR_US)))
    times = L.cusum_filter(bars, vol.select("symbol", "bar_seq", (F.col("trgt") * s.cusum_mult).alias("h")))
    times = times.join(t["features"].select("symbol", "us"), ["symbol", "us"], "left_semi")
    times = L.primary_side(L.add_vertical_barrier(times.select("symbol", "us"), bars, int(s.holding_h * HOUR_US)), t["features"])
    events = desk.put(f"events{tag}", L.get_events(bars, times, (s.pt, s.sl), vol, s.min_ret))
    labels = desk.put(f"labels{tag}", L.drop_labels(L.get_bins(events, bars, s.round_trip), 0.02))
    spans = labels.select("symbol", "us", "t1")
    co = desk.put(f"concurrency{tag}", S.num_co_events(spans, bars))
    unique = desk.put(f"uniqueness{tag}", S.avg_uniqueness(spans, bars, co))
    weights = S.combined_weights(S.sample_weights(spans, bars, co), S.time_decay(unique, s.time_decay_last_w))
    rows = labels.select("symbol", "us", "t1", "side", "ret", F.col("bin").alias("y")).join(weights.select("symbol", "us", F.col("w").alias("weight")), ["symbol", "us"])
    return desk.put(f"data{tag}", cv.positions(rows.join(t["features"].drop("bar_seq"), ["symbol", "us"])))


def bets(desk: Desk, data: DataFrame, names: list[str], s: Settings, seed: int = 0, trees: int | None = None, tag: str = "") -> BacktestResult:
    """Walk-forward probabilities, sizes, and the backtest from the first of them on."""
    split = desk.put(f"split{tag}", cv.purged_walk_forward(data.select("symbol", "pos", "us", "t1"), s.wf_splits, s.embargo, s.min_train_frac))
    if split.isEmpty():
        raise RuntimeError("no fold of the walk-forward has rows to train and to test")
    proba = desk.put(f"proba{tag}", cv.oof_predict_proba(cv.make_classifier(seed, trees or s.trees), data, names, split))
    events = proba.join(data.select("symbol", "pos", "us", "t1", "side"), ["symbol", "pos"])
    position = desk.put(f"position{tag}", sizing.get_signal(events.select("symbol", "us", "t1", "p", "side"), 2, s.bet_step))
    first = events.groupBy("symbol").agg(F.min("us").alias("_first"))
    clock = desk.tables["bars"].join(first, "symbol").where("us >= _first").select("symbol", "us", "close")
    out = run_backtest(position, clock, CostModel(s.half_spread, s.commission), target=1.0)
    return BacktestResult(desk.put(f"path{tag}", out.path), desk.put(f"bets{tag}", out.bets), desk.put(f"summary{tag}", out.summary))


def study(spark: SparkSession, ticks: DataFrame, settings: Settings = Settings(), seed: int = 0, order: float | None = None, report: bool = False, sweep: bool = False) -> tuple[Study, Desk]:  # noqa: B008
    """The study of a tape (symbol, seq, us, price, volume, dollar). The desk's tables stay until desk.close().

    report adds the overlap audit, the comparison of cross-validations, and feature importance; sweep
    runs the grid of configurations that the deflated Sharpe ratio needs.
    """
    desk = Desk(spark)
    facts = sampled(desk, desk.put("ticks", ticks), settings)
    facts["d_star"] = least_order(desk) if order is None else order
    desk.put("features", fe.build_features(desk.tables["bars"], desk.tables["sums"], facts["d_star"]))
    data = dataset(desk, settings)
    names = fe.feature_names(True)
    facts["n_events"] = data.count()
    result = bets(desk, data, names, settings, seed)
    if report:
        labels = data.select("symbol", "pos", "us", "t1")
        desk.put("audit", cv.overlap_audit(labels, 5, settings.embargo))
        compared = cv.compare_cv(cv.make_classifier(seed, 200), data, names, labels, 5, settings.embargo)
        desk.put("protocols", spark.createDataFrame([(k, v["mean"], v["std"]) for k, v in compared.items()], "protocol string, mean double, std double"))
        folds = cv.purged_kfold(labels, 4, settings.embargo)
        table = importance.feature_importance_report(cv.make_classifier(seed, 150), data, names, folds, seed)
        desk.put("importance", spark.createDataFrame(table.reset_index(names="feature")))
    if sweep:
        facts |= deflated(desk, names, settings, seed)
    return Study(settings, desk.tables, facts, result), desk


def deflated(desk: Desk, names: list[str], settings: Settings, seed: int) -> dict[str, float]:
    """Trials over a grid: their number and the variance of their annual Sharpe ratios."""
    sharpes = []
    for k, (hours, (pt, sl), step) in enumerate(product((8, 12, 24), ((1.0, 1.0), (1.5, 1.0)), (0.05, 0.20))):
        s = replace(settings, holding_h=hours, pt=pt, sl=sl, bet_step=step)
        out = bets(desk, dataset(desk, s, f"_{k}"), names, s, seed, 100, f"_{k}")
        value = out.summary.where("metric = 'sharpe'").agg(F.avg("value")).first()[0]
        if value is not None:
            sharpes.append(float(value))
    return {"n_trials": max(len(sharpes), 1), "var_trials": st.variance(sharpes) if len(sharpes) > 1 else 0.0}


def console(done: Study) -> str:
    """The report in lines: what was measured, and the performance of each symbol."""
    lines = [f"{k} = {v:g}" for k, v in done.facts.items()] + [f"{k} = {v}" for k, v in asdict(done.settings).items()]
    for r in done.tables["summary"].orderBy("symbol", "metric").collect():  # some thirty rows a symbol
        lines.append(f"{r['symbol']:<12} {r['metric']:<28} {'' if r['value'] is None else format(r['value'], '.4f')}")
    return "\n".join(lines)
