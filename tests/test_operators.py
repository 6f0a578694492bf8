"""Operators on small tapes against hand-computed values, and windows that split a symbol against those that don't."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickforge.functions import stats
from tickforge.functions.windows import carried, rolling, running
from tickforge.operators import bars, cv, labeling, sampling, sizing

HOUR = 3_600_000_000


def tape(spark, prices, volume=1):
    return spark.createDataFrame([("s", i + 1, i * HOUR, p, volume, p * volume) for i, p in enumerate(prices)], "symbol string, seq long, us long, price double, volume long, dollar double")


def closes(spark, prices):
    return spark.createDataFrame([("s", i, i * HOUR, float(p)) for i, p in enumerate(prices)], "symbol string, bar_seq long, us long, close double")


def test_tick_rule(spark):
    got = bars.tick_rule(tape(spark, [10.0, 10.0, 10.1, 10.1, 10.0, 10.0]), size=2).orderBy("seq").collect()
    assert [r["sign"] for r in got] == [1, 1, 1, 1, -1, -1]


def test_bars_conserve_volume_and_drop_the_partial_one(spark):
    got = bars.tick_bars(tape(spark, [1.0, 3.0, 2.0, 5.0, 4.0]), 2).orderBy("bar_seq").collect()
    assert [(r["open"], r["high"], r["low"], r["close"]) for r in got] == [(1, 3, 1, 3), (2, 5, 2, 5)]
    with pytest.raises(ValueError):
        bars.standard_bars(tape(spark, [1.0]), 1, "hours")
    with pytest.raises(ValueError):
        bars.raise_if_empty(bars.tick_bars(tape(spark, [1.0]), 5))


def test_blocks_equal_whole_windows(spark):
    df = tape(spark, [float((i * 7) % 11) for i in range(50)])
    small = running(df, "seq", {"c": "price"}, size=8).select("seq", "c")
    assert small.exceptAll(running(df, "seq", {"c": "price"}).select("seq", "c")).count() == 0
    v = F.when(F.col("price") > 8, F.col("price"))
    assert carried(df, "seq", "l", v, 8).select("seq", "l").exceptAll(carried(df, "seq", "l", v).select("seq", "l")).count() == 0
    stage = [lambda w: {"m": F.sum("price").over(w.rowsBetween(-4, 0))}]
    assert rolling(df, "seq", 5, stage, 8).select("seq", "m").exceptAll(rolling(df, "seq", 5, stage).select("seq", "m")).count() == 0


def test_barriers_on_a_step_path(spark):
    b = closes(spark, [100, 100.5, 102.5, 103, 99, 97, 100, 100, 100, 100, 100])
    e = spark.createDataFrame([("s", 0, 5 * HOUR, 0.02)], "symbol string, us long, t1 long, trgt double").withColumn("side", F.lit(1.0))
    r = labeling.touches(b, e, 1.0, 1.0).first()
    assert (r["pt_us"], r["sl_us"]) == (2 * HOUR, 5 * HOUR)
    r = labeling.touches(b, e, 0.0, 1.0).first()
    assert r["pt_us"] is None


def test_uniqueness_of_toy_intervals(spark):
    b = closes(spark, [1] * 6)
    l = spark.createDataFrame([("s", 0, 2 * HOUR), ("s", 2 * HOUR, 3 * HOUR), ("s", 4 * HOUR, 5 * HOUR)], "symbol string, us long, t1 long")
    got = [r["tW"] for r in sampling.avg_uniqueness(l, b).orderBy("us").collect()]
    assert got == pytest.approx([5 / 6, 3 / 4, 1])
    again = [r["tW"] for r in sampling.indicator_uniqueness(sampling.indicator(l, b)).orderBy("us").collect()]
    assert again == pytest.approx(got)


def test_purging_shapes(spark):
    day = 24 * HOUR
    l = spark.createDataFrame([("s", d * day, e * day) for d, e in ((1, 4), (3, 7), (5, 6), (9, 10))], "symbol string, us long, t1 long")
    t = spark.createDataFrame([("s", 4 * day, 6 * day)], "symbol string, lo long, hi long")
    assert [r["us"] for r in cv.get_train_times(l, t).collect()] == [9 * day]


def test_folds_partition_and_purge(spark):
    l = spark.range(100).select(F.lit("s").alias("symbol"), F.col("id").alias("pos"), (F.col("id") * HOUR).alias("us"), ((F.col("id") + 5) * HOUR).alias("t1"))
    s = cv.purged_kfold(l, 4, 0.0)
    assert s.where("role = 'test'").select("pos").distinct().count() == 100
    audit = {r["protocol"]: r["contaminated"] for r in cv.overlap_audit(l, 4, 0.0).collect()}
    assert audit["naive"] > 0 and audit["purged"] == 0


def test_active_signals_are_half_open(spark):
    s = spark.createDataFrame([("s", 1, 4, 1.0), ("s", 2, 3, 1.0), ("s", 3, 5, 1.0)], "symbol string, us long, t1 long, signal double")
    got = {r["us"]: r["position"] for r in sizing.avg_active_signals(s).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 0.0}


def test_grid_rounding(spark):
    df = spark.createDataFrame([(x,) for x in (-1.4, -0.11, 0.0, 0.13, 0.9, 1.7)], "x double")
    got = [r[0] for r in df.select(sizing.discrete_signal(F.col("x"), 0.1)).collect()]
    assert got == pytest.approx([-1, -0.1, 0, 0.1, 0.9, 1])


def test_drawdown_of_an_equity_path(spark):
    df = spark.createDataFrame([("s", i, float(e)) for i, e in enumerate([1, 1.2, 0.9, 1, 1.3, 1.25])], "symbol string, us long, equity double")
    assert max(r["drawdown"] for r in stats.drawdowns(df).collect()) == pytest.approx(0.25)


def test_bet_timing(spark):
    df = spark.createDataFrame([("s", i, p) for i, p in enumerate([0.5, 0.5, 0.0, -0.5, -0.5, 0.5, 0.5])], "symbol string, us long, position double")
    assert [r["us"] for r in stats.bet_timing(df).orderBy("us").collect()] == [2, 5, 6]


def test_models_learn_from_the_events_table(spark, tmp_path):
    from tickforge import queries as q

    r = np.random.default_rng(3)
    n = 6000
    rows = pd.DataFrame({"event_id": np.arange(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n) * 5, unit="min"), "user_id": 1, "event_type": np.where(r.random(n) < 0.5, "a", "b"), "value": 100 + np.cumsum(r.normal(0, 1, n)) % 60, "props": [f'{{"k":{k}}}' for k in r.integers(0, 100, n)]})
    spark.createDataFrame(rows).withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    d = str(tmp_path)
    data, names, split = q.learned(spark, d)
    at = {(x["symbol"], x["us"]) for x in data.collect()}
    bars = [(x["symbol"], x["us"]) for x in q.bars(spark, d).orderBy("symbol", "bar_seq").collect()]
    inside = [b for s in "ab" for b in [x for x in bars if x[0] == s][60:-40]]
    labelled = {(x["symbol"], x["us"]) for x in q.target(spark, d).where("trgt > 0.01").collect()}
    assert {x for x in inside if x in labelled} <= at and len(at) > 50  # every bar is an event
    tested = {(x["symbol"], x["pos"]) for x in split.where("role = 'test'").collect()}
    assert {(x["symbol"], x["pos"]) for x in q.Q["cv8_oof_predict_proba"](spark, d).collect()} == tested and {x[0] for x in tested} == {"a", "b"}
    assert {x["feature"] for x in q.Q["im2_feat_imp_mda"](spark, d).collect()} == set(names)
    assert q.Q["im5_ortho_features"](spark, d).count() == len(at) and q.Q["cv4_cv_score"](spark, d).count() == 2


def costs_of(path):
    return {r["metric"]: r["value"] for r in path.summary.collect()}


def test_backtest_laws(spark):
    from tickforge.operators import backtest

    r = np.random.default_rng(0)
    b = closes(spark, 100 * np.exp(np.cumsum(r.normal(0, 0.004, 200))))
    signs = [("s", i * HOUR, float(np.sign(np.sin(i / 7)))) for i in range(0, 200, 3)]
    p = spark.createDataFrame(signs, "symbol string, us long, position double")
    path = {x["us"]: x for x in backtest.backtest_path(p, b).collect()}
    prices = [x["close"] for x in b.orderBy("us").collect()]
    known = dict((u, v) for _, u, v in signs)
    held = 0.0
    for i in range(200):  # a position known at a bar earns from the next one on
        if i:
            assert path[i * HOUR]["gross"] == pytest.approx(held * (prices[i] / prices[i - 1] - 1))
        held = known.get(i * HOUR, held)
    free, dear = (backtest.run_backtest(p, b, backtest.CostModel(c, 0.0)) for c in (0.0, 0.01))
    assert costs_of(free)["total_cost"] == 0 and costs_of(dear)["sharpe"] < costs_of(free)["sharpe"] == pytest.approx(costs_of(free)["gross_sharpe"])
    late = backtest.backtest_path(p.where(F.col("us") > 50 * HOUR), b).where(F.col("us") <= 50 * HOUR)
    assert late.where("position <> 0 OR equity <> 1").isEmpty()


def test_blocks_of_time_equal_whole_symbols(spark):
    from tickforge.functions.windows import as_of

    r = np.random.default_rng(1)
    clock = spark.createDataFrame([("s", int(u), int(u)) for u in np.unique(r.integers(0, 3000, 80))], "symbol string, us long, v long")
    points = spark.createDataFrame([("s", int(u), k) for k, u in enumerate(r.integers(-50, 3100, 200))], "symbol string, us long, k long")
    times = sorted(x["us"] for x in clock.collect())
    for forward in (False, True):
        for exact in (False, True):
            got = {x["k"]: (x["us"], x["v"]) for x in as_of(points, clock, ["v"], forward, exact, 100).collect()}
            for u, v in got.values():
                ok = [t for t in times if (t > u if forward else t < u) or (exact and t == u)]
                assert v == ((min if forward else max)(ok) if ok else None)


def test_bet_ends_leave_no_residue(spark):
    s = spark.createDataFrame([("s", k, k + 7, [0.1, 0.2, -0.3, 0.7][k % 4]) for k in range(40)], "symbol string, us long, t1 long, signal double")
    got = {r["us"]: r["position"] for r in sizing.avg_active_signals(s).collect()}
    assert got[46] == 0.0 and all(p == 0 or abs(p) > 1e-9 for p in got.values())
