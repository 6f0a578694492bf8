"""The whole study on a small simulated tape."""

import math

import pytest
from pyspark.sql import functions as F

from tickforge.plans import features as fe
from tickforge.plans import study as st
from tickforge.sources.ticks import TickSimConfig, simulate


@pytest.fixture(scope="module")
def done(spark):
    ticks = simulate(spark, {"sim": TickSimConfig(n_ticks=60_000, seed=12345)})
    s = st.Settings(bars_per_day=150, cusum_mult=0.2, holding_h=4, vol_horizon_h=2, wf_splits=2, trees=5)
    out, desk = st.study(spark, ticks, s, order=0.3)
    yield out
    desk.close()


def test_rows_are_aligned_and_answer_the_meta_question(done):
    data = done.tables["data"].toPandas()
    assert len(data) > 40 and set(data["y"]) <= {0, 1} and set(data["side"]) <= {-1.0, 1.0}
    assert (data["weight"] >= 0).all() and abs(data["weight"].mean() - 1) < 0.2 and (data["t1"] > data["us"]).all()
    assert not data[fe.feature_names(True)].isna().any().any()
    close = dict(zip(*done.tables["bars"].toPandas()[["us", "close"]].to_numpy().T))
    for r in data.itertuples():
        made = (close[r.t1] / close[r.us] - 1) * r.side
        assert made == pytest.approx(r.ret) and (made > done.settings.round_trip) == (r.y == 1)


def test_walk_forward_gives_a_coherent_backtest(done):
    data, proba = done.tables["data"].toPandas(), done.tables["proba"].toPandas()
    assert proba["pos"].min() >= int(len(data) * 0.4) and proba["p"].between(0, 1).all()
    path = done.tables["path"].orderBy("us").toPandas()
    assert path["position"].between(-1, 1).all() and path["equity"].iloc[-1] == pytest.approx((1 + path["ret"]).prod(), rel=1e-9)
    s = {r["metric"]: r["value"] for r in done.tables["summary"].collect()}
    assert s["total_cost"] > 0 and 0 <= s["max_drawdown"] <= 1 and math.isfinite(s["sharpe"]) and s["sharpe"] <= s["gross_sharpe"]
    assert "n_bars" in st.console(done) and done.tables["path"].where(F.col("cost") < 0).isEmpty()
