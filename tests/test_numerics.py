"""Driver-side numerics against closed forms and hand-computed values."""

import math

import numpy as np
import pytest

from tickforge.functions import stats
from tickforge.operators import fracdiff, importance, jobs, sampling, sizing
from tickforge.operators.bars import InfoRule
from tickforge.operators.labeling import Cusum, EwmState


def test_weights_identities():
    assert np.allclose(fracdiff.get_weights(1, 5), [0, 0, 0, -1, 1])
    assert np.allclose(fracdiff.get_weights(0, 4), [0, 0, 0, 1])
    assert abs(fracdiff.get_weights_ffd(0.5, 1e-4)[0]) >= 1e-4


def test_unit_root_p_values():
    assert fracdiff.adf_p(-3.5880) == pytest.approx(0.00599, abs=5e-5)
    assert fracdiff.adf_critical(45_763) == pytest.approx(-2.8616, abs=1e-4)
    assert fracdiff.adf_p(5) == 1 and fracdiff.adf_p(-30) == 0


def test_implied_precision_and_expected_maximum():
    assert sizing.implied_precision(-0.01, 0.01, 250, 1) == pytest.approx(0.5316, abs=1e-4)
    assert stats.expected_max_sharpe(1, 1.0) == 0
    assert stats.expected_max_sharpe(12, 0.12217) == pytest.approx(0.58, abs=0.01)


def test_psr_needs_three_returns():
    assert math.isnan(stats.psr_value(2, 0.1, 0.1, 0.0, 0.0, 0.0, 252))


def test_bootstrap_by_prefix_sums_is_the_definition():
    start, end = np.array([0, 2, 4, 1]), np.array([2, 3, 5, 5])
    for seed in range(5):
        a = sampling.draw(start, end, 6, 8, np.random.default_rng(seed))
        assert a.tolist() == sampling.draw_reference(start, end, 6, 8, np.random.default_rng(seed)).tolist()


def test_cusum_fires_at_fixed_gaps_on_a_steady_rise():
    c = Cusum()
    fired = [i for i in range(40) if c.step(math.log(1.01), 0.045)]
    assert np.diff(fired).tolist() == [5] * (len(fired) - 1)


def test_ewm_deviation_matches_pandas():
    import pandas as pd

    x = np.random.default_rng(0).normal(size=50)
    s = EwmState()
    got = [s.step(v, 1 - 2 / 21) for v in x]
    assert got[0] is None
    assert np.allclose(got[1:], pd.Series(x).ewm(span=20).std().to_numpy()[1:])


def test_information_bars_wait_for_both_sides_and_obey_the_maximum():
    rule = InfoRule("imbalance", warm_up=3, least=1, most=10)
    s = rule.start()
    assert not any(rule.step(s, 1, 1.0) for _ in range(20))
    assert rule.step(s, -1, 1.0)


def test_eigen_vectors_keep_the_asked_share():
    values, vectors = importance.get_eigen_vectors(np.diag([5.0, 3.0, 1.0, 0.0]), 0.8)
    assert values.tolist() == [5.0, 3.0] and vectors.shape == (4, 2)


def test_cuts():
    assert jobs.lin_parts(10, 3).tolist() == [0, 4, 7, 10]
    cuts = jobs.nested_parts(100, 4)
    work = [sum(range(a, b)) for a, b in zip(cuts, cuts[1:])]
    assert max(work) / min(work) < 1.2
    assert jobs.nested_parts(100, 4, upper=True)[0] == 0
