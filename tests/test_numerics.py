import math

import numpy as np
import pytest

from tallyspark.functions import distributions as dist, numerics as n


def test_exponential_inverse():
    assert n.invert_exponential([3], 4, 1)[0] == pytest.approx(5.877, abs=1e-3)
    assert n.invert_exponential([1], 4, 1)[0] == pytest.approx(1.1645, abs=1e-3)
    assert n.invert_exponential([0], 4, 1)[0] == 0


def test_geometric_inverse():
    p = dist.Geometric(4, 0.6).probabilities()
    assert n.invert_fill([2], p)[0] == pytest.approx(3.38427734375, abs=2e-3)
    assert n.invert_fill([1], p)[0] == pytest.approx(1.0, abs=2e-3)


def test_bounds():
    assert dist.Geometric(4, 0.08).bounds() == pytest.approx([0.28208044, 0.54159445, 0.78034734, 1])
    assert dist.LogBucket(4).bounds() == pytest.approx([0.49373838, 0.77483521, 0.93154471, 1])
    assert dist.Exponential(4, 1.0) != dist.Exponential(4, 2.0)


def test_truncated_poisson():
    assert n.truncated_poisson(1, 4) == pytest.approx([0.3678794, 0.3678794, 0.1839397, 0.0803014], abs=1e-6)
    assert n.truncated_poisson(2, 3) == pytest.approx([0.1353353, 0.2706706, 0.5939942], abs=1e-6)
    with pytest.raises(ValueError):
        n.truncated_poisson(0, 3)


def test_flip_probability():
    assert n.flip_probability(math.log(3)) == pytest.approx(0.25)
    assert n.flip_probability(2 * math.log(3), 2) == pytest.approx(0.25)


def test_transitions_are_stochastic():
    t = n.transitions(3, 0.2)
    assert t.sum(axis=0) == pytest.approx(np.ones(4))
    c = n.combination_transitions([0.1, 0.3])
    assert c.sum(axis=0) == pytest.approx(np.ones(4))
    # sketch 0 is bit 0: pattern 0 shows as 1 when only sketch 0 flips
    assert c[1, 0] == pytest.approx(0.1 * 0.7)


def test_gaussian_sigma_meets_delta():
    s = n.gaussian_sigma(1.0, 1e-5)
    assert s == pytest.approx(3.7304, abs=1e-3)
    assert n.gaussian_sigma(1.0, 1e-5, num_queries=4) == pytest.approx(2 * s, rel=1e-6)


def test_monotone_inverse_extremes():
    got = n.invert_monotonic(lambda x: x * x, np.array([4.0, np.nan]))
    assert got[0] == pytest.approx(2, abs=1e-3) and np.isnan(got[1])
    assert np.isinf(n.invert_monotonic(np.tanh, np.array([2.0]))[0])
