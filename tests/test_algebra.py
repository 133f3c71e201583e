from math import inf, log, sqrt

import numpy as np
import pytest

from tallyspark.functions.distributions import Uniform
from tallyspark.operators import folds, posterior, setalgebra as alg
from tallyspark.operators.estimators import independent_histogram, venn_cardinalities
from tallyspark.operators.sketches import LiquidLegions


def strata_of(freqs, top):
    out = {k: frozenset() for k in range(top + 1)}
    for i, f in freqs:
        out[min(f, top)] |= {i}
        out[0] |= {i}
    return out


def histogram(state, top):
    return [sum(len(state[j]) for j in range(k, top + 1)) for k in range(1, top + 1)]


def test_stratified_merge():
    a = strata_of([(1, 2), (2, 3), (3, 1), (10, 1)], 3)
    b = strata_of([(1, 1), (3, 1), (4, 5), (5, 1)], 3)
    m = folds.merge_strata(a, b, 3, alg.ExactAlgebra())
    assert (m[1], m[2], m[3]) == ({5, 10}, {3}, {1, 2, 4})
    assert histogram(m, 3) == [6, 4, 3]


def test_stratified_merge_of_three():
    sets = [[(1, 2), (2, 3), (3, 1)], [(1, 1), (3, 1), (4, 5), (5, 1)], [(5, 1)]]
    state = None
    for s in sets:
        own = strata_of(s, 3)
        state = own if state is None else folds.merge_strata(state, own, 3, alg.ExactAlgebra())
    assert (state[1], state[2], state[3]) == (frozenset(), {3, 5}, {1, 2, 4})
    assert histogram(state, 3) == [5, 5, 3]


def test_stratified_merge_equals_adding_frequencies():
    rng = np.random.default_rng(0)
    for top in (2, 3, 5):
        a, b = ({i: int(rng.integers(1, 7)) for i in rng.choice(30, 15, replace=False)} for _ in range(2))
        m = folds.merge_strata(strata_of(a.items(), top), strata_of(b.items(), top), top, alg.ExactAlgebra())
        total = {i: a.get(i, 0) + b.get(i, 0) for i in {*a, *b}}
        assert {k: set(v) for k, v in m.items()} == {k: set(v) for k, v in strata_of(total.items(), top).items()}


def test_count_statistics():
    a, b = np.array([2.0, 2, 0, 0]), np.array([2.0, 0, 2, 0])
    for epsilon, common, sigma in ((1, 0, 6), (1, 4, sqrt(40)), (0.5, 0, 18), (0.5, 4, sqrt(328))):
        assert alg.CountAlgebra(True, epsilon).deviation(common, a, b) == pytest.approx(sigma)
    one = alg.CountAlgebra(True, 1)
    assert one.score(0, 0, a, b) == 0
    assert one.score(0, 4, a, b) == pytest.approx(-0.632, abs=1e-3)


def test_count_merge():
    one = np.array([1.0, 0.0])
    assert sorted(alg.CountAlgebra().merge(one, one)) == [0, 1.5]
    assert alg.CountAlgebra().prefix_sizes([one] * 3)[-1] == pytest.approx(1.75)
    assert alg.CountAlgebra().intersection_size(one, one) == pytest.approx(0.5)


RAW = np.array([1.0, 0, 1, 1, 0, 0]), np.array([0, 1.0, 1, 1, 0, 0])
CLEAN = np.array([1.5, -0.5, 1.5, 1.5, -0.5, -0.5]), np.array([-0.5, 1.5, 1.5, 1.5, -0.5, -0.5])


@pytest.mark.parametrize(
    "kind, pair, shared, mine",
    [
        ("bayesian", RAW, [0, 0, 0.742, 0.742, 0, 0], [1, 0, 0.524, 0.524, 0, 0]),
        ("bayesian", CLEAN, [-0.734, -0.734, 2.201, 2.201, 0.245, 0.245], [2.369, 0.369, -1.106, -1.106, -0.790, -0.790]),
        ("expectation", RAW, [0, 0, 0.698, 0.698, 0, 0], [1, 0, 0.441, 0.441, 0, 0]),
        ("expectation", CLEAN, [-0.614, -0.614, 1.843, 1.843, 0.205, 0.205], [2.25, 0.25, -0.75, -0.75, -0.75, -0.75]),
    ],
)
def test_filter_algebra(kind, pair, shared, mine):
    x = alg.FilterAlgebra(Uniform(6), kind)
    assert x.intersection(*pair) == pytest.approx(shared, abs=0.01)
    assert x.difference(*pair) == pytest.approx(mine, abs=0.01)
    one, two = np.eye(6)[:2]
    assert x.intersection(one, two).sum() == 0 and x.difference(one, two).tolist() == one.tolist()
    assert x.union(None, one) is one and x.intersection(None, one) is None and x.difference(one, None) is one


def test_fuzzy_union():
    x = alg.FilterAlgebra(Uniform(4))
    assert x.union(np.array([0.1, 0.9, 0.1, 0.9]), np.array([0.1, 0.1, 0.9, 0.9])) == pytest.approx([0.19, 0.91, 0.91, 0.99])


def test_independence():
    assert independent_histogram(independent_histogram([0], [50], 100), [50], 100) == pytest.approx([75, 25])
    two = independent_histogram([50, 20], [30, 10], 100)
    assert np.round(two).tolist() == [65, 34, 9, 2]
    with pytest.raises(ValueError):
        independent_histogram([0], [11], 10)


def test_venn_and_posterior():
    sketch = LiquidLegions(decay_rate=10.0, length=5000)
    rng = np.random.default_rng(2)
    hit = lambda ids: np.clip(np.floor(5000 * (1 - np.log(np.exp(10) + ids * (1 - np.exp(10))) / 10)).astype(int), 0, 4999)
    u = rng.random(3000)
    bits = [np.zeros(5000), np.zeros(5000)]
    bits[0][hit(u[:2000])] = 1
    bits[1][hit(u[1000:])] = 1
    v = posterior.venn_of(bits, [0.0, 0.0], sketch)
    assert v[1:] == pytest.approx([1000, 1000, 1000], rel=0.15)
    noised = [np.where(rng.random(5000) < 0.1, 1 - b, b) for b in bits]
    clean = posterior.sample(noised, [0.1, 0.1], sketch, rng)
    assert abs(clean[0].sum() - bits[0].sum()) < 0.1 * bits[0].sum()
    diff = posterior.sample_difference(bits, [0.0, 0.0], sketch, rng)
    assert np.all(diff <= bits[0])
    with pytest.raises(NotImplementedError):
        venn_cardinalities(np.ones(8), [0.1] * 3, sketch)


def test_infinite_budget_clips_nothing():
    a = alg.CountAlgebra(True, inf)
    assert a.clipped_empty(np.ones(4)).sum() == 4
    assert log(3) > 0
