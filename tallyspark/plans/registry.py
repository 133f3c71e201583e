"""Named scenarios and methods.

A method's parameters are kept as columns (sketch, config, estimator, local and global privacy),
and its name is made from them, so that nothing has to be parsed back out of names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import product
from math import log, sqrt

from tallyspark.operators import sketches as sk
from tallyspark.plans import methods as m
from tallyspark.sources import generators as gen

#: Fixed values of the published evaluations.
NUM_RUNS, NUM_SETS, NUM_SETS_FREQUENCY = 100, 20, 10
UNIVERSE, SMOKE_UNIVERSE, FREQUENCY_UNIVERSE, FREQUENCY_SET = 1_000_000, 200_000, 200_000, 20_000
SMALL_RATE, LARGE_RATE, SMOKE_SMALL_RATE, SMOKE_LARGE_RATE, REMARKETING_RATE = 0.01, 0.2, 0.1, 0.2, 0.2
SHARES = (0.25, 0.5, 0.75)
STRESS_REACHES = (1_000, 10_000, 100_000, 1_000_000, 10_000_000)
LOCAL_EPSILONS = (log(3), log(3) / 4, log(3) / 10, None)
GLOBAL_EPSILONS = (log(3), None)
LIMIT_DIVISORS = (1, 2, 4, 10, *range(100, 1000, 100), *range(1000, 10_001, 1000))
BUDGETS = ((log(3), 1e-5), (log(3), 1e-6), (log(3), 1e-7), (None, None))
QUERY_NUMBERS = (1, 2, 4, 10, *range(100, 1000, 100), *range(1000, 10_001, 1000), 50_000, 100_000, 500_000, 1_000_000)
FILTER_LENGTHS, BLOOM_LENGTHS, VOC_LENGTHS = (100_000, 250_000), (5_000_000,), (1024, 4096)
DECAY, GEOMETRIC_PRODUCT, STRATIFIED_SPLIT = 10, 2, 0.5
FREQUENCY_RATES, FREQUENCY_CAPS, CONSTANT_FREQUENCIES = (0.5, 1, 1.5, 2), (3, 5, 10), (2, 3, 5, 10)


# ---- names ---------------------------------------------------------------------------------


def epsilon_name(kind: str, epsilon: float | None = None, decimals: int = 4) -> str:
    """'local_dp_1.0986', 'no_global_dp' and the like."""
    if kind not in ("local_dp", "global_dp"):
        raise ValueError(f"a kind of privacy is local_dp or global_dp, not {kind!r}")
    return f"no_{kind}" if epsilon is None else f"{kind}_{epsilon:.{decimals}f}"


def budget_name(kind: str, epsilon: float | None = None, delta: float | None = None, num_queries: int | None = 1, noise: str | None = None, decimals: int = 4) -> str:
    """'global_dp_1.0986,0.0000100-gaussian_noise-budget_split-4' and the like."""
    if epsilon is None:
        if delta is not None:
            raise ValueError(f"delta {delta} needs an epsilon")
        return epsilon_name(kind)
    tail = (f"-{noise}" if noise else "") + (f"-budget_split-{num_queries}" if num_queries else "")
    return f"{epsilon_name(kind, epsilon, decimals)},{delta or 0:.7f}{tail}"


def method_name(sketch: str, config: str, estimator: str, *, local_epsilon: float | None = None, global_epsilon: float | None = None, delta: float | None = None, num_queries: int | None = None, noise: str | None = None, max_frequency: int | None = None, decimals: int = 4) -> str:
    if any("-" in part for part in (sketch, config, estimator)):
        raise ValueError("parts of a method's name hold no dash")
    spent = epsilon_name("global_dp", global_epsilon, decimals) if num_queries is None else budget_name("global_dp", global_epsilon, delta, num_queries, noise, decimals)
    parts = [sketch, config, estimator, epsilon_name("local_dp", local_epsilon, decimals), spent]
    return "-".join(parts + [str(max_frequency)] * (max_frequency is not None))


def method(sketch: str, config: object, estimator: str, estimate: m.Estimate, *, local: float | None = None, spent: float | None = None, delta: float | None = None, queries: int | None = None, noise: str = "geometric", top: int | None = None, decimals: int = 4) -> m.Method:
    name = method_name(sketch, str(config), estimator, local_epsilon=local, global_epsilon=spent, delta=delta, num_queries=queries, noise=f"{noise}_noise" if queries else None, max_frequency=top, decimals=decimals)
    added = {} if spent is None else {"kind": noise, "epsilon": spent, "num_queries": queries or 1} | ({"delta": delta} if noise == "gaussian" else {})
    parts = {"sketch": sketch, "sketch_config": str(config), "estimator": estimator, "sketch_epsilon": local, "estimate_epsilon": spent, "estimate_delta": delta, "num_queries": queries, "max_frequency": top}
    return m.Method(name, estimate, top or 1, added, parts)


# ---- methods -------------------------------------------------------------------------------


def log_filter(length: int, local: float | None = None, spent: float | None = None) -> m.Method:
    return method("log_bloom_filter", length, "first_moment_log", m.filter_method(sk.logarithmic_filter(length), local), local=local, spent=spent)


def geo_filter(length: int, local: float | None = None, spent: float | None = None) -> m.Method:
    p = GEOMETRIC_PRODUCT / length
    return method("geo_bloom_filter", f"{length}_{p:.6f}", "first_moment_geo", m.filter_method(sk.geometric_filter(length, p), local), local=local, spent=spent)


def exp_filter(length: int, local: float | None = None, spent: float | None = None, **more) -> m.Method:
    return method("exp_bloom_filter", f"{length}_{DECAY}", "first_moment_exp", m.filter_method(sk.exponential_filter(length, DECAY), local), local=local, spent=spent, **more)


def uniform_filter(length: int, local: float | None = None, spent: float | None = None) -> m.Method:
    return method("bloom_filter", f"{length}_hash1", "union_estimator", m.filter_method(sk.uniform_filter(length), local), local=local, spent=spent)


def voc(length: int = 4096, local: float | None = None, spent: float | None = None) -> m.Method:
    return method("vector_of_counts", length, "sequential", m.voc_method(length, local), local=local, spent=spent, noise="laplace")


def independent(local: float | None = None, spent: float | None = None, universe: int = UNIVERSE) -> m.Method:
    return method("reach_using_voc", 1, f"independent_estimator_universe{universe}", m.independent_method(universe, local), local=local, spent=spent, noise="laplace")


def hll(length: int = 16384) -> m.Method:
    return method("hyper_log_log_plus", length, "hll_cardinality", m.hll_method(length))


def meta_exp(length: int, voc_length: int, local: float | None = None) -> m.Method:
    return method("exp_bloom_filter", f"{length}_{DECAY}", f"meta_voc_{voc_length}", m.meta_voc_method(sk.exponential_filter(length, DECAY), voc_length, local), local=local)


def meta_uniform(length: int, voc_length: int, local: float | None = None) -> m.Method:
    return method("bloom_filter", length, f"meta_voc_{voc_length}", m.meta_voc_method(sk.uniform_filter(length), voc_length, local), local=local)


def liquid(decay: float = 10.0, length: int = 100_000, flip: float | None = None, sequential: bool = True) -> m.Method:
    label = "sequential" if sequential else "union"
    return method("liquid_legions", f"{decay:g}_{length}" + (f"_flip{flip:g}" if flip else ""), label, m.liquid_method(decay, length, flip, sequential))


def stratified_voc(length: int, top: int, local: float | None = None, clip: bool = False) -> m.Method:
    return method("stratified_sketch_vector_of_counts", length, f"sequential_{'clip' if clip else 'no_clip'}", m.stratified_voc_method(length, top, local, clip), local=local, top=top)


def stratified_geo(length: int, top: int, local: float | None = None, spent: float | None = None) -> m.Method:
    p = GEOMETRIC_PRODUCT / length
    run = m.stratified_filter_method(sk.geometric_filter(length, p), top, "expectation", local, STRATIFIED_SPLIT)
    return method("stratified_sketch_geo_adbf", f"{length}_{p:.6f}", "first_moment_estimator_geo_expectation", run, local=local, spent=spent, top=top)


def stratified_exp(length: int, top: int, local: float | None = None, spent: float | None = None, kind: str = "expectation") -> m.Method:
    run = m.stratified_filter_method(sk.exponential_filter(length, DECAY), top, kind, local, STRATIFIED_SPLIT)
    return method("stratified_sketch_exp_adbf", f"{length}_{DECAY}", f"first_moment_estimator_exp_{kind}", run, local=local, spent=spent, top=top)


def exact(top: int) -> m.Method:
    return method("exact_multi_set", 10000, "lossless", m.exact_method(top), top=top)


def same_key(length: int, top: int, spent: float | None = None) -> m.Method:
    own = method("exp_same_key_aggregator", f"{length}_{DECAY}", "standardized_histogram", m.ska_method(length, DECAY, top, spent), spent=spent, top=top)
    # the estimator spends the budget itself
    return m.Method(own.name, own.estimate, top, {}, own.parts)


def cardinality_methods() -> Iterator[m.Method]:
    """All 567 configurations; building one plans nothing."""
    for make, length, local, spent in product((log_filter, exp_filter, geo_filter), FILTER_LENGTHS, LOCAL_EPSILONS, GLOBAL_EPSILONS):
        yield make(length, local, spent)
    for length, (spent, delta), queries, noise in product(FILTER_LENGTHS, BUDGETS, QUERY_NUMBERS, ("gaussian", "geometric")):
        yield exp_filter(length, None, spent, delta=delta, queries=queries, noise=noise)
    for length, divisor in product(FILTER_LENGTHS, LIMIT_DIVISORS):
        yield exp_filter(length, None, log(3) / divisor, decimals=8)
    for make, local, spent in product((partial(voc, 4096), independent), LOCAL_EPSILONS, GLOBAL_EPSILONS):
        yield make(local, spent)
    yield hll()
    for voc_length, length, local in product(VOC_LENGTHS, FILTER_LENGTHS, LOCAL_EPSILONS):
        yield meta_exp(length, voc_length, local)
    for voc_length, length, local in product(VOC_LENGTHS, BLOOM_LENGTHS, LOCAL_EPSILONS):
        yield meta_uniform(length, voc_length, local)


def frequency_methods(top: int) -> Iterator[m.Method]:
    """All 69 configurations."""
    for local, clip, length in product(LOCAL_EPSILONS, (False, True), VOC_LENGTHS):
        yield stratified_voc(length, top, local, clip)
    for local, spent, length, kind in product(LOCAL_EPSILONS, GLOBAL_EPSILONS, FILTER_LENGTHS, ("expectation", "bayesian")):
        yield stratified_exp(length, top, local, spent, kind)
    for local, spent, length in product(LOCAL_EPSILONS, GLOBAL_EPSILONS, FILTER_LENGTHS):
        yield stratified_geo(length, top, local, spent)
    yield exact(top)
    for spent, length in product(GLOBAL_EPSILONS, FILTER_LENGTHS):
        yield same_key(length, top, spent)


def find_methods(names: list[str], max_frequency: int = 1) -> list[m.Method]:
    """The named methods, in the order asked for."""
    known: dict[str, m.Method] = {}
    for found in (*cardinality_methods(), *frequency_methods(max_frequency)):
        known.setdefault(found.name, found)
    wrong = [n for n in names if n not in known]
    if wrong:
        raise ValueError(f"unknown methods {wrong}; valid ones are {', '.join(known)}")
    return [known[n] for n in names]


# ---- scenarios -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Scenario:
    name: str
    generator: gen.Generator


@dataclass(frozen=True)
class Evaluation:
    name: str
    num_runs: int
    scenarios: tuple[Scenario, ...]


def sizes(small: int, large: int, n: int) -> dict[str, list[int]]:
    """Schedules of set sizes that all scenarios share."""
    half = n // 2
    return {
        "all_small": [small] * n,
        "all_large": [large] * n,
        "1st_small_then_large": [small] + [large] * (n - 1),
        "1st_half_small_2nd_half_large": [small] * half + [large] * (n - half),
        "small_then_last_large": [small] * (n - 1) + [large],
        "gradually_smaller": [int(large / sqrt(i + 1)) for i in range(n)],
    }


def more_sizes(small: int, large: int, n: int) -> dict[str, list[int]]:
    """Those, and the schedules of the correlated scenarios."""
    half = n // 2
    return sizes(small, large, n) | {
        "large_then_last_small": [large] * (n - 1) + [small],
        "all_large_except_middle_small": [large] * half + [small] + [large] * (n - 1 - half),
        "1st_large_then_small": [large] + [small] * (n - 1),
        "all_small_except_middle_large": [small] * half + [large] + [small] * (n - 1 - half),
        "1st_half_large_2nd_half_small": [large] * half + [small] * (n - half),
        "repeated_small_large": ([small, large] * (half + 1))[:n],
    }


def named(*words: str, **values: object) -> str:
    return "-".join([*words, *(f"{k}:{v}" for k, v in values.items())])


def smoke_test(universe_size: int = SMOKE_UNIVERSE, num_runs: int = NUM_RUNS) -> Evaluation:
    small, large = int(universe_size * SMOKE_SMALL_RATE), int(universe_size * SMOKE_LARGE_RATE)
    n = NUM_SETS
    return Evaluation("smoke_test", num_runs, (
        Scenario("independent", gen.Independent(universe_size, [large] * n)),
        Scenario("remarketing", gen.Independent(int(universe_size * REMARKETING_RATE), [large] * n)),
        Scenario("fully_overlapping", gen.FullyOverlapping(universe_size, n, large)),
        Scenario("sequentially_correlated_all", gen.SequentiallyCorrelated("original", "all", 0.5, [small] * n)),
        Scenario("sequentially_correlated_one", gen.SequentiallyCorrelated("original", "one", 0.5, [small] * n)),
    ))


def frequency_smoke_test(universe_size: int = SMOKE_UNIVERSE, num_runs: int = NUM_RUNS) -> Evaluation:
    own, n = [int(universe_size * SMOKE_SMALL_RATE)] * NUM_SETS_FREQUENCY, NUM_SETS_FREQUENCY
    return Evaluation("frequency_smoke_test", num_runs, (
        Scenario("homogeneous", gen.homogeneous(universe_size, own, [1] * n, 3)),
        Scenario("heterogeneous", gen.Heterogeneous(universe_size, own, [(1, 1)] * n, 3)),
        Scenario("publisher_constant", gen.PublisherConstant(universe_size, own, 3)),
    ))


def complete_test(universe_size: int = UNIVERSE, num_runs: int = NUM_RUNS, num_sets: int = NUM_SETS, order: str = "random") -> Evaluation:
    """101 scenarios of reach."""
    small, large = int(universe_size * SMALL_RATE), int(universe_size * LARGE_RATE)
    out: list[Scenario] = []
    for word, universe in (("independent", universe_size), ("remarketing", int(universe_size * REMARKETING_RATE))):
        for kind, own in sizes(small, large, num_sets).items():
            out.append(Scenario(named(word, universe_size=universe_size, small_set=small, large_set=large, set_type=kind), gen.Independent(universe, own)))
    for association in ("independent", "identical"):
        for kind, own in sizes(small, large, num_sets).items():
            out.append(Scenario(named("exponential_bow", user_activity_association=association, universe_size=universe_size, small_set=small, large_set=large, set_type=kind), gen.ExponentialBow(association, universe_size, own)))
    for size in (small, large):
        out.append(Scenario(named("fully_overlapped", universe_size=universe_size, num_sets=num_sets, set_sizes=size), gen.FullyOverlapping(universe_size, num_sets, size)))
    for many in (1, num_sets // 2, num_sets - 1):
        out.append(Scenario(named("subset", universe_size=universe_size, order=order, num_large_sets=many, num_small_sets=num_sets - many, large_set_size=large, small_set_size=small), gen.Subset(order, universe_size, many, num_sets - many, large, small)))
    for with_, share, (kind, own) in product(("one", "all"), SHARES, more_sizes(small, large, num_sets).items()):
        out.append(Scenario(named("sequentially_correlated", order=order, correlated_sets=with_, shared_prop=share, set_type=kind, large_set_size=large, small_set_size=small), gen.SequentiallyCorrelated(order, with_, share, own)))
    return Evaluation("complete_test_with_selected_parameters", num_runs, tuple(out))


def complete_frequency_test(universe_size: int = FREQUENCY_UNIVERSE, num_runs: int = NUM_RUNS, num_sets: int = NUM_SETS_FREQUENCY, set_size: int = FREQUENCY_SET) -> Evaluation:
    """28 scenarios of frequency."""
    own, out = [set_size] * num_sets, []
    for rate, cap in product(FREQUENCY_RATES, FREQUENCY_CAPS):
        out.append(Scenario(named("homogeneous", universe_size=universe_size, num_sets=num_sets, freq_rate=rate, freq_cap=cap), gen.homogeneous(universe_size, own, [rate] * num_sets, cap)))
    for rate, cap in product(FREQUENCY_RATES, FREQUENCY_CAPS):
        out.append(Scenario(named("heterogeneous", universe_size=universe_size, num_sets=num_sets, distribution_rate=rate, freq_cap=cap), gen.Heterogeneous(universe_size, own, [(1, rate)] * num_sets, cap)))
    for frequency in CONSTANT_FREQUENCIES:
        out.append(Scenario(named("publisher_constant_frequency", universe_size=universe_size, num_sets=num_sets, frequency=frequency), gen.PublisherConstant(universe_size, own, frequency)))
    return Evaluation("complete_frequency_test_with_selected_parameters", num_runs, tuple(out))


def stress_test(universe_size: int | None = None, num_runs: int = NUM_RUNS) -> Evaluation:
    return Evaluation("global_dp_stress_test", num_runs, tuple(Scenario(f"{i}-reach:{r}", gen.Disjoint([r])) for i, r in enumerate(STRESS_REACHES)))


def frequency_end_to_end_test(universe_size: int = 10_000, num_runs: int = NUM_RUNS) -> Evaluation:
    own = [int(universe_size * 0.1)] * 3
    return Evaluation("frequency_end_to_end_test", num_runs, (Scenario(named("subset", universe_size=universe_size, num_sets=3), gen.homogeneous(universe_size, own, [1, 2, 3], 5)),))


EVALUATIONS: dict[str, Callable[..., Evaluation]] = {
    "smoke_test": smoke_test,
    "complete_test_with_selected_parameters": complete_test,
    "global_dp_stress_test": stress_test,
    "frequency_end_to_end_test": frequency_end_to_end_test,
    "frequency_smoke_test": frequency_smoke_test,
    "complete_frequency_test_with_selected_parameters": complete_frequency_test,
}


def find_evaluation(name: str, **options) -> Evaluation:
    if name not in EVALUATIONS:
        raise ValueError(f"unknown evaluation {name!r}; valid ones are {', '.join(EVALUATIONS)}")
    found = EVALUATIONS[name](**options)
    twice = [s.name for s in found.scenarios]
    if len(set(twice)) < len(twice):
        raise ValueError(f"scenario names of {name} are not distinct")
    return found
