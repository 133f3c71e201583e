import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.functions import distributions as dist, noise
from tallyspark.functions.hashing import hash_id
from tallyspark.operators import estimators as est, folds, noisers, prefixes, setalgebra as alg, sketches as sk
from tallyspark.plans import analyze, registry, report, simulate
from tallyspark.sources import generators as gen


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_exact_histogram(imps):
    assert est.as_list(est.exact_histogram(imps([1, 2, 3, 1, 2, 1]))) == [3, 2, 1]
    many = [1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 1, 2, 3, 1, 2, 1, 1]
    assert est.as_list(est.exact_histogram(imps(many)))[:2] == [6, 4]
    assert est.as_list(est.exact_histogram(imps([]))) == [0]
    assert est.less_one_list(est.exact_histogram(imps([1, 2], [1, 3, 4]))) == [3, 0]
    assert est.less_one_list(est.exact_histogram(imps([1, 1, 2, 2, 3, 3, 3]))) == [2, 2, 0]
    with pytest.raises(ValueError):
        est.less_one_list(est.exact_histogram(imps([])))


def test_simulation_truth(imps):
    df = imps([1, 1, 1, 2, 2, 3], [1, 1, 1, 3, 3, 4])
    rows = simulate.raw_results(df, registry.exact(3), 1, 3).orderBy("num_sets").collect()
    assert [tuple(r)[:8] for r in rows] == [(1, 3, 2, 1, 3, 2, 1, 0), (2, 4, 3, 2, 4, 3, 2, 0)]
    assert rows[0].run_index == 0 and rows[0].relative_error_1 == 0


def test_shuffle_distance(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert value(spark, simulate.shuffle_distance(arr(1), arr(1))) == 0
    assert value(spark, simulate.shuffle_distance(arr(1, 1), arr(1))) == 1
    assert value(spark, simulate.shuffle_distance(arr(2, 1, 0), arr(2, 2, 1))) == 0.5
    with pytest.raises(Exception, match="empty"):
        value(spark, simulate.shuffle_distance(F.array().cast("array<double>"), arr(1)))


def test_extend_histogram(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert value(spark, simulate.extend_histogram(F.array().cast("array<double>"), 1)) == [0]
    for k, want in ((1, [3]), (2, [3, 2]), (3, [3, 2, 1]), (5, [3, 2, 1, 0, 0])):
        assert value(spark, simulate.extend_histogram(arr(3, 2, 1), k)) == want


def test_relative_error(spark):
    f = lambda a, b: value(spark, simulate.relative_error(F.lit(a), F.lit(b)))
    assert f(3.0, 2) == 0.5 and math.isnan(f(0.0, 0)) and f(1.0, 0) == math.inf


def test_first_moments(spark):
    one = F.lit(1)
    assert value(spark, est.uniform_cardinality(one, 4)) == pytest.approx(1.151, abs=1e-3)
    assert value(spark, est.logarithmic_cardinality(one, 4)) == pytest.approx(4 / 3)
    assert value(spark, est.exponential_cardinality(one, 4, 1.0)) == pytest.approx(1.1645, abs=1e-3)
    assert value(spark, est.geometric_cardinality(one, dist.Geometric(4, 0.6))) == pytest.approx(1.0005, abs=2e-3)
    assert value(spark, est.geometric_cardinality(F.lit(2), dist.Geometric(4, 0.6))) == pytest.approx(3.38427734375, abs=2e-3)
    assert value(spark, est.geometric_cardinality(F.lit(4), dist.Geometric(4, 0.6))) == 0
    assert math.isnan(value(spark, est.uniform_cardinality(F.lit(4), 4)))
    assert math.isnan(value(spark, est.uniform_cardinality(F.lit(-1), 4)))
    with pytest.raises(Exception, match="full"):
        value(spark, est.bloom_cardinality(F.lit(4), 4))


def test_hll_table(spark):
    bits = spark.createDataFrame([(0b00010000,), (0b00010001,), (0b00011000,), (0b11110000,), (0b01000100,)], "id long")
    reg, rho = dist.leading_zero_rank(F.col("id"), 4, 8)
    assert [tuple(r) for r in bits.select(reg, rho).collect()] == [(1, 5), (1, 4), (1, 1), (15, 5), (4, 2)]
    assert value(spark, est.hll_cardinality(F.lit(16), F.lit(8.0), 16)) == pytest.approx(0.673 * 16**2 * 2 / 16)


def test_hll_accuracy(spark):
    df = spark.range(200_000).select(F.lit(0).alias("run_index"), (F.col("id") % 2 + 1).cast("int").alias("set_index"), "id")
    got = [r.estimate for r in est.hll_prefixes(df, sk.HyperLogLog(length=4096, seed=3)).orderBy("num_sets").collect()]
    assert got == pytest.approx([100_000, 200_000], rel=0.05)


def test_unique_key_and_compatibility(imps):
    one = sk.AnySketch(distributions=(dist.Uniform(1),), value="unique")
    assert one.build(imps([5, 5])).first().value == 6
    assert one.build(imps([5, 6])).first().value == -1
    with pytest.raises(ValueError):
        sk.AnySketch(distributions=(dist.Uniform(4),), value="max")
    with pytest.raises(ValueError, match="decay_rate|distributions"):
        sk.exponential_filter(4, 1.0).check_compatible(sk.exponential_filter(4, 2.0))
    with pytest.raises(ValueError):
        sk.HyperLogLog(length=100)


def test_bloom_has_no_false_negatives(imps):
    df = imps(range(100))
    bloom = sk.bloom_filter(4000, 3, 5)
    hits = {r.id for r in bloom.contains(bloom.build(df), imps(range(200))).collect()}
    assert set(range(100)) <= hits and len(hits) < 120


def test_merge_is_order_free_and_idempotent(imps):
    a, b = imps(range(50)), imps(range(25, 80))
    for sketch in (sk.uniform_filter(64), sk.HyperLogLog(length=16)):
        own = sketch.build(a.union(b))
        both = sketch.merge(sketch.build(a).unionByName(sketch.build(b)), "run_index", "set_index")
        again = sketch.merge(sketch.build(b).unionByName(sketch.build(a)).unionByName(sketch.build(a)), "run_index", "set_index")
        want = sorted(map(tuple, own.select(*sorted(own.columns)).collect()))
        for x in (both, again):
            assert sorted(map(tuple, x.select(*sorted(own.columns)).collect())) == want


def test_prefix_statistics_match_brute_force(imps):
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 60, 40).tolist() for _ in range(4)]
    got = {(r.num_sets, r.frequency_level): r.cardinality for r in prefixes.level_reach(imps(*sets), 3).collect()}
    for n in range(1, 5):
        seen = {}
        for s in sets[:n]:
            for i in s:
                seen[i] = seen.get(i, 0) + 1
        for k in (1, 2, 3):
            assert got[n, k] == sum(v >= k for v in seen.values())


def test_harmonic_sums_match_brute_force(imps):
    rng = np.random.default_rng(5)
    df = imps(*[rng.integers(0, 10_000, 30).tolist() for _ in range(4)])
    hll = sk.HyperLogLog(length=16)
    regs = hll.build(df).collect()
    for r in prefixes.harmonic_sums(hll.build(df), prefixes.set_grid(df)).collect():
        top = {}
        for x in regs:
            if x.set_index <= r.num_sets:
                top[x.register] = max(top.get(x.register, 0), x.rho)
        assert r.active == len(top) and r.powers == pytest.approx(sum(2.0**-v for v in top.values()))


def test_noise_moments_and_repartitioning(spark):
    ids = spark.range(50_000)
    flips = ids.select(noise.flip_bit(F.lit(0), 0.25, 0.25, 1, F.col("id")).alias("v"))
    assert flips.agg(F.avg("v")).first()[0] == pytest.approx(0.25, abs=0.01)
    lap = ids.select(noise.laplace(1 / math.log(3), 1, F.col("id")).alias("v"))
    assert lap.agg(F.var_samp("v")).first()[0] == pytest.approx(1.657, rel=0.05)
    geo = ids.select(noise.geometric(math.log(3), 1, F.col("id")).alias("v"))
    assert geo.agg(F.var_samp("v")).first()[0] == pytest.approx(1.5, rel=0.05)
    h = lambda df: df.agg(F.sum(hash_id(F.col("id"), 3, modulus=1000))).first()[0]
    assert h(ids) == h(ids.repartition(7))


def test_denoise(spark):
    bits = spark.createDataFrame([(0, 1, 0, 1), (0, 1, 1, 0)], "run_index int, set_index int, register int, value int")
    got = [r.value for r in noisers.denoise(bits, epsilon=math.log(3)).orderBy("register").collect()]
    assert got == pytest.approx([1.5, -0.5])
    with pytest.raises(ValueError):
        noisers.denoise(bits, epsilon=1.0, num_hashes=2)
    with pytest.raises(ValueError):
        noisers.noised_legions(bits, bits, 4, 0.1, 1)


def test_noised_union_is_unbiased(imps):
    method = registry.exp_filter(20_000, math.log(3))
    df = imps(range(3000), range(2000, 4000))
    got = [r.estimate for r in method.levels(df, 3).orderBy("num_sets").collect()]
    assert got == pytest.approx([3000, 4000], rel=0.25)


def test_legions_accuracy(imps):
    df = imps(range(4000), range(2000, 6000))
    for method, rel in ((registry.liquid(10.0, 20_000, None, False), 0.05), (registry.liquid(10.0, 20_000, 0.1, False), 0.15), (registry.liquid(10.0, 20_000, 0.1, True), 0.15)):
        got = [r.estimate for r in method.levels(df, 3).orderBy("num_sets").collect()]
        assert got == pytest.approx([4000, 6000], rel=rel)


def test_same_key_histogram(imps):
    df = imps([i for i in range(900) for _ in range(i % 3 + 1)])
    got = [r.estimate for r in registry.same_key(50_000, 4).levels(df, 3, 4).orderBy("frequency_level").collect()]
    assert got[0] == pytest.approx(900, rel=0.05) and got[1] == pytest.approx(600, rel=0.1) and got[3] == 0


def test_stratified_estimates(imps):
    df = imps([i for i in range(3000) for _ in range(i % 2 + 1)], list(range(1500, 4000)))
    truth = [r.cardinality for r in prefixes.level_reach(df, 3).where("num_sets = 2").orderBy("frequency_level").collect()]
    for method in (registry.stratified_voc(1024, 3), registry.stratified_exp(20_000, 3), registry.stratified_exp(20_000, 3, kind="bayesian")):
        got = [r.estimate for r in method.levels(df, 3).where("num_sets = 2").orderBy("frequency_level").collect()]
        assert got[0] == pytest.approx(truth[0], rel=0.15), method.name


def test_voc_and_meta(imps):
    df = imps(range(4000), range(2000, 6000))
    for method in (registry.voc(), registry.meta_exp(100_000, 4096)):
        got = [r.estimate for r in method.levels(df, 3).orderBy("num_sets").collect()]
        assert got == pytest.approx([4000, 6000], rel=0.1)


def test_independent_reach(spark):
    reach = spark.createDataFrame([(0, 1, 50), (0, 2, 50)], "run_index int, set_index int, reach int")
    assert [r.estimate for r in est.independent_reach(reach, 100).orderBy("num_sets").collect()] == pytest.approx([50, 75])


def test_generators(spark):
    sizes = lambda g, runs=2: sorted((r.run_index, r.set_index, r["count"]) for r in g.generate(spark, runs, 9).groupBy("run_index", "set_index").count().collect())
    assert sizes(gen.Independent(1000, [10, 400])) == [(r, s, n) for r in (0, 1) for s, n in ((1, 10), (2, 400))]
    assert sizes(gen.Independent(100, [100]), 1) == [(0, 1, 100)]
    correlated = gen.SequentiallyCorrelated("original", "all", 0.2, [10, 15, 20, 20])
    assert correlated.overlaps() == [0, 3, 4, 4]
    assert gen.SequentiallyCorrelated("original", "one", 0.5, [1, 10]).overlaps() == [0, 1]
    rows = correlated.generate(spark, 1, 9).collect()
    sets = [{r.id for r in rows if r.set_index == k} for k in range(1, 5)]
    assert [len(s) for s in sets] == [10, 15, 20, 20]
    assert [len(sets[i] & set().union(*sets[:i])) for i in range(1, 4)] == [3, 4, 4]
    for order in gen.ORDERS:
        assert {n for *_, n in sizes(gen.Subset(order, 500, 2, 1, 100, 20))} == {100, 20}
    assert {n for *_, n in sizes(gen.PublisherConstant(100, [1, 2, 3], 3), 1)} == {3, 6, 9}
    assert [r.id for r in gen.Disjoint([1, 2]).generate(spark, 1).orderBy("id").collect()] == [0, 1, 2]
    bow = gen.ExponentialBow("identical", 2000, [100, 500])
    assert all(n <= s for (_, k, n), s in zip(sizes(bow), [100, 500] * 2))
    with pytest.raises(ValueError):
        gen.ExponentialBow("identical", 100, [10])
    with pytest.raises(ValueError):
        gen.HomogeneousPmf(100, [10], [[0.5, 0.4]])
    hetero = gen.Heterogeneous(2000, [1000], [(2.0, 0.5)], 4).generate(spark, 1, 3).groupBy("id").count().agg(F.max("count"), F.avg("count")).first()
    assert hetero[0] <= 4 and hetero[1] == pytest.approx(1.97, abs=0.15)
    draws = gen.ParameterSampler({"a": lambda r: r.integers(10), "b": lambda r: r.random()})
    assert draws(1) == draws(1) and set(draws(1)) == {"a", "b"}


def test_add_random_elements(imps):
    got = noisers.add_random_elements(imps(range(10)), 5, 1000, 1).collect()
    assert len({r.id for r in got}) == 15


def test_estimable_sets(spark):
    errors = {1: [0] * 4, 2: [0, 0, 1, -1], 3: [1, 1, -1, -1], 4: [0.5, -0.5, -1, 1]}
    rows = [("m", "s", n, r, float(e)) for n, es in errors.items() for r, e in enumerate(es)]
    raw = spark.createDataFrame(rows, "sketch_estimator string, scenario string, num_sets int, run_index int, relative_error_1 double")
    crit = analyze.criteria_table(spark, [(0.5, 0.5), (0.1, 0.9)])
    found = {r.error_margin: r.num_estimable_sets for r in analyze.estimable_sets(raw, crit).collect()}
    assert found == {0.5: 2, 0.1: 0}
    stats = {r.error_margin: r.relative_error_1_mean for r in analyze.error_at_estimable(raw, analyze.estimable_sets(raw, crit)).collect()}
    assert stats == {0.5: 0, 0.1: None}


def test_long_and_per_frequency(spark):
    rows = [("m", "s", 0, 1, 6.0, 4.0, 7, 3)]
    raw = spark.createDataFrame(rows, "sketch_estimator string, scenario string, run_index int, num_sets int, estimated_cardinality_1 double, estimated_cardinality_2 double, true_cardinality_1 long, true_cardinality_2 long")
    long = analyze.long_frequencies(raw)
    assert long.count() == 4
    got = {(r.source, r.frequency_level): r.cardinality for r in analyze.per_frequency(long).collect()}
    assert got == {("estimated_cardinality", 1): 2, ("estimated_cardinality", 2): 4, ("true_cardinality", 1): 4, ("true_cardinality", 2): 3}
    with pytest.raises(ValueError):
        analyze.box_plot(raw)


def test_registry():
    assert sum(1 for _ in registry.cardinality_methods()) == 567
    assert sum(1 for _ in registry.frequency_methods(5)) == 69
    assert len(registry.find_evaluation("complete_test_with_selected_parameters").scenarios) == 101
    assert len(registry.find_evaluation("complete_frequency_test_with_selected_parameters").scenarios) == 28
    assert registry.epsilon_name("local_dp", math.log(3)) == "local_dp_1.0986"
    assert registry.epsilon_name("global_dp") == "no_global_dp"
    with pytest.raises(ValueError):
        registry.budget_name("global_dp", None, 0.1)
    with pytest.raises(ValueError):
        registry.method_name("a-b", "c", "d")
    with pytest.raises(ValueError, match="valid ones"):
        registry.find_methods(["nothing"])
    with pytest.raises(ValueError):
        registry.find_evaluation("nothing")
    name = "vector_of_counts-4096-sequential-local_dp_1.0986-no_global_dp"
    assert registry.find_methods([name])[0].parts["sketch"] == "vector_of_counts"


def test_evaluation_end_to_end(spark, tmp_path):
    from tallyspark.plans import evaluate

    small = registry.Evaluation("tiny", 3, (registry.Scenario("independent", gen.Independent(2000, [50] * 3)), registry.Scenario("disjoint", gen.Disjoint([50, 70, 90]))))
    methods = [registry.uniform_filter(10_000), registry.hll()]
    out = str(tmp_path / "run")
    times = evaluate.evaluate(spark, small, methods, out)
    raw = evaluate.read_results(spark, out)
    assert raw.count() == 2 * 2 * 3 * 3
    with pytest.raises(Exception, match="exists|EXISTS"):
        evaluate.evaluate(spark, small, methods, out)
    summary = analyze.summary(spark, raw, [(0.05, 0.95)])
    assert summary.count() == 4
    page = report.report(summary, evaluate.running_times(times), analyze.box_plot(raw), str(tmp_path / "r.html"))
    assert "disjoint" in open(page).read()


def test_set_operators(imps):
    a, b = imps([1, 2, 3]), imps([1, 2, 4, 5])
    ids = lambda df: {r.id for r in df.collect()}
    assert ids(alg.set_union(a, b)) == {1, 2, 3, 4, 5}
    assert ids(alg.set_intersection(a, b)) == {1, 2}
    assert ids(alg.set_difference(a, b)) == {3}
    assert alg.set_union(None, None) is None and alg.set_intersection(a, None) is None and ids(alg.set_difference(a, None)) == {1, 2, 3}


def test_strata(imps):
    df = imps([1, 2, 2, 3, 3, 3, 4, 4, 4, 4])
    got = {}
    for r in sk.strata(sk.ExactMultiSet().build(df), 3).collect():
        got.setdefault(r.stratum, set()).add(r.id)
    assert got == {"1": {1}, "2": {2}, "3+": {3, 4}, "1+": {1, 2, 3, 4}}


def test_empty_sets_keep_their_row(imps):
    df = imps([1, 2, 3], [1])
    voc = sk.VectorOfCounts(num_buckets=4)
    rows = folds.voc_prefixes(voc.build(df.where("set_index = 1")), df, 4, alg.CountAlgebra()).collect()
    assert {r.num_sets for r in rows} == {1, 2}


# ---- sampling, evaluation and reports ------------------------------------------------------


def test_sampling_costs_what_it_draws(spark):
    """Sizes are exact at any share of the universe, and a small sample of a huge universe is cheap."""
    for universe, sizes in ((100, [1, 40, 50, 51, 99, 100]), (10**15, [10, 1000])):
        rows = gen.Independent(universe, sizes).generate(spark, 2, 5).collect()
        for run in range(2):
            for i, size in enumerate(sizes):
                own = [r.id for r in rows if (r.run_index, r.set_index) == (run, i + 1)]
                assert len(own) == len(set(own)) == size and min(own) >= 0 and max(own) < universe
    with pytest.raises(ValueError):
        gen.Independent(10, [11]).generate(spark, 1, 1)


def test_sampling_is_even(spark):
    rows = gen.Independent(50, [10, 40]).generate(spark, 400, 3).groupBy("set_index", "id").count().collect()
    for i, share in ((1, 0.2), (2, 0.8)):
        own = np.array([r["count"] for r in rows if r.set_index == i])
        assert len(own) == 50 and abs(own / 400 - share).max() < 5 * (share * (1 - share) / 400) ** 0.5


def test_heavy_tails_have_no_end(spark):
    """Frequencies over 1,000 of a gamma-Poisson mixture keep their own values."""
    rows = gen.Heterogeneous(4000, [2000], [(0.5, 3000.0)]).generate(spark, 1, 2).groupBy("id").count().collect()
    counts = np.array([r["count"] for r in rows])
    assert len(counts) == 2000 and (counts > 1001).sum() > 400 and len(set(counts[counts > 1001])) > 300
    assert abs(counts.mean() / 1501 - 1) < 0.15


def test_pooled_strata(spark):
    from tallyspark.operators import sketches as sk

    df = spark.createDataFrame([(0, 1, 7), (0, 2, 7), (0, 2, 8), (0, 3, 7), (1, 1, 8)], "run_index int, set_index int, id long")
    pooled = sk.pooled_strata(df, sk.Stratified(inner=sk.ExactMultiSet(), max_frequency=3))
    got = {(r.run_index, r.set_index, r.stratum, r.id) for r in pooled.collect()}
    assert got == {(0, 0, "3+", 7), (0, 0, "1", 8), (0, 0, "1+", 7), (0, 0, "1+", 8), (1, 0, "1", 8), (1, 0, "1+", 8)}


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_command_line(tmp_path, spark, kind):
    from tallyspark.plans import cli, evaluate, registry

    names = [m.name for m in registry.cardinality_methods()][:2]
    options = ["--evaluation", "smoke_test", "--methods", *names, "--out", str(tmp_path / "out"), "--num-runs", "2", "--universe-size", "2000", "--num-workers", "2", "--format", kind, "--analysis-out", str(tmp_path / "analysis"), "--report-out", str(tmp_path / "page")]
    cli.main(options)
    raw = evaluate.read_results(spark, str(tmp_path / "out"), kind)
    types = dict(raw.dtypes)
    assert (types["num_sets"], types["true_cardinality_1"], types["relative_error_1"], types["scenario"]) == ("int", "bigint", "double", "string")
    assert {r.sketch_estimator for r in raw.select("sketch_estimator").distinct().collect()} == set(names)
    page = (tmp_path / "page" / "report.html").read_text()
    assert "By privacy budget" in page and page.count("<svg") >= 2 and all(n in page for n in names)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        cli.main(options)


def test_frequency_report(tmp_path, spark):
    from tallyspark.plans import analyze, report

    rows = [("a-1-b-ln3-infty", "s", r, n, float(100 * n // k), 100 * n // k, 0.01 * r, 0.02) for r in range(3) for n in (1, 2) for k in (1,)]
    raw = spark.createDataFrame(rows, "sketch_estimator string, scenario string, run_index int, num_sets int, estimated_cardinality_1 double, true_cardinality_1 long, relative_error_1 double, shuffle_distance double")
    summary = analyze.summary(spark, raw, [(0.05, 0.9)], "frequency")
    bars = analyze.bar_plot(analyze.at_most_sets(analyze.per_frequency(analyze.long_frequencies(raw))))
    times = spark.createDataFrame([("a-1-b-ln3-infty", 0.5)], "sketch_estimator string, running_time double")
    path = report.report(summary, times, analyze.box_plot(raw, "shuffle_distance"), str(tmp_path / "r.html"), "shuffle_distance", bars=bars)
    page = open(path).read()
    assert "Cardinality by frequency" in page and "sketch epsilon ln3, estimate epsilon infty" in page and page.count("<svg") == 2
    assert list(report.by_epsilons(summary, "shuffle_distance")) == ["sketch epsilon ln3, estimate epsilon infty"]


def test_runs_have_hash_seeds_of_their_own(spark):
    """Where every run reaches the same people, errors still vary by run, and truth and exact results don't change."""
    same = gen.SequentiallyCorrelated("original", "all", 0.5, [2000] * 4)
    for method, spread in ((registry.log_filter(20_000), True), (registry.uniform_filter(20_000), True), (registry.exact(1), False)):
        for shared in (False, True):
            rows = simulate.simulate(spark, same, method, 6, shared_seed=shared).where("num_sets = 4").collect()
            assert {r.true_cardinality_1 for r in rows} == {5000} and len(rows) == 6
            assert (len({r.estimated_cardinality_1 for r in rows}) > 1) == (spread and not shared)
            if not spread:
                assert {r.estimated_cardinality_1 for r in rows} == {5000}
