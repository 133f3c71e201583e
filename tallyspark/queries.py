"""Queries over the test tables, one or more for each operator, with DuckDB SQL where SQL can express them.

Impressions are customers by order priority: five overlapping sets. Hashes are the portable
kind, so both engines place every id alike.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyspark.functions import distributions as dist, noise, numerics
from tallyspark.functions.hashing import fan_out, fingerprint, h60_sql, h60_value, hash_id, unit
from tallyspark.operators import estimators as est, folds, noisers, posterior, prefixes, setalgebra as alg, sketches as sk
from tallyspark.plans import analyze, methods as m, registry, report, simulate
from tallyspark.sources import generators as gen, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SEED, LENGTH, LOG_LENGTH, DECAY, GEOMETRIC_P, TOP = 7, 4096, 1024, 10.0, 0.0005, 5
FULL = "1152921504606846976.0::DOUBLE"

IMP = "imp AS (SELECT 0 AS run_index, substr(o_orderpriority, 1, 1)::INT AS set_index, o_custkey AS id FROM orders WHERE o_orderpriority IS NOT NULL AND o_custkey IS NOT NULL)"


def h(seed: object = SEED, col: str = "id") -> str:
    return h60_sql(f"'{seed}'", f"{col}::VARCHAR")


def u(*parts: str) -> str:
    """A hash-uniform in SQL."""
    return f"(({h60_sql(*parts)})::DOUBLE + 0.5) / {FULL}"


U_ID = f"(({h()})::DOUBLE + 0.5) / {FULL}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def imp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.order_impressions(spark, sf_dir)


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imp(spark, sf_dir).select("id").distinct()


IDS = f"WITH {IMP}, ids AS (SELECT DISTINCT id FROM imp)"

def inverse_sql(rows: str, keys: str, fill: str, name: str = "inv") -> str:
    """CTEs that solve fill(mid) = target by halving, for a table of (keys, target); they end in `name` (keys, n).

    This is another way than the library's: its closed forms are replaced by sums and quadrature here.
    """
    return f"{name}_b AS (SELECT {keys}, target, 0.0::DOUBLE AS lo, 1e12::DOUBLE AS hi, 0 AS step FROM {rows} UNION ALL SELECT {keys}, target, CASE WHEN filled < target THEN mid ELSE lo END, CASE WHEN filled < target THEN hi ELSE mid END, step + 1 FROM (SELECT *, {fill} AS filled FROM (SELECT *, (lo + hi) / 2 AS mid FROM {name}_b WHERE step < 110))), {name} AS (SELECT {keys}, CASE WHEN target <= 0 THEN 0.0::DOUBLE ELSE (lo + hi) / 2 END AS n FROM {name}_b WHERE step = 110)"


def listed(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


def exponential_fill_sql(length: int, decay: float) -> str:
    """Expected active registers of an exponential filter: the integral over its registers by Gauss and Legendre."""
    x, w = np.polynomial.legendre.leggauss(96)
    return f"{length} * list_dot_product({listed(w / 2)}, list_transform({listed(np.exp(decay * (x + 1) / 2))}, lambda e: 1 - exp(-mid * e * {decay / (length * (exp(decay) - 1))!r}::DOUBLE)))"


def flips_sql(index: str, length: int, probability: float, name: str = "clean") -> str:
    """CTE (set_index, register, value): all registers after random response, each with its unbiased value."""
    uu = u("'flip'", "'7'", "0::VARCHAR", "set_index::VARCHAR", "register::VARCHAR")
    return f"{name}_bits AS (SELECT DISTINCT set_index, ({index})::INT AS register FROM imp), {name}_all AS (SELECT s.set_index, r.k::INT AS register, (b.register IS NOT NULL) AS bit FROM (SELECT DISTINCT set_index FROM imp) s CROSS JOIN range({length}) r(k) LEFT JOIN {name}_bits b ON b.set_index = s.set_index AND b.register = r.k), {name} AS (SELECT set_index, register, ((CASE WHEN bit THEN (uu >= {probability!r})::INT ELSE (uu < {probability!r})::INT END) - {probability!r}::DOUBLE) / {1 - 2 * probability!r}::DOUBLE AS value FROM (SELECT *, {uu} AS uu FROM {name}_all))"


def prefix_active_sql(index: str) -> str:
    """CTE act (num_sets, target): registers active in the first n sets."""
    return f"act AS (SELECT g.n AS num_sets, count(DISTINCT {index})::DOUBLE AS target FROM (SELECT DISTINCT set_index AS n FROM imp) g JOIN imp ON set_index <= g.n GROUP BY g.n)"


# ---- hashes and distributions --------------------------------------------------------------


@query(f"{IDS} SELECT id, {h()} AS h, {h()} % 1000 AS h_mod, {h()} % 4294967296 AS fp, id % 16 AS h_identity FROM ids")
def hash_ids(spark, d):
    i = F.col("id")
    return ids(spark, d).select("id", hash_id(i, SEED).alias("h"), hash_id(i, SEED, modulus=1000).alias("h_mod"), fingerprint(i, SEED).alias("fp"), hash_id(i, SEED, "identity", 16).alias("h_identity"))


_FAN = fan_out(SEED, 3)


@query(f"{IDS} SELECT id, {', '.join(f'{h(s[0])} AS h{k}' for k, s in enumerate(_FAN))} FROM ids")
def hash_fan_out(spark, d):
    return ids(spark, d).select("id", *[hash_id(F.col("id"), s[0]).alias(f"h{k}") for k, s in enumerate(_FAN)])


def decaying_sql(q: float, n: int) -> str:
    return f"least(greatest(ceil(ln(1.0::DOUBLE - ({U_ID}) * {1 - q**n!r}::DOUBLE) / {log(q)!r}::DOUBLE) - 1, 0), {n - 1})::INT"


EXP_Q, GEO_Q = exp(-DECAY / (LENGTH + 1)), 1 - GEOMETRIC_P
EXP_INDEX, GEO_INDEX, UNI_INDEX = decaying_sql(EXP_Q, LENGTH), decaying_sql(GEO_Q, LENGTH), f"({h()} % {LENGTH})::INT"
LIQ_INDEX = f"least(floor({LENGTH} * (1 - ln({exp(DECAY)!r}::DOUBLE + ({U_ID}) * {1 - exp(DECAY)!r}::DOUBLE) / {DECAY}::DOUBLE)), {LENGTH - 1})::INT"
FP = f"({h()} % 4294967296)"
CAS_ZEROS = f"(CASE WHEN {FP} = 0 THEN 64 ELSE bit_count(({FP} & (-{FP})) - 1) END)"
CAS_INDEX = f"(least({CAS_ZEROS}, 9) * 256 + floor(({FP} // 2) / pow(2.0::DOUBLE, least({CAS_ZEROS}, 40)))::BIGINT % 256)::INT"
HLL_BITS = 8
HLL_REST = 60 - HLL_BITS
HLL_W = f"({h()} & {(1 << HLL_REST) - 1})"
HLL_REG, HLL_RHO = f"({h()} >> {HLL_REST})::INT", f"(CASE WHEN {HLL_W} = 0 THEN {HLL_REST + 1} ELSE {HLL_REST + 1} - length(ltrim(bin({HLL_W}), '0')) END)::INT"


@query(f"{IDS} SELECT id, {UNI_INDEX} AS uniform, {GEO_INDEX} AS geometric, {EXP_INDEX} AS exponential, {LIQ_INDEX} AS liquid, {CAS_INDEX} AS cascading, {HLL_REG} AS hll_register, {HLL_RHO} AS hll_rho FROM ids")
def index_distributions(spark, d):
    hashed = hash_id(F.col("id"), SEED)
    reg, rho = dist.leading_zero_rank(hashed, HLL_BITS, 60)
    return ids(spark, d).select(
        "id",
        dist.Uniform(LENGTH).index_of_hash(hashed).alias("uniform"),
        dist.Geometric(LENGTH, GEOMETRIC_P).index_of_hash(hashed).alias("geometric"),
        dist.Exponential(LENGTH, DECAY).index_of_hash(hashed).alias("exponential"),
        dist.truncated_exponential_index(unit(hashed), DECAY, LENGTH).alias("liquid"),
        dist.cascading_index(fingerprint(F.col("id"), SEED), 10, 256).alias("cascading"),
        reg.alias("hll_register"),
        rho.alias("hll_rho"),
    )


LOG_BOUNDS = f"bounds AS (SELECT k, ((k + 1) * ln({LOG_LENGTH + 1}::DOUBLE) - lgamma(k + 2.0::DOUBLE)) / ({LOG_LENGTH} * ln({LOG_LENGTH + 1}::DOUBLE) - lgamma({LOG_LENGTH + 1}.0::DOUBLE)) AS hi FROM range({LOG_LENGTH}) t(k))"


@query(f"{IDS}, {LOG_BOUNDS} SELECT id, (SELECT count(*) FROM bounds WHERE hi < {U_ID})::INT AS logarithmic FROM ids")
def index_logarithmic(spark, d):
    return ids(spark, d).select("id", dist.LogBucket(LOG_LENGTH).index_of_hash(hash_id(F.col("id"), SEED)).alias("logarithmic"))


# ---- sketches ------------------------------------------------------------------------------

KEYS = "run_index, set_index"


@query(f"WITH {IMP} SELECT {KEYS}, id, count(*) AS frequency FROM imp GROUP BY ALL")
def exact_multiset(spark, d):
    return sk.ExactMultiSet().build(imp(spark, d))


def bit_sql(index: str) -> str:
    return f"WITH {IMP} SELECT DISTINCT {KEYS}, {index} AS register, 1.0::DOUBLE AS value FROM imp"


UNIFORM = sk.uniform_filter(LENGTH, seed=SEED)
GEOMETRIC = sk.geometric_filter(LENGTH, GEOMETRIC_P, seed=SEED)
EXPONENTIAL = sk.exponential_filter(LENGTH, DECAY, seed=SEED)
LOGARITHMIC = sk.logarithmic_filter(LOG_LENGTH, seed=SEED)


@query(bit_sql(UNI_INDEX))
def uniform_registers(spark, d):
    return UNIFORM.build(imp(spark, d))


@query(bit_sql(GEO_INDEX))
def geometric_registers(spark, d):
    return GEOMETRIC.build(imp(spark, d))


@query(bit_sql(EXP_INDEX))
def exponential_registers(spark, d):
    return EXPONENTIAL.build(imp(spark, d))


@query(f"WITH {IMP}, {LOG_BOUNDS}, placed AS (SELECT id, (SELECT count(*) FROM bounds WHERE hi < {U_ID})::INT AS register FROM (SELECT DISTINCT id FROM imp)) SELECT DISTINCT {KEYS}, register, 1.0::DOUBLE AS value FROM imp JOIN placed USING (id)")
def logarithmic_registers(spark, d):
    return LOGARITHMIC.build(imp(spark, d))


K3 = sk.bloom_filter(LENGTH, 3, SEED)
K3_ROWS = " UNION ALL ".join(f"SELECT {KEYS}, id, ({h(s[0])} % {LENGTH})::INT AS register FROM imp" for s in fan_out(SEED, 3))


@query(f"WITH {IMP}, placed AS ({K3_ROWS}) SELECT DISTINCT {KEYS}, register, 1.0::DOUBLE AS value FROM placed")
def bloom_registers(spark, d):
    return K3.build(imp(spark, d))


@query(f"WITH {IMP}, placed AS ({K3_ROWS}), bits AS (SELECT DISTINCT {KEYS}, register FROM placed), cand AS (SELECT DISTINCT id, register FROM placed), all_ AS (SELECT id, count(*) AS n FROM cand GROUP BY id) SELECT run_index, set_index, id FROM cand JOIN bits USING (register) JOIN all_ USING (id) GROUP BY run_index, set_index, id, n HAVING count(*) = n")
def bloom_membership(spark, d):
    """Membership of every id of the table in every set."""
    rows = imp(spark, d)
    return K3.contains(K3.build(rows), rows)


@query(f"WITH {IMP} SELECT {KEYS}, {UNI_INDEX} AS register, count(*)::DOUBLE AS value FROM imp GROUP BY ALL")
def counting_registers(spark, d):
    return sk.counting_filter(LENGTH, seed=SEED).build(imp(spark, d))


@query(f"WITH {IMP} SELECT {KEYS}, {UNI_INDEX} AS register, CASE WHEN min(id) = max(id) THEN min(id) + 1 ELSE -1 END AS value FROM imp GROUP BY ALL")
def unique_key_registers(spark, d):
    return sk.AnySketch(distributions=(dist.Uniform(LENGTH),), value="unique", seed=SEED).build(imp(spark, d))


_AXES = fan_out(SEED, 1, 2)[0]


@query(f"WITH {IMP} SELECT {KEYS}, ({h(_AXES[0])} % 64)::INT AS register_0, ({h(_AXES[1])} % 32)::INT AS register_1, count(*)::DOUBLE AS value FROM imp GROUP BY ALL")
def two_axis_registers(spark, d):
    return sk.AnySketch(distributions=(dist.Uniform(64), dist.Uniform(32)), value="sum", seed=SEED).build(imp(spark, d))


LIQUID = sk.LiquidLegions(decay_rate=DECAY, length=LENGTH, seed=SEED)
CASCADING = sk.CascadingLegions(legions=10, positions=256, seed=SEED)


def legion_sql(index: str) -> str:
    return f"SELECT {KEYS}, {index} AS register, count(*) AS cnt, min({FP}) AS min_fp, max({FP}) AS max_fp FROM imp GROUP BY ALL"


@query(f"WITH {IMP} {legion_sql(LIQ_INDEX)}")
def liquid_registers(spark, d):
    return LIQUID.build(imp(spark, d))


@query(f"WITH {IMP} {legion_sql(CAS_INDEX)}")
def cascading_registers(spark, d):
    return CASCADING.build(imp(spark, d))


VOC = sk.VectorOfCounts(num_buckets=64, seed=SEED)
VOC_SQL = f"voc AS (SELECT {KEYS}, ({h()} % 64)::INT AS register, count(*)::DOUBLE AS value FROM (SELECT DISTINCT * FROM imp) GROUP BY ALL)"


@query(f"WITH {IMP}, {VOC_SQL} SELECT * FROM voc")
def voc_registers(spark, d):
    return VOC.build(imp(spark, d))


@query(f"WITH {IMP}, {VOC_SQL}, full_ AS (SELECT s.run_index, s.set_index, r.k, coalesce(value, 0.0::DOUBLE) AS v FROM (SELECT DISTINCT run_index, set_index FROM imp) s CROSS JOIN range(64) r(k) LEFT JOIN voc ON voc.run_index = s.run_index AND voc.set_index = s.set_index AND voc.register = r.k) SELECT {KEYS}, round(sum(v * k), 6) AS checksum, count(*) AS buckets, sum(v) AS cardinality FROM full_ GROUP BY ALL")
def voc_dense(spark, d):
    dense = VOC.dense(VOC.build(imp(spark, d)))
    total = lambda f: F.aggregate(F.transform("stats", f), F.lit(0.0), lambda s, x: s + x)
    return dense.select("run_index", "set_index", F.round(total(lambda v, i: v * i), 6).alias("checksum"), F.size("stats").cast("long").alias("buckets"), total(lambda v, i: v).alias("cardinality"))


HLL = sk.HyperLogLog(length=1 << HLL_BITS, seed=SEED)
HLL_SQL = f"hll AS (SELECT {KEYS}, {HLL_REG} AS register, max({HLL_RHO}) AS rho FROM imp GROUP BY ALL)"


@query(f"WITH {IMP}, {HLL_SQL} SELECT * FROM hll")
def hll_registers(spark, d):
    return HLL.build(imp(spark, d))


FLL = sk.FreqLogLog(length=1 << HLL_BITS, seed=SEED)
FP2 = f"({h(SEED + 1)} % 4294967296)"


@query(f"WITH {IMP}, c AS (SELECT {KEYS}, {HLL_REG} AS register, {HLL_RHO} AS rho, {FP2} AS fp, count(*) AS freq FROM imp GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY run_index, set_index, register ORDER BY rho DESC, fp DESC) = 1")
def fll_registers(spark, d):
    return FLL.build(imp(spark, d))


SKA = sk.SameKeyAggregator(length=LENGTH, decay_rate=DECAY, seed=SEED)
SKA_SQL = f"ska AS (SELECT {KEYS}, {EXP_INDEX} AS register, min(id) AS min_key, max(id) AS max_key, count(*) AS cnt FROM imp GROUP BY ALL)"


@query(f"WITH {IMP}, {SKA_SQL} SELECT * FROM ska")
def same_key_registers(spark, d):
    return SKA.build(imp(spark, d))


STRATA_SQL = f"f AS (SELECT {KEYS}, id, count(*) AS frequency FROM imp GROUP BY ALL), strata AS (SELECT {KEYS}, CASE WHEN frequency >= 3 THEN '3+' ELSE frequency::VARCHAR END AS stratum, id FROM f UNION ALL SELECT {KEYS}, '1+', id FROM f)"


@query(f"WITH {IMP}, {STRATA_SQL} SELECT * FROM strata")
def stratified_strata(spark, d):
    return sk.strata(sk.ExactMultiSet().build(imp(spark, d)), 3)


@query(f"WITH {IMP}, {STRATA_SQL} SELECT DISTINCT {KEYS}, stratum, {EXP_INDEX} AS register, 1.0::DOUBLE AS value FROM strata")
def stratified_registers(spark, d):
    return sk.Stratified(inner=EXPONENTIAL, max_frequency=3).build(imp(spark, d))


# ---- merges and set algebra ----------------------------------------------------------------


@query(f"WITH {IMP}, {HLL_SQL} SELECT run_index, register, max(rho) AS rho FROM hll GROUP BY ALL")
def hll_merge(spark, d):
    return HLL.merge(HLL.build(imp(spark, d)), "run_index")


@query(f"WITH {IMP}, c AS (SELECT run_index, {HLL_REG} AS register, {HLL_RHO} AS rho, {FP2} AS fp, count(*) AS freq FROM imp GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY run_index, register ORDER BY rho DESC, fp DESC) = 1")
def fll_merge(spark, d):
    # a set's register holds its greatest pair only, so merging sets can't lose a greater one
    return FLL.merge(FLL.build(imp(spark, d)), "run_index")


@query(f"WITH {IMP}, l AS ({legion_sql(LIQ_INDEX)}) SELECT run_index, register, sum(cnt)::BIGINT AS cnt, min(min_fp) AS min_fp, max(max_fp) AS max_fp FROM l GROUP BY ALL")
def legions_merge(spark, d):
    return LIQUID.merge(LIQUID.build(imp(spark, d)), "run_index")


@query(f"WITH {IMP}, {SKA_SQL} SELECT run_index, register, min(min_key) AS min_key, max(max_key) AS max_key, sum(cnt)::BIGINT AS cnt FROM ska GROUP BY ALL")
def same_key_merge(spark, d):
    return SKA.merge(SKA.build(imp(spark, d)), "run_index")


def one_set(spark, d, n):
    return imp(spark, d).where(F.col("set_index") == n)


@query(f"WITH {IMP} SELECT id FROM imp WHERE set_index = 1 UNION SELECT id FROM imp WHERE set_index = 2")
def set_union(spark, d):
    return alg.set_union(one_set(spark, d, 1), one_set(spark, d, 2))


@query(f"WITH {IMP} SELECT id FROM imp WHERE set_index = 1 INTERSECT SELECT id FROM imp WHERE set_index = 2")
def set_intersection(spark, d):
    return alg.set_intersection(one_set(spark, d, 1), one_set(spark, d, 2))


@query(f"WITH {IMP} SELECT id FROM imp WHERE set_index = 1 EXCEPT SELECT id FROM imp WHERE set_index = 2")
def set_difference(spark, d):
    return alg.set_difference(one_set(spark, d, 1), one_set(spark, d, 2))




@query(f"WITH {IMP}, v AS (SELECT set_index, {UNI_INDEX} AS register, (CASE WHEN count(*) % 2 = 0 THEN 0.3 ELSE -0.2 END)::DOUBLE AS value FROM imp GROUP BY ALL) SELECT coalesce(a.register, b.register) AS register, round(1 - (1 - coalesce(a.value, 0)) * (1 - coalesce(b.value, 0)), 6) AS value FROM (SELECT * FROM v WHERE set_index = 1) a FULL JOIN (SELECT * FROM v WHERE set_index = 2) b ON a.register = b.register")
def fuzzy_union(spark, d):
    counts = sk.counting_filter(LENGTH, seed=SEED).build(imp(spark, d))
    v = counts.withColumn("value", F.when(F.col("value") % 2 == 0, 0.3).otherwise(-0.2))
    both = alg.fuzzy_union(v.where("set_index = 1"), v.where("set_index = 2"))
    return both.select("register", F.round("value", 6).alias("value"))


@query(f"WITH {IMP}, {VOC_SQL}, full_ AS (SELECT s.set_index, r.k, coalesce(value, 0.0::DOUBLE) AS v FROM (SELECT DISTINCT set_index FROM imp) s CROSS JOIN range(64) r(k) LEFT JOIN voc ON voc.set_index = s.set_index AND voc.register = r.k) SELECT 0 AS run_index, a.set_index, b.set_index AS next_index, round(sum(a.v * b.v) - sum(a.v) * sum(b.v) / 64, 6) AS intersection, round(sum(a.v) + sum(b.v) - (sum(a.v * b.v) - sum(a.v) * sum(b.v) / 64), 6) AS union_size FROM full_ a JOIN full_ b ON a.k = b.k AND a.set_index < b.set_index GROUP BY a.set_index, b.set_index")
def voc_pairwise(spark, d):
    pairs = alg.pairwise_counts(VOC.dense(VOC.build(imp(spark, d))))
    return pairs.select("run_index", "set_index", "next_index", F.round("intersection", 6).alias("intersection"), F.round("union_size", 6).alias("union_size"))


EXP_P = f"({(1 - EXP_Q) / (1 - EXP_Q**LENGTH)!r}::DOUBLE * pow({EXP_Q!r}::DOUBLE, register))"
_TWO = f"bits AS (SELECT DISTINCT set_index, {EXP_INDEX} AS register FROM imp WHERE set_index IN (1, 2)), ab AS (SELECT r.k AS register, (x.register IS NOT NULL)::INT AS a, (y.register IS NOT NULL)::INT AS b FROM range({LENGTH}) r(k) LEFT JOIN (SELECT register FROM bits WHERE set_index = 1) x ON x.register = r.k LEFT JOIN (SELECT register FROM bits WHERE set_index = 2) y ON y.register = r.k)"
_SIZES = "raw AS (SELECT 'x' AS part, sum(a)::DOUBLE AS target FROM ab UNION ALL SELECT 'y', sum(b)::DOUBLE FROM ab UNION ALL SELECT 'u', sum(greatest(a, b))::DOUBLE FROM ab)"
_LEFT = "w AS (SELECT any_value(n) FILTER (part = 'x') AS x, any_value(n) FILTER (part = 'y') AS y, any_value(n) FILTER (part = 'u') AS u FROM inv), c AS (SELECT *, greatest(x + y - u, 0) AS common FROM w), g AS (SELECT ab.*, c.*, {p} AS p, 1 - pow(1 - {p}, common) AS shared, 1 - pow(1 - {p}, x - common) AS mine, 1 - pow(1 - {p}, y - common) AS theirs FROM ab CROSS JOIN c), sums AS (SELECT greatest(sum(p * a * b), {t}, min(p)) AS thin_both, greatest(sum(p * a), {t}, min(p)) AS thin_a, greatest(0, least(any_value(x - common), any_value(x - common) - sum(a * (1 - b)))) AS hidden FROM g)"
_KINDS = "parts AS (SELECT 'expectation' AS kind, 'intersection' AS part, sum(a * b * (1 - pow(1 - least(1, p / thin_both), common))) AS target FROM g CROSS JOIN sums UNION ALL SELECT 'expectation', 'difference', sum(a * (1 - b) + a * b * (1 - pow(1 - least(1, p / thin_a), hidden))) FROM g CROSS JOIN sums UNION ALL SELECT 'bayesian', 'intersection', sum(a * b * shared / greatest({t}, mine * theirs * (1 - shared) + shared)) FROM g UNION ALL SELECT 'bayesian', 'difference', sum(a * (1 - b) + a * b * (mine * theirs * shared + mine * (1 - theirs) * shared + mine * theirs * (1 - shared)) / greatest({t}, mine * theirs * (1 - shared) + shared)) FROM g)"
_THRESHOLD = f"{alg.FilterAlgebra(EXPONENTIAL.distributions[0], 'bayesian').threshold!r}::DOUBLE"


@query(f"WITH RECURSIVE {IMP}, {_TWO}, {_SIZES}, {inverse_sql('raw', 'part', exponential_fill_sql(LENGTH, DECAY))}, {_LEFT.format(p=EXP_P, t=_THRESHOLD)}, {_KINDS.format(t=_THRESHOLD)}, {inverse_sql('parts', 'kind, part', exponential_fill_sql(LENGTH, DECAY), 'again')} SELECT kind, round(any_value(n) FILTER (part = 'intersection'), 2) AS intersection, round(any_value(n) FILTER (part = 'difference'), 2) AS difference, (SELECT round(u, 2) FROM c) AS either FROM again GROUP BY kind")
def filter_algebra(spark, d):
    """Sizes of intersection and difference of two sets' filters, both kinds of approximation."""
    bits = EXPONENTIAL.build(imp(spark, d)).where("set_index in (1, 2)")

    def run(rows):
        import pandas as pd

        a, b = (folds.vectors(rows[rows["set_index"] == n], LENGTH) for n in (1, 2))
        out = []
        for kind in ("expectation", "bayesian"):
            algebra = alg.FilterAlgebra(EXPONENTIAL.distributions[0], kind)
            out.append((kind, algebra.size(algebra.intersection(a, b)), algebra.size(algebra.difference(a, b)), algebra.size(algebra.union(a, b))))
        return pd.DataFrame(out, columns=["kind", "intersection", "difference", "either"])

    found = bits.groupBy("run_index").applyInPandas(run, "kind string, intersection double, difference double, either double")
    return found.select("kind", *[F.round(c, 2).alias(c) for c in ("intersection", "difference", "either")])


# ---- estimators ----------------------------------------------------------------------------


@query(f"WITH {IMP}, f AS (SELECT id, count(*) AS n FROM imp GROUP BY id), levels AS (SELECT unnest(range(1, (SELECT max(n) FROM f) + 1))::INT AS frequency_level) SELECT 0 AS run_index, frequency_level, (SELECT count(*) FROM f WHERE n >= frequency_level) AS cardinality FROM levels")
def exact_histogram(spark, d):
    return est.exact_histogram(imp(spark, d))


@query(f"WITH {IMP}, f AS (SELECT id, count(*) AS n FROM imp GROUP BY id), levels AS (SELECT unnest(range(1, (SELECT max(n) FROM f) + 1))::INT AS frequency_level) SELECT 0 AS run_index, frequency_level, greatest((SELECT count(*) FROM f WHERE n >= frequency_level) - 1, 0) AS cardinality FROM levels")
def less_one_histogram(spark, d):
    return est.less_one(est.exact_histogram(imp(spark, d)))


KPLUS = f"{IMP}, grid AS (SELECT DISTINCT run_index, set_index AS num_sets FROM imp), pref AS (SELECT g.num_sets, i.id, count(*) AS n FROM grid g JOIN imp i ON i.set_index <= g.num_sets GROUP BY ALL), kplus AS (SELECT 0 AS run_index, num_sets, k::INT AS frequency_level, count(*) FILTER (n >= k) AS cardinality FROM pref CROSS JOIN range(1, {TOP + 1}) t(k) GROUP BY ALL)"


@query(f"WITH {KPLUS} SELECT * FROM kplus")
def exact_kplus_prefix(spark, d):
    return prefixes.level_reach(imp(spark, d), TOP)


ACTIVE = f"{IMP}, grid AS (SELECT DISTINCT run_index, set_index AS num_sets FROM imp), x AS (SELECT 0 AS run_index, g.num_sets, count(DISTINCT {UNI_INDEX})::DOUBLE AS active FROM grid g JOIN imp i ON i.set_index <= g.num_sets GROUP BY g.num_sets)"


@query(f"WITH {ACTIVE} SELECT run_index, num_sets, floor(abs({LENGTH} * ln(1 - active / {LENGTH}))) AS estimate FROM x")
def bloom_union_estimate(spark, d):
    rows = imp(spark, d)
    return est.filter_prefixes(UNIFORM.build(rows), prefixes.set_grid(rows), UNIFORM, "union", saturated=True)


@query(f"WITH {ACTIVE} SELECT run_index, num_sets, round(-{LENGTH} * ln(1 - active / {LENGTH}), 6) AS estimate FROM x")
def uniform_estimate(spark, d):
    rows = imp(spark, d)
    return rounded(est.filter_prefixes(UNIFORM.build(rows), prefixes.set_grid(rows), UNIFORM, saturated=True))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumn("estimate", F.round("estimate", digits))


@query(f"WITH {IMP}, {LOG_BOUNDS}, placed AS (SELECT id, (SELECT count(*) FROM bounds WHERE hi < {U_ID}) AS register FROM (SELECT DISTINCT id FROM imp)), x AS (SELECT g.n AS num_sets, count(DISTINCT register)::DOUBLE AS active FROM (SELECT DISTINCT set_index AS n FROM imp) g JOIN imp ON set_index <= g.n JOIN placed USING (id) GROUP BY g.n) SELECT 0 AS run_index, num_sets, round(active / (1 - active / {LOG_LENGTH}), 6) AS estimate FROM x")
def logarithmic_estimate(spark, d):
    rows = imp(spark, d)
    return rounded(est.filter_prefixes(LOGARITHMIC.build(rows), prefixes.set_grid(rows), LOGARITHMIC))


EXP_FILL = exponential_fill_sql(LENGTH, DECAY)
ESTIMATES = "SELECT 0 AS run_index, num_sets, round(n, 3) AS estimate FROM inv"


@query(f"WITH RECURSIVE {IMP}, {prefix_active_sql(EXP_INDEX)}, {inverse_sql('act', 'num_sets', EXP_FILL)} {ESTIMATES}")
def exponential_estimate(spark, d):
    rows = imp(spark, d)
    return rounded(est.filter_prefixes(EXPONENTIAL.build(rows), prefixes.set_grid(rows), EXPONENTIAL), 3)


GEO_FILL = f"list_sum(list_transform(range({LENGTH}), lambda k: 1 - pow(1 - {GEOMETRIC_P / (1 - GEO_Q**LENGTH)!r}::DOUBLE * pow({GEO_Q!r}::DOUBLE, k), mid)))"


@query(f"WITH RECURSIVE {IMP}, {prefix_active_sql(GEO_INDEX)}, {inverse_sql('act', 'num_sets', GEO_FILL)} {ESTIMATES}")
def geometric_estimate(spark, d):
    rows = imp(spark, d)
    return rounded(est.filter_prefixes(GEOMETRIC.build(rows), prefixes.set_grid(rows), GEOMETRIC, saturated=True), 3)


_LOG_TOTAL = f"({LOG_LENGTH} * ln({LOG_LENGTH + 1}.0::DOUBLE) - lgamma({LOG_LENGTH + 1}.0::DOUBLE))"
_LOG_WEIGHT = f"(0.5::DOUBLE + k / {LOG_LENGTH - 1}.0::DOUBLE)"
LOG_FILL = f"list_sum(list_transform(range({LOG_LENGTH}), lambda k: {_LOG_WEIGHT} * (1 - pow(1 + ln((k + 1) / {LOG_LENGTH + 1}.0::DOUBLE) / {_LOG_TOTAL}, mid))))"


@query(f"WITH RECURSIVE {IMP}, {LOG_BOUNDS}, placed AS (SELECT id, (SELECT count(*) FROM bounds WHERE hi < {U_ID}) AS k FROM (SELECT DISTINCT id FROM imp)), act AS (SELECT num_sets, sum({_LOG_WEIGHT}) AS target FROM (SELECT DISTINCT g.n AS num_sets, k FROM (SELECT DISTINCT set_index AS n FROM imp) g JOIN imp ON set_index <= g.n JOIN placed USING (id)) GROUP BY num_sets), {inverse_sql('act', 'num_sets', LOG_FILL)} {ESTIMATES}")
def weighted_estimate(spark, d):
    rows = imp(spark, d)
    return rounded(est.weighted_prefixes(LOGARITHMIC.build(rows), prefixes.set_grid(rows), LOGARITHMIC, np.linspace(0.5, 1.5, LOG_LENGTH)), 3)


_A = est.hll_alpha(1 << HLL_BITS) * (1 << HLL_BITS) ** 2
_LIMIT = est.LINEAR_LIMITS[HLL_BITS - 4]


@query(f"WITH {IMP}, {HLL_SQL}, grid AS (SELECT DISTINCT set_index AS n FROM imp), top AS (SELECT g.n, register, max(rho) AS rho FROM grid g JOIN hll ON set_index <= g.n GROUP BY ALL), s AS (SELECT n, count(*) AS active, sum(pow(2.0::DOUBLE, -rho)) AS powers FROM top GROUP BY n), c AS (SELECT g.n, count(DISTINCT id) AS ids FROM grid g JOIN imp ON set_index <= g.n GROUP BY g.n), e AS (SELECT n, ids, 256 - active AS empty, {_A!r}::DOUBLE / (powers + 256 - active) AS raw FROM s JOIN c USING (n)) SELECT 0 AS run_index, n AS num_sets, round(CASE WHEN ids <= {6 * 256} THEN ids WHEN empty > 0 AND 256 * ln(256.0::DOUBLE / empty) <= {_LIMIT} THEN 256 * ln(256.0::DOUBLE / empty) ELSE raw END, 6)::DOUBLE AS estimate FROM e")
def hll_estimate(spark, d):
    return rounded(est.hll_prefixes(imp(spark, d), HLL))


FLL_TOP = FLL.max_frequency


@query(f"WITH {IMP}, {HLL_SQL}, grid AS (SELECT DISTINCT set_index AS n FROM imp), top AS (SELECT g.n, register, max(rho) AS rho FROM grid g JOIN hll ON set_index <= g.n GROUP BY ALL), s AS (SELECT n, count(*) AS active, sum(pow(2.0::DOUBLE, -rho)) AS powers FROM top GROUP BY n), c AS (SELECT g.n, count(DISTINCT id) AS ids FROM grid g JOIN imp ON set_index <= g.n GROUP BY g.n), e AS (SELECT n, ids, 256 - active AS empty, {_A!r}::DOUBLE / (powers + 256 - active) AS raw FROM s JOIN c USING (n)), reach AS (SELECT n, ids, CASE WHEN ids <= {6 * 256} THEN ids WHEN empty > 0 AND 256 * ln(256.0::DOUBLE / empty) <= {_LIMIT} THEN 256 * ln(256.0::DOUBLE / empty) ELSE raw END AS estimate FROM e), keyed AS (SELECT g.n, {HLL_REG} AS register, {HLL_RHO} AS rho, {FP2} AS fp, count(*) AS freq FROM grid g JOIN imp ON set_index <= g.n GROUP BY ALL), held AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY n, register ORDER BY rho DESC, fp DESC) = 1), shares AS (SELECT n, k, avg((freq >= k)::INT) AS share FROM held CROSS JOIN range(1, {FLL_TOP + 1}) t(k) GROUP BY ALL), seen AS (SELECT g.n, id, count(*) AS f FROM grid g JOIN imp ON set_index <= g.n GROUP BY ALL), exact AS (SELECT n, k, count(*) FILTER (f >= k) AS cardinality FROM seen CROSS JOIN range(1, {FLL_TOP + 1}) t(k) GROUP BY ALL) SELECT 0 AS run_index, n AS num_sets, k::INT AS frequency_level, CASE WHEN ids <= {6 * 256} THEN cardinality ELSE round_even(estimate * share, 0) END::DOUBLE AS estimate FROM reach JOIN shares USING (n) JOIN exact USING (n, k)")
def fll_estimate(spark, d):
    return est.fll_prefixes(imp(spark, d), FLL)


@query(f"WITH RECURSIVE {IMP}, {prefix_active_sql(LIQ_INDEX)}, cut AS (SELECT num_sets, least(target, {LENGTH - 1}) AS target FROM act), {inverse_sql('cut', 'num_sets', EXP_FILL)} {ESTIMATES}")
def liquid_estimate(spark, d):
    rows = imp(spark, d)
    return rounded(est.liquid_prefixes(LIQUID.build(rows), prefixes.set_grid(rows), LIQUID), 3)


CAS_FILL = "list_sum(list_transform(range(10), lambda i: 256 * (1 - exp(-mid / (256 * pow(2.0::DOUBLE, least(i + 1, 9)))))))"


@query(f"WITH RECURSIVE {IMP}, {prefix_active_sql(CAS_INDEX)}, {inverse_sql('act', 'num_sets', CAS_FILL)} {ESTIMATES}")
def cascading_estimate(spark, d):
    rows = imp(spark, d)
    return rounded(est.cascading_prefixes(CASCADING.build(rows), prefixes.set_grid(rows), CASCADING), 3)


@query(f"WITH {IMP}, l AS ({legion_sql(LIQ_INDEX)}), s AS (SELECT {KEYS}, cnt AS frequency, count(*) AS n FROM l WHERE min_fp = max_fp GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY run_index, set_index), 6) AS share FROM s")
def legions_frequency_sample(spark, d):
    found = est.frequency_sample(LIQUID.build(imp(spark, d)), "run_index", "set_index")
    return found.withColumn("share", F.round("share", 6))


@query(f"SELECT register::INT AS register, round(1 - exp(-({DECAY} * exp({DECAY}::DOUBLE * (1 - register / {LENGTH}.0::DOUBLE)) / ({exp(DECAY) - 1!r}::DOUBLE)) / {LENGTH} * 1000), 6) AS probability FROM range({LENGTH}) t(register)")
def legions_hit_probability(spark, d):
    registers = spark.range(LENGTH).select(F.col("id").cast("int").alias("register"))
    return registers.select("register", F.round(est.hit_probability(F.col("register"), 1000.0, LIQUID), 6).alias("probability"))


@query(f"WITH {IMP}, r AS (SELECT set_index, count(DISTINCT id) AS reach FROM imp GROUP BY set_index) SELECT 0 AS run_index, a.set_index AS num_sets, round(10000 * (1 - product(1 - b.reach / 10000.0::DOUBLE)), 6) AS estimate FROM r a JOIN r b ON b.set_index <= a.set_index GROUP BY a.set_index")
def independent_reach(spark, d):
    reach = imp(spark, d).groupBy("run_index", "set_index").agg(F.count_distinct("id").alias("reach"))
    return rounded(est.independent_reach(reach, 10000))


_FOLD = f"[list_sum([s[i] * q[k - i + 1] FOR i IN range(1, k + 1)]) FOR k IN range(1, {TOP + 1})]"


@query(f"WITH RECURSIVE {IMP}, per AS (SELECT set_index, id, count(*) AS f FROM imp GROUP BY ALL), grid AS (SELECT set_index, row_number() OVER (ORDER BY set_index) AS place, count(*) AS reach FROM per GROUP BY set_index), q AS (SELECT g.set_index, g.place, list(CASE WHEN k = 0 THEN 1 - reach / 1e6::DOUBLE ELSE coalesce(c, 0) / 1e6::DOUBLE END ORDER BY k) AS q FROM grid g CROSS JOIN range({TOP}) t(k) LEFT JOIN (SELECT set_index, f, count(*) AS c FROM per GROUP BY ALL) x ON x.set_index = g.set_index AND x.f = k GROUP BY ALL), folded AS (SELECT 0::BIGINT AS place, 0 AS set_index, [1.0::DOUBLE{', 0.0::DOUBLE' * (TOP - 1)}] AS s UNION ALL SELECT q.place, q.set_index, {_FOLD} FROM folded JOIN q ON q.place = folded.place + 1) SELECT 0 AS run_index, set_index AS num_sets, k::INT AS frequency_level, round(1e6::DOUBLE * (1 - list_sum(s[1:k])), 3) AS estimate FROM folded CROSS JOIN range(1, {TOP + 1}) t(k) WHERE place > 0")
def independent_levels(spark, d):
    """Chances of a person's total frequency, convolved set by set."""
    rows = imp(spark, d)
    per_set = rows.groupBy("run_index", "set_index", "id").agg(F.count("*").alias("f")).groupBy("run_index", "set_index", "f").agg(F.count("*").alias("n"))
    return rounded(est.independent_levels(est.cumulative(per_set, "f", "n", "run_index", "set_index"), 1e6, TOP), 3)


@query(f"WITH {IMP}, grid AS (SELECT DISTINCT set_index AS n FROM imp), reg AS (SELECT g.n, {EXP_INDEX} AS register, min(id) AS a, max(id) AS b, count(*) AS c FROM grid g JOIN imp ON set_index <= g.n GROUP BY ALL), one AS (SELECT n, least(c, {TOP}) AS level, count(*) AS k FROM reg WHERE a = b GROUP BY ALL) SELECT 0 AS run_index, g.n AS num_sets, t.k::INT AS frequency_level, round(coalesce(sum(one.k) FILTER (one.level >= t.k), 0) / sum(one.k), 6) AS share FROM grid g CROSS JOIN range(1, {TOP + 1}) t(k) JOIN one ON one.n = g.n GROUP BY g.n, t.k")
def same_key_shares(spark, d):
    """The k+ shares of the standardized histogram: its estimates over its own reach."""
    rows = imp(spark, d)
    found = est.ska_prefixes(SKA.build(rows), prefixes.set_grid(rows), SKA, TOP)
    reach = F.max("estimate").over(Window.partitionBy("run_index", "num_sets"))
    return found.select("run_index", "num_sets", "frequency_level", F.round(F.col("estimate") / reach, 6).alias("share"))


@query(f"WITH {IMP}, t AS (SELECT run_index, id, count(*) AS f FROM imp GROUP BY ALL) SELECT run_index, id, CASE WHEN f >= 3 THEN '3+' ELSE f::VARCHAR END AS stratum FROM t")
def stratified_merge_exact(spark, d):
    return folds.stratified_exact(sk.ExactMultiSet().build(imp(spark, d)), 3)


def both_sql(op: str, a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda x: x[1] {op} x[2])"


def common_sql(a: str, b: str, length: int) -> str:
    return f"(list_dot_product({a}, {b}) - list_sum({a}) * list_sum({b}) / {length})"


def meet_sql(a: str, b: str, length: int = 256) -> str:
    """The intersection's vector: what the buckets of both hold, in proportion to the covariance."""
    return f"list_transform(list_zip({a}, {b}), lambda x: (x[1] + x[2]) * coalesce({common_sql(a, b, length)} / nullif(list_sum({a}) + list_sum({b}), 0), 0))"


def strata_merge_sql() -> str:
    """(s1, s2, s3, s0) after the next set (b1, b2, b3, b0), for a top level of 3."""
    minus, plus = (lambda a, b: both_sql("-", a, b)), (lambda a, b: both_sql("+", a, b))
    one = plus(minus("s1", meet_sql("s1", "b0")), minus("b1", meet_sql("s0", "b1")))
    two = plus(plus(minus("s2", meet_sql("s2", "b0")), minus("b2", meet_sql("s0", "b2"))), meet_sql("s1", "b1"))
    three = plus(plus(plus("s3", meet_sql("s2", "b0")), meet_sql("s1", minus("b0", "b1"))), minus("b3", meet_sql("b3", "s0")))
    return f"{one} AS s1, {two} AS s2, {three} AS s3"


_STRATA_VECTORS = f"vec AS (SELECT s.set_index, s.stratum, list(coalesce(c, 0)::DOUBLE ORDER BY k) AS v FROM (SELECT set_index, stratum FROM (SELECT DISTINCT set_index FROM imp) CROSS JOIN (VALUES ('1'), ('2'), ('3+'), ('1+')) n(stratum)) s CROSS JOIN range(256) r(k) LEFT JOIN (SELECT set_index, stratum, {h()} % 256 AS register, count(*) AS c FROM strata GROUP BY ALL) x ON x.set_index = s.set_index AND x.stratum = s.stratum AND x.register = r.k GROUP BY ALL), wide AS (SELECT row_number() OVER (ORDER BY set_index) AS place, set_index, any_value(v) FILTER (stratum = '1') AS b1, any_value(v) FILTER (stratum = '2') AS b2, any_value(v) FILTER (stratum = '3+') AS b3, any_value(v) FILTER (stratum = '1+') AS b0 FROM vec GROUP BY set_index)"


@query(f"WITH RECURSIVE {IMP}, {STRATA_SQL}, {_STRATA_VECTORS}, folded AS (SELECT place, set_index, b1 AS s1, b2 AS s2, b3 AS s3, b0 AS s0 FROM wide WHERE place = 1 UNION ALL SELECT place, set_index, s1, s2, s3, {both_sql('+', both_sql('+', 's1', 's2'), 's3')} FROM (SELECT w.place, w.set_index, {strata_merge_sql()} FROM folded f JOIN wide w ON w.place = f.place + 1)) SELECT 0 AS run_index, set_index AS num_sets, k::INT AS frequency_level, round(list_sum(s3) + CASE WHEN k <= 2 THEN list_sum(s2) ELSE 0 END + CASE WHEN k <= 1 THEN list_sum(s1) ELSE 0 END, 3) AS estimate FROM folded CROSS JOIN range(1, 4) t(k)")
def stratified_voc_estimate(spark, d):
    return rounded(m.stratified_voc_method(256, 3)(imp(spark, d), SEED), 3)


@query()
def stratified_filter_estimate(spark, d):
    return m.stratified_filter_method(EXPONENTIAL, 3, "expectation")(imp(spark, d), SEED)


@query()
def stratified_bayesian_estimate(spark, d):
    return m.stratified_filter_method(EXPONENTIAL, 3, "bayesian", local_epsilon=log(3))(imp(spark, d), SEED)


def sequential_sql(counts: str, length: int) -> str:
    """CTEs from (set_index, register, value) to seq (num_sets, size): vectors merged from left to right."""
    return f"dense AS (SELECT row_number() OVER (ORDER BY s.set_index) AS place, s.set_index, list(coalesce(v.value, 0.0::DOUBLE) ORDER BY r.k) AS v FROM (SELECT DISTINCT set_index FROM imp) s CROSS JOIN range({length}) r(k) LEFT JOIN {counts} v ON v.set_index = s.set_index AND v.register = r.k GROUP BY s.set_index), seqs AS (SELECT place, set_index, v AS s FROM dense WHERE place = 1 UNION ALL SELECT d.place, d.set_index, list_transform(list_zip(s, d.v), lambda x: (x[1] + x[2]) * (1 - {common_sql('s', 'd.v', length)} / (list_sum(s) + list_sum(d.v)))) FROM seqs JOIN dense d ON d.place = seqs.place + 1), seq AS (SELECT set_index AS num_sets, list_sum(s) AS size FROM seqs)"


@query(f"WITH RECURSIVE {IMP}, {VOC_SQL}, {sequential_sql('voc', 64)} SELECT 0 AS run_index, num_sets, round(size, 3) AS estimate FROM seq")
def voc_sequential_estimate(spark, d):
    rows = imp(spark, d)
    return rounded(folds.voc_prefixes(VOC.build(rows), rows, 64, alg.CountAlgebra()), 3)


_META = f"regs AS (SELECT DISTINCT set_index, {EXP_INDEX} AS id FROM imp), metas AS (SELECT set_index, ({h(SEED + 1)} % 1024)::INT AS register, count(*)::DOUBLE AS value FROM regs GROUP BY ALL)"


@query(f"WITH RECURSIVE {IMP}, {_META}, {sequential_sql('metas', 1024)}, act AS (SELECT num_sets, greatest(0, least(round(size), {LENGTH - 1}))::DOUBLE AS target FROM seq), {inverse_sql('act', 'num_sets', EXP_FILL)} {ESTIMATES}")
def meta_voc_estimate(spark, d):
    return rounded(m.meta_voc_method(EXPONENTIAL, 1024)(imp(spark, d), SEED), 3)


@query()
def legions_posterior_estimate(spark, d):
    return m.liquid_method(DECAY, LENGTH, 0.25, sequential=True)(imp(spark, d), SEED)


UNITED = "seen AS (SELECT set_index AS num_sets, register, 1 - product(1 - value) OVER (PARTITION BY register ORDER BY set_index) AS uv FROM clean)"


@query(f"WITH RECURSIVE {IMP}, {flips_sql(LIQ_INDEX, LENGTH, 0.25)}, {UNITED}, act AS (SELECT num_sets, greatest(0, least(sum(uv), {LENGTH - 1})) AS target FROM seen GROUP BY num_sets), {inverse_sql('act', 'num_sets', EXP_FILL)} {ESTIMATES}")
def legions_noised_estimate(spark, d):
    """The library inverts the matrix of the flips' transitions; SQL sums unbiased products."""
    return rounded(m.liquid_method(DECAY, LENGTH, 0.25)(imp(spark, d), SEED), 3)


@query(f"WITH {IMP}, {flips_sql(CAS_INDEX, 2560, 0.25)}, {UNITED}, cells AS (SELECT num_sets, register // 256 AS legion, pow(2.0::DOUBLE, least(register // 256 + 1, 9)) AS scale, sum(uv) AS active FROM seen GROUP BY ALL), sized AS (SELECT *, CASE WHEN active < 256 THEN -ln(greatest(1 - active / 256, 1e-300::DOUBLE)) * 256 * scale END AS size FROM cells), golden AS (SELECT num_sets, arg_min(greatest(size, 0), legion) FILTER (size < 128 * scale) AS size FROM sized GROUP BY num_sets) SELECT 0 AS run_index, num_sets, round(size, 3) AS estimate FROM golden")
def cascading_noised_estimate(spark, d):
    return rounded(m.cascading_method(10, 256, 0.25)(imp(spark, d), SEED), 3)


@query(f"WITH RECURSIVE {IMP}, {flips_sql(LIQ_INDEX, LENGTH, 0.1)}, both_ AS (SELECT register, any_value(value) FILTER (set_index = 1) AS a, any_value(value) FILTER (set_index = 2) AS b FROM clean GROUP BY register), act AS (SELECT part, greatest(0, least(t, {LENGTH - 1})) AS target FROM (SELECT 'a' AS part, sum(a) AS t FROM both_ UNION ALL SELECT 'b', sum(b) FROM both_ UNION ALL SELECT 'ab', sum(1 - (1 - a) * (1 - b)) FROM both_)), {inverse_sql('act', 'part', EXP_FILL)}, w AS (SELECT any_value(n) FILTER (part = 'a') AS a, any_value(n) FILTER (part = 'b') AS b, any_value(n) FILTER (part = 'ab') AS ab FROM inv), e AS (SELECT a, b, greatest(least(a + b, ab), a, b) AS either FROM w) SELECT k::INT AS part, round([0.0::DOUBLE, either - b, either - a, a + b - either][k + 1], 3) AS cardinality FROM e CROSS JOIN range(4) t(k)")
def legions_venn(spark, d):
    """The parts of two noised legions' Venn diagram."""
    rows = imp(spark, d).where("set_index in (1, 2)")
    noised = noisers.noised_legions(LIQUID.build(rows), rows, LENGTH, 0.1, SEED)

    def run(own):
        import pandas as pd

        bits = [folds.vectors(own[own["set_index"] == n], LENGTH) for n in (1, 2)]
        parts = posterior.venn_of(bits, [0.1, 0.1], LIQUID)
        return pd.DataFrame({"part": range(4), "cardinality": parts})

    return noised.groupBy("run_index").applyInPandas(run, "part int, cardinality double").withColumn("cardinality", F.round("cardinality", 3))


# ---- noise ---------------------------------------------------------------------------------


def lap(*parts: str) -> str:
    v = f"({u(chr(39) + 'laplace' + chr(39), *parts)} - 0.5)"
    return f"(-{{scale}} * sign({v}) * ln(1 - 2 * abs({v})))"


@query(f"{IDS} SELECT id, round({lap(chr(39) + '7' + chr(39), 'id::VARCHAR').format(scale='2.0::DOUBLE')}, 6) AS laplace, (ceil(ln({u(chr(39) + 'geometric1' + chr(39), chr(39) + '7' + chr(39), 'id::VARCHAR')}) / -0.5::DOUBLE) - ceil(ln({u(chr(39) + 'geometric2' + chr(39), chr(39) + '7' + chr(39), 'id::VARCHAR')}) / -0.5::DOUBLE))::BIGINT AS geometric, round({numerics.gaussian_sigma(0.5, 1e-5)!r}::DOUBLE * sqrt(-2 * ln({u(chr(39) + 'gauss1' + chr(39), chr(39) + '7' + chr(39), 'id::VARCHAR')})) * cos({2 * np.pi!r}::DOUBLE * ({u(chr(39) + 'gauss2' + chr(39), chr(39) + '7' + chr(39), 'id::VARCHAR')})), 6) AS gaussian FROM ids")
def noise_mechanisms(spark, d):
    i = F.col("id")
    return ids(spark, d).select("id", F.round(noise.laplace(2.0, 7, i), 6).alias("laplace"), noise.geometric(0.5, 7, i).alias("geometric"), F.round(noise.gaussian(0.5, 1e-5, 7, i), 6).alias("gaussian"))


@query()
def discrete_gaussian_noise(spark, d):
    return ids(spark, d).select("id", noise.discrete_gaussian(3.0, hash_id(F.col("id"), SEED)).alias("noise"))


BLIP_SQL = f"bits AS (SELECT DISTINCT {KEYS}, ({h()} % 512)::INT AS register FROM imp), full_ AS (SELECT s.run_index, s.set_index, r.k::INT AS register, (b.register IS NOT NULL)::INT AS bit FROM (SELECT DISTINCT run_index, set_index FROM imp) s CROSS JOIN range(512) r(k) LEFT JOIN bits b ON b.run_index = s.run_index AND b.set_index = s.set_index AND b.register = r.k), noised AS (SELECT run_index, set_index, register, CASE WHEN bit = 1 THEN (uu >= 0.25)::INT ELSE (uu < 0.25)::INT END AS value FROM (SELECT *, {u(chr(39) + 'flip' + chr(39), chr(39) + '7' + chr(39), 'run_index::VARCHAR', 'set_index::VARCHAR', 'register::VARCHAR')} AS uu FROM full_))"
SMALL = sk.uniform_filter(512, seed=SEED)


@query(f"WITH {IMP}, {BLIP_SQL} SELECT * FROM noised")
def blip_flip(spark, d):
    rows = imp(spark, d)
    return noisers.flip(SMALL.build(rows), rows, 512, SEED, 0.25)


@query(f"WITH {IMP}, {BLIP_SQL} SELECT run_index, set_index, register, round((value - 0.25) / 0.5, 6) AS value FROM noised")
def surreal_denoise(spark, d):
    rows = imp(spark, d)
    return noisers.denoise(noisers.flip(SMALL.build(rows), rows, 512, SEED, 0.25), probability=0.25).withColumn("value", F.round("value", 6))


@query(f"WITH {IMP}, {BLIP_SQL}, seen AS (SELECT set_index, register, 1 - product(1 - (value - 0.25) / 0.5) OVER (PARTITION BY register ORDER BY set_index) AS uv FROM noised) SELECT 0 AS run_index, set_index AS num_sets, round(sum(uv), 6) AS active FROM seen GROUP BY set_index")
def denoised_union(spark, d):
    rows = imp(spark, d)
    clean = noisers.denoise(noisers.flip(SMALL.build(rows), rows, 512, SEED, 0.25), probability=0.25)
    return prefixes.fuzzy_or(clean, prefixes.set_grid(rows)).withColumn("active", F.round("active", 6))


@query(f"WITH RECURSIVE {IMP}, {flips_sql(EXP_INDEX, LENGTH, numerics.flip_probability(log(3)))}, {UNITED}, act AS (SELECT num_sets, greatest(0, least(sum(uv), {LENGTH})) AS target FROM seen GROUP BY num_sets), {inverse_sql('act', 'num_sets', EXP_FILL)} {ESTIMATES}")
def noised_filter_estimate(spark, d):
    return rounded(m.filter_method(EXPONENTIAL, log(3))(imp(spark, d), SEED), 3)


@query(f"WITH {IMP}, {VOC_SQL}, full_ AS (SELECT s.run_index, s.set_index, r.k::INT AS register, coalesce(value, 0.0::DOUBLE) AS v FROM (SELECT DISTINCT run_index, set_index FROM imp) s CROSS JOIN range(64) r(k) LEFT JOIN voc ON voc.set_index = s.set_index AND voc.register = r.k) SELECT run_index, set_index, register, round(v + {lap(chr(39) + '7' + chr(39), 'run_index::VARCHAR', 'set_index::VARCHAR', 'register::VARCHAR').format(scale='1.0::DOUBLE')}, 6) AS value FROM full_")
def noised_counts(spark, d):
    rows = imp(spark, d)
    return noisers.noised_counts(VOC.build(rows), rows, 64, 1.0, SEED).withColumn("value", F.round("value", 6))


_ADD = h60_sql("'7'", "'add'", "run_index::VARCHAR", "set_index::VARCHAR", "t::VARCHAR")


@query(f"WITH {IMP}, held AS (SELECT DISTINCT * FROM imp), sizes AS (SELECT run_index, set_index, count(*) AS n FROM held GROUP BY ALL), tries AS (SELECT run_index, set_index, unnest(range(1, (20 + n) * 2 + 65)) AS t FROM sizes), drawn AS (SELECT run_index, set_index, {_ADD} % 1000000 AS id, min(t) AS t FROM tries GROUP BY ALL), fresh AS (SELECT * FROM drawn ANTI JOIN held USING (run_index, set_index, id)) SELECT run_index, set_index, id FROM held UNION ALL SELECT run_index, set_index, id FROM (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY run_index, set_index ORDER BY t) <= 20)")
def add_random_elements(spark, d):
    return noisers.add_random_elements(imp(spark, d).distinct(), 20, 1_000_000, SEED)


@query(f"WITH {KPLUS} SELECT run_index, num_sets, frequency_level, round(cardinality + {lap(chr(39) + '7' + chr(39), 'run_index::VARCHAR', 'num_sets::VARCHAR', 'frequency_level::VARCHAR').format(scale='2.0::DOUBLE')}, 6) AS estimate FROM kplus")
def noised_levels(spark, d):
    levels = prefixes.level_reach(imp(spark, d), TOP).withColumnRenamed("cardinality", "estimate")
    return rounded(noisers.noised_levels(levels, "laplace", 7, epsilon=0.5))


# ---- generators ----------------------------------------------------------------------------

RUNS, UNIVERSE = 2, 2000


def sample_sql(sizes: list[int], universe: int = UNIVERSE, label: str = "set", runs: int = RUNS, seed: int = SEED) -> str:
    """The first `size` different ids among hashed draws (here of twice the universe's draws, more than can be needed)."""
    listed_ = ", ".join(f"({i + 1}, {s})" for i, s in enumerate(sizes))
    draw = h60_sql(f"'{seed}'", f"'{label}'", "run_index::VARCHAR", "set_index::VARCHAR", "t::VARCHAR")
    return f"(SELECT run_index, set_index, id FROM (SELECT run_index, set_index, size, {draw} % {universe} AS id, min(t) AS t FROM (SELECT r.run_index::INT AS run_index, s.set_index, s.size, i.t FROM range({runs}) r(run_index) CROSS JOIN (VALUES {listed_}) s(set_index, size) CROSS JOIN range(1, {2 * universe + 1}) i(t)) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY run_index, set_index ORDER BY t) <= size)"


@query(f"SELECT * FROM {sample_sql([50, 200, 700])}")
def gen_independent(spark, d):
    return gen.Independent(UNIVERSE, [50, 200, 700]).generate(spark, RUNS, SEED)


@query(f"SELECT run_index, n.n::INT AS set_index, id FROM {sample_sql([300])} CROSS JOIN range(1, 5) n(n)")
def gen_fully_overlapping(spark, d):
    return gen.FullyOverlapping(UNIVERSE, 4, 300).generate(spark, RUNS, SEED)


@query("SELECT r.r::INT AS run_index, 1 AS set_index, i.i AS id FROM range(2) r(r) CROSS JOIN range(0, 10) i(i) UNION ALL SELECT r.r::INT, 2, i.i FROM range(2) r(r) CROSS JOIN range(10, 35) i(i)")
def gen_disjoint(spark, d):
    return gen.Disjoint([10, 25]).generate(spark, RUNS)


@query(f"WITH large AS {sample_sql([500])}, again AS (SELECT *, row_number() OVER (PARTITION BY run_index ORDER BY {h60_sql(chr(39) + '7' + chr(39), chr(39) + 'subset' + chr(39), 'run_index::VARCHAR', 'id::VARCHAR')}, id) AS place FROM large) SELECT run_index, (6 - n.n)::INT AS set_index, id FROM again CROSS JOIN range(1, 6) n(n) WHERE n.n <= 2 OR place <= 100")
def gen_subset(spark, d):
    return gen.Subset("reversed", UNIVERSE, 2, 3, 500, 100).generate(spark, RUNS, SEED)


_POOL = f"pool AS (SELECT r.r::INT AS run_index, i.i AS id, row_number() OVER (PARTITION BY r.r ORDER BY {h60_sql(chr(39) + '7' + chr(39), chr(39) + 'pool' + chr(39), 'r.r::VARCHAR', 'i.i::VARCHAR')}, i.i) - 1 AS position FROM range({RUNS}) r(r) CROSS JOIN range({{n}}) i(i))"


@query(f"WITH {_POOL.format(n=250)}, s(set_index, b, e, o) AS (VALUES (1, 0, 100, 0), (2, 100, 150, 50), (3, 150, 250, 100)) SELECT run_index, set_index, id FROM pool JOIN s ON position >= b - o AND position < e")
def gen_correlated_one(spark, d):
    return gen.SequentiallyCorrelated("original", "one", 0.5, [100, 100, 200]).generate(spark, RUNS, SEED)


@query(f"WITH {_POOL.format(n=250)}, s(set_index, b, e, o) AS (VALUES (1, 0, 100, 0), (2, 100, 150, 50), (3, 150, 250, 100)), old AS (SELECT run_index, set_index, id, o, row_number() OVER (PARTITION BY run_index, set_index ORDER BY {h60_sql(chr(39) + '7' + chr(39), chr(39) + 'shared' + chr(39), 'run_index::VARCHAR', 'set_index::VARCHAR', 'id::VARCHAR')}, id) AS place FROM pool JOIN s ON position < b) SELECT run_index, set_index, id FROM pool JOIN s ON position >= b AND position < e UNION ALL SELECT run_index, set_index, id FROM old WHERE place <= o")
def gen_correlated_all(spark, d):
    return gen.SequentiallyCorrelated("original", "all", 0.5, [100, 100, 200]).generate(spark, RUNS, SEED)


_BOW_ENDS = np.cumsum(gen.BOW_SHARES)
_BOW_GROUP = "CASE " + " ".join(f"WHEN g < {float(e)!r}::DOUBLE THEN {i}" for i, e in enumerate(_BOW_ENDS)) + f" ELSE {len(_BOW_ENDS) - 1} END"
_BOW_SIZES = ", ".join(f"({s}, {n}, {i}, {int(min(1.0, n / UNIVERSE * x) * round(float(share) * UNIVERSE))})" for s, n in ((1, 100), (2, 400)) for i, (share, x) in enumerate(zip(np.diff(_BOW_ENDS, prepend=0.0), gen.BOW_LEVELS)))


@query(f"WITH people AS (SELECT r.r::INT AS run_index, s.s::INT AS set_index, i.i AS id, {u(chr(39) + '7' + chr(39), chr(39) + 'bow' + chr(39), 'r.r::VARCHAR', 's.s::VARCHAR', 'i.i::VARCHAR')} AS g FROM range({RUNS}) r(r) CROSS JOIN range(1, 3) s(s) CROSS JOIN range({UNIVERSE}) i(i)), grouped AS (SELECT *, {_BOW_GROUP} AS stratum FROM people), sizes(set_index, size, stratum, wanted) AS (VALUES {_BOW_SIZES}) SELECT run_index, set_index, id FROM (SELECT g.*, wanted FROM grouped g JOIN sizes s ON s.set_index = g.set_index AND s.stratum = g.stratum) QUALIFY row_number() OVER (PARTITION BY run_index, set_index, stratum ORDER BY {h60_sql(chr(39) + '7' + chr(39), chr(39) + 'set' + chr(39), 'run_index::VARCHAR', 'set_index::VARCHAR', 'id::VARCHAR')}, id) <= wanted")
def gen_exponential_bow(spark, d):
    return gen.ExponentialBow("independent", UNIVERSE, [100, 400]).generate(spark, RUNS, SEED)


_UF = u("'7'", "'frequency'", "run_index::VARCHAR", "set_index::VARCHAR", "id::VARCHAR")
_CDF = np.cumsum(numerics.truncated_poisson(1.0, 4))


@query(f"SELECT run_index, set_index, id FROM (SELECT *, 1 + {' + '.join(f'({e!r}::DOUBLE < ({_UF}))::INT' for e in map(float, _CDF[:-1]))} AS f FROM {sample_sql([100, 300])}) CROSS JOIN range(1, 5) n(n) WHERE n.n <= f")
def gen_homogeneous(spark, d):
    return gen.homogeneous(UNIVERSE, [100, 300], [1.0, 1.0], 5).generate(spark, RUNS, SEED)


@query(f"SELECT run_index, set_index, id FROM (SELECT *, least(floor(ln(1 - ({_UF})) / {log(0.5)!r}::DOUBLE) + 1, 3) AS f FROM {sample_sql([100, 300])}) CROSS JOIN range(1, 4) n(n) WHERE n.n <= f")
def gen_heterogeneous(spark, d):
    return gen.Heterogeneous(UNIVERSE, [100, 300], [(1, 1)] * 2, 3).generate(spark, RUNS, SEED)


@query(f"SELECT run_index, set_index, id FROM {sample_sql([100, 300])} CROSS JOIN range(3) n(n)")
def gen_publisher_constant(spark, d):
    return gen.PublisherConstant(UNIVERSE, [100, 300], 3).generate(spark, RUNS, SEED)


# ---- simulation and analysis ---------------------------------------------------------------

EXACT = registry.exact(3)
_PIV = ", ".join(f"max(cardinality) FILTER (frequency_level = {k})::DOUBLE AS estimated_cardinality_{k}, max(cardinality) FILTER (frequency_level = {k}) AS true_cardinality_{k}" for k in (1, 2, 3))


@query(f"WITH {KPLUS}, w AS (SELECT run_index, num_sets, {_PIV} FROM kplus GROUP BY ALL) SELECT *, 0.0::DOUBLE AS shuffle_distance, 0.0::DOUBLE AS relative_error_1, 0.0::DOUBLE AS relative_error_2, 0.0::DOUBLE AS relative_error_3 FROM w")
def raw_results_exact(spark, d):
    return simulate.raw_results(imp(spark, d), EXACT, SEED, 3)


_RAW_INDEX = decaying_sql(exp(-DECAY / 100_001), 100_000)


@query(f"WITH RECURSIVE {KPLUS}, {prefix_active_sql(_RAW_INDEX)}, {inverse_sql('act', 'num_sets', exponential_fill_sql(100_000, DECAY))} SELECT 0 AS run_index, num_sets, round(n, 3) AS estimated_cardinality_1, cardinality AS true_cardinality_1, 0.0::DOUBLE AS shuffle_distance, round((n - cardinality) / cardinality, 6) + 0.0::DOUBLE AS relative_error_1 FROM inv JOIN kplus USING (num_sets) WHERE frequency_level = 1")
def raw_results_filter(spark, d):
    raw = simulate.raw_results(imp(spark, d), registry.exp_filter(100_000), SEED)
    return raw.withColumns({"estimated_cardinality_1": F.round("estimated_cardinality_1", 3), "relative_error_1": F.round("relative_error_1", 6) + 0.0})


@query(f"WITH {KPLUS}, e AS (SELECT num_sets, frequency_level, cardinality * (1 + num_sets * frequency_level / 10.0::DOUBLE) AS estimate, cardinality FROM kplus WHERE frequency_level <= 3), w AS (SELECT num_sets, " + ", ".join(f"max(estimate) FILTER (frequency_level = {k}) AS e{k}, max(cardinality) FILTER (frequency_level = {k}) AS t{k}" for k in (1, 2, 3)) + " FROM e GROUP BY num_sets) SELECT 0 AS run_index, num_sets, " + ", ".join(f"round(e{k}, 6) AS estimated_cardinality_{k}, t{k} AS true_cardinality_{k}, round((e{k} - t{k}) / t{k}, 6) AS relative_error_{k}" for k in (1, 2, 3)) + ", round((abs((e1 - e2) / e1 - (t1 - t2) / t1::DOUBLE) + abs((e2 - e3) / e1 - (t2 - t3) / t1::DOUBLE) + abs(e3 / e1 - t3 / t1::DOUBLE)) / 2, 6) AS shuffle_distance FROM w")
def raw_results_off(spark, d):
    """Errors and shuffle distance of estimates that are off by a known factor, which differs by level."""

    def estimate(rows, seed):
        levels = prefixes.level_reach(rows, 3)
        return levels.select("run_index", "num_sets", "frequency_level", (F.col("cardinality") * (1 + F.col("num_sets") * F.col("frequency_level") / 10.0)).alias("estimate"))

    raw = simulate.raw_results(imp(spark, d), m.Method("off", estimate, 3), SEED, 3)
    return raw.select("run_index", "num_sets", *[c if c.startswith("true_") else F.round(c, 6).alias(c) for c in raw.columns if c not in ("run_index", "num_sets")])


_SMOKE_SEED = h60_value("sketch", 2) % (1 << 31)
_SMOKE_METRICS = ("estimated_cardinality_1", "true_cardinality_1", "shuffle_distance", "relative_error_1")


def smoke_sql(hashed: str) -> str:
    return f"WITH imp AS MATERIALIZED {sample_sql([2000] * 5, 20_000, 'set', 5, 1)}, firsts AS (SELECT run_index, {hashed} % 100000 AS register, min(set_index) AS s FROM imp GROUP BY ALL), ids AS (SELECT run_index, id, min(set_index) AS s FROM imp GROUP BY ALL), raw AS (SELECT r.run_index, g.n AS num_sets, (SELECT count(*) FROM firsts f WHERE f.run_index = r.run_index AND f.s <= g.n) AS x, (SELECT count(*) FROM ids f WHERE f.run_index = r.run_index AND f.s <= g.n) AS true_cardinality_1 FROM (SELECT DISTINCT run_index FROM imp) r CROSS JOIN range(1, 6) g(n)), e AS (SELECT num_sets::INT AS num_sets, -100000 * ln(1 - x / 100000.0::DOUBLE) AS estimated_cardinality_1, true_cardinality_1::DOUBLE AS true_cardinality_1, 0.0::DOUBLE AS shuffle_distance, (-100000 * ln(1 - x / 100000.0::DOUBLE) - true_cardinality_1) / true_cardinality_1 AS relative_error_1 FROM raw) SELECT num_sets, " + ", ".join(f"round(avg({c}), 6) + 0.0::DOUBLE AS {c}_mean, round(stddev_samp({c}), 6) + 0.0::DOUBLE AS {c}_std" for c in _SMOKE_METRICS) + " FROM e GROUP BY num_sets"


@query(smoke_sql(h(_SMOKE_SEED)))
def simulate_smoke(spark, d):
    """A small run of a whole scenario: 5 runs of 5 independent sets under the uniform filter, all with one hash seed."""
    return smoke(simulate.simulate(spark, gen.Independent(20_000, [2000] * 5), registry.uniform_filter(100_000), 5, shared_seed=True))


def smoke(raw):
    found = simulate.aggregated(raw)
    return found.select("num_sets", *[(F.round(c, 6) + 0.0).alias(c) for c in found.columns if c != "num_sets"])


_RUN_ID = f"CASE WHEN run_index = 0 THEN id ELSE xor(id, {h60_sql(repr(str(_SMOKE_SEED)), repr('run'), 'run_index::VARCHAR')}) END"


@query(smoke_sql(h(_SMOKE_SEED, f"({_RUN_ID})")))
def simulate_run_seeds(spark, d):
    """The same with a hash seed for each run, as evaluations have it."""
    return smoke(simulate.simulate(spark, gen.Independent(20_000, [2000] * 5), registry.uniform_filter(100_000), 5))


RAW = "raw AS (SELECT l_returnflag AS sketch_estimator, l_linestatus AS scenario, (l_orderkey % 20)::INT AS run_index, l_linenumber AS num_sets, round(avg(l_discount) - 0.05, 9) AS relative_error_1, round(sum(l_quantity), 6) AS estimated_cardinality_1, round(sum(l_quantity) / 2, 6) AS estimated_cardinality_2, round(sum(l_tax), 6) AS true_cardinality_1, round(sum(l_tax) / 2, 6) AS true_cardinality_2 FROM lineitem GROUP BY ALL)"
CRITERIA = [(0.01, 0.8), (0.005, 0.6), (0.001, 0.5)]


def raw_frame(spark, d):
    li = tables.read(spark, d, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("sketch_estimator"), F.col("l_linestatus").alias("scenario"), (F.col("l_orderkey") % 20).cast("int").alias("run_index"), F.col("l_linenumber").alias("num_sets")).agg(
        F.round(F.avg("l_discount") - 0.05, 9).alias("relative_error_1"),
        F.round(F.sum("l_quantity"), 6).alias("estimated_cardinality_1"),
        F.round(F.sum("l_quantity") / 2, 6).alias("estimated_cardinality_2"),
        F.round(F.sum("l_tax"), 6).alias("true_cardinality_1"),
        F.round(F.sum("l_tax") / 2, 6).alias("true_cardinality_2"),
    )


_CRIT = "crit(error_margin, proportion_of_runs) AS (VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in CRITERIA) + ")"
ESTIMABLE = f"{RAW}, {_CRIT}, shares AS (SELECT error_margin, proportion_of_runs, sketch_estimator, scenario, num_sets, avg((abs(relative_error_1) < error_margin)::INT) >= proportion_of_runs OR num_sets <= 1 AS ok FROM raw CROSS JOIN crit GROUP BY error_margin, proportion_of_runs, sketch_estimator, scenario, num_sets), ff AS (SELECT *, min(num_sets) FILTER (NOT ok) OVER (PARTITION BY error_margin, proportion_of_runs, sketch_estimator, scenario) AS first_failure FROM shares), estimable AS (SELECT error_margin, proportion_of_runs, sketch_estimator, scenario, coalesce(max(num_sets) FILTER (num_sets > 1 AND (first_failure IS NULL OR num_sets < first_failure)), 0)::INT AS num_estimable_sets FROM ff GROUP BY error_margin, proportion_of_runs, sketch_estimator, scenario)"


@query(f"WITH {ESTIMABLE} SELECT * FROM estimable")
def estimable_sets(spark, d):
    return analyze.estimable_sets(raw_frame(spark, d), analyze.criteria_table(spark, CRITERIA))


def summary(spark, d):
    found = analyze.error_at_estimable(raw_frame(spark, d), estimable_sets(spark, d))
    return found.withColumns({c: report.signed_round(F.col(c), 6) for c in ("relative_error_1_mean", "relative_error_1_std")})


@query(f"WITH {ESTIMABLE} SELECT error_margin, proportion_of_runs, e.sketch_estimator, e.scenario, num_estimable_sets, round(avg(relative_error_1), 6) AS relative_error_1_mean, round(stddev_samp(relative_error_1), 6) AS relative_error_1_std FROM estimable e LEFT JOIN raw r ON r.sketch_estimator = e.sketch_estimator AND r.scenario = e.scenario AND r.num_sets = num_estimable_sets GROUP BY ALL")
def error_at_estimable(spark, d):
    return summary(spark, d)


_METRIC = ("estimated_cardinality_1", "estimated_cardinality_2", "true_cardinality_1", "true_cardinality_2")
LONG = RAW + ", long AS (" + " UNION ALL ".join(f"SELECT sketch_estimator, scenario, run_index, num_sets, {c} AS cardinality, '{c[:-2]}' AS source, {c[-1]} AS frequency_level FROM raw" for c in _METRIC) + ")"


@query(f"WITH {LONG} SELECT * FROM long")
def unpivot_long(spark, d):
    return analyze.long_frequencies(raw_frame(spark, d))


@query(f"WITH {LONG} SELECT sketch_estimator, scenario, run_index, num_sets, round(cardinality - coalesce(lead(cardinality) OVER (PARTITION BY sketch_estimator, scenario, run_index, num_sets, source ORDER BY frequency_level), 0), 6) AS cardinality, source, frequency_level FROM long")
def per_frequency(spark, d):
    return analyze.per_frequency(analyze.long_frequencies(raw_frame(spark, d))).withColumn("cardinality", F.round("cardinality", 6))


@query(f"WITH {LONG}, {ESTIMABLE[len(RAW) + 2:]} SELECT l.*, error_margin, proportion_of_runs FROM long l JOIN estimable e ON e.sketch_estimator = l.sketch_estimator AND e.scenario = l.scenario AND e.num_estimable_sets = l.num_sets")
def frequencies_at_estimable(spark, d):
    return analyze.at_estimable(analyze.long_frequencies(raw_frame(spark, d)), estimable_sets(spark, d))


@query(f"WITH {LONG} SELECT * FROM long QUALIFY num_sets = max(num_sets) OVER (PARTITION BY sketch_estimator, scenario)")
def frequencies_at_most_sets(spark, d):
    return analyze.at_most_sets(analyze.long_frequencies(raw_frame(spark, d)))


@query(f"WITH {RAW}, q AS (SELECT sketch_estimator, scenario, num_sets, quantile_cont(greatest(-0.1, least(0.1, relative_error_1)), [0, 0.25, 0.5, 0.75, 1]) AS p FROM raw GROUP BY ALL) SELECT sketch_estimator, scenario, num_sets, round(p[1], 6) + 0.0::DOUBLE AS low, round(p[2], 6) + 0.0::DOUBLE AS q1, round(p[3], 6) + 0.0::DOUBLE AS median, round(p[4], 6) + 0.0::DOUBLE AS q3, round(p[5], 6) + 0.0::DOUBLE AS high FROM q")
def box_plot(spark, d):
    return analyze.box_plot(raw_frame(spark, d)).withColumns({c: F.round(c, 6) for c in ("low", "q1", "median", "q3", "high")})


@query(f"WITH {LONG} SELECT sketch_estimator, scenario, frequency_level, source, round(avg(cardinality), 6) AS cardinality FROM long GROUP BY ALL")
def bar_plot(spark, d):
    return analyze.bar_plot(analyze.long_frequencies(raw_frame(spark, d))).withColumn("cardinality", F.round("cardinality", 6))


@query(f"WITH {RAW}, e AS (SELECT scenario, num_sets::DOUBLE / 10 AS eps, relative_error_1 AS x FROM raw), s AS (SELECT scenario, eps, avg((abs(x) < 0.01)::INT) AS share, stddev_pop(x) AS std FROM e GROUP BY ALL) SELECT scenario, min(eps) AS least_epsilon, round(arg_min(std, eps), 6) AS std FROM s WHERE share >= 0.5 GROUP BY scenario")
def least_epsilon(spark, d):
    rows = raw_frame(spark, d).withColumn("estimate_epsilon", F.col("num_sets").cast("double") / 10)
    return analyze.least_epsilon(rows, 0.01, 0.5, ("scenario",)).withColumn("std", F.round("std", 6))


@query(f"WITH {RAW} SELECT num_sets, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std" for c in ("relative_error_1", *_METRIC)) + " FROM raw GROUP BY num_sets")
def aggregated_results(spark, d):
    out = simulate.aggregated(raw_frame(spark, d))
    return out.select("num_sets", *[F.round(c, 6).alias(c) for c in out.columns if c != "num_sets"])


@query("WITH n(name) AS (VALUES ('vector_of_counts-4096-sequential-ln3-infty'), ('exact_multi_set-10000-lossless-no_local_dp-no_global_dp-5')) SELECT name, split_part(name, '-', 1) AS sketch, split_part(name, '-', 2) AS sketch_config, split_part(name, '-', 3) AS estimator, split_part(name, '-', 4) AS sketch_epsilon, split_part(name, '-', 5) AS estimate_epsilon, nullif(split_part(name, '-', 6), '') AS max_frequency FROM n")
def parsed_names(spark, d):
    rows = spark.createDataFrame([("vector_of_counts-4096-sequential-ln3-infty",), ("exact_multi_set-10000-lossless-no_local_dp-no_global_dp-5",)], "name string")
    return report.with_name_parts(rows, "name")


@query(f"WITH {ESTIMABLE}, s AS (SELECT error_margin, proportion_of_runs, e.sketch_estimator, e.scenario, num_estimable_sets, round(avg(relative_error_1), 6) AS mean, round(stddev_samp(relative_error_1), 6) AS std FROM estimable e LEFT JOIN raw r ON r.sketch_estimator = e.sketch_estimator AND r.scenario = e.scenario AND r.num_sets = num_estimable_sets GROUP BY ALL), c AS (SELECT round(proportion_of_runs * 100)::INT || '%/' || round(error_margin * 100)::INT || '%' AS criteria, sketch_estimator, scenario, num_estimable_sets || ' (' || coalesce(printf('%.4f', round(mean, 4)), 'nan') || ', ' || coalesce(printf('%.4f', round(std, 4)), 'nan') || ')' AS cell FROM s) SELECT criteria, sketch_estimator, coalesce(max(cell) FILTER (scenario = 'F'), '') AS \"F\", coalesce(max(cell) FILTER (scenario = 'O'), '') AS \"O\" FROM c GROUP BY ALL")
def pivoted_report(spark, d):
    return report.pivoted(summary(spark, d))


@query()
def registered_methods(spark, d):
    """Every configured method with its parameters."""
    rows = [(x.name, x.parts["sketch"], x.parts["sketch_config"], x.parts["estimator"], x.parts["sketch_epsilon"], x.parts["estimate_epsilon"]) for x in (*registry.cardinality_methods(), *registry.frequency_methods(5))]
    return spark.createDataFrame(rows, "name string, sketch string, sketch_config string, estimator string, sketch_epsilon double, estimate_epsilon double")


@query("WITH e AS (SELECT event_type, user_id FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL), t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS set_index FROM (SELECT DISTINCT event_type FROM e)), g AS (SELECT t.set_index::INT AS num_sets, count(DISTINCT user_id) AS ids FROM t JOIN t b ON b.set_index <= t.set_index JOIN e ON e.event_type = b.event_type GROUP BY ALL) SELECT 0 AS run_index, * FROM g")
def event_reach(spark, d):
    rows = tables.event_impressions(spark, d)
    return prefixes.distinct_ids(rows, prefixes.set_grid(rows))

