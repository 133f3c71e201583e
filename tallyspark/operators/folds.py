"""Ordered folds: merges whose result depends on the order of the sets.

One group per run holds that run's sketches as dense vectors, whose number and length
are parameters of the sketch, and returns the estimates of every prefix in one pass.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tallyspark.functions.numerics import reverse_cumulative
from tallyspark.operators.setalgebra import CountAlgebra

LEVELS = "run_index int, num_sets int, frequency_level int, estimate double"


def vectors(rows: pd.DataFrame, length: int) -> np.ndarray:
    """Dense vectors from (register, value) rows."""
    out = np.zeros(length)
    out[rows["register"].to_numpy()] = rows["value"].to_numpy(np.float64)
    return out


def voc_prefixes(registers: DataFrame, sets: DataFrame, num_buckets: int, algebra: CountAlgebra) -> DataFrame:
    """(run_index, num_sets, estimate): vectors of counts merged left to right."""
    all_ = with_empty_sets(registers.select("run_index", "set_index", "register", "value"), sets)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        own = [(int(n), vectors(g[g["register"] >= 0], num_buckets)) for n, g in rows.groupby("set_index")]
        sizes = algebra.prefix_sizes([v for _, v in own])
        return pd.DataFrame({"run_index": int(rows["run_index"].iloc[0]), "num_sets": [n for n, _ in own], "estimate": sizes})

    return all_.groupBy("run_index").applyInPandas(fold, "run_index int, num_sets int, estimate double")


def with_empty_sets(registers: DataFrame, sets: DataFrame) -> DataFrame:
    """A row with register -1 for each set, so that one without registers still counts as a set."""
    marks = sets.select("run_index", "set_index").distinct()
    rest = [F.lit(-1).cast(t).alias(n) if n in ("register", "id") else F.lit(None).cast(t).alias(n) for n, t in registers.dtypes if n not in ("run_index", "set_index")]
    return registers.unionByName(marks.select("run_index", "set_index", *rest))


def merge_strata(one: dict, two: dict, top: int, algebra) -> dict:
    """The strata of two multisets' sum. Keys 1 .. top are exact levels, top meaning top or more,
    and 0 is everyone.

    Level k holds those at k in one and absent from the other, and those whose levels add to k; the
    top one holds whoever adds to top or more.
    """
    out: dict = {}
    for k in range(1, top):
        alone_one = algebra.difference(one.get(k), algebra.intersection(one.get(k), two.get(0)))
        alone_two = algebra.difference(two.get(k), algebra.intersection(one.get(0), two.get(k)))
        parts = [algebra.intersection(one.get(i), two.get(k - i)) for i in range(1, k)]
        out[k] = reduce(algebra.union, parts, algebra.union(alone_one, alone_two))
    # whoever is at k in one needs at least top - k in the other: the rest after its lower levels
    state, rest = one.get(top), two.get(0)
    for k in range(1, top):
        state = algebra.union(state, algebra.intersection(one.get(top - k), rest))
        if k < top - 1:
            rest = algebra.difference(rest, two.get(k))
    alone = algebra.difference(two.get(top), algebra.intersection(two.get(top), one.get(0)))
    out[top] = algebra.union(state, alone)
    out[0] = reduce(algebra.union, [out[k] for k in range(1, top + 1)])
    return out


def stratum_level(stratum: str, top: int) -> int:
    """'1+' is 0, 'K+' is K, other strata are their number."""
    return 0 if stratum == "1+" else top if stratum.endswith("+") else int(stratum)


def stratified_prefixes(registers: DataFrame, sets: DataFrame, length: int, top: int, algebra) -> DataFrame:
    """k+ estimates of every prefix from stratified registers (stratum, register, value): strata are
    merged in order, each is sized by the algebra, and sizes are summed from the top down."""
    all_ = with_empty_sets(registers.select("run_index", "set_index", "stratum", "register", "value"), sets)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        run, state, out = int(rows["run_index"].iloc[0]), None, []
        for n, own in rows.groupby("set_index"):
            own = own[own["register"] >= 0]
            found = {stratum_level(s, top): vectors(g, length) for s, g in own.groupby("stratum")}
            # an empty stratum is a sketch of nothing, not an absent one
            strata = {k: found.get(k, np.zeros(length)) for k in range(top + 1)}
            state = strata if state is None else merge_strata(state, strata, top, algebra)
            sizes = np.array([algebra.size(state[k]) for k in range(1, top + 1)])
            out += [(run, int(n), k + 1, float(v)) for k, v in enumerate(reverse_cumulative(sizes))]
        return pd.DataFrame(out, columns=["run_index", "num_sets", "frequency_level", "estimate"])

    return all_.groupBy("run_index").applyInPandas(fold, LEVELS)


def stratified_exact(frequencies: DataFrame, top: int) -> DataFrame:
    """The exact merge of all sets' strata: (run_index, id, stratum) from (set_index, id, frequency).

    Adding frequencies is the whole merge, so it is one aggregation, in any order.
    """
    total = frequencies.groupBy("run_index", "id").agg(F.sum("frequency").alias("f"))
    return total.select("run_index", "id", F.when(F.col("f") >= top, F.lit(f"{top}+")).otherwise(F.col("f").cast("string")).alias("stratum"))
