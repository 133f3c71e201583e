"""Exact top-k by inner product with a KD-tree per shard.

Vectors are turned into integers. Median splits over a bounded sample of at most `SAMPLE` rows cut space
into shards of about `SHARD` rows, and every row goes to the shard it lies in, so that a shard's box is
tight; a shard that still holds more is dealt to tasks by hash. In a shard a KD-tree is split at medians down to leaves, each with its tight bounding
box. A query walks a tree best-first: the box's upper bound on the inner
product orders the heap, and the walk ends at the first bound below the kth score so far.

Queries are taken in blocks of at most `QUERIES` rows and `QUERY_BYTES`, which are broadcast; the rows are never copied for them. For a block each query is first
asked in the shard where it lies, and that kth score is propagated to all other shards, whose root
boxes are tested before a tree is even built.

Scores are exact integers: float64 products are used only where no sum can pass 2^53, 64-bit integers below 2^63, and
Python's integers beyond, whose scores are cut to the ends of the 64-bit range. Bounds are widened by their rounding error.

Cases: a vector that is null, empty, or holds null or non-finite components takes no part;
vectors of different lengths are not compared; a row is not its own
candidate, nor is another row with its id; repeated rows count once, and ties go to smaller ids; fewer than k candidates
are all returned; an empty table gives an empty table; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from tallyspark.llm.shared import appended, groups, materialize, partitions

SHARD, LEAF = 8192, 128
#: Bounds: rows that the splits are found from; spatial shards; queries and bytes of a broadcast block.
SAMPLE, SHARDS, QUERIES, QUERY_BYTES = 32_768, 4096, 16_384, 32 << 20
FOUND = "query_id long, vec_id long, score long"
#: Shards in preorder: for an inner node its axis, threshold and children, for a leaf its number.
Splits = list[tuple[int, float, int, int]]
#: A block of queries of one length: ids, vectors, the shard each lies in, and its kth score so far.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def median_splits(rows: np.ndarray, shards: int) -> Splits:
    """Splits of space at the medians of the widest axis until there are `shards` leaves."""
    made: Splits = []

    def grow(own: np.ndarray, want: int) -> int:
        at = len(made)
        made.append((-1, 0.0, 0, 0))
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if len(own) else 0
        if want > 1 and len(own) > 1 and own[:, axis].max() > own[:, axis].min():
            share = want // 2 / want
            cut = float(np.quantile(own[:, axis], share, method="higher"))
            left = own[:, axis] < cut
            if left.any():
                one, two = grow(own[left], want // 2), grow(own[~left], want - want // 2)
                made[at] = (axis, cut, one, two)
        return at

    grow(rows.astype(np.float64), shards)
    return made


def shard_of(splits: Splits, rows: np.ndarray) -> np.ndarray:
    """The leaf of the splits that each row lies in."""
    out = np.zeros(len(rows), np.int32)
    todo = [(0, np.arange(len(rows)))] if splits else []
    while todo:
        node, own = todo.pop()
        axis, cut, one, two = splits[node]
        if axis < 0:
            out[own] = node
        elif len(own):
            left = rows[own, axis] < cut
            todo += [(one, own[left]), (two, own[~left])]
    return out


class KDTree:
    """Nodes in preorder; a leaf's rows are order[begin:end]."""

    def __init__(self, rows: np.ndarray) -> None:
        self.order = np.arange(len(rows))
        self.low, self.high, self.begin, self.end, self.child = [], [], [], [], []
        self.grow(rows, 0, len(rows))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def grow(self, rows: np.ndarray, begin: int, end: int) -> int:
        own = rows[self.order[begin:end]]
        low, high = own.min(axis=0), own.max(axis=0)
        at = len(self.begin)
        self.low.append(low)
        self.high.append(high)
        self.begin.append(begin)
        self.end.append(end)
        self.child.append(())
        widest = int(np.argmax(high.astype(np.float64) - low))
        if end - begin > LEAF and high[widest] > low[widest]:
            middle = (end - begin) // 2
            self.order[begin:end] = self.order[begin:end][np.argpartition(own[:, widest], middle)]
            self.child[at] = (self.grow(rows, begin, begin + middle), self.grow(rows, begin + middle, end))
        return at


def products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The exact integer inner products of all rows with all queries."""
    most = int(largest(rows)) * int(largest(queries)) * rows.shape[1]
    if most < 1 << 53:
        return (rows.astype(np.float64) @ queries.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return rows @ queries.T
    exact = rows.astype(object) @ queries.T.astype(object)
    return np.clip(exact, LOW, HIGH).astype(np.int64)


def largest(values: np.ndarray) -> int:
    return max(-int(values.min()), int(values.max())) if values.size else 0


def bounds_of(low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """[query, box]: no vector in the box has a larger inner product with the query."""
    low, high, q = low.astype(np.float64), high.astype(np.float64), queries.astype(np.float64)
    sure = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    # what float64 sums can lose, and the cut of scores at the ends of the range
    slack = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T * (q.shape[1] + 4) * 2.0**-52
    return np.maximum(sure + slack, float(LOW))


def walk(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's number, ids, scores) of the shard's k best candidates not below the query's floor."""
    root = bounds_of(rows.min(axis=0)[None], rows.max(axis=0)[None], queries)[:, 0]
    able = np.flatnonzero(root >= floor)
    if not len(able):
        return
    tree = KDTree(rows)
    for at in range(0, len(able), 1024):
        part = able[at : at + 1024]
        own_queries = queries[part]
        bounds = bounds_of(tree.low, tree.high, own_queries)
        scored: dict[int, np.ndarray] = {}
        for i, q in enumerate(part):
            kth, best_scores, best_ids = int(floor[q]), np.zeros(0, np.int64), np.zeros(0, np.int64)
            heap = [(-bounds[i, 0], 0)]
            while heap and -heap[0][0] >= kth:
                _, node = heapq.heappop(heap)
                if tree.child[node]:
                    for c in tree.child[node]:
                        if bounds[i, c] >= kth:
                            heapq.heappush(heap, (-bounds[i, c], c))
                    continue
                members = tree.order[tree.begin[node] : tree.end[node]]
                if node not in scored:
                    # one matrix product gives the leaf's scores for all these queries
                    scored[node] = products(rows[members], own_queries)
                score, own = scored[node][:, i], ids[members]
                take = (score >= kth) & (own != query_ids[q])
                if take.any():
                    best_scores, best_ids = np.concatenate([best_scores, score[take]]), np.concatenate([best_ids, own[take]])
                    if len(best_scores) > k:
                        # by descending score, which -x would overflow at the range's end
                        keep = np.lexsort((best_ids, ~best_scores))[:k]
                        best_scores, best_ids = best_scores[keep], best_ids[keep]
                    if len(best_scores) == k:
                        kth = max(kth, int(best_scores.min()))
            if len(best_ids):
                yield int(q), best_ids, best_scores


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    some = some.where(~bad)
    return some.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v")).distinct()


def matrix_of(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks]).reshape(rows, -1)


def placed(rows: DataFrame, splits: dict[int, Splits]) -> DataFrame:
    """rows with the number of the shard each lies in. The splits have at most 2 SHARDS nodes of 32 bytes."""
    shipped = rows.sparkSession.sparkContext.broadcast(splits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column(2).to_numpy()
            shard = np.zeros(batch.num_rows, np.int32)
            for d in np.unique(dim):
                own = np.flatnonzero(dim == d)
                shard[own] = shard_of(shipped.value.get(int(d), []), matrix_of(batch.column(1).take(pa.array(own)), len(own)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], ["vec_id", "v", "dim", "shard"])

    return rows.mapInArrow(run, "vec_id long, v array<long>, dim int, shard int")


def search(rows: DataFrame, shipped: Broadcast, k: int, home: bool) -> DataFrame:
    """The block's best candidates, from the shard a query lies in or from all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Block] = shipped.value
        for table, starts in groups(batches, ["dim", "shard", "piece"]):
            out: list[list[np.ndarray]] = [[], [], []]
            for s, e in zip(starts[:-1], starts[1:]):
                part = table.slice(s, e - s)
                dim, shard = part.column("dim")[0].as_py(), part.column("shard")[0].as_py()
                if dim not in blocks:
                    continue
                query_ids, queries, at, floor = blocks[dim]
                asked = np.flatnonzero((at == shard) == home)
                if len(asked):
                    for q, own, score in walk(matrix_of(part.column("v"), e - s), part.column("vec_id").to_numpy(), queries[asked], query_ids[asked], floor[asked], k):
                        out[0].append(np.full(len(own), query_ids[asked[q]]))
                        out[1].append(own)
                        out[2].append(score)
            arrays = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out]
            yield pa.RecordBatch.from_arrays(arrays, ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, FOUND)


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_topk(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every,
    the k largest integer inner products with other rows, ties to smaller ids."""
    spark = vectors.sparkSession
    all_ = materialize(usable(vectors, scale).withColumn("dim", F.size("v")), "vectors")
    sizes = {r.dim: r.n for r in all_.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(SHARDS).collect()}
    total = sum(sizes.values())
    splits: dict[int, Splits] = {}
    for dim, n in sizes.items():
        shards = min(SHARDS, -(-n // SHARD))
        if shards > 1:
            # by hash, so that reruns agree; the bound holds over all lengths together
            sample = all_.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", "v")).limit(max(1, SAMPLE * n // total)).select("v")
            splits[dim] = median_splits(np.array([r.v for r in sample.collect()]), shards)
    rows = placed(all_, splits)
    pieces = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, total // (SHARDS * SHARD)))).cast("int")
    rows = rows.withColumn("piece", pieces)
    keys = ["dim", "shard", "piece"]
    rows = materialize(rows.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "vec_id"), "shards")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    count, width = asked.agg(F.count("*"), F.coalesce(F.sum(F.col("dim") + 4), F.lit(0))).first()
    blocks = max(1, -(-count // QUERIES), -(-8 * width // QUERY_BYTES))
    asked = materialize(asked.select("dim", "shard", "vec_id", "v").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))), "queries") if blocks > 1 else asked
    result = None
    for b in range(blocks):
        own = asked.where(F.col("block") == b) if blocks > 1 else asked
        found = one_block(rows, own.select("dim", "shard", "vec_id", "v"), k)
        result = appended(found, "best", result)
    return spark.read.schema(f"{FOUND}, rank int").parquet(result).select("query_id", "rank", "vec_id", "score")


def one_block(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best of a block of queries; the block's size is bounded, and so is what the driver gathers of it."""
    context = rows.sparkSession.sparkContext
    by: dict[int, list] = {}
    for r in asked.orderBy("vec_id").collect():
        by.setdefault(r.dim, []).append(r)
    queries = {d: (np.array([r.vec_id for r in own]), np.array([r.v for r in own], dtype=np.int64), np.array([r.shard for r in own])) for d, own in by.items()}
    first = materialize(search(rows, context.broadcast({d: (*q, np.full(len(q[0]), LOW)) for d, q in queries.items()}), k, True), "first")
    # the kth score at home is a floor for all other shards; ids that repeat share the least one
    floors = best_of(first, k).where(F.col("rank") == k).select("query_id", "score")
    floors = {r.query_id: r.score for r in floors.collect()}
    repeated = {d: np.unique(q[0], return_counts=True) for d, q in queries.items()}
    alone = {d: dict(zip(ids.tolist(), (n == 1).tolist())) for d, (ids, n) in repeated.items()}
    known = {d: (*q, np.array([floors.get(i, LOW) if alone[d][i] else LOW for i in q[0].tolist()], dtype=np.int64)) for d, q in queries.items()}
    rest = search(rows, context.broadcast(known), k, False)
    return best_of(first.unionAll(rest), k).select("query_id", "vec_id", "score", F.col("rank").cast("int").alias("rank"))
