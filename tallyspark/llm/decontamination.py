"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is short and may lie inside a document of any length, so the items
are sketched, not the documents: an item's MinHash sketch is its smallest shingle hashes,
and each of these is in the document with the probability of the containment.

1. Items are partitioned by the size of their shingle sets. Each partition has a sketch length and
   a number of hits that a document needs (`PARTITIONS`), such that an item contained to the threshold is missed with probability below
   `MISS`; the partition of items of up to 64 shingles keeps whole sets, which miss nothing.
2. A filter of fixed size holds the items' shingles. The documents are scanned once; of each
   one only the shingles in the filter go on.
3. A document that has the needed h of an item's m sketched shingles has one at least of any m - h + 1 of
   them, so only those of an item that the fewest documents have are joined. What meets there is counted against the whole sketch, and
   what has enough hits is verified by exact shingle containment, |item and document| / |item|.

Words are runs of letters and digits, in lower case; shingles take five words. Neither items nor documents
pass through the driver, which gathers the filter's 2^`FILTER_BITS` bits only.

Cases: a null or empty item or document has no shingles and matches nothing;
an item of fewer than five words is one shingle; documents of any length are
read whole; repeated items and documents, and ties, each give their rows; documents with a null id are searched like
others, items with one are not; empty tables give an
empty table; extra columns, whatever their names, are not read, and pass through `decontaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tallyspark.llm import textkernel as tk
from tallyspark.llm.shared import bitmap, has_bit, lists, materialize, tidied

MISS = 1e-9
FILTER_BITS = 27
#: Largest set of each partition of the items, and its sketch length; the last one has no end.
PARTITIONS = ((64, 64), (256, 72), (1024, 96), (4096, 112), (None, 128))
SCHEMA = "doc_id long, item_id long, n_shared long, n_item long, containment double"


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    return tk.text_shingles(pc.utf8_lower(texts.cast(pa.string())), k, tk.PUNCTUATION, tk.SAME)


def hits_needed(m: int, share: float) -> int:
    """The most hits h such that fewer than h among m, each with chance share, has probability below MISS."""
    below, h = 0.0, 0
    while h < m:
        below += comb(m, h) * share**h * (1 - share) ** (m - h)
        if below >= MISS:
            break
        h += 1
    return max(h, 1)


def own_sets(texts: pa.Array, k: int, bits: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; with a filter, those in it."""
    for _, _, hashes, firsts in shingle_sets(texts, k):
        if bits is None:
            for a, b in zip(firsts[:-1], firsts[1:]):
                yield np.unique(hashes[a:b])
            continue
        at = np.flatnonzero(has_bit(bits, hashes))
        cuts = np.searchsorted(at, firsts)
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield np.unique(hashes[at[a:b]])


def set_rows(rows: DataFrame, k: int, bits: np.ndarray | None = None) -> DataFrame:
    """(id, shingles) of rows (id, text) with a shingle (in the filter)."""
    shipped = None if bits is None else rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(own_sets(batch.column(1), k, shipped.value if shipped else None))
            sizes = np.array([len(s) for s in found], dtype=np.int64)
            some = np.flatnonzero(sizes)
            flat = np.concatenate([found[i] for i in some]) if len(some) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), lists(flat.view(np.int64), np.concatenate([[0], np.cumsum(sizes[some])]), pa.int64())], ["id", "shingles"])

    return rows.mapInArrow(lambda batches: tidied(run(batches)), "id long, shingles array<long>")


def partitioned(items: DataFrame, num: int, den: int) -> DataFrame:
    """items with n (set size), m (sketch length), need (hits) and least (shared shingles) of their size partition."""
    n = F.size("shingles")
    m, need = F.lit(None).cast("int"), F.lit(None).cast("int")
    least = F.ceil(F.lit(num) * n / den).cast("int")
    for most, length in reversed(PARTITIONS):
        here = F.lit(True) if most is None else n <= most
        whole = most is not None and length >= most
        m = F.when(here, F.least(F.lit(length), n)).otherwise(m)
        # a sketch that is the whole set needs as many hits as the containment itself
        need = F.when(here, least if whole else F.lit(hits_needed(length, num / den))).otherwise(need)
    return items.select(F.monotonically_increasing_id().alias("item"), "id", "shingles", n.alias("n"), m.alias("m"), need.alias("need"), least.alias("least"))


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """A row per document and item that the document contains to num/den or more."""
    # numbers of rows are given to written tables, so that a task that runs again gives the same ones
    items = materialize(set_rows(benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("id"), "text"), k), "items")
    items = materialize(partitioned(items, num, den), "partitions")
    keys = items.select("item", F.posexplode("shingles").alias("place", "shingle"), "m", "need")
    bits = bitmap(keys.select("shingle").distinct(), "shingle", FILTER_BITS)
    hits = materialize(set_rows(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), k, bits), "hits")
    hits = hits.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("doc_id"), F.col("shingles").alias("own"))
    posts = hits.select("row", F.explode("own").alias("shingle"))
    often = posts.groupBy("shingle").agg(F.count("*").alias("docs"))
    sketch = keys.where("place < m").join(often, "shingle", "left")
    # of an item's sketch the shingles that the fewest documents have
    rarest = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("docs", F.lit(0)), "shingle"))
    probes = sketch.withColumn("rank", rarest).where("rank <= m - need + 1 and docs is not null").select("item", "shingle")
    pairs = posts.join(probes, "shingle").select("row", "item").distinct()
    shared = lambda a: F.size(F.array_intersect("own", a))
    found = pairs.join(items, "item").join(hits, "row").where(shared(F.slice("shingles", F.lit(1), F.col("m"))) >= F.col("need"))
    found = found.withColumn("shared", shared(F.col("shingles"))).where("shared >= least")
    return found.select("doc_id", F.col("id").alias("item_id"), F.col("shared").cast("long").alias("n_shared"), F.col("n").cast("long").alias("n_item"), F.round(F.col("shared") / F.col("n"), 6).alias("containment"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows whose text contains no item, whatever their ids.

    A row is known by the 64-bit hash of its text, so that rows that repeat an id or have none are each judged
    by their own text. The hashes of what goes are written first: Spark then knows their size and broadcasts them if they
    are few, and joins by sorting if not.
    """
    names = docs.columns
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    dirty = materialize(contamination(texts, benchmark, k, num, den).select(F.col("doc_id").alias("_dirty")).distinct(), "dirty")
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return rows.join(dirty, F.xxhash64(f"c{names.index('text')}") == F.col("_dirty"), "left_anti").toDF(*names)
