"""N-gram Jaccard join in size-banded tiles with hashed bitmap signatures.

1. Every text becomes its set of k-word shingles (64-bit hashes); equal sets
   form classes, and one row stands for a class from here on.
2. A set's `KEYS` smallest shingle hashes are its tile keys (a set of up to KEYS shingles has all). Linked sets differ in fewer than
   `needed` of them: always, if the set is too small to have so many shingles of its own, else but for the probability that of KEYS
   hashes KEEP are missing, each with at most 1 - s: 5e-14 at 0.85. So all keys in one order, a set emits its first `needed` ones only, and the first key that
   two linked sets share is among those of both. Keys of over `TILE` sets come last in this order, by their number of sets: a common line
   makes no tile of all its documents, as these meet under rarer keys, if they are linked.
3. Within a tile rows are sorted by size and compared only inside the band of
   sizes that can link. Bit counts of the signatures bound the intersection from
   above, and sets that differ in `needed` keys aren't linked (which tells apart long texts, whose signatures are full); what passes is joined to a forest, so that a tile of m rows emits at most
   m - 1 edges, never all its pairs.
4. The components of that forest are candidates only: inside each
   the sorted shingle arrays are intersected exactly, and the
   exact links' components are the result.

A tile or component over its bounds (`TILE`, `BLOCK_ROWS`, `BLOCK_SHINGLES`) is compared with one leader first, a row of about its mean size, in as many
tasks as it has blocks. Those linked with the leader need no comparison with one another; only the u rows that aren't are
compared with all m, in pairs of blocks. So a group of near copies costs about m, and u * m pairs are the worst, within bounded memory.

Cases: null and empty texts have no shingles and are linked with nothing; fewer
than k words make one shingle; texts of any length are hashed whole; repeated rows and
ties fall into one class (repeated ids give a row each and count as one node); an empty table
gives an empty table; extra columns are not read; rows with a null id are
returned with a null component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyspark.llm import textkernel as tk
from tallyspark.llm.components import connected_components
from tallyspark.llm.shared import binaries, bitmap, column, dealt, groups, has_bit, lists, materialize, matrix, tidied

KEYS, KEEP = 32, 24
#: Bits of a signature, words of 64 bits of it with 32 bits of each key, and the logarithm of the bits of the filter of shared keys.
BITS, KEY_BITS = 1024, 26
WORDS = BITS // 64 + KEYS // 2
#: Rows of a tile, and shingles of a block of candidates, that one task compares.
TILE, BLOCK_ROWS, BLOCK_SHINGLES = 4096, 512, 1_000_000
#: The logarithm of the bits of the filter of members.
ID_BITS = 26


def sets(texts: pa.Array, k: int, separators: np.ndarray = tk.SPACE) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    for _, _, hashes, firsts in tk.text_shingles(texts, k, separators):
        for a, b in zip(firsts[:-1], firsts[1:]):
            own = np.sort(hashes[a:b])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            yield own


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, d1, d2, keys, bits): set size, 128-bit set digest, tile keys, signature and keys again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            digest = np.zeros((2, batch.num_rows), dtype=np.uint64)
            bits = np.zeros((batch.num_rows, WORDS), dtype=np.uint64)
            keys, offsets = [], np.zeros(batch.num_rows + 1, dtype=np.int64)
            with np.errstate(over="ignore"):
                for i, own in enumerate(sets(batch.column(1), k)):
                    n[i] = len(own)
                    digest[0, i], digest[1, i] = tk.seeded(own, 1).sum(dtype=np.uint64), tk.seeded(own, 2).sum(dtype=np.uint64)
                    keys.append(own[:KEYS])
                    offsets[i + 1] = offsets[i] + len(keys[-1])
                    bits[i] = signature(own)
            keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), lists(keys.view(np.int64), offsets, pa.int64()), binaries(bits)],
                ["doc_id", "n", "d1", "d2", "keys", "bits"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda rows: tidied(run(rows)), "doc_id long, n long, d1 long, d2 long, keys array<long>, bits binary")


def signature(own: np.ndarray) -> np.ndarray:
    """BITS bits; a shingle sets the one that its hash's low bits name. Behind them 32 bits of each key, zeros where there are fewer."""
    on = np.zeros(BITS, dtype=bool)
    on[(own & np.uint64(BITS - 1)).astype(np.int64)] = True
    keys = np.zeros(KEYS, np.uint32)
    keys[: len(own[:KEYS])] = np.maximum(mark(own[:KEYS]), 1)
    return np.concatenate([np.packbits(on, bitorder="little").view(np.uint64), keys.view(np.uint64)])


def mark(keys: np.ndarray) -> np.ndarray:
    """32 bits of each key. The smallest hashes are alike in their upper bits, and the lowest ones make the signature."""
    return (tk.mixed(keys) >> np.uint64(32)).astype(np.uint32)


def needed(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """So many of their keys linked sets don't differ by; size is of either."""
    # the union has at most size * den / num shingles, and num/den of them are common
    return np.minimum(KEEP, size * (den - num) // num + 1)


class Forest:
    """Union-find over the rows of one tile."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if np.array_equal(up, self.up):
                return up
            self.up = up

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def tile_edges(size: np.ndarray, bits: np.ndarray, side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A forest of the rows, sorted by size, whose bit counts allow a link.

    side is 0 and 1 for the two blocks of a split tile (only pairs across are
    compared) and all 0 or all 1 where the whole tile is here.
    """
    forest, out = Forest(len(size)), []
    split = bool(side.any()) and not bool(side.all())
    last = np.searchsorted(size, size * den // num, side="right")
    for i in range(len(size) - 1):
        js = np.arange(i + 1, last[i])
        if split:
            js = js[side[js] != side[i]]
        if len(js) > 1:
            roots = forest.roots()
            js = js[roots[js] != roots[i]]
        if not len(js):
            continue
        for j in js[may_link(int(size[i]), bits[i], size[js], bits[js], num, den)]:
            if forest.join(i, int(j)):
                out.append((i, int(j)))
    return out


def may_link(size: int, bits: np.ndarray, sizes: np.ndarray, others: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the rows the bit counts and keys can't rule out as links of one row."""
    on, their = bits[: BITS // 64], others[:, : BITS // 64]
    most = np.minimum(size - np.bitwise_count(on & ~their).sum(axis=1), sizes - np.bitwise_count(their & ~on).sum(axis=1))
    out = den * most >= num * (size + sizes - most)
    some = np.flatnonzero(out)
    # a key's 32 bits may be those of another one by chance, which only adds to what is shared
    own = bits[BITS // 64 :].view(np.uint32)
    keys = np.ascontiguousarray(others[some][:, BITS // 64 :]).view(np.uint32)
    both = (np.isin(keys, own[own > 0]) & (keys > 0)).sum(axis=1)
    out[some] = np.minimum(sizes[some], KEYS) - both < needed(sizes[some], num, den)
    return out


def starred(rows: DataFrame, large: DataFrame, linked: Callable[[int, bytes, np.ndarray, pa.Array], np.ndarray]) -> DataFrame:
    """(key, id, n, leader, linked) for rows (key, id, n, payload) of the large groups (key, blocks, mean): whether
    a row is linked with its group's leader, the one of about mean size.

    Links with a leader make a star, which is all that its members need of one another. The leader goes along to each of its group's
    blocks, so a group of m rows costs m. The tables of large groups and leaders are written ones, which Spark broadcasts while they are small and
    sorts when they aren't.
    """
    leaders = rows.select("key", "id", "n").join(large, "key").groupBy("key").agg(F.min_by("id", F.struct(F.abs(F.col("n") - F.col("mean")), "id")).alias("leader"), F.first("blocks").alias("blocks"))
    both = rows.join(materialize(leaders, "leaders"), "key")
    own = both.withColumns({"salt": F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), "place": F.lit(1)})
    first = both.where("id = leader").withColumns({"salt": F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))), "place": F.lit(0)})
    columns = ["key", "salt", "place", "id", "n", "leader", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size, payload = None, 0, b""
        for batch in batches:
            key, salt, place, n = (column(batch, c) for c in ("key", "salt", "place", "n"))
            out = np.zeros(batch.num_rows, dtype=bool)
            cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (place[1:] != place[:-1])])) if batch.num_rows else []
            for s, e in zip(cuts, [*cuts[1:], batch.num_rows]):
                if place[s] == 0:
                    at, size, payload = (key[s], salt[s]), int(n[s]), batch.column(6)[int(s)].as_py()
                elif at == (key[s], salt[s]):
                    out[s:e] = linked(size, payload, n[s:e], batch.column(6).slice(s, e - s))
            found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), batch.column(5), pa.array(out)], ["key", "id", "n", "leader", "linked"])
            yield found.filter(pa.array(place == 1))

    made = dealt(own.select(*columns).unionAll(first.select(*columns)), "key", "salt").sortWithinPartitions("key", "salt", "place", "id")
    return materialize(made.mapInArrow(lambda rows: tidied(run(rows)), "key long, id long, n long, leader long, linked boolean"), "stars")


def tiles(stars: DataFrame, large: DataFrame, rows: int) -> DataFrame:
    """(key, left, right, id, n, side): the rows that no star holds, in blocks (side 0), with blocks of all rows of the group (side 1)."""
    alone = stars.where("not linked")
    some = materialize(alone.groupBy("key").agg(F.ceil(F.count("*") / rows).alias("parts")).join(large, "key").select("key", "parts", "blocks"), "parts")
    upto = lambda c: F.explode(F.sequence(F.lit(0), (F.col(c) - 1).cast("int")))
    dealt_to = lambda c, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(c)).cast("int")
    one = alone.join(some, "key").select("key", dealt_to("parts", 0).alias("left"), upto("blocks").alias("right"), "id", "n", F.lit(0).alias("side"))
    two = stars.join(some, "key").select("key", upto("parts").alias("left"), dealt_to("blocks", 1).alias("right"), "id", "n", F.lit(1).alias("side"))
    return one.unionAll(two)


def star_edges(stars: DataFrame) -> DataFrame:
    return stars.where("linked and id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))


def kept_posts(reps: DataFrame, bits: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], num: int, den: int) -> DataFrame:
    """(key, id, n, often): each class under those of its first `needed` tile keys that are in the filter of shared ones.

    frequent: the frequent keys, sorted, and how many classes have them; they come last, by that number.
    """
    shipped = reps.sparkSession.sparkContext.broadcast((bits, *frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, often, counts = shipped.value
        for batch in batches:
            keys = batch.column(2)
            values, sizes = keys.flatten().to_numpy(), keys.value_lengths().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            rows = np.zeros(len(values), np.int64)
            if len(often):
                at = np.minimum(np.searchsorted(often, values), len(often) - 1)
                rows = np.where(often[at] == values, counts[at], 0)
            order = np.lexsort((values, rows, row))
            values, rows = values[order], rows[order]
            rank = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            on = (rank < needed(batch.column(1).to_numpy(), num, den)[row]) & has_bit(bits, values)
            row = pa.array(row[on])
            yield pa.RecordBatch.from_arrays([pa.array(values[on]), batch.column(0).take(row), batch.column(1).take(row), pa.array(rows[on] > 0)], ["key", "id", "n", "often"])

    return reps.select("rep", "n", "keys").mapInArrow(lambda rows: tidied(run(rows)), "key long, id long, n long, often boolean")


def candidate_edges(reps: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) between classes, by tile, that the signatures cannot rule out."""
    many = materialize(reps.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), "tiles")
    # at most KEYS / TILE of the classes' number, 1 in 128
    found = sorted(tuple(r) for r in many.where(F.col("rows") > TILE).collect())
    frequent = tuple(np.array([r[i] for r in found], np.int64) for i in range(2))
    posts = kept_posts(reps, bitmap(many, "key", KEY_BITS), frequent, num, den)
    bits = reps.select(F.col("rep").alias("of"), "bits").hint("merge")
    placed, stars = posts, None
    if found:
        kept = materialize(posts.where("often").drop("often"), "kept")
        rows = kept.groupBy("key").agg(F.count("*").alias("rows"), F.avg("n").alias("mean")).where(F.col("rows") > TILE)
        large = materialize(rows.select("key", F.ceil(F.col("rows") / TILE).alias("blocks"), "mean"), "large")
        placed = posts.where("not often").drop("often").unionAll(kept.join(large.select("key"), "key", "left_anti"))
        if not large.isEmpty():
            ours = kept.join(large.select("key"), "key", "left_semi").join(bits, F.col("id") == F.col("of")).select("key", "id", "n", F.col("bits").alias("payload"))

            def linked(size: int, payload: bytes, sizes: np.ndarray, others: pa.Array) -> np.ndarray:
                return may_link(size, np.frombuffer(payload, np.uint64), sizes, matrix(others, np.uint64, WORDS), num, den)

            stars = starred(ours, large, linked)
    placed = placed.select("key", F.lit(0).alias("left"), F.lit(0).alias("right"), "id", "n", F.lit(0).alias("side"))
    placed = placed if stars is None else placed.unionAll(tiles(stars, large, TILE))
    placed = placed.join(bits, F.col("id") == F.col("of"))
    placed = placed.select("key", "left", "right", "n", "id", "side", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, starts in groups(batches, ["key", "left", "right"]):
            size, rep, side = (whole.column(c).to_numpy() for c in ("n", "id", "side"))
            bits = matrix(whole.column("bits"), np.uint64, WORDS)
            a, b = [], []
            for s, e in zip(starts[:-1], starts[1:]):
                for i, j in tile_edges(size[s:e], bits[s:e], side[s:e], num, den) if e - s > 1 else ():
                    if rep[s + i] != rep[s + j]:
                        a.append(rep[s + i])
                        b.append(rep[s + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    sorted_ = dealt(placed, "key", "left", "right").sortWithinPartitions("key", "left", "right", "n", "id")
    edges = sorted_.mapInArrow(lambda rows: tidied(run(rows)), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return (edges if stars is None else edges.unionAll(star_edges(stars))).distinct()


def exact_edges(size: np.ndarray, flat: np.ndarray, firsts: np.ndarray, side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A forest of the exact links among rows sorted by size.

    The rows' sorted arrays are intersected through an inverted index of the
    shingles that two rows or more hold; a row is left out of the count once every
    row in its size band is in its component.
    """
    m = len(size)
    forest, out = Forest(m), []
    split_ = bool(side.any()) and not bool(side.all())
    owner = np.repeat(np.arange(m), np.diff(firsts))
    values, inverse = np.unique(flat, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    holders = owner[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(inverse, minlength=len(values)))])
    last = np.searchsorted(size, size * den // num, side="right")
    for i in range(m - 1):
        if last[i] <= i + 1:
            continue
        roots = forest.roots()
        if (roots[i + 1 : last[i]] == roots[i]).all():
            continue
        own = inverse[firsts[i] : firsts[i + 1]]
        spans = begin[own + 1] - begin[own]
        own, spans = own[spans > 1], spans[spans > 1]
        if not len(own):
            continue
        at = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        both = np.bincount(holders[at], minlength=m)[i + 1 : last[i]]
        js = np.flatnonzero(den * both >= num * (size[i] + size[i + 1 : last[i]] - both)) + i + 1
        for j in js:
            if (not split_ or side[j] != side[i]) and forest.join(i, int(j)):
                out.append((i, int(j)))
    return out


def exact_links(docs: DataFrame, members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) of the exact links inside the candidate components.

    members: (id, label, n, d1); of repeated ids, d1 says which row's text is meant. A component over a block's bounds
    is linked to a leader first, and what is not linked with it is compared with the whole component in blocks.
    """
    whole = members.groupBy(F.col("label").alias("key")).agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"), F.avg("n").alias("mean"))
    large = materialize(whole.where("blocks > 1"), "large")
    # only members' texts are read further: a filter of their ids comes before any shuffle
    hashed = F.xxhash64("id").alias("hash")
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap(members.select(hashed), "hash", ID_BITS))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(has_bit(shipped.value, column(batch, "hash"))))
            # in slices, as a text's array is larger than the text
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                arrays = list(sets(part.column(1), k))
                with np.errstate(over="ignore"):
                    digest = [int(tk.seeded(own, 1).sum(dtype=np.uint64).view(np.int64)) for own in arrays]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest, pa.int64()), pa.array([own.tobytes() for own in arrays], pa.binary())], ["of", "digest", "payload"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null").select("id", "text", hashed)
    made = texts.mapInArrow(lambda rows: tidied(shingled(rows)), "of long, digest long, payload binary")
    arrays = made.join(members.hint("merge"), (F.col("of") == F.col("id")) & (F.col("digest") == F.col("d1"))).select(F.col("label").alias("key"), "id", "n", "payload")
    columns = ["key", "left", "right", "n", "id", "side", "payload"]
    zero = F.lit(0)
    stars = None
    if large.isEmpty():
        placed = arrays.withColumns({"left": zero, "right": zero, "side": zero}).select(*columns)
    else:
        arrays = materialize(arrays, "arrays")
        ours = arrays.join(large.select("key"), "key", "left_semi")

        def linked(size: int, payload: bytes, sizes: np.ndarray, others: pa.Array) -> np.ndarray:
            own = np.frombuffer(payload, np.uint64)
            both = np.array([shared(own, np.frombuffer(x.as_buffer(), np.uint64)) for x in others], dtype=np.int64)
            return den * both >= num * (size + sizes - both)

        stars = starred(ours, large, linked)
        placed = arrays.join(large.select("key"), "key", "left_anti").withColumns({"left": zero, "right": zero, "side": zero}).select(*columns)
        again = tiles(stars, large, BLOCK_ROWS).join(ours.select(F.col("key").alias("of"), F.col("id").alias("whose"), "payload").hint("merge"), (F.col("key") == F.col("of")) & (F.col("id") == F.col("whose")))
        placed = placed.unionAll(again.select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in groups(batches, ["key", "left", "right"]):
            size, ids, side = (table.column(c).to_numpy() for c in ("n", "id", "side"))
            firsts = np.concatenate([[0], np.cumsum(size)])
            shingles = table.column("payload")
            a, b = [], []
            for s, e in zip(starts[:-1], starts[1:]):
                if e - s > 1:
                    flat = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in shingles.slice(s, e - s)])
                    for i, j in exact_edges(size[s:e], flat, firsts[s : e + 1] - firsts[s], side[s:e], num, den):
                        if ids[s + i] != ids[s + j]:
                            a.append(ids[s + i])
                            b.append(ids[s + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    sorted_ = dealt(placed, "key", "left", "right").sortWithinPartitions("key", "left", "right", "n", "id")
    edges = sorted_.mapInArrow(lambda rows: tidied(run(rows)), "a long, b long")
    return edges if stars is None else edges.unionAll(star_edges(stars))


def shared(one: np.ndarray, two: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values have in common."""
    if not len(two):
        return 0
    at = np.minimum(np.searchsorted(two, one), len(two) - 1)
    return int(np.count_nonzero(two[at] == one))


def ngram_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: components of documents whose shingle
    sets' intersection is at least num/den of their union."""
    sketch = materialize(sketches(docs, k), "sketches")
    some = sketch.where("n > 0 and doc_id is not null")
    reps = materialize(some.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("bits").alias("bits")), "classes")
    loose = connected_components(candidate_edges(reps, num, den))
    members = materialize(loose.join(reps.select(F.col("rep").alias("id"), "n", "d1").hint("merge"), "id"), "members")
    links = connected_components(exact_links(docs, members, k, num, den))
    classes = reps.select("d1", "d2", F.col("n").alias("n2"), "rep").join(links.withColumnRenamed("id", "rep"), "rep", "left").select("d1", "d2", "n2", F.coalesce("label", "rep").alias("component"))
    out = sketch.join(classes.hint("merge"), (sketch.d1 == classes.d1) & (sketch.d2 == classes.d2) & (sketch.n == classes.n2), "left")
    return out.select(sketch.doc_id, F.col("n").alias("n_shingles"), F.when(sketch.doc_id.isNotNull() & (F.col("n") > 0), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents that are their component's smallest id; equal rows stay once."""
    joined = ngram_join(docs, k, num, den).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(joined.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
