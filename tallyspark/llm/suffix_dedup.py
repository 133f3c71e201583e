"""Suffix-array dedup: removes every byte covered by a `LENGTH`-byte string that
also starts in a document with a smaller id.

0. Of equal texts only the one with the smallest id goes on; a later copy of LENGTH
   bytes or more goes whole.
1. Every string of LENGTH bytes has a minimum among the hashes of its 16-byte
   grams; equal strings have equal minima. One pass counts in how many documents each
   minimum occurs. Only strings whose minimum is shared can repeat, so a bitmap of
   fixed size of the shared minima is broadcast and a second pass keeps the
   stretches under it, cut where the minimum changes.
2. Stretches are dealt to shards by their minimum, so equal strings meet. A frequent
   minimum is subdivided first: every string around its 16 bytes has 17 bytes more after or before them, which go into its key, so that
   what meets is equal over 33 bytes. Its strings are also salted by document, over
   `SALTS` shards.
3. Stretches equal to one of a smaller document go whole. Of the others a shard builds
   the suffix array by Larsson-Sadakane refinement (only groups that are still equal
   are sorted again), takes common prefixes by Kasai's rule, that the next suffix's is at most one shorter, in parallel lanes,
   and finds each repeated string's smallest document.
4. What a salted shard could not decide goes on, one document per string and shard,
   and the sorted shards are merged by binary search.
5. Spans are joined to their texts and cut out.

Cases: null and empty texts have no bytes; texts of any length are read whole; equal ids
never repeat one another, so of repeated rows all are judged against smaller ids only;
a null id is neither removed from nor removes; an empty table gives an empty table;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.llm import textkernel as tk
from tallyspark.llm.shared import bitmap, dealt, has_bit, materialize, tidied

LENGTH, GRAM = 50, 16
#: Fixed bounds: bits of the broadcast bitmap; bytes of a suffix array; windows of a stretch.
BITMAP_BITS, SHARD_BYTES, STRETCH = 27, 1 << 19, 4096
COPY_BITS = 24
#: A minimum is frequent if over HOT documents have it (a filter of 2^HOT_BITS bits holds these); its strings are salted.
HOT, HOT_BITS, SALTS = 2000, 24, 16
#: Bytes beside the minimum's gram that subdivide a frequent one: a string has so many before or after it.
BESIDE = (LENGTH - GRAM) // 2
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on, little endian, zeros past the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", padded, strides=(1,)).copy()


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Per position the hash of the 16 bytes from there on."""
    w = words_at(data)
    with np.errstate(over="ignore"):
        h = w.copy()
        h[:-8] ^= (w[8:] << np.uint64(29) | w[8:] >> np.uint64(35)) * tk.MIX[1]
        return tk.mixed(h)


def minima(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per position the minimum of the string that starts there, and whether it ends inside its text."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(n, np.uint64), np.zeros(n, dtype=bool)
    span, low = 1, gram_hashes(data)
    width = LENGTH - GRAM + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    low = np.minimum(low[: len(low) - rest], low[rest:])[: n - LENGTH + 1]
    out, inside = np.zeros(n, np.uint64), np.zeros(n, dtype=bool)
    out[: len(low)] = low
    lengths = np.diff(offsets)
    inside[:] = np.arange(n) + LENGTH <= np.repeat(offsets[1:], lengths)
    return out, inside


def anchors(texts: DataFrame, but: Broadcast | None) -> DataFrame:
    """(m): each text's distinct minima; without the texts whose version is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if but:
                batch = batch.filter(pa.array(~has_bit(but.value, batch.column(0).to_numpy())))
            for _, _, data, offsets in tk.chunks(batch.column(1)):
                m, inside = minima(data, offsets)
                out = []
                for a, b in zip(offsets[:-1], offsets[1:]):
                    if b - a >= LENGTH:
                        own = m[a : b - LENGTH + 1]
                        own = np.sort(own[np.concatenate([[True], own[1:] != own[:-1]])])
                        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], ["m"])

    return texts.select("version", "text").mapInArrow(lambda rows: tidied(run(rows)), "m long")


def subdivided(data: np.ndarray, begin: np.ndarray, end: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, begin, end, key): stretches of frequent minima, cut where the bytes beside the minimum's gram change sides.

    A string's gram is the first in it that has the minimum, so equal strings have equal keys.
    """
    h = gram_hashes(data)
    w = words_at(data)
    sizes = end - begin
    own = np.repeat(np.arange(len(begin)), sizes)
    start = np.arange(len(own)) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)
    low, gram = value[own], np.zeros(len(own), np.int64)
    for ahead in range(LENGTH - GRAM, -1, -1):
        at = start + ahead
        gram = np.where(h[at] == low, at, gram)
    after = gram - start <= BESIDE
    place = np.where(after, gram + GRAM, gram - BESIDE)
    key = tk.mixed(low ^ tk.mixed(w[place] ^ tk.mixed(w[place + 8] ^ tk.mixed(data[place + BESIDE - 1].astype(np.uint64) + after.astype(np.uint64) * np.uint64(256)))))
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])])) if len(own) else own
    last = np.append(new[1:] - 1, len(own) - 1) if len(own) else new
    return own[new], start[new], start[last] + 1, key[new]


def stretches(texts: DataFrame, but: Broadcast | None, shared: Broadcast, hot: Broadcast) -> DataFrame:
    """(m, salt, doc_id, version, at, bytes): runs of strings with one shared minimum; without the
    texts whose version is in the bitmap `but`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            if but:
                batch = batch.filter(pa.array(~has_bit(but.value, batch.column(1).to_numpy())))
            ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, _, data, offsets in tk.chunks(batch.column(2)):
                m, inside = minima(data, offsets)
                starts = np.flatnonzero(inside)
                starts = starts[has_bit(bits, m[starts])]
                if not len(starts):
                    continue
                value = m[starts]
                text = np.searchsorted(offsets, starts, side="right") - 1
                new = np.concatenate([[True], (starts[1:] != starts[:-1] + 1) | (value[1:] != value[:-1]) | (text[1:] != text[:-1])])
                begin = starts[new]
                end = np.append(starts[np.flatnonzero(new)[1:] - 1], starts[-1]) + 1
                value, text = value[new], text[new]
                often = has_bit(hot.value, value)
                if often.any():
                    of, b, e, key = subdivided(data, begin[often], end[often], value[often])
                    rest = ~often
                    begin, end, value, text = np.concatenate([begin[rest], b]), np.concatenate([end[rest], e]), np.concatenate([value[rest], key]), np.concatenate([text[rest], text[often][of]])
                    often = np.concatenate([np.zeros(int(rest.sum()), dtype=bool), np.ones(len(b), dtype=bool)])
                # a run of one minimum can be long only in periodic text
                pieces = -(-(end - begin) // STRETCH)
                if (pieces > 1).any():
                    back = np.repeat(np.arange(len(begin)), pieces)
                    step = np.arange(len(back)) - np.repeat(np.concatenate([[0], np.cumsum(pieces)[:-1]]), pieces)
                    begin, end, value, text, often = begin[back] + step * STRETCH, np.minimum(begin[back] + (step + 1) * STRETCH, end[back]), value[back], text[back], often[back]
                sizes = end - begin + LENGTH - 1
                cut = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = data[np.repeat(begin - cut[:-1], sizes) + np.arange(cut[-1])]
                rows = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(flat))])
                owner = ids[first + text]
                key = value.view(np.int64)
                salt = np.where(often, tk.seeded(owner.astype(np.int64).view(np.uint64), 3) % np.uint64(SALTS) + np.uint64(1), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(salt), pa.array(owner), pa.array(versions[first + text]), pa.array(begin - offsets[text]), rows], ["m", "salt", "doc_id", "version", "at", "bytes"])

    return texts.select("doc_id", "version", "text").mapInArrow(lambda rows: tidied(run(rows)), "m long, salt int, doc_id long, version long, at long, bytes binary")


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their next depth bytes or more (Larsson-Sadakane), and
    whether each one's differ from those of the one before."""
    n = len(data)
    key = words_at(data).byteswap()
    order = np.argsort(key)
    rank = np.empty(n, dtype=np.int64)
    sorted_ = key[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    head = np.flatnonzero(new)
    # a group's rank is the place of its first member
    rank[order] = np.repeat(head, np.diff(np.append(head, n)))
    # ranks of an array this short fit three to a sort key, so each round triples the depth (else doubles it)
    bits = int(n).bit_length()
    fit = 3 if 3 * bits <= 63 else 2
    h = 8
    while h < depth:
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(open_):
            break
        at = order[open_]
        key = rank[at]
        for j in range(1, fit):
            ahead = at + j * h
            key = key << bits | np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[open_] = at
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        new[open_] = fresh
        head = np.flatnonzero(fresh)
        rank[at] = np.repeat(open_[head], np.diff(np.append(head, len(open_))))
        h *= fit
    return order, new


def common_prefixes(data: np.ndarray, order: np.ndarray, new: np.ndarray, depth: int, lane: int = 32) -> np.ndarray:
    """Of each entry of the suffix array, the bytes it shares with the one before, up to depth.

    Kasai's rule in lanes of neighbouring positions: all lanes step together, each
    starting from one less than its last position had. The order is complete only to
    a little over depth, so after a prefix of full depth the rule is used only where the
    two suffixes before are neighbours as well.
    """
    n = len(data)
    w = np.concatenate([words_at(data), np.zeros(depth + 8, np.uint64)])
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, dtype=np.int64)
    # the refinement has already found these equal to a greater depth
    equal = np.zeros(n, dtype=bool)
    equal[order[~new]] = True
    starts = np.arange(0, n, lane)
    length = np.zeros(len(starts), dtype=np.int64)
    for t in range(lane):
        at = starts + t
        if at[-1] >= n:
            at = at[:-1]
        length = length[: len(at)]
        prior = before[at]
        if t:
            length = np.where((length < depth) | (prior == before[at - 1] + 1), np.maximum(length - 1, 0), 0)
        length[prior < 0] = 0
        length[equal[at]] = depth
        going = np.flatnonzero((prior >= 0) & (length < depth))
        while len(going):
            a, b, so = at[going], prior[going], length[going]
            differ = w[a + so] ^ w[b + so]
            same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
            # past the end of the data nothing is shared
            so = np.minimum(so + same, n - np.maximum(a, b))
            length[going] = np.minimum(so, depth)
            going = going[(same == 8) & (so < depth) & (so < n - np.maximum(a, b))]
        out[at] = length
    return out[order]


def decide(flat: np.ndarray, cut: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Per byte of the stretches flat[cut[i]:cut[i+1]]: 2 where a string starts that also
    starts in a smaller document of this shard, 1 where another one starts, else 0."""
    order, new = suffix_array(flat, LENGTH)
    shared = common_prefixes(flat, order, new, LENGTH)
    row = np.repeat(np.arange(len(ids)), np.diff(cut))
    begins = np.arange(len(flat)) + LENGTH <= cut[row + 1]
    on = np.flatnonzero(begins[order])
    out = begins.astype(np.uint8)
    if not len(on):
        return out
    # entries between two strings' starts count as well: take the least on the way
    least = np.minimum.reduceat(shared[: on[-1] + 1], np.append(0, on[:-1] + 1))
    group = np.flatnonzero(np.concatenate([[True], least[1:] < LENGTH]))
    own = ids[row[order[on]]]
    smallest = np.repeat(np.minimum.reduceat(own, group), np.diff(np.append(group, len(own))))
    out[order[on][own > smallest]] = 2
    return out


def runs(flags: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, first, end) of the runs of set flags inside each stretch."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    row = np.searchsorted(cut, at, side="right") - 1
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])])
    begin, row = at[new], row[new]
    end = np.append(at[np.flatnonzero(new)[1:] - 1], at[-1]) + 1
    return row, begin - cut[row], end - cut[row]


def joined_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches sorted by (m, salt) as tables of about SHARD_BYTES with whole keys: table, flat, cut, key's first rows."""
    held: list[pa.RecordBatch] = []
    size = 0

    def made(table: pa.Table):
        column = table.column("bytes").combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        cut = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        flat = np.frombuffer(column.buffers()[2], dtype=np.uint8)[cut[0] : cut[-1]]
        m, salt = table.column("m").to_numpy(), table.column("salt").to_numpy()
        new = np.concatenate([[True], (m[1:] != m[:-1]) | (salt[1:] != salt[:-1])])
        return table, flat, cut - cut[0], np.flatnonzero(new)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.get_total_buffer_size() if batch.num_rows < 64 else batch.nbytes
        if size >= SHARD_BYTES:
            table = pa.Table.from_batches(held)
            *_, firsts = made(table)
            if firsts[-1] > 0:
                yield made(table.slice(0, firsts[-1]))
                rest = table.slice(firsts[-1]).combine_chunks()
                held = rest.to_batches()
                size = sum(b.nbytes for b in held)
    if held:
        yield made(pa.Table.from_batches(held))


def repeats(flat: np.ndarray, cut: np.ndarray, ids: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Which stretches are equal, byte for byte, to one of a smaller document in this shard: they go
    whole and need no place in the suffix array. Equality is that of a 64-bit hash under an equal
    64-bit minimum."""
    key = tk.span_hashes(flat, cut[:-1], cut[1:], tk.SAME) ^ tk.seeded(m.view(np.uint64), 7)
    order = np.lexsort((ids, key))
    sorted_ = key[order]
    head = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    first = np.repeat(ids[order][head], np.diff(np.append(head, len(order))))
    out = np.zeros(len(ids), dtype=bool)
    out[order] = ids[order] > first
    return out


SPANS = "m long, salt int, doc_id long, version long, at long, size long, bytes binary"


def span_batch(table: pa.Table, row: np.ndarray, begin: np.ndarray, end: np.ndarray, kept: pa.Array | None = None) -> pa.RecordBatch:
    """A row per run of strings; bytes stays null for a span that is decided."""
    cols = {c: table.column(c).to_numpy()[row] for c in ("m", "salt", "doc_id", "version", "at")}
    return pa.RecordBatch.from_arrays(
        [pa.array(cols["m"]), pa.array(cols["salt"]), pa.array(cols["doc_id"]), pa.array(cols["version"]), pa.array(cols["at"] + begin), pa.array(end - begin + LENGTH - 1), pa.nulls(len(row), pa.binary()) if kept is None else kept],
        ["m", "salt", "doc_id", "version", "at", "size", "bytes"],
    )


def sharded(pieces: DataFrame) -> DataFrame:
    """Decided spans, and of salted shards also the stretches that are first in their shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, flat, cut, _ in joined_shards(batches):
            ids, sizes = table.column("doc_id").to_numpy(), np.diff(cut)
            later = repeats(flat, cut, ids, table.column("m").to_numpy())
            row = np.flatnonzero(later)
            if len(row):
                yield span_batch(table, row, np.zeros(len(row), np.int64), sizes[row] - LENGTH + 1)
                kept = np.flatnonzero(~later)
                begin, sizes = cut[kept], sizes[kept]
                cut = np.concatenate([[0], np.cumsum(sizes)])
                flat = flat[np.repeat(begin - cut[:-1], sizes) + np.arange(cut[-1])]
                table = table.take(kept)
            flags = decide(flat, cut, table.column("doc_id").to_numpy())
            row, begin, end = runs(flags == 2, cut)
            if len(row):
                yield span_batch(table, row, begin, end)
            open_ = (flags == 1) & (np.repeat(table.column("salt").to_numpy(), np.diff(cut)) > 0)
            row, begin, end = runs(open_, cut)
            if len(row):
                kept = pa.array([flat[cut[r] + b : cut[r] + e + LENGTH - 1].tobytes() for r, b, e in zip(row, begin, end)], pa.binary())
                yield span_batch(table, row, begin, end, kept)

    return dealt(pieces, "m", "salt").sortWithinPartitions("m", "salt", "doc_id", "at").mapInArrow(lambda rows: tidied(run(rows)), SPANS)


def merged(pieces: DataFrame) -> DataFrame:
    """Spans that another salted shard of the same minimum decides, by binary search in its sorted strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, flat, cut, _ in joined_shards(b.set_column(1, "salt", pa.array(np.zeros(b.num_rows, np.int32))) if b.num_rows else b for b in batches):
            ids, shard = table.column("doc_id").to_numpy(), tk.seeded(table.column("doc_id").to_numpy().astype(np.int64).view(np.uint64), 3) % np.uint64(SALTS)
            row = np.repeat(np.arange(len(ids)), np.diff(cut))
            at = np.flatnonzero(np.arange(len(flat)) + LENGTH <= cut[row + 1])
            strings = np.ndarray((len(flat) - LENGTH + 1,), f"S{LENGTH}", np.ascontiguousarray(flat), strides=(1,))[at]
            owner, home = ids[row[at]], shard[row[at]]
            sorted_ = {}
            for s in np.unique(home):
                own = np.flatnonzero(home == s)
                own = own[np.lexsort((owner[own], strings[own]))]
                sorted_[s] = (strings[own], owner[own])
            least = owner.copy()
            for s, (keys, first) in sorted_.items():
                pos = np.minimum(np.searchsorted(keys, strings), len(keys) - 1)
                least = np.where(keys[pos] == strings, np.minimum(least, first[pos]), least)
            flags = np.zeros(len(flat), dtype=bool)
            flags[at[owner > least]] = True
            row, begin, end = runs(flags, cut)
            if len(row):
                yield span_batch(table, row, begin, end)

    ready = pieces.select("m", "salt", "doc_id", "version", "at", "bytes")
    return dealt(ready, "m").sortWithinPartitions("m", "doc_id", "at").mapInArrow(lambda rows: tidied(run(rows)), SPANS)


def without_copies(docs: DataFrame, count: Column | None = None) -> tuple[list[tuple[DataFrame, Broadcast | None]], DataFrame]:
    """Texts (doc_id, version, text), each distinct one once, under its smallest id: all with
    the bitmap of those to leave out, and the firsts of those. And the other copies
    (doc_id, version, at, size, first), which go whole; size is in bytes, or what count says.

    Only the rows whose hash is in a bitmap of the repeated hashes are shuffled.
    """
    texts = docs.where(F.octet_length("text") >= LENGTH).where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    check = F.xxhash64(F.lit(1), F.col("text")).alias("check")
    twice = materialize(texts.groupBy("version", check).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "copies")
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap(twice, "version", COPY_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shipped.value
        for batch in batches:
            yield batch.filter(pa.array(has_bit(bits, batch.column(1).to_numpy())))

    some = texts.withColumn("check", check)
    some = materialize(some.mapInArrow(lambda rows: tidied(run(rows)), some.schema), "repeated")
    size = F.octet_length("text") if count is None else count
    ids = some.select("doc_id", "version", "check", size.cast("long").alias("size")).join(twice.hint("merge"), ["version", "check"], "left")
    ids = materialize(ids.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("first"), F.lit(True))), "ids")
    firsts = ids.where("kept").select("doc_id", "version", "check").distinct()
    kept = some.join(firsts.hint("merge"), ["doc_id", "version", "check"], "left_semi").dropDuplicates(["doc_id", "version", "check"]).select("doc_id", "version", "text")
    later = ids.where("not kept").select("doc_id", "version", F.lit(0).cast("long").alias("at"), "size", "first").distinct()
    return [(texts, shipped), (materialize(kept, "firsts"), None)], later


def united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, version, spans): what to remove; version is the text's hash, as ids may repeat."""
    texts, copies = without_copies(docs)
    shared = materialize(united([anchors(*t) for t in texts]).groupBy("m").agg(F.count("*").alias("n")).where("n > 1"), "minima")
    context = docs.sparkSession.sparkContext
    often = bitmap(shared.where(F.col("n") > HOT), "m", HOT_BITS)
    hot, bits = context.broadcast(often), context.broadcast(bitmap(shared, "m", BITMAP_BITS))
    found = materialize(sharded(united([stretches(*t, bits, hot) for t in texts])), "spans")
    where = ["doc_id", "version", "at", "size"]
    parts = [copies.select(*where), found.where("bytes is null").select(*where)]
    if often.any():
        parts.append(merged(found.where("bytes is not null")).select(*where))
    spans = united(parts)
    return spans.groupBy("doc_id", "version").agg(F.collect_list(F.struct("at", "size")).alias("spans"))


def suffix_dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and, asked for, text)."""
    spans = repeated_spans(docs).withColumnRenamed("doc_id", "of").withColumnRenamed("version", "what")
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version"))
    both = chosen.join(spans.hint("merge"), (chosen.doc_id == spans.of) & (chosen.version == spans.what), "left").select("doc_id", "text", F.col("spans.at").alias("at"), F.col("spans.size").alias("size"))
    schema = SCHEMA + ", text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.raw(batch.column(1))
            n_bytes = np.diff(offsets)
            removed, spans, digests, texts = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [], []
            for i in range(batch.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                starts = batch.column(2)[i].values
                if starts is not None and len(starts):
                    begin = starts.to_numpy()
                    change = np.zeros(len(own) + 1, dtype=np.int64)
                    np.add.at(change, begin, 1)
                    np.add.at(change, begin + batch.column(3)[i].values.to_numpy(), -1)
                    gone = np.cumsum(change[:-1]) > 0
                    removed[i] = gone.sum()
                    spans[i] = (gone & ~np.concatenate([[False], gone[:-1]])).sum()
                    own = own[~gone]
                digests.append(hashlib.sha256(own.tobytes()).hexdigest())
                if with_text:
                    texts.append(own.tobytes().decode("utf-8", "replace"))
            arrays = [batch.column(0), pa.array(n_bytes), pa.array(removed), pa.array(spans), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(texts, pa.string())] * with_text, [c.split()[0] for c in schema.split(", ")])

    return both.mapInArrow(lambda rows: tidied(run(rows)), schema)
