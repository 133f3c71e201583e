"""Line dedup with a log-template tree.

A line's tokens are its words; those with a digit are variable fields. The tree
has a fixed depth: the token count, then the first `DEPTH` tokens. In a leaf,
lines join the template with which they share the most tokens by position, if that is at least
num/den of them; where they differ the template gets a wildcard. A template found
in `min_docs` documents or more is boilerplate: its lines are dropped from every
document but the one with the smallest id. (Five by default: what fewer documents share is rather a quotation or a near copy,
which other operators judge as a whole.)

A leaf is parsed whole, however many lines it has, so what becomes of a line doesn't depend on how many others there are: a line is compared
only with templates with which it shares one of so many stretches that two lines which join can't differ in all of them, which leaves out none.
(With `LEAF_LINES` set, a leaf of more distinct lines is split twice, by more of the leading tokens and by as many of the last
ones; a part that is still too large is split again by twice as many, and a line of such a leaf has a template in each split, and goes if one of them is boilerplate. That
bounds a task, but a template with fields at both ends is missed, and the result depends on the leaf's size.)

Only leaves that enough documents reach can hold such a template. They are
counted first (one row per document and leaf, combined before the shuffle) and
broadcast as a bitmap of fixed size, so the second scan ships only their lines; equal
lines are combined before a leaf is parsed.

Cases: null and empty texts have no lines; blank lines are kept; a text of one
very long line is one line; repeated rows and equal ids count as one document; rows with a
null id are kept whole and don't count; ties between templates go to the older one, a leaf's lines are read from the one in most rows on, equally frequent ones by their hash;
an empty table gives an empty table; extra columns, whatever their names, pass through `drop_lines`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyspark.llm import textkernel as tk
from tallyspark.llm.shared import bitmap, dealt, groups, has_bit, lists, materialize, tidied

DEPTH, MIN_DOCS = 3, 5
BITMAP_BITS = 24
#: Distinct lines of a leaf beyond which it is split; None: never.
LEAF_LINES: int | None = None
SALTS = 8
WILD = np.uint64(0x2A)

_digit = np.zeros(256, dtype=np.int64)
_digit[0x30:0x3A] = 1


def parsed(data: np.ndarray, offsets: np.ndarray):
    """Lines of a chunk of texts: their offsets, texts, token hashes, first tokens, leaves and line hashes."""
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 0x0A) + 1]))
    cuts = cuts if len(cuts) > 1 else np.zeros(1, np.int64)
    starts, ends, firsts = tk.words(data, cuts)
    text = np.searchsorted(offsets, cuts[:-1], side="right") - 1
    if not len(starts):
        none = np.zeros(len(cuts) - 1, np.uint64)
        return cuts, text, np.zeros(0, np.uint64), firsts, none, none
    tokens = tk.span_hashes(data, starts, ends)
    digits = np.concatenate([[0], np.cumsum(_digit[data])])
    tokens[digits[ends] > digits[starts]] = WILD
    counts = np.diff(firsts)
    up, down = tk.powers(len(tokens) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * up[: len(tokens)])])
        line = tk.mixed((sums[firsts[1:]] - sums[firsts[:-1]]) * down[np.minimum(firsts[:-1], len(tokens) - 1)] + counts.astype(np.uint64))
        leaf = counts.astype(np.uint64) * np.uint64(tk.BASE)
        for j in range(DEPTH):
            at = firsts[:-1] + j
            some = j < counts
            leaf[some] += tk.seeded(tokens[at[some]], j)
    return cuts, text, tokens, firsts, tk.mixed(leaf), line


def leaves(docs: DataFrame) -> DataFrame:
    """(leaf): each document's distinct leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, _, data, offsets in tk.chunks(batch.column(1)):
                _, text, _, firsts, leaf, _ = parsed(data, offsets)
                some = np.diff(firsts) > 0
                pairs = np.unique(np.stack([ids[first + text[some]].astype(np.uint64), leaf[some]], axis=1), axis=0) if some.any() else np.zeros((0, 2), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))], ["leaf"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(lambda rows: tidied(run(rows)), "leaf long")


def leaf_bitmap(docs: DataFrame, min_docs: int) -> np.ndarray:
    """One bit for each leaf that enough documents reach, in an array of fixed size (2 MB)."""
    often = leaves(docs).groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    return bitmap(often, "leaf", BITMAP_BITS)


def lines_in(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(leaf, line, doc_id, tokens): each document's distinct lines of the leaves in the bitmap."""
    shipped = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shipped.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, _, data, offsets in tk.chunks(batch.column(1)):
                _, text, tokens, firsts, leaf, line = parsed(data, offsets)
                on = (np.diff(firsts) > 0) & has_bit(bits, leaf)
                at = np.flatnonzero(on)
                order = np.lexsort((line[at], text[at]))
                at = at[order]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (line[at][1:] != line[at][:-1]) | (text[at][1:] != text[at][:-1])
                at = at[new]
                sizes = firsts[at + 1] - firsts[at]
                cut = np.concatenate([[0], np.cumsum(sizes)])
                flat = tokens[np.repeat(firsts[at] - cut[:-1], sizes) + np.arange(cut[-1])]
                yield pa.RecordBatch.from_arrays([pa.array(leaf[at].view(np.int64)), pa.array(line[at].view(np.int64)), pa.array(ids[first + text[at]], pa.int64()), lists((flat >> np.uint64(32)).astype(np.uint32).view(np.int32), cut, pa.int32())], ["leaf", "line", "doc_id", "tokens"])

    chosen = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return chosen.mapInArrow(lambda rows: tidied(run(rows)), "leaf long, line long, doc_id long, tokens array<int>")


def grow(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """Each line's template, for one leaf's lines as rows of equally many tokens, in order: the place of its first line.

    A line and its template differ, or have a wildcard, in at most `most` places. These are dealt to most + 1 stretches of the places that
    vary, so in one of these the line equals the template's first line, and only such templates are looked at.
    """
    n, width = tokens.shape
    out = np.arange(n)
    most = width - -(-num * width // den)
    varied = np.flatnonzero((tokens != tokens[0]).any(axis=0))
    if len(varied) <= most:
        return np.zeros(n, np.int64)
    shared = []
    for places in np.array_split(varied, most + 1):
        keys = np.zeros(n, np.uint64)
        for j in places:
            keys = tk.mixed(keys ^ tokens[:, j].astype(np.uint64))
        _, number, counts = np.unique(keys, return_inverse=True, return_counts=True)
        # a stretch that no other line has leads nowhere
        shared.append(np.where(counts[number] > 1, number, -1))
    shared = np.stack(shared, axis=1)
    held: dict[tuple[int, int], list[int]] = {}
    wild = np.zeros(tokens.shape, dtype=bool)
    for i in np.flatnonzero((shared >= 0).any(axis=1)).tolist():
        row, places = tokens[i], [(s, g) for s, g in enumerate(shared[i].tolist()) if g >= 0]
        found = sorted({t for place in places for t in held.get(place, ())})
        if found:
            same = ((tokens[found] == row) & ~wild[found]).sum(axis=1)
            best = int(np.argmax(same))
            if den * same[best] >= num * width:
                best = found[best]
                wild[best] |= tokens[best] != row
                out[i] = best
                continue
        for place in places:
            held.setdefault(place, []).append(i)
    return out


def templates(lines: DataFrame, num: int, den: int) -> DataFrame:
    """(line, template): every distinct line's template, or two and more for the lines of a leaf that is split."""
    todo = lines.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.first("tokens").alias("tokens"))
    if LEAF_LINES is None:
        return grown(todo, num, den)
    todo = materialize(todo, "distinct")
    parts, depth = [], DEPTH
    while True:
        many = materialize(todo.groupBy(F.col("leaf").alias("large")).count().where(F.col("count") > LEAF_LINES), "large")
        widest = todo.join(many, todo.leaf == many.large, "left_semi").agg(F.max(F.size("tokens"))).first()[0]
        # lines of which all tokens are equal are one line
        if widest is None or depth >= widest:
            parts.append(grown(todo, num, den))
            break
        parts.append(grown(todo.join(many.hint("merge"), todo.leaf == many.large, "left_anti"), num, den))
        depth *= 2
        size = F.size("tokens")
        ends = F.array(F.xxhash64("leaf", F.lit(0), F.slice("tokens", F.lit(1), F.lit(depth))), F.xxhash64("leaf", F.lit(1), F.slice("tokens", F.greatest(size - depth, F.lit(0)) + 1, F.lit(depth))))
        todo = materialize(todo.join(many.hint("merge"), todo.leaf == many.large, "left_semi").select(F.explode(ends).alias("leaf"), "line", "n", "tokens"), "split")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def grown(lines: DataFrame, num: int, den: int) -> DataFrame:
    """(line, template) of whole leaves; a template is named by its leaf and its first line's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in groups(batches, ["leaf"]):
            line, leaf = table.column("line").to_numpy(), table.column("leaf").to_numpy()
            names = line.copy()
            flat = table.column("tokens").combine_chunks()
            flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
            values, offsets = flat.flatten().to_numpy(), flat.offsets.to_numpy() - flat.offsets[0].as_py()
            for s, e in zip(starts[:-1], starts[1:]):
                if e - s > 1:
                    width = offsets[s + 1] - offsets[s]
                    if width <= DEPTH or offsets[e] - offsets[s] != width * (e - s):
                        continue  # all tokens lead to the leaf: only equal lines share it
                    found = grow(values[offsets[s] : offsets[e]].reshape(e - s, width), num, den)
                    names[s:e] = line[s:e][found]
            names = tk.mixed(names.view(np.uint64) ^ tk.mixed(leaf.view(np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(line), pa.array(names)], ["line", "template"])

    ready = lines.select("leaf", F.negate("n").alias("rarer"), "line", "tokens")
    return dealt(ready, "leaf").sortWithinPartitions("leaf", "rarer", "line").mapInArrow(lambda rows: tidied(run(rows)), "line long, template long")


def dropped_lines(docs: DataFrame, min_docs: int, num: int, den: int) -> DataFrame:
    """(doc_id, lines): the hashes of the lines that each document loses."""
    lines = materialize(lines_in(docs, leaf_bitmap(docs, min_docs)), "lines")
    of = materialize(salted(lines.select("line", "doc_id"), templates(lines, num, den), "line"), "templates")
    often = of.groupBy("template", "doc_id").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") >= min_docs)
    return salted(of, often, "template").where("doc_id <> first").groupBy("doc_id").agg(F.collect_set("line").alias("lines"))


def salted(rows: DataFrame, one_each: DataFrame, key: str) -> DataFrame:
    """rows joined to a table with one row a key; a frequent key's rows are dealt to SALTS tasks by document."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    copies = one_each.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.join(copies.hint("merge"), [key, "salt"]).drop("salt")


def cut_out(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """All columns of docs with text cut, then the numbers of its lines and of those dropped, counting lines that aren't blank.

    Columns are known by their places, not their names (c0, c1, ... in the result), so that no name can clash.
    """
    where = docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]
    placed = docs.toDF(*names)
    both = placed.join(lost.select(F.col("doc_id").alias("of"), "lines").hint("merge"), F.col(f"c{docs.columns.index('doc_id')}") == F.col("of"), "left").select(*names, "lines")
    more = [f"c{len(names)}", f"c{len(names) + 1}"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sets = batch.column(where), batch.column(len(names))
            n_lines, n_dropped = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            out = []
            for first, end, data, offsets in tk.chunks(texts):
                cuts, text, _, firsts, _, line = parsed(data, offsets)
                some = np.diff(firsts) > 0
                n_lines[first:end] = np.bincount(text[some], minlength=end - first)
                begin = np.searchsorted(text, np.arange(end - first + 1))
                for i in range(end - first):
                    own = sets[first + i].values
                    if own is None:
                        out.append(texts[first + i].as_py())
                        continue
                    a, b = begin[i], begin[i + 1]
                    gone = some[a:b] & np.isin(line[a:b], own.to_numpy().view(np.uint64))
                    n_dropped[first + i] = gone.sum()
                    kept = b"".join(data[cuts[j] : cuts[j + 1]].tobytes() for j in np.flatnonzero(~gone) + a)
                    # the line break before a dropped last line goes with it
                    if gone[-1] and kept.endswith(b"\n"):
                        kept = kept[:-1]
                    out.append(kept.decode("utf-8", "replace"))
            columns = batch.columns[: len(names)]
            columns[where] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines), pa.array(n_dropped)], [*names, *more])

    schema = placed.schema
    for name in more:
        schema = schema.add(name, "long")
    return both.mapInArrow(lambda rows: tidied(run(rows)), schema)


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, num: int = 80, den: int = 100) -> DataFrame:
    """A row per document: doc_id, n_lines, n_dropped, text."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut_out(chosen, dropped_lines(docs, min_docs, num, den)).toDF("doc_id", "text", "n_lines", "n_dropped").select("doc_id", "n_lines", "n_dropped", "text")


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, num: int = 80, den: int = 100) -> DataFrame:
    """The documents with those lines gone and n_chars, if there, counted anew; no row goes."""
    names = docs.columns
    cut = cut_out(docs, dropped_lines(docs, min_docs, num, den))
    columns = [F.col(f"c{i}") for i in range(len(names))]
    if "n_chars" in names:
        columns[names.index("n_chars")] = F.length(f"c{names.index('text')}").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[c.alias(n) for c, n in zip(columns, names)])
