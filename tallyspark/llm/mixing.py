"""Mixing sources to target weights along a time-varying curriculum.

Each source's share of the words is its weight's share, stopped at `cap` times
what the source holds; what is over goes to the other sources by weight. Within
a source the documents stand in a hash order, the cumulative sizes say how often
each is taken, and the integral of the source's weight schedule, inverted at
the document's cumulative demand, says when in training it is read.

All of it is DataFrame expressions. A source's running total is taken in two
levels (1,024 hash ranges, then within a range), so a source with a third of
all rows is spread over as many tasks; the totals over the sources are in two levels too.
A document that is read more than once has a position for each reading (`readings`).

Cases: null text has size 0 and is taken 0 times; texts of any length are counted whole; the null source is the last
one; ties and repeated rows are ordered by hash, id and size, so that equal rows
are interchangeable; an empty table gives an empty table; extra columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspark.llm.shared import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Slopes of the sources' rates over training, repeating: falling, level, rising.
SLOPES = (-0.5, 0.0, 0.5)
RANGE_BITS = 10
#: Sources of a shard of their running totals.
SHARD_ROWS = 1 << 17


def before_each(rows: DataFrame, order: list[Column], sums: dict[str, Column], shards: int) -> DataFrame:
    """rows with, for each name of sums, the total of its expression over the rows before in a total order.

    The rows are range-partitioned by the order; a window runs within each shard, and only the shards' totals meet in one task.
    """
    ranged = materialize(rows.repartitionByRange(shards, *order).withColumn("shard", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy(F.col("shard").alias("of")).agg(*[F.sum(e).alias(f"all_{n}") for n, e in sums.items()])
    rest = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("of", *[F.coalesce(F.sum(f"all_{n}").over(rest), F.lit(0)).alias(f"to_{n}") for n in sums])
    within = Window.partitionBy("shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    for name, e in sums.items():
        ranged = ranged.withColumn(name, F.coalesce(F.sum(e).over(within), F.lit(0)))
    found = ranged.join(totals, F.col("shard") == F.col("of"))
    return found.select(*rows.columns, *[(F.col(n) + F.col(f"to_{n}")).alias(n) for n in sums])


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(source, source_size, weight, slope, target) from (source, size).

    Sorted by cap over weight, the sources that reach their cap come first, and the first that does not
    sets the level; those after it, which subtract caps that aren't reached, find a lower one. There may be as
    many sources as domains, so both orders are running totals over shards of about shard_rows sources.
    """
    by = materialize(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "sources")
    n, size = by.agg(F.count("*"), F.sum("source_size")).first()
    shards = 1 + n // shard_rows
    by = before_each(by, [F.col("source").isNull(), F.col("source")], {"place": F.lit(1)}, shards)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("place", F.lit(len(weights))) + 1).cast("int")).cast("double"))
    by = by.withColumn("slope", F.element_at(F.array(*map(F.lit, SLOPES)), (F.pmod("place", F.lit(len(SLOPES))) + 1).cast("int")))
    by = by.withColumn("most", (F.col("source_size") * cap).cast("double"))
    by = before_each(by, [F.col("most") / F.col("weight"), F.col("place")], {"capped": F.col("most"), "heavier": F.col("weight")}, shards)
    total = by.agg(F.sum("weight")).first()[0] or 0.0
    level = (F.lit(float(size or 0)) - F.col("capped")) / (F.lit(total) - F.col("heavier"))
    top = by.where(F.col("most") > level * F.col("weight")).agg(F.max(level)).first()[0]
    target = F.col("most") if top is None else F.least("most", F.lit(top) * F.col("weight"))
    return by.select("source", "source_size", "weight", "slope", F.round(target, 6).alias("target"))


def demanded_at(read: Column) -> Column:
    """The point of training, 0 to 1, at which a source's schedule has asked for `read` words of its target:
    demand(t) = target (t + slope (t^2 - t)), inverted."""
    x = F.least(F.lit(1.0), F.when(F.col("target") > 0, read / F.greatest("target", F.lit(1e-9))).otherwise(F.lit(0.0)))
    a = F.col("slope")
    return F.when(a == 0, x).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * x) - (1 - a)) / F.when(a == 0, F.lit(1.0)).otherwise(2 * a))


def taken_of(docs: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Each document with its source's target, the words of its source before it, and the words and copies that the mix takes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)), 1, 15), 16, 10).cast("long")
    sized = materialize(docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key")), "sizes")
    sized = sized.withColumn("part", F.shiftright("key", 60 - RANGE_BITS))
    targets = source_targets(sized, weights, cap).withColumnRenamed("source", "of")
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    parts = parts.join(targets, parts.source.eqNullSafe(targets.of)).drop("of").withColumnsRenamed({"source": "of", "part": "at"}).drop("part_size")
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ran = sized.withColumn("upto", F.sum("size").over(within))
    ran = ran.join(parts, ran.source.eqNullSafe(parts.of) & (ran.part == parts["at"]))
    ran = ran.withColumn("before", F.col("offset") + F.col("upto") - F.col("size"))
    goal = F.round("target").cast("long")
    ran = ran.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(goal / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
    left = goal - F.col("passes") * F.col("source_size")
    last = F.greatest(F.lit(0), F.least("size", left - F.col("before")))
    ran = ran.withColumn("taken", (F.col("passes") * F.col("size") + last).cast("long"))
    ran = ran.withColumn("copies", F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.greatest("size", F.lit(1)))).otherwise(0).cast("long"))
    return ran


def in_order(rows: DataFrame) -> DataFrame:
    """rows range-sorted by position and doc_id."""
    order = F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last()
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken, then source, copies, position.

    taken counts words: every whole pass over the source counts the document's
    size, and the last pass ends where the source's target is reached, if need
    be within a document, so that a source's sum is its rounded target. position
    (0 to 1) is the point of training at which the document is first read, null if it isn't;
    rows are range-sorted by it. `readings` has the positions of the repeats as well.
    """
    ran = taken_of(docs, weights, cap)
    position = F.when(F.col("taken") > 0, F.round(demanded_at(F.col("before")), 9)).alias("position")
    return in_order(ran.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", position))


def readings(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The training order itself: doc_id, source, copy (from 1), words, position, a row for each time that a document is read,
    range-sorted by position. The last copy may end within the document; words sum to `taken` of `mix`.
    A document has at most `cap` copies, so nothing is exploded without a bound."""
    ran = taken_of(docs, weights, cap).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    words = F.least("size", F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    position = F.round(demanded_at(F.col("before") + (F.col("copy") - 1) * F.col("source_size")), 9)
    return in_order(ran.select("doc_id", "source", "copy", words.alias("words"), position.alias("position")))
