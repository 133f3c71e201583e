"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one the cluster names in spark.checkpoint.dir; where that
    is unset, a temporary folder is made and remembered, but only for a local master, as
    a cluster's executors don't see the driver's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark, "_tallyspark_dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tallyspark-")
        spark._tallyspark_dir = found
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage
    and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyspark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def appended(df: DataFrame, name: str, path: str | None) -> str:
    """Add df's rows to the table at path, which is made if there is none; the table's path."""
    path = path or f"{shared_dir(df.sparkSession)}/tallyspark/{name}-{uuid.uuid4().hex}"
    df.write.mode("append").parquet(path)
    return path


def clean_up(spark: SparkSession) -> None:
    """Delete the written tables of all operators. For the end of a job: frames made from them can't be read any more."""
    jvm, context = spark._jvm, spark.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tallyspark")
    path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows with equal keys together, in key order within each partition."""
    n = partitions(df.sparkSession)
    return df.repartition(n, *[F.col(k) for k in keys])


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A non-null numeric column as numpy."""
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Cut a stream that is sorted by integer keys into tables of whole groups.

    Yields (table, starts): starts has the first row of each group and the
    number of rows at its end. Only a group that crosses batches is held back.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [column(batch, k) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        if held:
            last = held[-1]
            change[0] = any(column(last, k)[-1] != c[0] for k, c in zip(keys, cols))
        else:
            change[0] = True
        cuts = np.flatnonzero(change)
        if held and cuts.size == 0:
            held.append(batch)
            continue
        if held:
            whole = pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))])
            held = [batch.slice(int(cuts[-1]))]
        else:
            whole = pa.Table.from_batches([batch.slice(0, int(cuts[-1]))], schema=batch.schema)
            held = [batch.slice(int(cuts[-1]))]
        if whole.num_rows:
            yield whole, group_starts(whole, keys)
    if held:
        whole = pa.Table.from_batches(held)
        yield whole, group_starts(whole, keys)


def group_starts(whole: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(whole.num_rows, dtype=bool)
    change[:1] = True
    for k in keys:
        c = whole.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), whole.num_rows)


def bitmap(values: DataFrame, name: str, bits: int) -> np.ndarray:
    """A Bloom filter of a long column in an array of fixed size: two of 2^bits bits for each value.

    Places are dealt by bucket before they are set, as a partial bitmap of every task and bucket would be
    far larger than the places.
    """
    mask = F.lit((1 << bits) - 1)
    # Spark numbers a bitmap's places from 1
    both = F.explode(F.array(F.col(name).bitwiseAND(mask) + 1, F.shiftrightunsigned(name, bits).bitwiseAND(mask) + 1))
    placed = values.select(both.alias("place")).select(F.bitmap_bucket_number("place").alias("b"), F.bitmap_bit_position("place").alias("p"))
    parts = dealt(placed, "b").groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for row in parts.collect():
        part = np.frombuffer(bytes(row.bits), dtype=np.uint8)[: len(out)]
        out[(row.b - 1) * 4096 : (row.b - 1) * 4096 + len(part)] |= part
    return out


def has_bit(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the 64-bit values may be in the filter."""
    values = values.view(np.uint64)
    mask, width = np.uint64(len(bits) * 8 - 1), np.uint64((len(bits) * 8 - 1).bit_length())
    at = lambda place: bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0
    out = at(values & mask)
    some = np.flatnonzero(out)
    out[some] = at(values[some] >> width & mask)
    return out


def tidied(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows; then the worker, which is used again, gives freed memory back to the system."""
    yield from rows
    give_back()


def give_back() -> None:
    """Give freed memory back to the system, which the allocators else keep."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def binaries(rows: np.ndarray) -> pa.Array:
    """The rows of a 2-d array as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = (np.arange(len(rows) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def matrix(col: pa.Array | pa.ChunkedArray, dtype: type, width: int) -> np.ndarray:
    """A column of equally long binary values as a 2-d array."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.binary())
    if not len(col):
        return np.zeros((0, width), dtype)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype).reshape(len(col), width)
