"""What the operators of this subpackage share: the shared folder, written tables, skew-proof
joins and Arrow slicing."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.session import shared_dir

#: The vocabulary files of public tokenizers; a parameter of every operator that reads them.
TOKENIZERS = "/opt/tokenizers"

#: Words as the contracts define them: runs of anything but ASCII white space.
WORD_GAPS = r"[\x20\x09-\x0D]+"

#: Bytes of text that Python works on at once. Results don't depend on it; memory does.
SLICE_BYTES = 3 << 20


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/evspark/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """`df` written as a table in the shared folder and read again: it cuts lineage, outlives lost
    executors, and lets adaptive execution split either side of a later join."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Deletes what written() wrote; for intermediate tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key with 1/HOT_SHARE of all rows or more is hot; there are HOT_SHARE such keys at most.
HOT_SHARE = 256


def join_groups(left: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """left inner-joined to one row per `key` of `groups`, without a task that gathers a hot key.

    `size` is the column of `groups` with the number of left rows of the key, `total` the number of
    all left rows. Keys with total / HOT_SHARE rows or more, of which there can't be more than
    HOT_SHARE, are broadcast; the others are joined by a shuffle in which no key has a larger share.
    """
    hot = groups.filter(F.col(size) * HOT_SHARE >= F.lit(total))
    cold = groups.filter(F.col(size) * HOT_SHARE < F.lit(total))
    few = F.broadcast(hot)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(few, key).unionByName(rest.join(cold, key))


def null_safe_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: What a Python worker keeps between tasks, by key, and the operator whose it is.
_RESIDENT: dict = {}
_OWNER: list[str] = []


def _enter(owner: str) -> None:
    if _OWNER != [owner]:
        _RESIDENT.clear()
        _OWNER[:] = [owner]


def resident(owner: str, key, build: Callable):
    """build(), which a worker makes once and keeps until another operator works in it."""
    _enter(owner)
    if key not in _RESIDENT:
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def _give_back() -> None:
    """Memory that is free again goes back to the system; allocators would keep it beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def in_worker(owner: str, work: Callable) -> Callable:
    """`work` as mapInArrow takes it. Workers outlive stages: what another operator kept there goes before
    the task, and what the task no longer needs after it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _enter(owner)
        try:
            yield from work(batches)
        finally:
            _give_back()

    return whole


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The batches cut to `most` bytes in column `name` and so many rows, or to one row where it has more."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(name))
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, base + most, "right"))))
            yield batch.slice(start, stop - start)
            base, start = int(ends[stop - 1]), stop


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and each row's first byte (and the end)."""
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of `flags` between successive offsets."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def words_of(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a string array without nulls, and the number of words in each row."""
    lists = pc.ascii_split_whitespace(col)
    flat = lists.flatten()
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    edges = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=edges[1:])
    counts = per_row(real, edges)
    return (flat if real.all() else flat.filter(pa.array(real))), counts


def numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the values, and the values that the codes stand for."""
    d = values.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary
