"""Chunked streams: cutting, packing, deduplication and digests over ordered chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(rows: DataFrame, key: list[str], text: str, size: int, per_segment: int, every: bool = False) -> DataFrame:
    """The chunks of a column's bytes (UTF-8 of a text): chunk_no, segment, place in it, data and true length.

    A row is cut before it is dealt out, so that a chunk's row holds the chunk alone, and in one pass over the bytes,
    each of which stands for a character meanwhile: time grows with length. With `every`, no row is without a chunk: that
    of no bytes has an empty one, and that of a null a null one, without number."""
    as_characters = F.decode(F.col(text).cast("binary"), "ISO-8859-1")
    pieces = F.regexp_extract_all(as_characters, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    dealt = F.posexplode_outer(F.when(F.octet_length(F.col(text).cast("binary")) == 0, F.array(F.lit(""))).otherwise(pieces)) if every else F.posexplode(pieces)
    cut_up = rows.select(*key, dealt.alias("chunk_no", "_data"))
    out = cut_up.select(*key, "chunk_no", F.floor(F.col("chunk_no") / per_segment).cast("int").alias("segment"), (F.col("chunk_no") % per_segment).alias("place"), F.encode("_data", "ISO-8859-1").alias("data"))
    return out.withColumn("length", F.octet_length("data"))


def content(data: str, pad: int) -> Column:
    """The digest of a chunk's bytes, padded with zeros to the chunk size."""
    return F.sha2(F.concat(F.col(data), F.unhex(F.repeat(F.lit("00"), F.greatest(F.lit(pad) - F.octet_length(data), F.lit(0))))), 256)


def of_regions(regions: DataFrame, start: Column, stop: Column, size: Column) -> DataFrame:
    """The regions [start, stop) of streams cut at chunk borders: chunk_no, the place within the chunk and the length."""
    cut_up = regions.withColumn("chunk_no", F.explode(F.sequence(F.floor(start / size), F.floor((stop - 1) / size))))
    first = F.col("chunk_no") * size
    low = F.greatest(start, first)
    return cut_up.withColumn("within", low - first).withColumn("length", F.least(stop, first + size) - low)


def segments(text_length: Column, chunk: int, per_segment: int) -> Column:
    """How many segments a stream of a length takes."""
    return F.ceil(text_length / (chunk * per_segment)).cast("long")


def dedupe(chunks: DataFrame, order: list[str], pad: int) -> DataFrame:
    """A row for each distinct content (padded to the chunk size): its digest, first place and uses."""
    at = F.struct(*order)
    return chunks.withColumn("content", content("data", pad)).groupBy("content").agg(F.min(at).alias("first_at"), F.count("*").alias("uses"), F.sum("length").alias("presented"))


def slice_map(chunks: DataFrame, key: list[str], pad: int) -> DataFrame:
    """Each chunk as an entry of its stream's map: offset, length, and the target's number within the
    stream, by first use."""
    rows = chunks.withColumn("content", content("data", pad))
    first = F.min("chunk_no").over(Window.partitionBy(*key, "content"))
    rows = rows.withColumn("first_use", first)
    local = F.dense_rank().over(Window.partitionBy(*key).orderBy("first_use")) - 1
    return rows.select(*key, "chunk_no", (F.col("chunk_no") * pad).cast("long").alias("offset"), "length", local.alias("local_id"), "content")


def in_order(value: Column, *order: str) -> Column:
    """Aggregate: the values joined in the order of the columns."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("_v")))), lambda x: x["_v"]), "")


def block_digests(chunks: DataFrame, key: list[str]) -> DataFrame:
    """By stream, the digest of the bytes of its chunks' digests in order."""
    each = chunks.withColumn("d", F.sha2(F.col("data").cast("binary"), 256))
    return each.groupBy(*key).agg(F.count("*").alias("blocks"), F.sha2(F.unhex(in_order(F.col("d"), "chunk_no")), 256).alias("block_hashes_hash"))


def first_difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """By key, the first chunk in which two streams differ, or the shorter's number of chunks where one
    is a start of the other; null where they are equal."""
    a, b = (x.select(*key, "chunk_no", F.col("data").alias(n)) for x, n in ((left, "a"), (right, "b")))
    both = a.join(b, [*key, "chunk_no"], "full")
    return both.groupBy(*key).agg(F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("chunk_no"))).alias("first_difference"))


#: Algorithms that Python's hashlib has, by their names in metadata, and the bytes of the two that
#: need a length. Fixed values.
ALGORITHMS = {"md5": None, "sha1": None, "sha256": None, "sha384": None, "sha512": None, "blake2b": None, "sha3_256": None, "sha3_384": None, "sha3_512": None, "shake_128": 32, "shake_256": 64}


def stream_digests(chunks: DataFrame, key: str, data: str, order: str, algorithms: list[str], tasks: int | None = None) -> DataFrame:
    """All wanted digests of each stream's bytes in one pass over its ordered chunks.

    A linear digest can't be joined from parts, so a stream is one task's; chunks arrive sorted and are
    fed to the digests one by one, so memory holds a batch, not a stream. Chunk rows are
    (key, order, data binary); algorithms without a provider give null."""
    import hashlib

    names = [a for a in algorithms if a in ALGORITHMS]
    dealt = chunks.select(F.col(key).cast("string").alias("k"), F.col(order).alias("o"), F.col(data).cast("binary").alias("d"))
    dealt = (dealt.repartition(tasks, "k") if tasks else dealt.repartition("k")).sortWithinPartitions("k", "o")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running, size = None, [], 0

        def done() -> pa.RecordBatch:
            out = {a: h.hexdigest(*([ALGORITHMS[a]] if ALGORITHMS[a] else [])) for a, h in zip(names, running, strict=True)}
            return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([size], pa.int64()), *(pa.array([out.get(a)], pa.string()) for a in algorithms)], names=["k", "bytes", *algorithms])

        first = True
        for batch in batches:
            for k, d in zip(batch.column("k").to_pylist(), batch.column("d"), strict=True):
                if first or k != now:
                    if not first:
                        yield done()
                    now, running, size, first = k, [hashlib.new(a) for a in names], 0, False
                piece = d.as_py() or b""
                size += len(piece)
                for h in running:
                    h.update(piece)
        if not first:
            yield done()

    schema = "k string, bytes long, " + ", ".join(f"{a} string" for a in algorithms)
    return dealt.mapInArrow(work, schema).withColumnRenamed("k", key)


def split_by_size(rows: DataFrame, key: str, order: str, length: str, limit: int) -> DataFrame:
    """rows with `part`: a part ends with the row that brings it to the limit or beyond. The sum starts
    anew with each part, so rows of a key are read in order, a batch at a time."""
    names = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used, part = None, 0, 0
        for batch in batches:
            parts = []
            for k, n in zip(batch.column(key).to_pylist(), batch.column(length).to_pylist(), strict=True):
                if k != now:
                    now, used, part = k, 0, 0
                parts.append(part)
                used += n or 0
                if used >= limit:
                    used, part = 0, part + 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(parts, pa.int64())], names=[*names, "part"])

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(work, _ddl(rows, "part bigint"))


def _ddl(rows: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), more])
