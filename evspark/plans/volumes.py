"""Sets of volumes that make up one image, and digests over maps.

Metadata of volumes is never merged before it is resolved: every table keeps its container.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.functions import scalars as S
from evspark.operators import graph as G
from evspark.operators import triples as T
from evspark.plans import containers as P
from evspark.sources import container as K


def numbered(paths: list[str], rows: DataFrame) -> DataFrame:
    """rows with volume_ix, the container's place in the list of paths."""
    order = rows.sparkSession.createDataFrame([(p, i) for i, p in enumerate(paths)], "container string, volume_ix int")
    return rows.join(F.broadcast(order), "container")


def merged_objects(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One declaration of each object: the one with most digests, of those the first volume's."""
    return T.merge_declarations(numbered(paths, P.info(spark, paths)).withColumn("n_digests", F.size("digests")), ["subject"], "n_digests", ["volume_ix"])


def stream_conflicts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """By stream and property, the first value and the first that another volume states differently."""
    s = numbered(paths, P.statements(spark, paths)).withColumn("name", S.local_name(F.col("predicate"))).filter(F.col("name").isin("size", "chunkSize", "chunksInSegment", "compressionMethod"))
    return T.first_conflict(s, ["subject", "name"], "obj_lexical", ["volume_ix", "seq"])


def shared_images(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Disk images that every volume declares."""
    return T.held_by_all(P.info(spark, paths).filter("role = 'DiskImage'"), "container", "subject")


def holders(spark: SparkSession, paths: list[str]) -> DataFrame:
    """By stream, the first volume that has a bevy of it."""
    index = numbered(paths, K.read(spark, paths, "chunk_index"))
    return index.groupBy("stream").agg(F.min_by("container", "volume_ix").alias("container"))


def missing_volumes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Volumes that objects say they are stored in and that aren't among the containers."""
    o = P.info(spark, paths).filter("stored is not null")
    volumes = spark.createDataFrame([(v,) for v in names(paths) if v], "stored string")
    return o.join(F.broadcast(volumes), "stored", "left_anti").groupBy("stored").agg(F.min("first_seq").alias("first_seq"))


def names(paths: list[str]) -> list[str | None]:
    out = []
    for p in paths:
        with K.opened(p) as z:
            out.append(K.volume_name(z))
    return out


def spine(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Objects that images lead to, breadth first: node and depth over data, dependent and target streams."""
    s = P.statements(spark, paths)
    edges = s.filter(F.col("predicate").isin(*P.REFERENCES)).select(F.col("subject").alias("src"), F.col("obj_lexical").alias("dst"))
    o = P.info(spark, paths)
    roots = o.filter(F.col("role").isin("DiskImage", "DiscontiguousImage", "ContiguousImage")).select("subject")
    return G.reach(edges, roots)


def striped_root(stripes: DataFrame, recorded: str, algorithm: str = "sha256") -> tuple[str, str | None]:
    """Whether a recorded digest over the stripes' digests (columns file, map, stream and digest, in hex) is
    right, and by which order of them it is; stripes are as many as volumes."""
    rows = stripes.select("file", "map", "stream", "digest").collect()
    for key in ("file", "map", "stream"):
        joined = b"".join(bytes.fromhex(r["digest"]) for r in sorted(rows, key=lambda r: r[key]))
        if hashlib.new(algorithm, joined).hexdigest() == recorded.lower():
            return "matched", key
    return "mismatch", None


def work_estimate(spark: SparkSession, paths: list[str]) -> DataFrame:
    """By container what verifying it takes: streams, their bytes and bevies, stored bytes and digests."""
    o = P.info(spark, paths)
    per = P.statements(spark, paths).filter(S.local_name(F.col("predicate")).isin("chunkSize", "chunksInSegment")).groupBy("container", "subject").agg(F.product(F.col("obj_lexical").try_cast("double")).alias("segment_bytes"))
    streams = o.filter("role = 'ImageStream'").join(per, ["container", "subject"], "left")
    a = streams.groupBy("container").agg(F.count("*").alias("streams"), F.sum("size").alias("stream_bytes"), F.sum(F.ceil(F.col("size") / F.col("segment_bytes"))).alias("bevies"), F.max(F.size("digests")).alias("most_digests"))
    b = K.read(spark, paths, "segments").filter("kind = 'bevy'").groupBy("container").agg(F.sum("compressed").alias("stored_bytes"))
    return a.join(b, "container", "full")
