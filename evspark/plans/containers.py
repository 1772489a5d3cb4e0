"""What can be asked of containers: information, verification, conformance, reading and export.

Each is a DataFrame over the tables of the container source. Metadata is joined first; bytes are read
last and only for what a digest is recorded of.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.functions import scalars as S
from evspark.functions.raw import decode_chunk
from evspark.operators import chunks as C
from evspark.operators import findings as D
from evspark.operators import intervals as I
from evspark.operators import triples as T
from evspark.session import written
from evspark.sources import container as K
from evspark.sources.turtle import RDF_TYPE

#: Roles, the most specific first. Fixed values.
ROLES = ["DiskImage", "DiscontiguousImage", "ContiguousImage", "FileImage", "FolderImage", "Folder", "Map", "ImageStream", "ZipSegment", "BlockHashes", "AcquisitionTask", "CaseDetails", "Image"]
REFERENCES = [K.SCHEMA_NS + t for t in ("target", "dataStream", "dependentStream")]


def statements(spark: SparkSession, paths: list[str]) -> DataFrame:
    return K.read(spark, paths, "statements")


def role(types: Column) -> Column:
    """The first of the roles that is among the types' local names, else other:<first type>."""
    names = F.transform(types, lambda t: S.local_name(t))
    first = F.get(F.filter(F.array(*[F.lit(r) for r in ROLES]), lambda r: F.array_contains(names, r)), F.lit(0))
    return F.coalesce(first, F.concat(F.lit("other:"), F.get(names, F.lit(0))))


def info(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row for each object of each container: role, types, size, properties, digests, where stored."""
    return _objects(statements(spark, paths))


def _objects(s: DataFrame) -> DataFrame:
    name = S.local_name(F.col("predicate"))
    hashed = (F.col("obj_kind") == "literal") & F.lower(S.local_name(F.col("obj_datatype"))).isin(*[k.replace("-", "") for k in S.DIGEST_DIGITS])
    types = F.transform(F.array_sort(F.collect_list(F.when(F.col("predicate") == RDF_TYPE, F.struct("seq", "obj_lexical")))), lambda x: x["obj_lexical"])
    size = F.max(F.when(name == "size", F.struct("seq", T.as_whole_number(F.col("obj_lexical"), S.local_name(F.col("obj_datatype"))).alias("v"))))
    digest = F.struct("seq", name.alias("property"), F.lower(S.local_name(F.col("obj_datatype"))).alias("algorithm"), F.col("obj_lexical").alias("digest"))
    prop = F.struct("seq", name.alias("name"), F.col("obj_lexical").alias("value"))
    known = (F.col("predicate") == RDF_TYPE) | name.isin("size", "stored", "contains") | hashed
    out = s.groupBy("container", "subject").agg(
        F.min("seq").alias("first_seq"), types.alias("types"), size["v"].alias("size"),
        F.array_sort(F.collect_list(F.when(hashed, digest))).alias("digests"),
        F.array_sort(F.collect_list(F.when(~known, prop))).alias("properties"),
        F.array_distinct(F.collect_list(F.when(name == "stored", F.col("obj_lexical")))).alias("stored"),
    )
    # Of several places that an object is said to be stored in, none counts.
    out = out.withColumn("stored", F.when(F.size("stored") == 1, F.get("stored", F.lit(0))))
    return out.withColumn("role", role(F.col("types")))


def recorded_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    o = info(spark, paths)
    return o.select("container", "subject", "role", "stored", F.explode("digests").alias("d")).select("container", "subject", "role", "stored", "d.property", "d.algorithm", F.col("d.digest").alias("expected"))


# -- streams


def streams(spark: SparkSession, paths: list[str]) -> DataFrame:
    """size, chunk_size, per_segment and codec of each stream, by the first volume that states them in whole."""
    s, name = statements(spark, paths), S.local_name(F.col("predicate"))
    number = lambda n: F.first(F.when(name == n, F.col("obj_lexical").try_cast("long")), ignorenulls=True)
    codecs = F.create_map(*[x for iri, c in K.CODEC_IRIS.items() for x in (F.lit(iri), F.lit(c))])
    iri = F.first(F.when(name == "compressionMethod", F.col("obj_lexical")), ignorenulls=True)
    rows = s.groupBy("container", F.col("subject").alias("stream")).agg(number("size").alias("size"), number("chunkSize").alias("chunk_size"), number("chunksInSegment").alias("per_segment"), iri.alias("iri"))
    rows = rows.filter("size >= 0 and chunk_size > 0 and per_segment > 0")
    rows = rows.withColumn("codec", F.when(F.col("iri").isNull(), "stored").otherwise(F.coalesce(F.try_element_at(codecs, F.col("iri")), F.lit("unsupported"))))
    first = F.min_by(F.struct("size", "chunk_size", "per_segment", "codec"), _place_of(paths))
    return rows.groupBy("stream").agg(first.alias("x")).select("stream", "x.*")


def _place_of(paths: list[str]) -> Column:
    """A container's place in the list of paths."""
    return F.array_position(F.array(*[F.lit(p) for p in paths]), F.col("container"))


def chunks(spark: SparkSession, paths: list[str], only: list | None = None) -> DataFrame:
    """container, stream, chunk_no and the decoded data of chunks; null for one that can't be decoded, or that is
    shorter than the chunk size before its stream's end. Metadata is read once, and joined to chunks as stored."""
    rows = K.read(spark, paths, "stored_chunks", only=only).join(streams(spark, paths), "stream")
    number = F.col("bevy") * F.col("per_segment") + F.col("place")
    rows = rows.select("container", "stream", number.alias("chunk_no"), "data", "codec", "chunk_size", (F.col("size") - number * F.col("chunk_size")).alias("left"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, codec, size, left in zip(*(batch.column(c).to_pylist() for c in ("data", "codec", "chunk_size", "left")), strict=True):
                try:
                    piece = None if data is None else decode_chunk(codec, data, size)
                except (ValueError, OSError, IndexError, zlib.error):
                    piece = None
                out.append(None if piece is None or len(piece) < min(size, left) else piece[: max(0, left)])
            yield pa.RecordBatch.from_arrays([batch.column("container"), batch.column("stream"), batch.column("chunk_no"), pa.array(out, pa.binary())], names=["container", "stream", "chunk_no", "data"])

    return rows.mapInArrow(work, "container string, stream string, chunk_no long, data binary")


# -- verification

#: What a recorded digest's property says that it is over, where that isn't the resource's bytes. Fixed values.
MAP_PARTS = {"mapPointHash": ("map",), "mapIdxHash": ("idx",), "mapPathHash": ("mapPath",), "mapHash": ("map", "idx", "mapPath")}
#: The order of block hashes' algorithms in blockMapHash. Fixed values.
BLOCK_ORDER = ("md5", "sha1", "sha256", "sha512", "blake2b")
_PLAIN = {a.replace("_", "").replace("-", ""): a for a in C.ALGORITHMS}
_KEY = ["container", "subject", "property"]


def verify(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A check for each recorded digest: container, subject, role, property, algorithm, expected, actual, outcome.

    Streams and file members by their bytes, maps by their parts, block hashes by their segments in order, and
    blockMapHash by the digests of those. One pass over a resource's bytes makes all of its digests; bytes of what
    nobody recorded a digest of, and bevies that aren't a stream's, are never read."""
    recorded = recorded_digests(spark, paths).withColumn("algorithm", F.lower("algorithm"))
    rows = _stream_bytes(spark, paths, recorded).unionByName(_member_bytes(spark, paths, recorded)).unionByName(_object_bytes(spark, paths, recorded))
    made = C.stream_digests(rows.withColumn("k", F.concat_ws("\n", *_KEY)), "k", "data", "chunk_no", list(_PLAIN.values()))
    pairs = F.array(*[F.struct(F.lit(plain).alias("algorithm"), F.col(a).alias("actual")) for plain, a in _PLAIN.items()])
    part = lambda i: F.get(F.split("k", "\n"), F.lit(i))
    computed = made.select(*[part(i).alias(c) for i, c in enumerate(_KEY)], F.explode(pairs).alias("p")).select(*_KEY, "p.algorithm", "p.actual")
    computed = computed.unionByName(_block_map_hashes(spark, paths, recorded))
    return D.compare_digests(recorded.drop("stored"), computed, [*_KEY, "algorithm"])


def _stream_bytes(spark: SparkSession, paths: list[str], recorded: DataFrame) -> DataFrame:
    wanted = recorded.filter("role = 'ImageStream' and property = 'hash'").select("container", F.col("subject").alias("stream")).distinct()
    # Another volume of the set may hold a stream that this one describes; a stream that lacks a chunk has no digest.
    rows = chunks(spark, paths).drop("container").join(wanted, "stream")
    short = rows.groupBy("container", "stream").agg(F.count_distinct("chunk_no").alias("n"), F.bool_or(F.col("data").isNull()).alias("bad")).join(streams(spark, paths), "stream")
    whole = short.filter(~F.col("bad") & (F.col("n") == F.ceil(F.col("size") / F.col("chunk_size")))).select("container", "stream")
    return rows.join(whole, ["container", "stream"], "left_semi").select("container", F.col("stream").alias("subject"), F.lit("hash").alias("property"), "chunk_no", "data")


def _object_bytes(spark: SparkSession, paths: list[str], recorded: DataFrame) -> DataFrame:
    """Of objects that are neither streams nor members: files in maps or metadata, and images by their maps."""
    wanted = recorded.filter("property = 'hash' and role not in ('ImageStream', 'BlockHashes')").select("container", "subject").distinct()
    objects = info(spark, paths).join(wanted, ["container", "subject"], "left_semi")
    return object_bytes(spark, paths, objects.filter(~F.exists("types", lambda t: S.local_name(t).isin("ZipSegment", "zip_segment")))).withColumn("property", F.lit("hash"))


def _member_bytes(spark: SparkSession, paths: list[str], recorded: DataFrame) -> DataFrame:
    none = F.lit(0).cast("long")
    inner = F.when(F.startswith(F.col("subject"), F.concat("stored", F.lit("/"))), F.replace(F.substring(F.col("subject"), F.length("stored") + 2, F.length("subject")), F.lit("%20"), F.lit(" ")))
    files = recorded.filter(~F.col("role").isin("ImageStream", "Map", "BlockHashes")).select("container", "subject", inner.alias("name")).distinct()
    out = K.read(spark, paths, "members", kinds="file").join(files, ["container", "name"]).select("container", "subject", F.lit("hash").alias("property"), none.alias("chunk_no"), "data")
    structures = K.read(spark, paths, "members", kinds="map_structure")
    tail = F.element_at(F.split("name", "/"), -1)
    for prop, parts in MAP_PARTS.items():
        place = F.array_position(F.array(*[F.lit(x) for x in parts]), tail)
        wanted = recorded.filter(F.col("property") == prop).select("container", F.col("subject").alias("owner")).distinct()
        out = out.unionByName(structures.filter(tail.isin(*parts)).join(wanted, ["container", "owner"]).select("container", F.col("owner").alias("subject"), F.lit(prop).alias("property"), place.cast("long").alias("chunk_no"), "data"))
    objects = recorded.filter("role = 'BlockHashes'").select("container", "subject", "property").distinct()
    objects = objects.select("container", "subject", "property", F.regexp_extract("subject", r"^(.*)/blockhash\.\w+$", 1).alias("owner"), F.lower(F.regexp_extract("subject", r"\.(\w+)$", 1)).alias("suffix"))
    return out.unionByName(_block_segments(spark, paths).join(objects, ["container", "owner", "suffix"]).select("container", "subject", "property", F.col("bevy").alias("chunk_no"), "data"))


def _block_segments(spark: SparkSession, paths: list[str]) -> DataFrame:
    name = r"(\d{8})\.blockHash\.(\w+)$"
    return K.read(spark, paths, "members", kinds="block_hash").select("container", "owner", F.lower(F.regexp_extract("name", name, 2)).alias("suffix"), F.regexp_extract("name", name, 1).cast("long").alias("bevy"), "data")


def _block_map_hashes(spark: SparkSession, paths: list[str], recorded: DataFrame) -> DataFrame:
    """blockMapHash of maps, and of images by their map: a digest over the digests of the block hashes of the streams
    that the volume holds, in the order of the map's targets and of BLOCK_ORDER, and of the three parts of the map."""
    algorithms = [a for a in ("sha512", "sha256") if a in C.ALGORITHMS]
    own = recorded.filter("property = 'blockMapHash'")
    streams_of = statements(spark, paths).filter(S.local_name(F.col("predicate")) == "dataStream").select("container", "subject", F.col("obj_lexical").alias("map"))
    maps = own.join(streams_of, ["container", "subject"], "left").select("container", "subject", F.coalesce("map", "subject").alias("map")).distinct()
    held = K.read(spark, paths, "chunk_index").select("container", F.col("stream").alias("target")).distinct()
    targets = K.read(spark, paths, "map_targets").filter("kind = 'stored'").join(held, ["container", "target"]).join(maps.select("container", "map").distinct(), ["container", "map"])
    place = F.array_position(F.array(*[F.lit(a) for a in BLOCK_ORDER]), F.col("suffix"))
    blocks = _block_segments(spark, paths).withColumn("o", place).filter("o > 0").join(targets.select("container", F.col("target").alias("owner"), "map", "target_id"), ["container", "owner"])
    blocks = blocks.select("container", "map", (F.col("target_id") * 8 + F.col("o")).alias("ord"), F.col("bevy").alias("chunk_no"), "data")
    tail = F.element_at(F.split("name", "/"), -1)
    parts = K.read(spark, paths, "members", kinds="map_structure").withColumn("map", F.col("owner")).join(maps.select("container", "map").distinct(), ["container", "map"])
    parts = parts.select("container", "map", (F.lit(1 << 40) + F.array_position(F.array(F.lit("map"), F.lit("idx"), F.lit("mapPath")), tail)).alias("ord"), F.lit(0).cast("long").alias("chunk_no"), "data")
    inner = C.stream_digests(blocks.unionByName(parts).withColumn("k", F.concat_ws("\n", "container", "map", F.col("ord").cast("string"))), "k", "data", "chunk_no", algorithms)
    split = F.split("k", "\n")
    inner = inner.select(F.get(split, F.lit(0)).alias("container"), F.get(split, F.lit(1)).alias("map"), F.get(split, F.lit(2)).cast("long").alias("ord"), *algorithms)
    whole = inner.groupBy("container", "map").agg(*[F.sha2(F.unhex(C.in_order(F.col(a), "ord")), int(a[3:])).alias(a) for a in algorithms])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("algorithm"), F.col(a).alias("actual")) for a in algorithms])).alias("p")
    return maps.join(whole, ["container", "map"]).select("container", "subject", F.lit("blockMapHash").alias("property"), each).select(*_KEY, "p.algorithm", "p.actual")


def undigested_images(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Images for which no digest is recorded, neither of their own nor of a part."""
    images = info(spark, paths).filter(F.col("role").isin(*ROLES[:3])).select("container", "subject")
    return D.undigested(images, recorded_digests(spark, paths), "subject", "subject")


def block_checks(spark: SparkSession, paths: list[str], algorithm: str = "sha256") -> DataFrame:
    """By stream, how many chunks have their recorded block digest and how many don't."""
    width = S.DIGEST_DIGITS[algorithm] // 2
    n = F.floor(F.octet_length("data") / width).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("digits", i * (2 * width) + 1, F.lit(2 * width)))
    segments = _block_segments(spark, paths).filter(F.col("suffix") == algorithm).filter(n > 0).withColumn("digits", F.lower(F.hex("data")))
    recorded = segments.select("container", F.col("owner").alias("stream"), "bevy", F.posexplode(cut).alias("place", "expected"))
    digest = F.sha2("data", 256) if algorithm == "sha256" else F.md5("data") if algorithm == "md5" else F.sha1("data")
    made = chunks(spark, paths).join(streams(spark, paths).select("stream", "per_segment"), "stream")
    made = made.select("container", "stream", F.floor(F.col("chunk_no") / F.col("per_segment")).alias("bevy"), (F.col("chunk_no") % F.col("per_segment")).cast("int").alias("place"), digest.alias("actual"))
    both = recorded.join(made, ["container", "stream", "bevy", "place"], "left")
    return both.groupBy("container", "stream").agg(F.count("*").alias("blocks"), F.count_if(F.col("expected") == F.col("actual")).alias("matched"), F.count_if(F.col("actual").isNull()).alias("not_verifiable"))


# -- conformance


def deviations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row for each deviation: container, generation, kind, subject, detail. A rule of one generation's standard
    applies to containers of that generation. What the many rules read is read from the containers once and written."""
    s = written(statements(spark, paths), "statements")
    o = written(_objects(s), "objects")
    seg = written(K.read(spark, paths, "segments"), "segments")
    members = seg.select("container", F.col("name")).distinct()

    def found(rows: DataFrame, kind, subject: Column, detail: Column) -> DataFrame:
        return rows.select("container", (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), subject.alias("subject"), detail.cast("string").alias("detail"))

    local, files = F.regexp_extract("subject", r"^[a-z0-9+.-]+://[^/]*/(.*)$", 1), o.filter("role = 'FileImage'")
    prop = lambda n: F.get(F.filter("properties", lambda p: p["name"] == n), F.lit(0))["value"]
    types = F.transform("types", lambda t: S.local_name(t))
    forms = F.size(F.array_intersect(types, F.array(*[F.lit(x) for x in ("ZipSegment", "zip_segment", "Map", "ImageStream")])))
    stored = files.withColumn("member", F.replace(F.substring(F.col("subject"), F.length("stored") + 2, F.length("subject")), F.lit("%20"), F.lit(" "))).withColumn("types_", types).withColumn("forms", forms)
    with_member = stored.join(seg.groupBy("container", F.col("name").alias("member")).agg(F.max("method").alias("method"), F.max("uncompressed").alias("bytes")), ["container", "member"], "left")
    pair = lambda d, r: S.name_pair_rule(prop(d), prop(r))
    numbers = s.filter(S.local_name(F.col("predicate")) == "size")
    known = s.select("container", F.col("subject").alias("obj_lexical")).distinct()
    refs = s.filter(F.col("predicate").isin(*REFERENCES) & (F.col("obj_kind") == "iri") & ~S.local_name(F.col("obj_lexical")).rlike("^(SymbolicStream.*|Zero|FF|UnknownData|UnreadableData|[0-9A-Fa-f]{2})$"))
    digests = o.select("container", "subject", F.explode("digests").alias("d"))
    # Across all volumes: the first value of a stream's property, and the first that another statement differs in.
    stated = s.filter(S.local_name(F.col("predicate")).isin("size", "chunkSize", "chunksInSegment", "compressionMethod")).withColumn("volume_ix", _place_of(paths))
    where = stated.groupBy("subject", "predicate", F.col("obj_lexical").alias("other_value")).agg(F.min_by("container", "volume_ix").alias("container"))
    conflicts = T.first_conflict(stated, ["subject", "predicate"], "obj_lexical", ["volume_ix", "seq"]).join(where, ["subject", "predicate", "other_value"])
    listed = s.filter((S.local_name(F.col("predicate")) == "contains") & (F.col("obj_kind") == "iri"))
    out = [
        found(seg.groupBy("container", "name").agg(F.count("*").alias("n")).filter("n > 1"), "DuplicateSegmentName", F.col("name"), F.col("n")),
        found(seg.filter("kind = 'description' and pos <> 0"), "DescriptionNotFirst", F.col("name"), F.col("pos")),
        found(numbers.filter(T.as_whole_number(F.col("obj_lexical"), S.local_name(F.col("obj_datatype"))).isNull()), "UnexpectedDatatype", F.col("subject"), F.col("obj_lexical")),
        found(digests.filter(~S.digest_length_right(F.col("d.algorithm"), F.col("d.digest"))), "DigestLengthMismatch", F.col("subject"), F.col("d.digest")),
        found(refs.join(known, ["container", "obj_lexical"], "left_anti"), "DanglingReference", F.col("subject"), F.col("obj_lexical")),
        found(s.filter(F.col("subject").rlike("^aff4:sha(256|512):")).groupBy("container").agg(F.count_distinct("subject").alias("n")), "ContentAddressedSubject", F.lit(None).cast("string"), F.col("n")),
        found(files.filter(~F.arrays_overlap(types, F.array(F.lit("ZipSegment"), F.lit("zip_segment"), F.lit("ImageStream")))).withColumn("name", local).join(members, ["container", "name"], "left_semi"), "MissingZipSegmentType", F.col("subject"), F.lit(None)),
        found(files.filter(S.guid_case(S.local_name(F.col("subject"))) == "none"), "NonGuidArn", F.col("subject"), F.lit(None)),
        found(files.filter(S.guid_case(S.local_name(F.col("subject"))).isin("upper", "mixed")), "UppercaseGuidArn", F.col("subject"), F.lit(None)),
        found(files.filter(F.coalesce(*[F.nullif(prop(n), F.lit("")) for n in ("originalPathName", "originalFileName", "fileName")]).isNull()), "MissingRecordedPath", F.col("subject"), F.lit(None)),
        found(files.withColumn("rule", pair("originalPathName", "originalPathNameRaw")).filter("rule is not null"), F.col("rule"), F.col("subject"), prop("originalPathName")),
        found(files.withColumn("rule", pair("fileName", "fileNameRaw")).filter("rule is not null"), F.col("rule"), F.col("subject"), prop("fileName")),
        found(stored.filter("forms > 1"), "AmbiguousStorageForm", F.col("subject"), F.col("forms")),
        found(with_member.filter(F.array_contains("types_", "ZipSegment") & F.col("method").isNull()), "StorageFormNotFound", F.col("subject"), F.col("member")),
        found(with_member.filter("method not in (0, 8)"), "UnsupportedSegmentCompression", F.col("subject"), F.col("method")),
        found(with_member.filter(F.col("bytes") >= K.MOST_BYTES), "OversizedZipSegment", F.col("subject"), F.col("bytes")),
        found(with_member.filter(F.array_contains("types_", "ZipSegment") & (F.size("digests") == 0)), "MissingZipSegmentHash", F.col("subject"), F.lit(None)),
        found(conflicts, "ConflictingStreamValue", F.col("subject"), F.concat_ws(" / ", "first_value", "other_value")),
        found(listed.join(known, ["container", "obj_lexical"], "left_anti"), "DanglingReference", F.col("subject"), F.col("obj_lexical")),
    ]
    out += [found(r, k, u, d) for r, k, u, d in _volume_rules(spark, paths, s, o, files, members)]
    whole = out[0]
    for rows in out[1:]:
        whole = whole.unionByName(rows)
    return D.in_force(whole.join(generations(spark, paths), "container", "left"), D.rules(spark))


#: Namespaces of the standard's terms and of those that the logical standard adds, and such terms. Fixed values.
LOGICAL_NS = "http://aff4.org/Schema/2022/#"
KNOWN_NS = (K.SCHEMA_NS, LOGICAL_NS, "https://aff4.org/Schema/2022/#", "http://afflib.org/2009/aff4#")
STANDARD_TERMS = ("Image", "ContiguousImage", "DiskImage", "ImageStream", "Map", "ZipVolume", "BlockHashes", "size", "chunkSize", "chunksInSegment", "compressionMethod", "hash", "stored", "dataStream", "dependentStream", "target", "mapGapDefaultStream", "contains")

def _volume_rules(spark: SparkSession, paths: list[str], s: DataFrame, o: DataFrame, files: DataFrame, members: DataFrame) -> list[tuple]:
    """Deviations of volumes as wholes: rows, kind, subject and detail."""
    none = F.lit(None).cast("string")
    v = K.read(spark, paths, "volumes")
    clean = lambda c: F.regexp_replace(c, r"^[\x00\s]+|[\x00\s]+$", "")
    both = v.withColumn("c", F.nullif(clean("comment"), F.lit(""))).withColumn("d", F.nullif(clean("description"), F.lit("")))
    alpha = v.filter("major = 2 and minor = 1").select("container", "metadata_hashes")
    own = both.select("container", F.coalesce("d", "c").alias("volume"))
    known = both.select(F.coalesce("d", "c").alias("stored")).filter("stored is not null").distinct()
    ranges = s.select("container", F.explode(F.array("subject", F.when(F.col("obj_kind") == "iri", F.col("obj_lexical")))).alias("iri")).filter(F.col("iri").rlike(r"\[[^\]]*\]")).groupBy("container").agg(F.count_distinct("iri").alias("n"))
    term, space = S.local_name(F.col("predicate")), S.namespace(F.col("predicate"))
    wrong = s.join(alpha.select("container"), "container", "left_semi").filter(term.isin(*STANDARD_TERMS) & space.isin(*KNOWN_NS) & (space != K.SCHEMA_NS))
    local = files.join(own, "container").withColumn("name", F.regexp_extract("subject", r"^[a-z0-9+.-]+://[^/]*/(.*)$", 1)).filter("name <> ''")
    spelt = local.withColumn("escaped", F.replace(F.col("name"), F.lit(" "), F.lit("%20"))).filter("escaped <> name")
    resident = s.filter((S.local_name(F.col("predicate")) == "dataStream") & (F.col("obj_kind") == "literal")).withColumn("bytes", F.octet_length(S.strict_base64(F.col("obj_lexical"))))
    algorithms = S.algorithm_list(F.col("metadata_hashes"))
    return [
        (v.filter(F.col("comment").rlike(r"^[\x00 ]+[^\x00 ]")), "ArnNotAtCommentStart", none, none),
        (both.filter("c <> d"), "InconsistentVolumeArn", F.col("d"), F.col("c")),
        (o.filter("stored is not null").join(F.broadcast(known), "stored", "left_anti"), "ExternalReference", F.col("subject"), F.col("stored")),
        (ranges, "ByteRangeArn", none, F.col("n")),
        (wrong, "WrongTermNamespace", F.col("subject"), F.col("predicate")),
        (spelt.join(members, ["container", "name"], "left_anti").join(members.withColumnRenamed("name", "escaped"), ["container", "escaped"], "left_semi"), "EscapedV21MemberName", F.col("subject"), F.col("escaped")),
        (resident.filter(F.col("bytes") > K.MOST_RESIDENT), "OversizedResidentStream", F.col("subject"), F.col("bytes")),
        (resident.filter("bytes is null"), "StorageFormNotFound", F.col("subject"), F.lit("not base 64")),
        (alpha.filter("metadata_hashes is null"), "MissingMetadataHash", none, none),
        (alpha.filter((F.col("metadata_hashes") != "") & ~S.strong_enough(algorithms)), "WeakMetadataHash", none, F.col("metadata_hashes")),
        (_misnamed(spark, paths), "MultiPartNamingScheme", none, F.col("name")),
    ]


def notes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """What a verification says beside its checks: maps of discontiguous images that leave holes, images without a
    digest, and members that can't be read: container, kind, subject, detail."""
    o = info(spark, paths)
    holes = I.coverage(K.read(spark, paths, "map_entries"), ["container", "map"], ["ord"]).filter("gaps > 0")
    images = o.filter("role = 'DiscontiguousImage'").select("container", F.explode(F.filter("properties", lambda p: p["name"] == "dataStream")).alias("p")).select("container", F.col("p.value").alias("map"))
    gaps = holes.join(images, ["container", "map"], "left_semi").select("container", F.lit("MapGap").alias("kind"), F.col("map").alias("subject"), F.concat_ws(" ", "gaps", F.lit("holes of"), "gap_bytes", F.lit("bytes")).alias("detail"))
    bare = undigested_images(spark, paths).select("container", F.lit("NoDigest").alias("kind"), "subject", F.lit("no digest is recorded").alias("detail"))
    bad = K.read(spark, paths, "problems").select("container", F.lit("Unreadable").alias("kind"), F.col("name").alias("subject"), "detail")
    return gaps.unionByName(bare).unionByName(bad)


def _misnamed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Names of a set of several containers that aren't name, name.1, name.2 and so on."""
    names = [p.rsplit("/", 1)[-1] for p in paths]
    first = min(names, key=len) if names else ""
    wanted = {first, *(f"{first}.{k}" for k in range(1, len(names)))}
    rows = [(p, n) for p, n in zip(paths, names, strict=True) if len(names) > 1 and n not in wanted and re.match(r".*[-_. ]\d+\.[^.]+$|.*\.\d+$", n)]
    return spark.createDataFrame(rows, "container string, name string")


#: Which generation governs a container, by version. Fixed values.
GENERATIONS = {(1, 0): "standard10", (1, 1): "logical", (2, 1): "alpha"}


def generations(spark: SparkSession, paths: list[str]) -> DataFrame:
    """container and generation: by the version that it declares, null for one that declares none that is known."""
    versions = F.lit(None).cast("string")
    for (major, minor), name in GENERATIONS.items():
        versions = F.when((F.col("major") == major) & (F.col("minor") == minor), name).otherwise(versions)
    return K.read(spark, paths, "volumes").select("container", versions.alias("generation"))


def conformance(spark: SparkSession, paths: list[str], generation: str | None = None) -> DataFrame:
    """Deviations with the sections that they cite, by each container's own generation or by the one given."""
    return D.cited(deviations(spark, paths), D.rules(spark), generation or F.col("generation"))


# -- reading


#: Bytes of a region that isn't stored in one row, and what stands for what is unknown: a text that begins anew at
#: every so many bytes of the target. Fixed values of the format.
BLOCK = 1 << 20
FILLERS = {"UnknownData": "UNKNOWN", "UnreadableData": "UNREADABLEDATA"}
#: Streams whose bevies are asked for one by one; beyond that all are scanned.
MOST_ASKED = 10_000


def resolved_targets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Targets of maps, those with block hashes followed to the slice of the stream that holds them: kind, target and
    shift, which is to be added to a target offset. Those that lead nowhere keep their kind."""
    targets = K.read(spark, paths, "map_targets")
    slices = statements(spark, paths).filter((S.local_name(F.col("predicate")) == "dataStream") & F.col("subject").rlike("^aff4:sha(256|512):"))
    slices = slices.groupBy(F.col("subject").alias("target")).agg(F.min("obj_lexical").alias("slice"), F.count_distinct("obj_lexical").alias("n")).filter("n = 1")
    start = S.name_part(F.col("slice"), "range_start")
    out = targets.join(slices.filter(start.isNotNull()), "target", "left")
    bare = F.regexp_replace("slice", r"\[[^\]]*\]$", "")
    return out.select("container", "map", "target_id", F.when(F.col("slice").isNull(), F.col("kind")).otherwise("stored").alias("kind"), F.coalesce(bare, "target").alias("target"), F.coalesce(start, F.lit(0)).alias("shift"))


def gap_target(spark: SparkSession, paths: list[str], image_map: str) -> str:
    """What fills the holes of a map: the stream that it names, or zeros."""
    rows = statements(spark, paths).filter((F.col("subject") == image_map) & (S.local_name(F.col("predicate")) == "mapGapDefaultStream") & (F.col("obj_kind") == "iri")).select("obj_lexical").distinct().limit(2).collect()
    return rows[0][0] if len(rows) == 1 else K.SCHEMA_NS + "Zero"


def image_regions(spark: SparkSession, paths: list[str], image_map: str, start: int, stop: int) -> DataFrame:
    """The regions of [start, stop) of a map: clip_start, clip_length, from (the place in the target), kind, target and
    gap (whether it is a hole that is filled). The first volume that holds the map tells it. A region whose target
    isn't listed has no kind."""
    entries = K.read(spark, paths, "map_entries").filter(F.col("map") == image_map)
    first = entries.agg(F.min(F.struct(_place_of(paths).alias("i"), F.col("container"))).alias("x"), F.max(F.col("offset") + F.col("length")).alias("end")).head()
    holder = first["x"]["container"] if first["x"] else None
    entries = entries.filter(F.col("container") == F.lit(holder)) if holder else entries
    fill = gap_target(spark, paths, image_map)
    holes = I.with_gaps(entries.select("map", "ord", "offset", "length"), ["map"], ["ord"]).filter("gap > 0").select("map", (F.col("offset") - F.col("gap")).alias("offset"), F.col("gap").alias("length"))
    end = first["end"] or 0
    if stop > end:
        holes = holes.unionByName(spark.createDataFrame([(image_map, end, stop - end)], "map string, offset long, length long"))
    told = entries.select("map", "offset", "length", "target_offset", "target_id").unionByName(holes.select("map", "offset", "length", F.lit(0).cast("long").alias("target_offset"), F.lit(-1).cast("long").alias("target_id")))
    ranges = spark.createDataFrame([(image_map, start, stop)], "map string, start long, stop long")
    clipped = I.range_clip(ranges, told, ["map"], 1 << 30)
    targets = resolved_targets(spark, paths).filter((F.col("map") == image_map) & (F.col("container") == F.lit(holder))).select("map", "target_id", "kind", "target", "shift")
    targets = targets.unionByName(spark.createDataFrame([(image_map, -1, K.target_kind(fill), fill, 0)], targets.schema))
    out = clipped.join(targets, ["map", "target_id"], "left")
    return out.select("map", "clip_start", "clip_length", (F.col("target_offset") + F.coalesce("shift", F.lit(0)) + F.col("into")).alias("from"), "kind", "target", (F.col("target_id") < 0).alias("gap"))


def read_accounting(spark: SparkSession, paths: list[str], image_map: str, size: int) -> DataFrame:
    """Bytes of a map that are stored, described, placeholders for what is unknown, and fill of holes; one row."""
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("clip_length"))), F.lit(0))
    gap, kind = F.col("gap"), F.col("kind")
    return image_regions(spark, paths, image_map, 0, size).agg(n(~gap & (kind == "stored")).alias("stored"), n(~gap & (kind == "repeated_byte")).alias("described"), n(~gap & (kind == "unknown")).alias("unknown_placeholder"), n(gap).alias("gap_filled"))


def filler(target: Column, place: Column, length: Column) -> Column:
    """`length` bytes, BLOCK at most, of what stands for a target that isn't stored, from `place` in it, without passing
    the end of its block."""
    name = S.local_name(target)
    byte = F.when(name == "Zero", "00").when(name.rlike("^[0-9A-Fa-f]{2}$"), name).otherwise(F.regexp_extract(target, "([0-9A-Fa-f]{2})$", 1))
    n = length.cast("int")
    out = F.unhex(F.repeat(byte, n))
    for unknown, text in FILLERS.items():
        phase = (place % BLOCK % len(text)).cast("int")
        repeated = F.repeat(F.lit(text), F.floor(n / len(text)).cast("int") + 2)
        out = F.when(name == unknown, F.substring(repeated, phase + 1, n).cast("binary")).otherwise(out)
    return out


def read_image(spark: SparkSession, paths: list[str], image_map: str, start: int, stop: int) -> DataFrame:
    """The bytes of [start, stop) of a map, as pieces (at, data, kind, length) that follow on from each other when
    ordered by `at`. Entries and holes are clipped to the range, cut at chunk borders and joined to their chunks, of
    which only the bevies in question are opened. data is null where nothing tells the bytes."""
    return _pieces(spark, paths, image_regions(spark, paths, image_map, start, stop)).drop("map")


def _pieces(spark: SparkSession, paths: list[str], regions: DataFrame) -> DataFrame:
    """The bytes of regions(map, clip_start, clip_length, from, kind, target) of any number of maps: map, at, data, kind, length."""
    regions = written(regions, "regions")
    stored = regions.filter("kind = 'stored'").join(streams(spark, paths).withColumnRenamed("stream", "target"), "target", "left")
    others = regions.filter("kind is null or kind <> 'stored'")
    # What isn't stored is made in blocks, cut where the target's own blocks end.
    block = F.explode(F.sequence(F.floor(F.col("from") / BLOCK), F.floor((F.col("from") + F.col("clip_length") - 1) / BLOCK)))
    cut = others.withColumn("b", block).withColumn("low", F.greatest(F.col("from"), F.col("b") * BLOCK)).withColumn("length", F.least(F.col("from") + F.col("clip_length"), (F.col("b") + 1) * BLOCK) - F.col("low"))
    made = F.when(F.col("kind").isin("repeated_byte", "unknown"), filler(F.col("target"), F.col("low"), F.col("length")))
    filled = cut.select("map", (F.col("clip_start") + F.col("low") - F.col("from")).alias("at"), made.alias("data"), "kind", "length")
    size, end = F.col("chunk_size"), F.col("from") + F.col("clip_length")
    lost = stored.filter("chunk_size is null").select("map", F.col("clip_start").alias("at"), F.lit(None).cast("binary").alias("data"), "kind", F.col("clip_length").alias("length"))
    stored = stored.filter("chunk_size is not null")
    spans = stored.groupBy("target").agg(F.min(F.floor(F.col("from") / size / F.col("per_segment"))).alias("first"), F.max(F.floor((end - 1) / size / F.col("per_segment"))).alias("last")).limit(MOST_ASKED + 1).collect()
    only = [(r["target"], r["first"], r["last"]) for r in spans] if len(spans) <= MOST_ASKED else None
    parts = C.of_regions(stored, F.col("from"), end, size)
    at = F.col("clip_start") + F.col("chunk_no") * size + F.col("within") - F.col("from")
    parts = parts.select("map", "target", "chunk_no", "kind", at.alias("at"), (F.col("within") + 1).cast("int").alias("skip"), "length")
    held = chunks(spark, paths, only).groupBy(F.col("stream").alias("target"), "chunk_no").agg(F.first("data", ignorenulls=True).alias("bytes"))
    parts = parts.join(held, ["target", "chunk_no"], "left")
    piece = F.substring(F.col("bytes"), F.col("skip"), F.col("length").cast("int"))
    right = F.when(F.octet_length(piece) == F.col("length"), piece)
    return parts.select("map", "at", right.alias("data"), "kind", "length").unionByName(filled).unionByName(lost)


def map_regions(spark: SparkSession, paths: list[str], maps: DataFrame) -> DataFrame:
    """The regions of all of maps(map, size), holes filled as image_regions() fills those of one."""
    entries = K.read(spark, paths, "map_entries").join(maps.select("map", "size"), "map")
    # The first volume that holds a map tells it.
    entries = entries.join(entries.groupBy("map").agg(F.min_by("container", _place_of(paths)).alias("container")), ["map", "container"], "left_semi")
    entries = written(entries, "entries")
    holes = I.with_gaps(entries.select("map", "size", "ord", "offset", "length"), ["map"], ["ord"]).filter("gap > 0").select("map", "size", (F.col("offset") - F.col("gap")).alias("offset"), F.col("gap").alias("length"))
    ends = entries.groupBy("map", "size").agg(F.max(F.col("offset") + F.col("length")).alias("offset"))
    holes = holes.unionByName(ends.select("map", "size", "offset", (F.col("size") - F.col("offset")).alias("length")).filter("length > 0"))
    s = statements(spark, paths).filter((S.local_name(F.col("predicate")) == "mapGapDefaultStream") & (F.col("obj_kind") == "iri"))
    named = s.groupBy(F.col("subject").alias("map")).agg(F.min("obj_lexical").alias("named"), F.count_distinct("obj_lexical").alias("n")).filter("n = 1")
    fill = F.coalesce("named", F.lit(K.SCHEMA_NS + "Zero"))
    filled = holes.join(named, "map", "left").select("map", "size", "offset", "length", F.lit(0).cast("long").alias("from"), _kind_of(fill).alias("kind"), fill.alias("target"), F.lit(True).alias("gap"))
    told = entries.join(resolved_targets(spark, paths), ["container", "map", "target_id"], "left")
    told = told.select("map", "size", "offset", "length", (F.col("target_offset") + F.coalesce("shift", F.lit(0))).alias("from"), "kind", "target", F.lit(False).alias("gap"))
    rows = told.unionByName(filled).withColumn("clip_length", F.least("length", F.col("size") - F.col("offset"))).filter("clip_length > 0")
    return rows.select("map", F.col("offset").alias("clip_start"), "clip_length", "from", "kind", "target", "gap")


def _kind_of(target: Column) -> Column:
    """K.target_kind() as an expression."""
    tail = S.local_name(target)
    kind = F.when(target.rlike("^aff4:sha(256|512):"), "block_hash").when(tail.rlike("^(Zero|FF|SymbolicStream.*|[0-9A-Fa-f]{2})$"), "repeated_byte").when(tail.isin(*FILLERS), "unknown")
    return kind.when(F.startswith(target, F.lit(K.SCHEME)), "stored").otherwise("unrecognised")


def object_bytes(spark: SparkSession, paths: list[str], objects: DataFrame) -> DataFrame:
    """The bytes of objects(container, subject, size), however they are stored: in a member, in the metadata, as a stream,
    or as a map, the object's own or the one that its dataStream names. Pieces (container, subject, chunk_no, data) in
    the order of chunk_no; an object whose bytes aren't there in whole has none."""
    o, s = objects.select("container", "subject", "size"), statements(spark, paths)
    told = s.filter(S.local_name(F.col("predicate")) == "dataStream").join(o.select("container", "subject"), ["container", "subject"], "left_semi")
    none = F.lit(0).cast("long").alias("chunk_no")
    resident = told.filter("obj_kind = 'literal'").select("container", "subject", none, S.strict_base64(F.col("obj_lexical")).alias("data"))
    stream = streams(spark, paths).select(F.col("stream").alias("subject"))
    maps = o.join(stream, "subject", "left_anti").join(told.filter("obj_kind = 'iri'").groupBy("container", "subject").agg(F.min("obj_lexical").alias("via")), ["container", "subject"], "left")
    maps = maps.withColumn("map", F.coalesce("via", "subject")).join(K.read(spark, paths, "map_targets").select("map").distinct(), "map", "left_semi").filter("size >= 0")
    pieces = _pieces(spark, paths, map_regions(spark, paths, maps.groupBy("map").agg(F.max("size").alias("size"))))
    mapped = pieces.join(maps.select("container", "subject", "map"), "map").select("container", "subject", F.col("at").alias("chunk_no"), "data")
    streamed = chunks(spark, paths).drop("container").join(o.join(stream, "subject", "left_semi").select("container", "subject"), F.col("stream") == F.col("subject")).select("container", "subject", "chunk_no", "data")
    rows = written(resident.unionByName(mapped).unionByName(streamed), "bytes")
    held = rows.groupBy("container", "subject").agg(F.sum(F.octet_length("data")).alias("n"), F.bool_or(F.col("data").isNull()).alias("bad")).join(o, ["container", "subject"])
    return rows.join(held.filter("not bad and n = size").select("container", "subject"), ["container", "subject"], "left_semi")


def export_image(spark: SparkSession, paths: list[str], image_map: str, size: int, out: str) -> int:
    """Writes a map's bytes to a new file, in order, a partition at a time; the number of bytes."""
    pieces = read_image(spark, paths, image_map, 0, size).repartitionByRange("at").sortWithinPartitions("at")
    done = 0
    with open(out, "xb") as f:
        for row in pieces.toLocalIterator(prefetchPartitions=True):
            if row["at"] != done or row["data"] is None:
                raise ValueError(f"no bytes at {done}")
            f.write(row["data"])
            done += len(row["data"])
    if done != size:
        raise ValueError(f"{done} bytes instead of {size}")
    return done


def export_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The logical files of containers with the safe and distinct paths that they are to be written to:
    container, subject, recorded, written, lastWritten, chunk_no and data, in pieces of which a file has one or more."""
    o = info(spark, paths).filter("role = 'FileImage'")
    prop = lambda n: F.nullif(F.get(F.filter("properties", lambda p: p["name"] == n), F.lit(0))["value"], F.lit(""))
    named = o.select("container", "subject", "first_seq", prop("lastWritten").alias("lastWritten"), F.coalesce(prop("originalPathName"), prop("originalFileName"), prop("fileName")).alias("recorded"), F.replace(F.substring(F.col("subject"), F.length("stored") + 2, F.length("subject")), F.lit("%20"), F.lit(" ")).alias("name"))
    named = named.withColumn("path", S.safe_path(F.coalesce("recorded", "name")))
    placed = D.deconflicted(named, "path", ["first_seq", "subject"])
    members = K.read(spark, paths, "members", kinds="file").select("container", "name", F.lit(0).cast("long").alias("chunk_no"), "data")
    held = placed.join(members, ["container", "name"])
    others = placed.join(held.select("container", "subject").distinct(), ["container", "subject"], "left_anti")
    rest = object_bytes(spark, paths, o.join(others.select("container", "subject"), ["container", "subject"], "left_semi"))
    others = others.join(rest, ["container", "subject"], "left")
    out = ["container", "subject", "recorded", "written", "lastWritten", "chunk_no", "data"]
    return held.select(out).unionByName(others.select(out))


def recorded_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """container, subject and recorded path of each logical file; null where none is recorded."""
    prop = lambda n: F.nullif(F.get(F.filter("properties", lambda p: p["name"] == n), F.lit(0))["value"], F.lit(""))
    return info(spark, paths).filter("role = 'FileImage'").select("container", "subject", F.coalesce(prop("originalPathName"), prop("originalFileName"), prop("fileName")).alias("recorded"))


def natural_parts(names: list[str]) -> list[str]:
    """File names of a set in the order of their numbers; refuses sets with gaps."""

    def number(n: str) -> int:
        m = re.search(r"\.aff4\.(\d+)$", n) or (None if n.endswith(".aff4") and not re.search(r"[-_. ]\d+\.aff4$", n) else re.search(r"(?:^|[-_. ])(\d+)[^\d]*$", n.rsplit(".", 1)[0]))
        return int(m[1]) if m else 0

    out = sorted(names, key=number)
    numbers = [number(n) for n in out]
    if len(out) > 1 and any(b != a + 1 for a, b in zip(numbers, numbers[1:], strict=False)):
        raise ValueError(f"parts are missing: {numbers}")
    return out
