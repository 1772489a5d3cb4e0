"""Objects of containers: rows (subject, role, types, size, first_seq, ...), how they are chosen, counted, grouped and
ordered for reports, and the names that writers give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.functions import scalars as S
from evspark.operators import intervals as I

#: Roles of images, and those that a listing of images shows beside them. Fixed values.
IMAGE_ROLES = ("DiskImage", "DiscontiguousImage", "ContiguousImage", "FileImage", "Image")
BESIDE_IMAGES = ("ImageStream", "Map")
#: Bytes from which a stream counts as substantial, parts that a set may have, seconds that an estimate is cut at. Fixed values.
SUBSTANTIAL, MOST_PARTS, MOST_SECONDS, GIB = 1 << 30, 4096, 359_999, 1 << 30


def statements_for(statements: DataFrame, subject: str) -> DataFrame:
    """The statements about a subject."""
    return statements.filter(F.col("subject") == subject)


def objects_of(statements: DataFrame, subject: str, predicate: str) -> DataFrame:
    """What a subject's statements by a predicate say, in the order of statement by seq."""
    return statements_for(statements, subject).filter(F.col("predicate") == predicate).select("seq", "obj_kind", "obj_lexical")


def listed(objects: DataFrame, mode: str) -> DataFrame:
    """The objects that a listing shows: all, images (with their streams and maps) or none."""
    if mode not in ("all", "images", "none"):
        raise ValueError(mode)
    return objects if mode == "all" else objects.filter(F.col("role").isin(*IMAGE_ROLES, *BESIDE_IMAGES) if mode == "images" else F.lit(False))


def role_counts(objects: DataFrame, by: list[str] = ()) -> DataFrame:
    """How many objects there are and how many of each kind of role."""
    n = lambda *roles: F.count_if(F.col("role").isin(*roles))
    return objects.groupBy(*by).agg(
        F.count("*").alias("objects"), n(*IMAGE_ROLES).alias("images"), n("FileImage").alias("files"), n("FolderImage", "Folder").alias("folders"),
        n("ImageStream").alias("streams"), n("Map").alias("maps"), n("BlockHashes").alias("block_hashes"), F.count_if(F.startswith("role", F.lit("other:"))).alias("others"),
    )


def content_types(objects: DataFrame, by: list[str], content: Column) -> DataFrame:
    """What a container is of: a disk image, files, folders or both, else the content types that its objects state."""
    has = lambda *roles: F.bool_or(F.col("role").isin(*roles))
    files, folders = has("FileImage"), has("FolderImage", "Folder")
    stated = F.array_join(F.array_sort(F.collect_set(content)), ", ")
    kind = F.when(has(*IMAGE_ROLES[:3]), "disk image").when(files & folders, "files and folders").when(files, "files").when(folders, "folders")
    return objects.groupBy(*by).agg(F.coalesce(kind, F.nullif(stated, F.lit("")), F.lit("not stated")).alias("content_type"))


def is_substantial(size: Column) -> Column:
    return F.coalesce(size >= SUBSTANTIAL, F.lit(False))


def storage_form(types: Column, resident: Column, referred: Column, empty: Column) -> Column:
    """How a file's bytes are kept: the one form that its types and properties name, a reference only where there is no
    other; no_content for one without size and digest, else missing or ambiguous."""
    has = lambda *names: F.arrays_overlap(types, F.array(*[F.lit(x) for x in names]))
    forms = F.array_compact(F.array(F.when(has("ZipSegment", "zip_segment"), "zip_segment"), F.when(has("Map"), "map"), F.when(has("ImageStream"), "image_stream"), F.when(resident, "resident")))
    n = F.size(forms)
    return F.when(n == 1, forms[0]).when(n > 1, "ambiguous").when(referred, "reference").when(empty, "no_content").otherwise("missing")


#: Sizes up to which a file is kept in the metadata, as a member, and in a stream that files share. Fixed values.
STORAGE_BANDS = (1 << 10, 1 << 20, 16 << 20)


def storage_choice(size: Column, bands: tuple[int, int, int] = STORAGE_BANDS) -> Column:
    """The form in which a writer keeps a file of a size."""
    resident, member, shared = bands
    return F.when(size == 0, "no_content").when(size <= resident, "in_metadata").when(size <= member, "zip_segment").when(size <= shared, "shared_map").otherwise("own_stream")


def vendor_terms(statements: DataFrame, known: list[str]) -> DataFrame:
    """By namespace that isn't one of the known ones: statements, subjects and distinct terms."""
    space = S.namespace(F.col("predicate"))
    return statements.filter(~space.isin(*known)).groupBy(space.alias("namespace")).agg(F.count("*").alias("statements"), F.count_distinct("subject").alias("subjects"), F.count_distinct("predicate").alias("terms"))


def children(objects: DataFrame, subject: str = "subject") -> DataFrame:
    """Objects whose name is another's and one more part: child and parent."""
    parent = F.regexp_extract(subject, r"^(.*)/[^/]*$", 1)
    return objects.select(F.col(subject).alias("child"), parent.alias("parent")).join(objects.select(F.col(subject).alias("parent")).distinct(), "parent", "left_semi").select("child", "parent")


def ordered(objects: DataFrame, spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """objects(subject, role, first_seq) with their place in a report: those of the spine(subject, rank) by rank, those that
    the manifest(subject, ord) lists in its order, then the rest, by role if there is a manifest, as they first appear."""
    rows = objects.join(spine.select("subject", F.col("rank").cast("long").alias("_rank")), "subject", "left").join(manifest.select("subject", F.col("ord").cast("long").alias("_ord")), "subject", "left")
    tier = F.when(F.col("_rank").isNotNull(), 0).when(F.col("_ord").isNotNull(), 1).otherwise(2)
    group = F.when(tier == 2, F.col("role")) if manifest.limit(1).count() else F.lit(None).cast("string")
    rows = rows.withColumn("tier", tier).withColumn("_group", F.coalesce(group, F.lit("")))
    within = F.when(F.col("tier") == 0, F.col("_rank")).when(F.col("tier") == 1, F.col("_ord")).otherwise(F.lit(0))
    return I.places(rows.withColumn("_within", within), [F.col("tier"), F.col("_within"), F.col("_group"), F.col("first_seq"), F.col("subject")]).drop("_rank", "_ord", "_group", "_within")


def first_of_each(rows: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key with their place and how many more there are. Ranks are cut before the sort's
    rows leave their task, so a large key costs n rows of each task."""
    top = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long")).filter(F.col("place") <= n)
    total = rows.groupBy(*key).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return top.join(total, key)


def grouped_notes(notes: DataFrame, text: str, subject: str) -> DataFrame:
    """Notes that differ in the name that they tell only: the shape, how many, how many subjects, and the first."""
    shape = F.regexp_replace(F.replace(F.col(text), F.col(subject), F.lit("*")), r"\d+", "#")
    return notes.groupBy(shape.alias("shape")).agg(F.count("*").alias("notes"), F.count_distinct(subject).alias("subjects"), F.min(subject).alias("first_subject"))


def stream_shapes(streams: DataFrame, by: list[str], size: str) -> DataFrame:
    """Streams by shape: how many, their bytes and the largest."""
    return streams.groupBy(*by).agg(F.count("*").alias("streams"), F.sum(size).alias("bytes"), F.max(size).alias("largest"))


def progress(done: Column, total: Column, seconds: Column) -> tuple[Column, Column]:
    """Whole bytes a second, and the whole seconds that are left at that rate; null before anything is done."""
    rate = F.when((seconds > 0) & (done > 0), F.floor(done / seconds))
    left = F.when(rate > 0, F.least(F.floor((total - done) / rate), F.lit(MOST_SECONDS)))
    return rate, left


def by_digest_length(digests: Column) -> Column:
    """Digests from the shortest to the longest; those alike in length keep their order."""
    numbered = F.transform(digests, lambda d, i: F.struct(F.length(d).alias("n"), i.alias("i"), d.alias("d")))
    return F.transform(F.array_sort(numbered), lambda x: x["d"])


def slice_name(stream: Column, start: Column, length: Column) -> Column:
    """The name of a range of a stream."""
    return F.concat(stream, F.lit("[0x"), F.lower(F.hex(start)), F.lit(":0x"), F.lower(F.hex(length)), F.lit("]"))


def part_plan(total: Column, part: Column) -> tuple[Column, Column]:
    """How many parts of a size a total takes at worst, and if those are too many the least power of two of GiB that
    would do; else null."""
    parts = F.ceil(total / part).cast("long")
    needed = F.greatest(F.ceil(total / (GIB * MOST_PARTS)), F.lit(1))
    power = F.ceil(F.log2(needed.cast("double"))).cast("int")
    return parts, F.when(parts > MOST_PARTS, F.call_function("shiftleft", F.lit(1).cast("long"), power))


def offset_stamp(text: Column) -> Column:
    """Seconds since 1970 of a time with an offset or Z, its fraction left out; null for any other text."""
    m = r"^(\d{4}-\d{2}-\d{2})[Tt](\d{2}:\d{2}:\d{2})(?:\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
    part = lambda i: F.regexp_extract(text, m, i)
    day, clock = part(1).try_cast("date"), part(2)
    second = F.substring(clock, 1, 2).try_cast("long") * 3600 + F.substring(clock, 4, 2).try_cast("long") * 60 + F.substring(clock, 7, 2).try_cast("long")
    zone = part(3)
    minutes = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")
    shift = F.when(F.upper(zone) == "Z", 0).when(F.startswith(zone, F.lit("-")), -minutes).otherwise(minutes)
    return F.when(text.rlike(m), F.unix_date(day) * F.lit(86400).cast("long") + second - shift * 60)
