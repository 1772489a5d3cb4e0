"""Interval maps over an address space: entries (key..., offset, length, target...).

Entries are ordered in two levels: dealt by ranges of the map and offset, with what came before a range carried
into it, so that one map is many tasks'. Points and ranges find entries through buckets of the address space, wider
ones for longer entries: both sides are dealt to the buckets that they touch and joined by (key, level, bucket), so no
pair is tried that shares no bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.session import written


def _w(key: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*key).orderBy(*order)


#: The range of a row in a table that is dealt by order.
_RANGE = "_evspark_range"


def dealt(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """rows written by ranges of (key, order), each range a task's, with the range's number. A key of any size is
    many tasks' that way; what is before a range comes from before()."""
    return written(rows.repartitionByRange(*key, *order).withColumn(_RANGE, F.spark_partition_id()), "dealt")


def before(ranged: DataFrame, key: list[str], order: list[str], value: Column, total) -> DataFrame:
    """dealt() rows with `_before`: total (sum or max) of the value over all rows of the key that are before it, null
    where none is.

    Inside a range it is a window's. Of the totals of whole ranges only those matter that continue a key of the range
    before, of which a range has one at most, so they are broadcast: as many rows as ranges."""
    inside = total(value).over(Window.partitionBy(*key, _RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    totals = ranged.groupBy(*key, _RANGE).agg(total(value).alias("_total"))
    earlier = total("_total").over(Window.partitionBy(*key).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(_RANGE).alias("_r"), earlier.alias("_carried")).filter("_carried is not null")
    same = F.col(_RANGE) == F.col("_r")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    both = ranged.withColumn("_inside", inside).join(F.broadcast(carried), same, "left")
    joined = F.greatest("_inside", "_carried") if total is F.max else F.when(F.col("_inside").isNotNull() | F.col("_carried").isNotNull(), F.coalesce("_inside", F.lit(0)) + F.coalesce("_carried", F.lit(0)))
    return both.withColumn("_before", joined).drop("_inside", "_carried", "_r", *[f"_k{i}" for i in range(len(key))])


def places(rows: DataFrame, order: list[Column], into: str = "place") -> DataFrame:
    """rows with their place, from 1, in an order without ties. Rows are dealt by ranges and numbered inside each; the
    counts of the ranges, one for each task, are what passes through one."""
    names = [f"_o{i}" for i in range(len(order))]
    ranged = dealt(rows.select("*", *[c.alias(n) for c, n in zip(order, names, strict=True)]), [], names)
    counts = ranged.groupBy(_RANGE).agg(F.count("*").alias("_n"))
    first = counts.select(F.col(_RANGE).alias("_r"), (F.sum("_n").over(Window.orderBy(_RANGE)) - F.col("_n")).alias("_first"))
    inside = ranged.withColumn("_inside", F.row_number().over(Window.partitionBy(_RANGE).orderBy(*names)))
    return inside.join(F.broadcast(first), F.col(_RANGE) == F.col("_r")).withColumn(into, (F.col("_inside") + F.col("_first")).cast("long")).drop(_RANGE, "_inside", "_r", "_first", *names)


def with_gaps(entries: DataFrame, key: list[str], tie: list[str]) -> DataFrame:
    """Entries in order of offset with `gap` and `overlap`: bytes between the end of all entries before
    and this one's offset, one of the two being 0."""
    return _with_gaps(entries, key, tie).drop(_RANGE, "_first")


def _with_gaps(entries: DataFrame, key: list[str], tie: list[str]) -> DataFrame:
    order = ["offset", *tie]
    rows = before(dealt(entries, key, order), key, order, F.col("offset") + F.col("length"), F.max)
    lead = F.coalesce(F.col("offset") - F.col("_before"), F.col("offset"))
    return rows.withColumn("gap", F.greatest(lead, F.lit(0))).withColumn("overlap", F.greatest(-lead, F.lit(0))).withColumn("_first", F.col("_before").isNull()).drop("_before")


def coverage(entries: DataFrame, key: list[str], tie: list[str]) -> DataFrame:
    """By map: entries, gaps and their bytes, overlaps, covered bytes and the end."""
    return with_gaps(entries, key, tie).groupBy(*key).agg(
        F.count("*").alias("entries"),
        F.count_if(F.col("gap") > 0).alias("gaps"),
        F.sum("gap").alias("gap_bytes"),
        F.count_if(F.col("overlap") > 0).alias("overlaps"),
        F.sum("length").alias("entry_bytes"),
        F.max(F.col("offset") + F.col("length")).alias("map_end"),
    )


def gap_fill(entries: DataFrame, key: list[str], tie: list[str], target: str, fill: str) -> DataFrame:
    """Entries and, for each gap, an entry of the fill target."""
    gaps = with_gaps(entries, key, tie).filter("gap > 0").select(*key, (F.col("offset") - F.col("gap")).alias("offset"), F.col("gap").alias("length"), F.lit(fill).alias(target))
    return entries.select(*key, "offset", "length", target).unionByName(gaps)


def _levels(entries: DataFrame, width: int) -> DataFrame:
    """entries with _level and _bucket: an entry lies in buckets of width times a power of 16, the least that its
    length doesn't exceed, so that it touches two of them at most, however long it is. Empty entries touch none."""
    ratio = F.greatest(F.col("length").cast("double") / width, F.lit(1.0))
    level = F.ceil(F.log2(ratio) / 4).cast("int")
    sized = entries.filter("length > 0").withColumn("_level", level).withColumn("_width", _width(F.col("_level"), width))
    first, last = F.floor(F.col("offset") / F.col("_width")), F.floor((F.col("offset") + F.col("length") - 1) / F.col("_width"))
    return sized.withColumn("_bucket", F.explode(F.sequence(first, last))).drop("_width")


def _width(level: Column, width: int) -> Column:
    return F.lit(width) * F.call_function("shiftleft", F.lit(1).cast("long"), level * 4)


def _known_levels(entries: DataFrame, width: int) -> list[int]:
    """The levels that entries have: few, as a level is a power of 16."""
    return sorted(r[0] for r in _levels(entries, width).select("_level").distinct().collect())


def point_lookup(points: DataFrame, entries: DataFrame, key: list[str], at: str, width: int) -> DataFrame:
    """points with the columns of the entry that holds them, null where none does."""
    levels = _known_levels(entries, width)
    e = _levels(entries, width)
    id_ = "_evspark_point"
    p = points.withColumn(id_, F.monotonically_increasing_id()) if len(levels) > 1 else points
    at_levels = F.array(*[F.struct(F.lit(n).alias("_level"), F.floor(F.col(at) / F.lit(width << (4 * n))).alias("_bucket")) for n in levels or [0]])
    p = p.withColumn("_x", F.explode(at_levels)).select("*", "_x._level", "_x._bucket").drop("_x")
    held = (p[at] >= e["offset"]) & (p[at] < e["offset"] + e["length"])
    for k in [*key, "_level", "_bucket"]:
        held = held & (p[k] == e[k])
    more = [e[c] for c in entries.columns if c not in key]
    if len(levels) < 2:
        return p.join(e, held, "left").select(*[p[c] for c in points.columns], *more)
    # A point is looked up at each level. Of levels without an entry for it one stays, if no other has any.
    out = p.join(e, held, "left").select(*[p[c] for c in points.columns], p[id_], p["_level"].alias("_at"), e["_level"].isNotNull().alias("_has"), *more)
    out = out.withColumn("_any", F.max("_has").over(Window.partitionBy(id_)))
    return out.filter(F.col("_has") | (~F.col("_any") & (F.col("_at") == levels[0]))).drop(id_, "_at", "_has", "_any")


def range_clip(ranges: DataFrame, entries: DataFrame, key: list[str], width: int) -> DataFrame:
    """For each entry that a range (start, stop) overlaps, the part inside: clip_start, clip_length and
    the place in the target, into. A pair that shares several buckets is made in the first."""
    e = _levels(entries, width)
    span = lambda n: F.transform(F.sequence(F.floor(F.col("start") / F.lit(width << (4 * n))), F.floor((F.col("stop") - 1) / F.lit(width << (4 * n)))), lambda b: F.struct(F.lit(n).alias("_level"), b.alias("_bucket")))
    at_levels = F.flatten(F.array(*[span(n) for n in _known_levels(entries, width) or [0]]))
    r = ranges.filter("stop > start").withColumn("_x", F.explode(at_levels)).select("*", "_x._level", "_x._bucket").drop("_x")
    j = r.join(e, [*key, "_level", "_bucket"]).filter("offset < stop and offset + length > start")
    j = j.withColumn("clip_start", F.greatest("start", "offset"))
    j = j.filter(F.floor(F.col("clip_start") / _width(F.col("_level"), width)) == F.col("_bucket"))
    stop = F.least(F.col("stop"), F.col("offset") + F.col("length"))
    return j.withColumn("clip_length", stop - F.col("clip_start")).withColumn("into", F.col("clip_start") - F.col("offset")).drop("_bucket", "_level")


def runs(entries: DataFrame, key: list[str], order: list[str], target: str) -> DataFrame:
    """By map, the runs of equal targets in order, the distinct targets, and the layout they make."""
    w = _w(key, order)
    started = entries.withColumn("_new", (~F.col(target).eqNullSafe(F.lag(target).over(w)) | (F.row_number().over(w) == 1)).cast("long"))
    out = started.groupBy(*key).agg(F.sum("_new").alias("runs"), F.count_distinct(target).alias("targets"))
    layout = F.when(F.col("targets") < 2, "single").when(F.col("runs") == F.col("targets"), "sequential").otherwise("striped")
    return out.withColumn("layout", layout)


def running_offset(rows: DataFrame, key: list[str], order: list[str], length: str, into: str = "at") -> DataFrame:
    """rows with the sum of the lengths before them."""
    out = before(dealt(rows, key, order), key, order, F.col(length), F.sum)
    return out.withColumn(into, F.coalesce("_before", F.lit(0))).drop("_before", _RANGE)


def islands(extents: DataFrame, key: list[str], tie: list[str]) -> DataFrame:
    """Extents that touch or overlap, merged: start, length and how many."""
    order = ["offset", *tie]
    new = F.when(F.col("_first") | (F.col("gap") > 0), 1).otherwise(0)
    marked = before(_with_gaps(extents, key, tie).withColumn("_new", new), key, order, F.col("_new"), F.sum)
    marked = marked.withColumn("_island", F.coalesce("_before", F.lit(0)) + F.col("_new"))
    out = marked.groupBy(*key, "_island").agg(F.min("offset").alias("island_start"), F.max(F.col("offset") + F.col("length")).alias("_end"), F.count("*").alias("extents"))
    return out.withColumn("island_length", F.col("_end") - F.col("island_start")).drop("_island", "_end")


def numbering_gaps(rows: DataFrame, key: list[str], number: str) -> DataFrame:
    """Numbers after which one or more are missing, and the next one there is."""
    w = _w(key, [number])
    return rows.select(*key, number).distinct().withColumn("next_number", F.lead(number).over(w)).filter(F.col("next_number") != F.col(number) + 1)


def is_sequential(entries: DataFrame, key: list[str], order: list[str], target: str) -> DataFrame:
    """By map: whether each target is one run whose target offsets follow on from 0."""
    w = _w([*key, target], order)
    want = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    right = entries.withColumn("_ok", F.col("target_offset") == want).groupBy(*key).agg(F.bool_and("_ok").alias("_ok"))
    return runs(entries, key, order, target).join(right, key).select(*key, (F.col("_ok") & (F.col("runs") == F.col("targets"))).alias("sequential"))
