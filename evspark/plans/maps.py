"""Queries over interval maps and chunked streams, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.operators import chunks as C
from evspark.operators import intervals as I
from evspark.operators import objects as O
from evspark.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry for each event in its user's map: entries that leave gaps, touch or overlap."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", (F.col("event_id") * 10).alias("offset"), (F.col("event_id") % 5 * 300 + 1).alias("length"), F.col("event_type").alias("target"), (F.col("event_id") * 3).alias("target_offset"))


ENTRIES = "e AS (SELECT user_id, event_id, event_id * 10 AS \"offset\", event_id % 5 * 300 + 1 AS length, event_type AS target, event_id * 3 AS target_offset FROM events)"
GAPS = ENTRIES + """, g AS (SELECT *, coalesce("offset" - max("offset" + length) OVER (PARTITION BY user_id ORDER BY "offset", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), "offset") AS lead FROM e)"""


@query(f"""WITH {GAPS} SELECT user_id, count(*) AS entries, count(*) FILTER (lead > 0) AS gaps, CAST(sum(greatest(lead, 0)) AS BIGINT) AS gap_bytes, count(*) FILTER (lead < 0) AS overlaps,
    CAST(sum(length) AS BIGINT) AS entry_bytes, max("offset" + length) AS map_end FROM g GROUP BY 1""")
def interval_coverage(spark, sf_dir):
    return I.coverage(entries(spark, sf_dir), ["user_id"], ["event_id"])


@query(f"""WITH {GAPS} SELECT user_id, "offset", length, target FROM e UNION ALL SELECT user_id, "offset" - lead, lead, 'Zero' FROM g WHERE lead > 0""")
def gap_fill(spark, sf_dir):
    return I.gap_fill(entries(spark, sf_dir), ["user_id"], ["event_id"], "target", "Zero")


@query(f"""WITH {GAPS} SELECT user_id, event_id, -lead AS overlap FROM g WHERE lead < 0""")
def overlap_findings(spark, sf_dir):
    return I.with_gaps(entries(spark, sf_dir), ["user_id"], ["event_id"]).filter("overlap > 0").select("user_id", "event_id", "overlap")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 7 % 100003).alias("point"), F.lit(0).alias("map"))


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.lit(0).alias("map"), (F.col("event_id") * 10).alias("offset"), F.lit(7).alias("length"), "event_id")


@query("""SELECT o_orderkey, point, CASE WHEN point < "offset" + 7 THEN event_id END AS event_id FROM (SELECT o_orderkey, o_orderkey * 7 % 100003 AS point FROM orders) p
    ASOF LEFT JOIN (SELECT event_id * 10 AS "offset", event_id FROM events) e ON p.point >= e."offset" """)
def asof_lookup(spark, sf_dir):
    return I.point_lookup(_points(spark, sf_dir), _flat(spark, sf_dir), ["map"], "point", 4096).select("o_orderkey", "point", "event_id")


@query("""WITH r AS (SELECT s_suppkey, s_suppkey * 911 % 90000 AS start, s_suppkey * 911 % 90000 + 500 AS stop FROM supplier), e AS (SELECT event_id * 10 AS "offset", 7 AS length, event_id FROM events)
    SELECT s_suppkey, event_id, greatest(start, "offset") AS clip_start, least(stop, "offset" + length) - greatest(start, "offset") AS clip_length, greatest(start, "offset") - "offset" AS into_entry
    FROM r JOIN e ON "offset" < stop AND "offset" + length > start""")
def range_clip(spark, sf_dir):
    start = F.col("s_suppkey") * 911 % 90000
    ranges = table(spark, sf_dir, "supplier").select("s_suppkey", start.alias("start"), (start + 500).alias("stop"), F.lit(0).alias("map"))
    return I.range_clip(ranges, _flat(spark, sf_dir), ["map"], 4096).select("s_suppkey", "event_id", "clip_start", "clip_length", F.col("into").alias("into_entry"))


@query("SELECT l_suppkey AS target_id, count(*) AS entries, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes FROM lineitem GROUP BY 1")
def bytes_by_target(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("target_id")).agg(F.count("*").alias("entries"), F.sum(F.col("l_quantity").cast("long")).alias("bytes"))


@query("""WITH r AS (SELECT l_orderkey, l_suppkey % 3 AS t, lag(l_suppkey % 3) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem)
    SELECT l_orderkey, CAST(count(*) FILTER (p IS NULL OR p <> t) AS BIGINT) AS runs, count(DISTINCT t) AS targets,
    CASE WHEN count(DISTINCT t) < 2 THEN 'single' WHEN count(*) FILTER (p IS NULL OR p <> t) = count(DISTINCT t) THEN 'sequential' ELSE 'striped' END AS layout FROM r GROUP BY 1""")
def part_layout(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_suppkey") % 3).alias("t"))
    return I.runs(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "t")


@query("""WITH s AS (SELECT user_id, event_id, event_id % 2 AS t, 4 AS length, CASE WHEN user_id % 3 = 0 THEN 4 * (row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) - 1) ELSE event_id END AS target_offset FROM events),
    w AS (SELECT *, 4 * (row_number() OVER (PARTITION BY user_id, t ORDER BY event_id) - 1) AS want, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM s)
    SELECT user_id, bool_and(want = target_offset) AND count(*) FILTER (p IS NULL OR p <> t) = count(DISTINCT t) AS sequential FROM w GROUP BY 1""")
def is_sequential(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 2).alias("t"), F.lit(4).alias("length"))
    n = F.row_number().over(Window.partitionBy("user_id", "t").orderBy("event_id"))
    e = e.withColumn("target_offset", F.when(F.col("user_id") % 3 == 0, 4 * (n - 1)).otherwise(F.col("event_id")))
    return I.is_sequential(e, ["user_id"], ["event_id"], "t")


@query(f"""WITH {ENTRIES}, m AS (SELECT *, max("offset" + length) OVER (PARTITION BY user_id ORDER BY "offset", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM e),
    i AS (SELECT *, sum(CASE WHEN pe IS NULL OR "offset" > pe THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY "offset", event_id ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT user_id, min("offset") AS island_start, max("offset" + length) - min("offset") AS island_length, count(*) AS extents FROM i GROUP BY user_id, island""")
def extent_islands(spark, sf_dir):
    return I.islands(entries(spark, sf_dir), ["user_id"], ["event_id"])


@query(f"""WITH {GAPS} SELECT user_id, CAST(sum(length) FILTER (target IN ('click', 'view')) AS BIGINT) AS stored, CAST(sum(length) FILTER (target NOT IN ('click', 'view')) AS BIGINT) AS described, CAST(sum(greatest(lead, 0)) AS BIGINT) AS gap_filled FROM g GROUP BY 1""")
def read_accounting(spark, sf_dir):
    stored = F.col("target").isin("click", "view")
    rows = I.with_gaps(entries(spark, sf_dir), ["user_id"], ["event_id"])
    return rows.groupBy("user_id").agg(F.sum(F.when(stored, F.col("length"))).alias("stored"), F.sum(F.when(~stored, F.col("length"))).alias("described"), F.sum("gap").alias("gap_filled"))


@query("SELECT l_suppkey, l_partkey, n AS next_number FROM (SELECT *, lead(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) WHERE n <> l_partkey + 1")
def numbering_gap(spark, sf_dir):
    return I.numbering_gaps(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_partkey")


@query("SELECT source, doc_id, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at, n_chars FROM documents")
def shared_pack_offsets(spark, sf_dir):
    return I.running_offset(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "n_chars")


# -- chunks of 64 bytes, 8 to a segment

#: A blob's slice is taken from its hex digits, which DuckDB cuts by place.
CHUNKS = "h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), n AS (SELECT doc_id, h, unnest(range(0, CAST(ceil(length(h) / 128.0) AS BIGINT))) AS chunk_no FROM h), c AS (SELECT doc_id, chunk_no, h[chunk_no * 128 + 1 : chunk_no * 128 + 128] AS x FROM n), p AS (SELECT doc_id, chunk_no, unhex(x) AS data, length(x) // 2 AS length, sha256(unhex(rpad(x, 128, '0'))) AS content FROM c)"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cut(table(spark, sf_dir, "documents"), ["doc_id"], "text", 64, 8)


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_no // 8 AS segment, count(*) AS chunks, CAST(sum(length) AS BIGINT) AS length, CAST(max(chunk_no % 8) AS BIGINT) AS last_place FROM p GROUP BY 1, 2")
def chunk_index(spark, sf_dir):
    return _chunks(spark, sf_dir).groupBy("doc_id", F.col("segment").cast("long").alias("segment")).agg(F.count("*").alias("chunks"), F.sum("length").alias("length"), F.max("place").cast("long").alias("last_place"))


@query(f"WITH {CHUNKS}, f AS (SELECT content, min(doc_id * 100000 + chunk_no) AS first_at, count(*) AS uses, CAST(sum(length) AS BIGINT) AS presented FROM p GROUP BY 1) SELECT * FROM f")
def chunk_dedupe(spark, sf_dir):
    d = C.dedupe(_chunks(spark, sf_dir), ["doc_id", "chunk_no"], 64)
    return d.select("content", (F.col("first_at.doc_id") * 100000 + F.col("first_at.chunk_no")).alias("first_at"), "uses", "presented")


@query(f"WITH {CHUNKS}, f AS (SELECT content, count(*) AS uses, sum(length) AS presented FROM p GROUP BY 1) SELECT count(*) AS unique_chunks, CAST(sum(uses) AS BIGINT) AS chunks, count(*) * 64 AS stored, CAST(sum(presented) AS BIGINT) AS presented, CAST(sum(presented) - count(*) * 64 AS BIGINT) AS saved FROM f")
def dedupe_summary(spark, sf_dir):
    d = C.dedupe(_chunks(spark, sf_dir), ["doc_id", "chunk_no"], 64)
    return d.agg(F.count("*").alias("unique_chunks"), F.sum("uses").alias("chunks"), (F.count("*") * 64).alias("stored"), F.sum("presented").alias("presented"), (F.sum("presented") - F.count("*") * 64).alias("saved"))


@query(f"WITH {CHUNKS}, u AS (SELECT *, min(chunk_no) OVER (PARTITION BY doc_id, content) AS first_use FROM p) SELECT doc_id, chunk_no, chunk_no * 64 AS \"offset\", length, dense_rank() OVER (PARTITION BY doc_id ORDER BY first_use) - 1 AS local_id FROM u")
def slice_map(spark, sf_dir):
    return C.slice_map(_chunks(spark, sf_dir), ["doc_id"], 64).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "offset", F.col("length").cast("long").alias("length"), F.col("local_id").cast("long").alias("local_id"))


@query(f"WITH {CHUNKS} SELECT doc_id, count(*) AS blocks, sha256(unhex(string_agg(sha256(data), '' ORDER BY chunk_no))) AS block_hashes_hash FROM p GROUP BY 1")
def block_digests(spark, sf_dir):
    return C.block_digests(_chunks(spark, sf_dir), ["doc_id"])


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, octet_length(encode(text)) AS bytes FROM documents")
def multi_digest(spark, sf_dir):
    """Each row's text is a stream of its own, whatever its id: one without bytes too, while a null has no digest."""
    rows = table(spark, sf_dir, "documents").select(F.concat_ws(":", F.monotonically_increasing_id(), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(F.col("text").isNull(), "null")).alias("stream"), "text")
    out = C.stream_digests(C.cut(rows, ["stream"], "text", 64, 8, every=True), "stream", "data", "chunk_no", ["md5", "sha1", "sha256"])
    part = F.split("stream", ":")
    there = F.get(part, F.lit(2)).isNull()
    return out.select(F.get(part, F.lit(1)).try_cast("long").alias("doc_id"), *[F.when(there, F.col(c)).alias(c) for c in ("md5", "sha1", "sha256", "bytes")])


@query("SELECT conv_id, sha256(string_agg(role || text, '' ORDER BY turn)) AS sha256, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def ordered_concat_digest(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.groupBy("conv_id").agg(F.sha2(C.in_order(F.concat("role", "text"), "turn").cast("binary"), 256).alias("sha256"), F.sum(F.length("text")).alias("chars"))


@query("""WITH d AS (SELECT source, doc_id, sha256(text) AS h FROM documents), r AS (SELECT source, sha256(string_agg(h, '' ORDER BY doc_id)) AS stripe, min(doc_id) AS first_doc FROM d GROUP BY 1)
    SELECT sha256(string_agg(stripe, '' ORDER BY source)) AS by_name, sha256(string_agg(stripe, '' ORDER BY first_doc)) AS by_first FROM r""")
def tree_root(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    r = d.groupBy("source").agg(F.sha2(C.in_order(F.col("h"), "doc_id").cast("binary"), 256).alias("stripe"), F.min("doc_id").alias("first_doc"))
    root = lambda key: F.sha2(C.in_order(F.col("stripe"), key).cast("binary"), 256)
    return r.agg(root("source").alias("by_name"), root("first_doc").alias("by_first"))


@query(f"""WITH {CHUNKS}, a AS (SELECT doc_id // 2 AS pair, chunk_no, data FROM p WHERE doc_id % 2 = 0), b AS (SELECT doc_id // 2 AS pair, chunk_no, data FROM p WHERE doc_id % 2 = 1)
    SELECT pair, min(CASE WHEN a.data IS DISTINCT FROM b.data THEN chunk_no END) AS first_difference FROM a FULL JOIN b USING (pair, chunk_no) GROUP BY 1""")
def first_difference(spark, sf_dir):
    c = _chunks(spark, sf_dir).withColumn("pair", F.floor(F.col("doc_id") / 2)).withColumn("chunk_no", F.col("chunk_no").cast("long"))
    return C.first_difference(c.filter("doc_id % 2 = 0"), c.filter("doc_id % 2 = 1"), ["pair"])


@query("""WITH RECURSIVE d AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
    w AS (SELECT source, n, n_chars, CAST(0 AS BIGINT) AS part, CAST(n_chars AS BIGINT) AS used FROM d WHERE n = 1
      UNION ALL SELECT d.source, d.n, d.n_chars, w.part + CASE WHEN w.used >= 20000 THEN 1 ELSE 0 END, d.n_chars + CASE WHEN w.used >= 20000 THEN 0 ELSE w.used END FROM w JOIN d ON d.source = w.source AND d.n = w.n + 1)
    SELECT source, part, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM w GROUP BY 1, 2""")
def split_by_size(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return C.split_by_size(rows, "source", "doc_id", "n_chars", 20000).groupBy("source", "part").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query("""SELECT doc_id, CASE WHEN n_chars = 0 THEN 'no_content' WHEN n_chars <= 1024 THEN 'in_metadata' WHEN n_chars <= 4096 THEN 'zip_segment' WHEN n_chars <= 16384 THEN 'shared_map' ELSE 'own_stream' END AS storage,
    n_chars + CASE WHEN n_chars <= 1048576 THEN 4096 ELSE 0 END AS cost, CAST(ceil(n_chars / 512.0) AS BIGINT) AS segments FROM documents""")
def storage_choice(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", O.storage_choice(n, (1024, 4096, 16384)).alias("storage"), (n + F.when(n <= 1048576, 4096).otherwise(0)).alias("cost"), C.segments(n, 64, 8).alias("segments"))


@query("SELECT lang, count(*) AS streams, CAST(sum(n_chars) AS BIGINT) AS bytes, CAST(sum(ceil(n_chars / 512.0)) AS BIGINT) AS segments, count(DISTINCT source) AS codecs, max(n_chars) AS largest FROM documents GROUP BY 1")
def work_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("streams"), F.sum("n_chars").alias("bytes"), F.sum(C.segments(F.col("n_chars"), 64, 8)).alias("segments"), F.count_distinct("source").alias("codecs"), F.max("n_chars").alias("largest"))
