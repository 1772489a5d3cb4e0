"""Queries over objects made of the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evspark.operators import objects as O
from evspark.plans.metadata import STATEMENTS, statements
from evspark.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


_ROLES = ("DiskImage", "ImageStream", "FileImage", "Folder", "Map", "BlockHashes", "other:x")
_OBJECTS = "o AS (SELECT doc_id AS subject, (['" + "', '".join(_ROLES) + "'])[doc_id % 7 + 1] AS role, doc_id AS first_seq, n_chars AS size FROM documents)"


def _objects(spark, sf_dir):
    role = F.element_at(F.array(*[F.lit(r) for r in _ROLES]), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("subject"), role.alias("role"), F.col("doc_id").alias("first_seq"), F.col("n_chars").alias("size"))


@query(f"WITH {STATEMENTS} SELECT seq, predicate, obj_lexical FROM s WHERE subject = 'urn:customer:7'")
def statements_of_subject(spark, sf_dir):
    return O.statements_for(statements(spark, sf_dir), "urn:customer:7").select("seq", "predicate", "obj_lexical")


@query(f"WITH {STATEMENTS} SELECT seq, obj_kind, obj_lexical FROM s WHERE subject = 'urn:part:11' AND predicate = 'type'")
def objects_of_statement(spark, sf_dir):
    return O.objects_of(statements(spark, sf_dir), "urn:part:11", "type")


@query(f"WITH {_OBJECTS} SELECT 'all' AS mode, role, count(*) AS n FROM o GROUP BY 2 UNION ALL SELECT 'images', role, count(*) FROM o WHERE role IN ('DiskImage', 'FileImage', 'ImageStream', 'Map') GROUP BY 2")
def listing_modes(spark, sf_dir):
    o = _objects(spark, sf_dir)
    parts = [O.listed(o, m).groupBy(F.lit(m).alias("mode"), "role").agg(F.count("*").alias("n")) for m in ("all", "images", "none")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {_OBJECTS} SELECT count(*) AS objects, count(*) FILTER (role IN ('DiskImage', 'FileImage')) AS images, count(*) FILTER (role = 'FileImage') AS files, count(*) FILTER (role = 'Folder') AS folders,
    count(*) FILTER (role = 'ImageStream') AS streams, count(*) FILTER (role = 'Map') AS maps, count(*) FILTER (role = 'BlockHashes') AS block_hashes, count(*) FILTER (role LIKE 'other:%') AS others FROM o""")
def role_counts(spark, sf_dir):
    return O.role_counts(_objects(spark, sf_dir))


@query("SELECT count(*) FILTER (o_totalprice * 8192 >= 1073741824) AS substantial, count(*) AS streams FROM orders")
def substantial_streams(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count_if(O.is_substantial(F.col("o_totalprice") * 8192)).alias("substantial"), F.count("*").alias("streams"))


@query("""WITH f AS (SELECT CASE WHEN n_chars % 3 = 0 THEN 'zip_segment' END AS a, CASE WHEN n_chars % 5 = 0 THEN 'map' END AS b, CASE WHEN n_chars % 7 = 0 THEN 'image_stream' END AS c, CASE WHEN n_chars % 11 = 0 THEN 'resident' END AS d, n_chars % 2 = 0 AS r, n_chars % 13 = 0 AS e FROM documents),
    n AS (SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT AS k FROM f)
    SELECT CASE WHEN k = 1 THEN coalesce(a, b, c, d) WHEN k > 1 THEN 'ambiguous' WHEN r THEN 'reference' WHEN e THEN 'no_content' ELSE 'missing' END AS form, count(*) AS files FROM n GROUP BY 1""")
def storage_forms(spark, sf_dir):
    n = F.col("n_chars")
    types = F.array_compact(F.array(F.lit("FileImage"), F.when(n % 3 == 0, F.when(n % 2 == 0, "ZipSegment").otherwise("zip_segment")), F.when(n % 5 == 0, "Map"), F.when(n % 7 == 0, "ImageStream")))
    form = O.storage_form(types, n % 11 == 0, n % 2 == 0, n % 13 == 0)
    return table(spark, sf_dir, "documents").groupBy(form.alias("form")).agg(F.count("*").alias("files"))


_KNOWN = ["https://example.org/", "http://aff4.org/Schema#"]


@query("WITH n AS (SELECT left(url, length(url) - length(regexp_extract(url, '[^#/]*$'))) AS namespace, url, page_id FROM pages) SELECT namespace, count(*) AS statements, count(DISTINCT page_id) AS subjects, count(DISTINCT url) AS terms FROM n WHERE namespace NOT IN ('" + "', '".join(_KNOWN) + "') GROUP BY 1")
def vendor_terms(spark, sf_dir):
    return O.vendor_terms(table(spark, sf_dir, "pages").select(F.col("url").alias("predicate"), F.col("page_id").alias("subject")), _KNOWN)


@query("""WITH o AS (SELECT 'n/' || o_custkey AS s FROM orders UNION SELECT 'n/' || c_custkey || '/block' || (c_custkey % 3) FROM customer) SELECT a.s AS child, b.s AS parent FROM o a JOIN o b ON regexp_extract(a.s, '^(.*)/[^/]*$', 1) = b.s""")
def block_children(spark, sf_dir):
    named = table(spark, sf_dir, "orders").select(F.concat(F.lit("n/"), F.col("o_custkey").cast("string")).alias("subject"))
    blocks = table(spark, sf_dir, "customer").select(F.concat(F.lit("n/"), F.col("c_custkey").cast("string"), F.lit("/block"), (F.col("c_custkey") % 3).cast("string")))
    return O.children(named.union(blocks).distinct())


@query("""WITH o AS (SELECT c_custkey AS subject, c_mktsegment AS role, -c_custkey AS first_seq, CASE WHEN c_nationkey = 1 THEN c_custkey % 10 END AS r, CASE WHEN s_suppkey IS NOT NULL THEN 1000000 - s_suppkey END AS m FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey),
    t AS (SELECT *, CASE WHEN r IS NOT NULL THEN 0 WHEN m IS NOT NULL THEN 1 ELSE 2 END AS tier FROM o)
    SELECT subject, tier, row_number() OVER (ORDER BY tier, CASE tier WHEN 0 THEN r WHEN 1 THEN m ELSE 0 END, CASE WHEN tier = 2 THEN role ELSE '' END, first_seq, subject) AS place FROM t""")
def object_order(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    objects = c.select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("role"), (-F.col("c_custkey")).alias("first_seq"))
    spine = c.filter("c_nationkey = 1").select(F.col("c_custkey").alias("subject"), (F.col("c_custkey") % 10).alias("rank"))
    manifest = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("subject"), (F.lit(1000000) - F.col("s_suppkey")).alias("ord"))
    return O.ordered(objects, spine, manifest).select("subject", "tier", "place")


@query("""WITH n AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS place, count(*) OVER (PARTITION BY o_orderstatus) AS total FROM orders)
    SELECT o_orderstatus, o_orderkey, place, greatest(total - 10, 0) AS more FROM n WHERE place <= 10""")
def first_skips(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_orderdate")
    return O.first_of_each(rows, ["o_orderstatus"], ["o_orderdate", "o_orderkey"], 10).drop("o_orderdate")


@query("""WITH n AS (SELECT c_name AS subject, c_name || ' of ' || c_mktsegment || ' owes ' || c_custkey || ' times' AS note FROM customer)
    SELECT regexp_replace(replace(note, subject, '*'), '[0-9]+', '#', 'g') AS shape, count(*) AS notes, count(DISTINCT subject) AS subjects, min(subject) AS first_subject FROM n GROUP BY 1""")
def grouped_notes(spark, sf_dir):
    note = F.concat("c_name", F.lit(" of "), "c_mktsegment", F.lit(" owes "), F.col("c_custkey").cast("string"), F.lit(" times"))
    return O.grouped_notes(table(spark, sf_dir, "customer").select(F.col("c_name").alias("subject"), note.alias("note")), "note", "subject")


@query("SELECT lang, source, count(*) AS streams, CAST(sum(n_chars) AS BIGINT) AS bytes, max(n_chars) AS largest FROM documents GROUP BY 1, 2")
def stream_shapes(spark, sf_dir):
    return O.stream_shapes(table(spark, sf_dir, "documents"), ["lang", "source"], "n_chars")


@query("""WITH p AS (SELECT p_partkey, p_partkey * 1000 AS done, p_partkey * 1000 + p_size * 99999 AS total, p_partkey % 60 AS secs FROM part), r AS (SELECT *, CASE WHEN secs > 0 AND done > 0 THEN done // secs END AS rate FROM p)
    SELECT p_partkey, rate, CASE WHEN rate > 0 THEN least((total - done) // rate, 359999) END AS seconds_left FROM r""")
def progress_rates(spark, sf_dir):
    done = F.col("p_partkey") * 1000
    rate, left = O.progress(done, done + F.col("p_size") * 99999, F.col("p_partkey") % 60)
    return table(spark, sf_dir, "part").select("p_partkey", rate.alias("rate"), left.alias("seconds_left"))


@query("SELECT doc_id, array_to_string(CASE doc_id % 3 WHEN 0 THEN [md5(text), left(md5(text), 8), sha1(text), sha256(text)] WHEN 1 THEN [left(md5(text), 8), md5(text), sha1(text), sha256(text)] ELSE [md5(text), md5(text || 'x'), sha1(text)] END, ',') AS digests FROM documents".replace("[md5(text), left(md5(text), 8), sha1(text), sha256(text)] WHEN 1", "[left(md5(text), 8), md5(text), sha1(text), sha256(text)] WHEN 1"))
def digest_order(spark, sf_dir):
    t = F.col("text")
    m, s1, s2, short = F.md5(t), F.sha1(t), F.sha2(t, 256), F.left(F.md5(t), F.lit(8))
    k = F.col("doc_id") % 3
    given = F.when(k == 0, F.array(m, s2, short, s1)).when(k == 1, F.array(s2, s1, m, short)).otherwise(F.array(m, F.md5(F.concat(t, F.lit("x"))), s1))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(O.by_digest_length(given), ",").alias("digests"))


@query("SELECT page_id, url || '[0x' || printf('%x', page_id * 4096) || ':0x' || printf('%x', page_id + 7) || ']' AS slice FROM pages")
def slice_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", O.slice_name(F.col("url"), F.col("page_id") * 4096, F.col("page_id") + 7).alias("slice"))


@query("""WITH p AS (SELECT p_partkey, p_partkey * 99999999999 AS total, (p_size + 1) * 33554432 AS part FROM part), n AS (SELECT *, (total + part - 1) // part AS parts, greatest((total + 4398046511103) // 4398046511104, 1) AS needed FROM p)
    SELECT p_partkey, parts, CASE WHEN parts > 4096 THEN (SELECT min(1 << k) FROM range(0, 40) r(k) WHERE (1::BIGINT << k) >= needed) END AS gib FROM n""".replace("min(1 << k)", "min(1::BIGINT << k)"))
def part_plans(spark, sf_dir):
    parts, gib = O.part_plan(F.col("p_partkey") * F.lit(99999999999), (F.col("p_size") + 1) * F.lit(33554432))
    return table(spark, sf_dir, "part").select("p_partkey", parts.alias("parts"), gib.alias("gib"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE CAST(epoch(date_trunc('second', ts)) AS BIGINT) - CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 330 * 60 ELSE -480 * 60 END END AS seconds FROM events""")
def offset_stamps(spark, sf_dir):
    k, stamp = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.concat(stamp, F.when(k == 0, ".125Z").when(k == 1, "+05:30").when(k == 2, "-08:00").otherwise(" nowhere"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text")).select("event_id", O.offset_stamp(F.col("text")).alias("seconds"))


@query("""WITH o AS (SELECT c_custkey // 3 AS container, CASE c_custkey * 7 % 11 WHEN 0 THEN 'DiskImage' WHEN 1 THEN 'FileImage' WHEN 2 THEN 'Folder' ELSE 'Map' END AS role, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS content FROM customer)
    SELECT container, CASE WHEN bool_or(role = 'DiskImage') THEN 'disk image' WHEN bool_or(role = 'FileImage') AND bool_or(role = 'Folder') THEN 'files and folders' WHEN bool_or(role = 'FileImage') THEN 'files' WHEN bool_or(role = 'Folder') THEN 'folders'
      WHEN count(content) > 0 THEN array_to_string(list_sort(list(DISTINCT content) FILTER (content IS NOT NULL)), ', ') ELSE 'not stated' END AS content_type FROM o GROUP BY 1""")
def content_types(spark, sf_dir):
    k = F.col("c_custkey")
    role = F.when(k * 7 % 11 == 0, "DiskImage").when(k * 7 % 11 == 1, "FileImage").when(k * 7 % 11 == 2, "Folder").otherwise("Map")
    objects = table(spark, sf_dir, "customer").select(F.floor(k / 3).alias("container"), role.alias("role"), F.when(k % 4 == 0, F.col("c_mktsegment")).alias("content"))
    return O.content_types(objects, ["container"], F.col("content"))
