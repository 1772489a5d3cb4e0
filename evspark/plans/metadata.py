"""Queries over triples made of the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.operators import objects as O
from evspark.operators import triples as T
from evspark.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


def _c(text: str, *cols: str):
    return F.concat(F.lit(text), *[F.col(c).cast("string") for c in cols])


def _sources(spark: SparkSession, sf_dir: str) -> list:
    """What part, supplier and customer state: rows, subject, order and values."""
    part, supplier, customer = (table(spark, sf_dir, t) for t in ("part", "supplier", "customer"))
    return [
        (part, _c("urn:part:", "p_partkey"), F.col("p_partkey"), [("type", "iri", F.lit("Part"), ""), ("type", "iri", F.col("p_type"), ""), ("name", "literal", F.col("p_name"), "string"), ("brand", "literal", F.col("p_brand"), "string"), ("size", "literal", F.col("p_size"), "int")]),
        (supplier, _c("urn:supplier:", "s_suppkey"), F.col("s_suppkey") + 10**12, [("type", "iri", F.lit("Supplier"), ""), ("name", "literal", F.col("s_name"), "string"), ("nation", "iri", _c("urn:nation:", "s_nationkey"), "")]),
        (customer, _c("urn:customer:", "c_custkey"), F.col("c_custkey") + 2 * 10**12, [("type", "iri", F.lit("Customer"), ""), ("name", "literal", F.col("c_name"), "string"), ("nation", "iri", _c("urn:nation:", "c_nationkey"), ""), ("segment", "literal", F.col("c_mktsegment"), "string"), ("size", "literal", F.col("c_nationkey"), "long")]),
    ]


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triples of part, supplier and customer."""
    part, supplier, customer = (T.unpivot(*source) for source in _sources(spark, sf_dir))
    return part.unionByName(supplier).unionByName(customer)


def _branch(t: str, subject: str, order: str, values: list[tuple[str, str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {subject} AS subject, '{p}' AS predicate, '{k}' AS obj_kind, CAST({v} AS VARCHAR) AS obj_lexical, '{d}' AS obj_datatype, ({order}) * 16 + {i} AS seq FROM {t} WHERE {v} IS NOT NULL" for i, (p, k, v, d) in enumerate(values))


STATEMENTS = "s AS (" + " UNION ALL ".join([
    _branch("part", "'urn:part:' || p_partkey", "p_partkey", [("type", "iri", "'Part'", ""), ("type", "iri", "p_type", ""), ("name", "literal", "p_name", "string"), ("brand", "literal", "p_brand", "string"), ("size", "literal", "p_size", "int")]),
    _branch("supplier", "'urn:supplier:' || s_suppkey", "s_suppkey + 1000000000000", [("type", "iri", "'Supplier'", ""), ("name", "literal", "s_name", "string"), ("nation", "iri", "'urn:nation:' || s_nationkey", "")]),
    _branch("customer", "'urn:customer:' || c_custkey", "c_custkey + 2000000000000", [("type", "iri", "'Customer'", ""), ("name", "literal", "c_name", "string"), ("nation", "iri", "'urn:nation:' || c_nationkey", ""), ("segment", "literal", "c_mktsegment", "string"), ("size", "literal", "c_nationkey", "long")]),
]) + ")"


@query(f"WITH {STATEMENTS} SELECT predicate, obj_kind, count(*) AS statements, count(DISTINCT subject) AS subjects, count(DISTINCT obj_lexical) AS objects FROM s GROUP BY 1, 2")
def triples_of_tables(spark, sf_dir):
    return T.count_by_predicate(T.unpivot_dealt(_sources(spark, sf_dir)))


@query(f"""WITH {STATEMENTS} SELECT subject, min(seq) AS first_seq, string_agg(obj_lexical, '|' ORDER BY seq) FILTER (predicate = 'type') AS types,
    max(CASE WHEN predicate = 'size' THEN CAST(obj_lexical AS BIGINT) END) AS size, count(*) FILTER (predicate NOT IN ('type', 'size')) AS n_properties,
    string_agg(predicate || '=' || obj_lexical, '|' ORDER BY seq) FILTER (predicate NOT IN ('type', 'size')) AS properties FROM s GROUP BY 1""")
def object_build(spark, sf_dir):
    o = T.build_objects(T.unpivot_dealt(_sources(spark, sf_dir)))
    return o.select("subject", "first_seq", F.array_join("types", "|").alias("types"), "size", F.size("properties").cast("long").alias("n_properties"), F.array_join("properties", "|").alias("properties"))


@query("SELECT l_orderkey AS subject, count(*) AS n, CASE WHEN count(*) = 1 THEN any_value(l_suppkey) END AS value FROM lineitem GROUP BY 1")
def exactly_one_value(spark, sf_dir):
    return T.exactly_one(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "subject"), ["subject"], "l_suppkey")


@query(f"WITH {STATEMENTS} SELECT predicate, count(*) AS n FROM s WHERE subject IN (SELECT subject FROM s WHERE predicate = 'type' AND obj_lexical = 'Supplier') GROUP BY 1")
def subjects_of_type(spark, sf_dir):
    return T.subjects_of_type(statements(spark, sf_dir), "Supplier").groupBy("predicate").agg(F.count("*").alias("n"))


@query("SELECT 'urn:order:' || o_orderkey AS subject, 'urn:customer:' || o_custkey AS target FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey < 20)")
def dangling_refs(spark, sf_dir):
    orders = T.unpivot(table(spark, sf_dir, "orders"), _c("urn:order:", "o_orderkey"), F.col("o_orderkey"), [("target", "iri", _c("urn:customer:", "o_custkey"), ""), ("status", "literal", F.col("o_orderstatus"), "string")])
    known = table(spark, sf_dir, "customer").filter("c_nationkey < 20").select(_c("urn:customer:", "c_custkey").alias("subject"))
    return T.dangling(orders, ["target", "dataStream"], known).select("subject", F.col("obj_lexical").alias("target"))


@query("SELECT source, count(*) AS listed, count(*) FILTER (l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def manifest_check(spark, sf_dir):
    local = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("there", F.lit(True))
    return table(spark, sf_dir, "documents").join(local, "doc_id", "left").groupBy("source").agg(F.count("*").alias("listed"), F.count_if(F.col("there").isNull()).alias("missing"))


@query("SELECT o_custkey AS volume, min(o_orderkey) AS first_seen FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) GROUP BY 1")
def missing_volumes(spark, sf_dir):
    held = table(spark, sf_dir, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(held, "o_custkey", "left_anti").groupBy(F.col("o_custkey").alias("volume")).agg(F.min("o_orderkey").alias("first_seen"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS strength FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) = 1""")
def merge_declarations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("strength"))
    return T.merge_declarations(rows, ["l_orderkey"], "strength", ["l_linenumber", "l_partkey", "l_suppkey"])


@query("""WITH r AS (SELECT l_orderkey, l_returnflag, row_number() OVER w AS n, first_value(l_returnflag) OVER w AS f FROM lineitem
      WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag))
    SELECT l_orderkey, any_value(f) AS first_value, arg_min(l_returnflag, n) AS other_value FROM r WHERE l_returnflag <> f GROUP BY 1""")
def stream_conflict(spark, sf_dir):
    return T.first_conflict(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"), ["l_orderkey"], "l_returnflag", ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"])


@query("SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) = (SELECT count(DISTINCT l_linenumber) FROM lineitem)")
def shared_set(spark, sf_dir):
    return T.held_by_all(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_partkey")


@query("SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'undeclared' WHEN c_custkey IS NULL THEN 'external' ELSE 'local' END AS locality, count(*) AS n FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) ON c_custkey = o_custkey GROUP BY 1")
def locality(spark, sf_dir):
    own = table(spark, sf_dir, "customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("own"))
    stored = F.when(F.col("o_orderkey") % 10 == 0, "undeclared").when(F.col("own").isNull(), "external").otherwise("local")
    return table(spark, sf_dir, "orders").join(own, "o_custkey", "left").groupBy(stored.alias("locality")).agg(F.count("*").alias("n"))


_PREFIXES = ["http://", "https://", "https://m.", "http://m.", "https://www.", "http://th", "https://th", "https://then"]


@query("SELECT page_id, (SELECT p FROM (VALUES " + ", ".join(f"('{p}')" for p in _PREFIXES) + ") v(p) WHERE starts_with(url, p) ORDER BY length(p) DESC LIMIT 1) AS best_prefix FROM pages")
def longest_prefix(spark, sf_dir):
    prefixes = spark.createDataFrame([(p,) for p in _PREFIXES], "prefix string")
    return T.longest_prefix(table(spark, sf_dir, "pages").select("page_id", "url"), "url", prefixes, "prefix", 64).select("page_id", "best_prefix")


#: The most specific role wins: patterns in order.
ROLES = [("ECONOMY", "economy_image"), ("PROMO", "promo_image"), ("STANDARD", "image"), ("SMALL", "stream"), ("LARGE", "map")]


@query("SELECT role, count(*) AS n, min(p_partkey) AS first_part FROM (SELECT p_partkey, CASE " + " ".join(f"WHEN contains(p_type, '{a}') THEN '{b}'" for a, b in ROLES) + " ELSE 'other:' || p_type END AS role FROM part) GROUP BY 1")
def role_priority(spark, sf_dir):
    role = F.lit(None)
    for a, b in ROLES:
        role = F.when(F.contains(F.col("p_type"), F.lit(a)), b) if a == ROLES[0][0] else role.when(F.contains(F.col("p_type"), F.lit(a)), b)
    return table(spark, sf_dir, "part").select("p_partkey", role.otherwise(F.concat(F.lit("other:"), "p_type")).alias("role")).groupBy("role").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


@query("""SELECT event_type AS kind, count(*) AS n, max(event_id) AS example, string_agg(DISTINCT CAST(user_id % 7 AS VARCHAR), ', ' ORDER BY CAST(user_id % 7 AS VARCHAR)) AS tails FROM events GROUP BY 1""")
def kind_histogram(spark, sf_dir):
    tails = F.array_join(F.array_sort(F.collect_set((F.col("user_id") % 7).cast("string"))), ", ")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.max("event_id").alias("example"), tails.alias("tails"))


@query("SELECT count(*) AS objects, count(*) FILTER (lang = 'en') AS images, count(*) FILTER (n_chars = 0) AS empty, count(*) FILTER (n_chars >= 10000) AS large, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents")
def object_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("objects"), F.count_if(F.col("lang") == "en").alias("images"), F.count_if(F.col("n_chars") == 0).alias("empty"), F.count_if(F.col("n_chars") >= 10000).alias("large"), F.sum("n_chars").alias("bytes"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '#(.*)$', 1), ''), nullif(regexp_extract(url, '\\?([^#]*)', 1), ''), url) AS recorded_path FROM pages")
def recorded_path(spark, sf_dir):
    pick = lambda p: F.nullif(F.regexp_extract("url", p, 1), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(pick("#(.*)$"), pick(r"\?([^#]*)"), "url").alias("recorded_path"))


@query("""WITH n AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS total FROM events)
    SELECT event_type, rn, event_id, total - 3 AS more FROM n WHERE rn <= 3""")
def brief_listing(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id")
    return O.first_of_each(e, ["event_type"], ["event_id"], 3).withColumnRenamed("place", "rn")


@query("""SELECT CASE WHEN predicate = 'nation' AND starts_with(subject, 'urn:supplier') THEN 'describes' WHEN predicate = 'nation' THEN 'target_stream' WHEN predicate = 'type' THEN 'type' ELSE 'other' END AS kind, count(*) AS n
    FROM (WITH """ + STATEMENTS + """ SELECT * FROM s WHERE obj_kind = 'iri') GROUP BY 1""")
def edge_kinds(spark, sf_dir):
    kind = F.when((F.col("predicate") == "nation") & F.startswith(F.col("subject"), F.lit("urn:supplier")), "describes").when(F.col("predicate") == "nation", "target_stream").when(F.col("predicate") == "type", "type").otherwise("other")
    return statements(spark, sf_dir).filter("obj_kind = 'iri'").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT conv_id, role, lag(conv_id) OVER (ORDER BY conv_id, turn) AS p FROM conversations), r AS (SELECT role AS subject, conv_id, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
    SELECT subject, count(*) FILTER (before IS NULL OR before <> subject) AS starts FROM r GROUP BY 1""")
def repeated_subject_blocks(spark, sf_dir):
    from pyspark.sql import Window

    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").withColumn("b", before).groupBy(F.col("role").alias("subject")).agg(F.count_if(F.col("b").isNull() | (F.col("b") != F.col("role"))).alias("starts"))


@query("SELECT lower(role) AS field, count(DISTINCT text) AS texts, count(DISTINCT length(text)) > 1 AS disagree, min(conv_id) AS first_conv FROM conversations GROUP BY 1")
def case_disagree(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(F.lower("role").alias("field")).agg(F.count_distinct("text").alias("texts"), (F.count_distinct(F.length("text")) > 1).alias("disagree"), F.min("conv_id").alias("first_conv"))


@query("SELECT conv_id, string_agg(role || ':' || length(text), ' ' ORDER BY turn NULLS LAST, role, text) AS notes FROM conversations GROUP BY 1")
def notes_order(spark, sf_dir):
    one = F.struct(F.col("turn").isNull(), "turn", "role", "text", F.concat_ws(":", "role", F.length("text")).alias("note"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["note"]), " ").alias("notes"))
