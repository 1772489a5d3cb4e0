"""Queries over findings and graphs, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.operators import findings as D
from evspark.operators import graph as G
from evspark.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# -- checks: a document's digests are recorded right, wrong or by an algorithm that nothing computes

RECORDED = """r AS (SELECT doc_id AS subject, 'md5' AS algorithm, CASE WHEN doc_id % 17 = 0 THEN md5(text || 'x') ELSE upper(md5(text)) END AS expected FROM documents
    UNION ALL SELECT doc_id, 'sha256', CASE WHEN doc_id % 23 = 0 THEN sha256(text || 'x') ELSE sha256(text) END FROM documents WHERE doc_id % 3 <> 0
    UNION ALL SELECT doc_id, 'blake3', left(sha256(text), 64) FROM documents WHERE doc_id % 5 = 0),
    m AS (SELECT doc_id AS subject, 'md5' AS algorithm, md5(text) AS actual FROM documents UNION ALL SELECT doc_id, 'sha256', sha256(text) FROM documents),
    k AS (SELECT r.*, actual, CASE WHEN actual IS NULL THEN 'not_verifiable' WHEN lower(expected) = lower(actual) THEN 'matched' ELSE 'mismatch' END AS outcome FROM r LEFT JOIN m USING (subject, algorithm))"""


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("subject"), "text")
    text, wrong, i = F.col("text").cast("binary"), F.concat("text", F.lit("x")).cast("binary"), F.col("subject")
    row = lambda a, v: F.struct(F.lit(a).alias("algorithm"), v.alias("expected"))
    recorded = F.array(
        row("md5", F.when(i % 17 == 0, F.md5(wrong)).otherwise(F.upper(F.md5(text)))),
        row("sha256", F.when(i % 3 != 0, F.when(i % 23 == 0, F.sha2(wrong, 256)).otherwise(F.sha2(text, 256)))),
        row("blake3", F.when(i % 5 == 0, F.sha2(text, 256))),
    )
    recorded = d.select("subject", F.explode(recorded).alias("r")).select("subject", "r.*").filter("expected is not null")
    computed = d.select("subject", F.explode(F.create_map(F.lit("md5"), F.md5(text), F.lit("sha256"), F.sha2(text, 256))).alias("algorithm", "actual"))
    return D.compare_digests(recorded, computed, ["subject", "algorithm"])


@query(f"WITH {RECORDED} SELECT algorithm, outcome, count(*) AS n, min(subject) AS first_subject FROM k GROUP BY 1, 2")
def recorded_vs_computed(spark, sf_dir):
    return checks(spark, sf_dir).groupBy("algorithm", "outcome").agg(F.count("*").alias("n"), F.min("subject").alias("first_subject"))


@query(f"WITH {RECORDED} SELECT subject, CASE max(CASE outcome WHEN 'mismatch' THEN 2 WHEN 'not_verifiable' THEN 1 ELSE 0 END) WHEN 2 THEN 'mismatch' WHEN 1 THEN 'not_verifiable' ELSE 'matched' END AS verdict, count(*) AS checks FROM k GROUP BY 1")
def row_verdict(spark, sf_dir):
    return D.verdicts(checks(spark, sf_dir), ["subject"])


@query(f"WITH {RECORDED} SELECT subject, " + ", ".join(f"any_value({c}) FILTER (algorithm = '{a}') AS {a}_{c}" for a in ("md5", "sha256", "blake3") for c in ("expected", "actual", "outcome")) + " FROM k GROUP BY 1")
def digest_pivot(spark, sf_dir):
    return D.digest_table(checks(spark, sf_dir), "subject", ["md5", "sha256", "blake3"])


@query(f"WITH {RECORDED} SELECT count(*) AS checked, count(*) FILTER (outcome = 'matched') AS matched, count(*) FILTER (outcome = 'mismatch') AS mismatched, count(*) FILTER (outcome = 'not_verifiable') AS not_verifiable, count(DISTINCT algorithm) AS algorithms FROM k")
def report_counters(spark, sf_dir):
    return D.report_counters(checks(spark, sf_dir))


@query(f"WITH {RECORDED} SELECT max(CASE outcome WHEN 'mismatch' THEN 3 WHEN 'not_verifiable' THEN 2 ELSE 0 END) AS exit_code FROM k")
def worst_exit(spark, sf_dir):
    o = F.col("outcome")
    return checks(spark, sf_dir).agg(F.max(F.when(o == "mismatch", 3).when(o == "not_verifiable", 2).otherwise(0)).alias("exit_code"))


_KINDS = ["UnexpectedDatatype", "ExternalReference", "DanglingReference", "NonGuidArn", "MissingZipSegmentType", "Unheard"]


@query("""WITH r(kind, document, clause, requirement, routine) AS (VALUES ('UnexpectedDatatype', 'standard', '§2.2', 'Must', false), ('ExternalReference', 'standard', '§7.1', 'May', true), ('DanglingReference', 'standard', 'none', 'May', false),
      ('NonGuidArn', 'alpha', '§1.1', 'Must', false), ('MissingZipSegmentType', 'paper', '§3.8', 'Must', false)),
    d AS (SELECT event_id, (['UnexpectedDatatype', 'ExternalReference', 'DanglingReference', 'NonGuidArn', 'MissingZipSegmentType', 'Unheard'])[event_id % 6 + 1] AS kind FROM events)
    SELECT kind, CASE WHEN document = 'standard' AND clause <> 'none' THEN clause END AS section, CASE WHEN document = 'alpha' THEN document || ' ' || clause END AS other_specification, requirement, routine, count(*) AS n, min(event_id) AS first_event
    FROM d LEFT JOIN r USING (kind) GROUP BY ALL""")
def rules_join(spark, sf_dir):
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    deviations = table(spark, sf_dir, "events").select("event_id", F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int")).alias("kind"))
    return D.cited(deviations, D.rules(spark), "alpha").groupBy("kind", "section", "other_specification", "requirement", "routine").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("SELECT document, state, CAST(rules AS BIGINT) AS rules, any_binding FROM (VALUES ('alpha', 'Unchecked', 32, true), ('standard', 'Noted', 1, false), ('standard', 'Unchecked', 19, true)) v(document, state, rules, any_binding)")
def coverage_gap(spark, sf_dir):
    return D.coverage_gaps(D.rules(spark), "alpha")


@query("SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = page_id AND toxic = 0) AND NOT EXISTS (SELECT 1 FROM labels WHERE doc_id = page_id * 3)")
def undigested_images(spark, sf_dir):
    """Pages that no label of the same number, and no label of three times it, checks."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.lit("img/"), F.col("page_id").cast("string")).alias("arn"))
    labels = table(spark, sf_dir, "labels")
    own = labels.filter("toxic = 0").select(F.concat(F.lit("img/"), F.col("doc_id").cast("string")).alias("subject"))
    child = labels.filter("doc_id % 3 = 0").select(F.concat(F.lit("img/"), (F.col("doc_id") / 3).cast("long").cast("string"), F.lit("/block")).alias("subject"))
    return D.undigested(pages, own.union(child), "arn", "subject").select("page_id", "url")


@query(f"WITH {RECORDED} SELECT algorithm || ' ' || outcome AS label, count(DISTINCT subject) AS subjects, min(subject * 10 + length(algorithm)) AS first_seen, count(*) > 100 AS many FROM k GROUP BY 1")
def group_matches(spark, sf_dir):
    return checks(spark, sf_dir).groupBy(F.concat_ws(" ", "algorithm", "outcome").alias("label")).agg(F.count_distinct("subject").alias("subjects"), F.min(F.col("subject") * 10 + F.length("algorithm")).alias("first_seen"), (F.count("*") > 100).alias("many"))


@query("""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN source || '/' || lang || ' (2).txt' ELSE source || '/' || lang || '.txt' END AS path FROM documents),
    n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY doc_id) AS k, regexp_replace(path, '\\.txt$', '') AS stem FROM f),
    t AS (SELECT DISTINCT path FROM f)
    SELECT doc_id, path, CASE WHEN k = 1 THEN path ELSE stem || ' (' || (k + CASE WHEN NOT ends_with(stem, ' (2)') AND EXISTS (SELECT 1 FROM t WHERE t.path = stem || ' (2).txt') THEN 1 ELSE 0 END) || ').txt' END AS written FROM n""")
def deconflict(spark, sf_dir):
    stem = F.concat_ws("/", "source", "lang")
    path = F.concat(stem, F.when(F.col("doc_id") % 10 == 3, " (2).txt").otherwise(".txt"))
    return D.deconflicted(table(spark, sf_dir, "documents").select("doc_id", path.alias("path")), "path", ["doc_id"])


def _reach(spark, nation, customer, orders):
    node = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    edges = nation.select(node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst"))
    edges = edges.union(customer.select(node("c", "c_custkey"), node("n", "c_nationkey"))).union(orders.select(node("o", "o_orderkey"), node("c", "o_custkey")))
    return G.reach(edges, spark.createDataFrame([("n1",)], "node string"))


@query("""WITH e AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation), home AS (SELECT r FROM e WHERE n = 1),
    nn AS (SELECT n, CASE WHEN n = 1 THEN 0 WHEN r = (SELECT r FROM home) THEN 2 END AS depth FROM e), cc AS (SELECT c_custkey AS c, depth + 1 AS depth FROM customer JOIN nn ON n = c_nationkey WHERE depth IS NOT NULL)
    SELECT 'n' || n AS node, depth FROM nn WHERE depth IS NOT NULL UNION ALL SELECT 'r' || r, 1 FROM home UNION ALL SELECT 'c' || c, depth FROM cc UNION ALL SELECT 'o' || o_orderkey, depth + 1 FROM orders JOIN cc ON c = o_custkey""")
def bfs_reach(spark, sf_dir):
    return _reach(spark, *(table(spark, sf_dir, t) for t in ("nation", "customer", "orders")))


@query("""WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') AS child FROM pages UNION SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]*)', 1) FROM pages)
    SELECT c.child, arg_max(a.child, length(a.child)) AS parent FROM p c LEFT JOIN p a ON starts_with(c.child, a.child || '/') GROUP BY 1""")
def path_tree(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    paths = pages.select(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", "").alias("p")).union(pages.select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)))
    return G.parents(paths, "p")
