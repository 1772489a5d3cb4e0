"""Queries over scalar functions, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evspark.functions import raw
from evspark.functions import scalars as S
from evspark.operators import intervals as I
from evspark.session import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


_NAMED = "concat(url, '[0x', printf('%x', page_id * 4096), ':', page_id + 7, ']')"


@query(f"""WITH n AS (SELECT page_id, {_NAMED} AS name FROM pages) SELECT page_id, regexp_extract(name, '^([a-z]+)://', 1) AS scheme, regexp_extract(name, '^[a-z]+://([^/\\[]*)', 1) AS authority,
    nullif(regexp_extract(name, '^[a-z]+://[^/\\[]*(/[^\\[]*)', 1), '') AS path, page_id * 4096 AS range_start, page_id + 7 AS range_length FROM n""")
def url_parts(spark, sf_dir):
    name = F.concat("url", F.lit("[0x"), F.lower(F.hex(F.col("page_id") * 4096)), F.lit(":"), (F.col("page_id") + 7).cast("string"), F.lit("]"))
    return table(spark, sf_dir, "pages").select("page_id", *[S.name_part(name, p).alias(p) for p in ("scheme", "authority", "path", "range_start", "range_length")])


@query("SELECT page_id, regexp_extract(url, '[^#/]*$') AS local, left(url, length(url) - length(regexp_extract(url, '[^#/]*$'))) AS namespace FROM pages")
def local_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.local_name(F.col("url")).alias("local"), S.namespace(F.col("url")).alias("namespace"))


@query("""WITH n AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, '.', '%2e') WHEN 1 THEN replace(url, '.', '%2E') WHEN 2 THEN url || '%zz' ELSE url END AS u FROM pages)
    SELECT page_id, regexp_matches(u, '%[0-9A-Fa-f]{2}') AS escaped, regexp_matches(u, '%([a-f][0-9A-Fa-f]|[0-9A-F][a-f])') AS lowercase FROM n""")
def percent_detect(spark, sf_dir):
    k = F.col("page_id") % 4
    u = F.when(k == 0, F.replace("url", F.lit("."), F.lit("%2e"))).when(k == 1, F.replace("url", F.lit("."), F.lit("%2E"))).when(k == 2, F.concat("url", F.lit("%zz"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", S.has_percent_escape(u).alias("escaped"), S.has_lowercase_escape(u).alias("lowercase"))


@query("""WITH g AS (SELECT p_partkey, md5(p_name) AS h FROM part), t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN x WHEN 1 THEN upper(x) WHEN 2 THEN upper(left(x, 18)) || substr(x, 19) ELSE h END AS u
    FROM (SELECT *, concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) AS x FROM g))
    SELECT p_partkey, CASE WHEN NOT regexp_matches(u, '^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$') THEN 'none' WHEN u = lower(u) THEN 'lower' WHEN u = upper(u) THEN 'upper' ELSE 'mixed' END AS guid FROM t""")
def guid_case(spark, sf_dir):
    h, k = F.md5("p_name"), F.col("p_partkey") % 4
    x = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    u = F.when(k == 0, x).when(k == 1, F.upper(x)).when(k == 2, F.concat(F.upper(F.left(x, F.lit(18))), F.substring(x, 19, 99))).otherwise(h)
    return table(spark, sf_dir, "part").select("p_partkey", S.guid_case(u).alias("guid"))


_ESC = "replace(replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
_TSV = "replace(replace(replace(replace(text, '\\', '\\\\'), chr(9), '\\t'), chr(13), '\\r'), chr(10), '\\n')"


@query(f"SELECT doc_id, md5({_ESC}) AS turtle, md5({_TSV}) AS tsv FROM documents")
def text_escapes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.turtle_escape(F.col("text"))).alias("turtle"), F.md5(S.tsv_escape(F.col("text"))).alias("tsv"))


@query("""WITH b AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN to_base64(encode(c_name)) WHEN 1 THEN rtrim(to_base64(encode(c_name || 'x')), '=') WHEN 2 THEN to_base64(encode(c_name)) || '=' WHEN 3 THEN 'a=bc' ELSE replace(to_base64(encode(c_name)), 'Q', '-') END AS x FROM customer)
    SELECT c_custkey, CASE WHEN regexp_matches(x, '^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$') THEN octet_length(from_base64(CASE WHEN regexp_matches(x, '^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$') THEN x ELSE '' END)) END AS decoded FROM b""")
def base64_strict(spark, sf_dir):
    b = lambda c: F.base64(c.cast("binary"))
    k, name = F.col("c_custkey") % 5, F.col("c_name")
    x = F.when(k == 0, b(name)).when(k == 1, F.rtrim(b(F.concat(name, F.lit("x"))), F.lit("="))).when(k == 2, F.concat(b(name), F.lit("="))).when(k == 3, "a=bc").otherwise(F.replace(b(name), F.lit("Q"), F.lit("-")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.octet_length(S.strict_base64(x)).cast("long").alias("decoded"))


def _about(n: str) -> str:
    cases = []
    for unit, name in ((1 << 40, "TiB"), (1 << 30, "GiB"), (1 << 20, "MiB"), (1 << 10, "KiB")):
        t = f"(({n} * 10) // {unit} + CASE WHEN ({n} * 10) % {unit} * 2 > {unit} OR (({n} * 10) % {unit} * 2 = {unit} AND ({n} * 10) // {unit} % 2 = 1) THEN 1 ELSE 0 END)"
        cases.append(f"WHEN {n} >= {unit} THEN ({t} // 10) || '.' || ({t} % 10) || ' {name}'")
    return "CASE " + " ".join(cases) + f" ELSE {n} || ' B' END"


@query(f"""WITH x AS (SELECT doc_id, n_chars * (doc_id % 13 * doc_id % 7919 * 997 + 1) AS n FROM documents) SELECT doc_id, {_about('n')} AS about,
    CASE WHEN n >= 1073741824 THEN (n // 1073741824) || '.' || (n % 1073741824 * 10 // 1073741824) || ' GiB' WHEN n >= 1048576 THEN (n // 1048576) || '.' || (n % 1048576 * 10 // 1048576) || ' MiB'
      WHEN n >= 1024 THEN (n // 1024) || '.' || (n % 1024 * 10 // 1024) || ' KiB' ELSE n || ' bytes' END AS cut, format('{{:,}}', n) AS grouped FROM x""")
def human_units(spark, sf_dir):
    n = F.col("n_chars") * (F.col("doc_id") % 13 * F.col("doc_id") % 7919 * 997 + 1)
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).select("doc_id", S.bytes_about(F.col("n")).alias("about"), S.bytes_cut(F.col("n")).alias("cut"), S.thousands(F.col("n")).alias("grouped"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def utc_stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.utc_stamp(F.col("ts")).alias("stamp"))


_LIST = "concat_ws(',', ' ' || upper(lang), source, lang, '', CASE WHEN doc_id % 2 = 0 THEN 'MD5' ELSE 'sha1 ' END, upper(source))"


@query(f"""WITH a AS (SELECT doc_id, list_filter(list_transform(string_split({_LIST}, ','), lambda x: lower(trim(x))), lambda x: x <> '') AS l FROM documents)
    SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS algorithms, len(list_filter(l, lambda x: x NOT IN ('md5', 'sha1', 'en'))) > 0 AS strong FROM a""")
def algorithm_lists(spark, sf_dir):
    text = F.concat_ws(",", F.concat(F.lit(" "), F.upper("lang")), "source", "lang", F.lit(""), F.when(F.col("doc_id") % 2 == 0, "MD5").otherwise("sha1 "), F.upper("source"))
    names = S.algorithm_list(text)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(names, ",").alias("algorithms"), S.strong_enough(F.filter(names, lambda x: x != "en")).alias("strong"))


_PART_NAMES = "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'disk.aff4' WHEN 1 THEN 'disk.aff4.' || c_custkey WHEN 2 THEN 'case_2024_' || lpad(c_custkey::VARCHAR, 5, '0') || '.aff4' WHEN 3 THEN 'lz' || c_custkey || '.aff4' WHEN 4 THEN 'image.' || c_custkey ELSE 'img-' || (c_custkey % 97) || 'b.001' END AS name FROM customer"


def _part_names(spark, sf_dir):
    k, key = F.col("c_custkey") % 6, F.col("c_custkey").cast("string")
    name = F.when(k == 0, "disk.aff4").when(k == 1, F.concat(F.lit("disk.aff4."), key)).when(k == 2, F.concat(F.lit("case_2024_"), F.lpad(key, 5, "0"), F.lit(".aff4"))).when(k == 3, F.concat(F.lit("lz"), key, F.lit(".aff4"))).when(k == 4, F.concat(F.lit("image."), key)).otherwise(F.concat(F.lit("img-"), (F.col("c_custkey") % 97).cast("string"), F.lit("b.001")))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))


@query(f"""WITH n AS ({_PART_NAMES}), s AS (SELECT *, regexp_extract(name, '\\.aff4\\.([0-9]+)$', 1) AS after, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM n)
    SELECT c_custkey, name, TRY_CAST(CASE WHEN after <> '' THEN after WHEN ends_with(name, '.aff4') AND NOT regexp_matches(stem, '(^|[-_. ])[0-9]+[^0-9]*$') THEN '0' ELSE regexp_extract(stem, '(?:^|[-_. ])([0-9]+)[^0-9]*$', 1) END AS BIGINT) AS number FROM s""")
def part_numbers(spark, sf_dir):
    return _part_names(spark, sf_dir).withColumn("number", S.part_number(F.col("name")))


@query(f"""WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'part_' || c_custkey ELSE name END AS name FROM ({_PART_NAMES})),
    k AS (SELECT *, array_to_string(list_transform(regexp_extract_all(name, '([0-9]+|[^0-9])'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '0' || lpad(regexp_replace(x, '^0+', ''), 40, '0') || lpad(length(x)::VARCHAR, 4, '0') ELSE x END), '') AS key FROM n)
    SELECT c_custkey, name, row_number() OVER (ORDER BY key COLLATE "C", c_custkey) AS place FROM k""".replace(' COLLATE "C"', ""))
def natural_sort(spark, sf_dir):
    n = _part_names(spark, sf_dir).withColumn("name", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("part_"), F.col("c_custkey").cast("string"))).otherwise(F.col("name")))
    return I.places(n, [S.natural_key(F.col("name")), F.col("c_custkey")]).select("c_custkey", "name", "place")


_PATHS = "SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'C:\\Users\\x' || page_id || '. ' WHEN 2 THEN '/a/../b/./nul.txt' WHEN 3 THEN '../..' WHEN 4 THEN 'dir/com1/' || page_id || '?' ELSE ' . /x ' END AS p FROM pages"
_RESERVED = ", ".join(f"'{r}'" for r in S.RESERVED)


@query(f"""WITH n AS ({_PATHS}), s AS (SELECT page_id, list_transform(list_filter(string_split_regex(p, '[/\\\\]'), lambda x: x NOT IN ('', '.', '..')), lambda x: regexp_replace(regexp_replace(CASE WHEN length(x) = 2 AND ends_with(x, ':') THEN left(x, 1) ELSE x END, '[<>:"|?*\\x00-\\x1f]', '_', 'g'), '[ .]+$', '')) AS l FROM n),
    t AS (SELECT page_id, array_to_string(list_transform(list_transform(l, lambda x: CASE WHEN x = '' THEN '_' ELSE x END), lambda x: CASE WHEN upper(regexp_extract(x, '^[^.]*')) IN ({_RESERVED}) THEN x || '_' ELSE x END), '/') AS q FROM s)
    SELECT page_id, CASE WHEN q = '' THEN '_' ELSE q END AS written FROM t""")
def path_sanitize(spark, sf_dir):
    k, key = F.col("page_id") % 6, F.col("page_id").cast("string")
    p = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("C:\\Users\\x"), key, F.lit(". "))).when(k == 2, "/a/../b/./nul.txt").when(k == 3, "../..").when(k == 4, F.concat(F.lit("dir/com1/"), key, F.lit("?"))).otherwise(" . /x ")
    return table(spark, sf_dir, "pages").select("page_id", S.safe_path(p).alias("written"))


_PAIRS = """SELECT c_custkey, CASE c_custkey % 8 WHEN 6 THEN c_name || '%4A' WHEN 7 THEN c_name || '%4a' WHEN 1 THEN c_name || chr(9) ELSE c_name END AS display,
    CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN to_base64(encode(c_name)) WHEN 3 THEN 'not base64' WHEN 4 THEN to_base64(encode('other')) WHEN 5 THEN to_base64(encode(c_name || chr(10))) ELSE to_base64(encode(c_name || chr(9))) END AS raw FROM customer"""


@query(f"""WITH p AS ({_PAIRS}) SELECT c_custkey, CASE c_custkey % 8 WHEN 1 THEN 'MissingRawName' WHEN 2 THEN 'RedundantRawName' WHEN 3 THEN 'MalformedRawName' WHEN 4 THEN 'ContradictoryRawName' WHEN 7 THEN 'LowercaseNameEscape' END AS rule FROM p""")
def name_pair_rules(spark, sf_dir):
    k, n = F.col("c_custkey") % 8, F.col("c_name")
    b = lambda c: F.base64(c.cast("binary"))
    more = lambda t: F.concat(n, F.lit(t))
    display = F.when(k == 6, more("%4A")).when(k == 7, more("%4a")).when(k == 1, more("\t")).otherwise(n)
    stored = F.when(k.isin(0, 1), None).when(k == 2, b(n)).when(k == 3, "not base64").when(k == 4, b(F.lit("other"))).when(k == 5, b(more("\n"))).otherwise(b(more("\t")))
    return table(spark, sf_dir, "customer").select("c_custkey", S.name_pair_rule(display, stored).alias("rule"))


@query("SELECT p_partkey, CAST(('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::UBIGINT AS VARCHAR) AS word FROM (SELECT p_partkey, md5(p_name) AS h FROM part)")
def little_endian_words(spark, sf_dir):
    h = F.md5("p_name")
    word = F.conv(F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)]), 16, 10)
    return table(spark, sf_dir, "part").select("p_partkey", word.alias("word"))


@query("SELECT page_id, md5(replace(replace(replace(url, '%', '%25'), ':', '%3A'), '/', '%2F')) AS escaped, url AS back FROM pages")
def component_escape(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", raw.escape_component("url").alias("e"))
    return rows.select("page_id", F.md5("e").alias("escaped"), raw.unescape("e").alias("back"))
