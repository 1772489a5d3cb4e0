"""The queries of this subpackage: opN_<name> over whole tables, and the oracle SQL of those that SQL
can express."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField

from evspark.llm import chat, dart, fertility, fingerprints, html_layout, licenses, mixing, shards, spm, warc
from evspark.llm.common import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    # A record whose digests aren't those of its bytes has none here.
    return back.select("page_id", "payload_bytes", F.when(F.col("digest_ok"), F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


def op3_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.score(table(spark, sf_dir, "documents"))


def op4_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document is after all arrivals and merges: its shard, the shard's size and rows, and
    what is read back of the text."""
    store = shards.sharded(table(spark, sf_dir, "documents"))
    now = store.current()
    listed = spark.createDataFrame([(s.path, s.bytes, s.rows) for s in now.shards] or [("", 0, 0)], "shard string, shard_bytes long, shard_rows long")
    path = F.concat_ws("/", F.lit("data"), F.slice(F.split(F.input_file_name(), "/"), -2, 2))
    rows = store.read().select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.length("text").cast("long").alias("text_chars"), path.alias("shard"))
    # The list grows with the table, so its size decides whether it is broadcast.
    return rows.join(listed, "shard").withColumn("version", F.lit(now.version).cast("long"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = written(mixing.sized(table(spark, sf_dir, "documents")), "sized")
    chosen, by_source = mixing.choice_by_weight(sized)
    targets = spark.createDataFrame([([s], size, float(t)) for s, (size, t) in by_source.items()], "pattern array<string>, source_size long, target double")
    taken = mixing.times(sized, chosen, seed=17).join(F.broadcast(targets), "pattern")
    return taken.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.template_table(spark)).drop("at")


def op7_dartminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart.classes(table(spark, sf_dir, "documents"))


def op8_budgeted_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.windows(turns))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    def digests(encoder, ids, ends, batch):
        texts = batch.column("text")
        parts = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        back = [spm.decode(encoder.pieces, p.tolist()) if len(p) else "" for p in parts]
        byte_ids = np.zeros(len(encoder.pieces.text), bool)
        byte_ids[list(encoder.pieces.byte_ids)] = True
        lost = np.concatenate([[0], np.cumsum(byte_ids[ids])])
        return [
            pa.array(np.diff(ends), pa.int64()),
            pa.array(lost[ends[1:]] - lost[ends[:-1]], pa.int64()),
            pa.array([hashlib.sha256(p.astype("<i4").tobytes()).hexdigest() for p in parts]),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
            pc.equal(pc.fill_null(texts, ""), pa.array(back, pa.string())),
        ]

    fields = [StructField("n_ids", LongType()), StructField("n_byte_ids", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()), StructField("round_trip", BooleanType())]
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spm.with_ids(docs, digests, fields).drop("text")


def op10_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items(), key=lambda x: (len(x[0].split("_")[0]), x[0])) if name.startswith("op") and name[2].isdigit()}


#: Payloads, digests (base 32 of SHA-1, four characters from each five hex digits) and revisits of pages.
OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, list_transform(range(0, 8), lambda g: CAST('0x' || substr(h, CAST(g * 5 + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM p),
e AS (SELECT *, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> s) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest,
  max(page_id) OVER (PARTITION BY html) AS first FROM d)
SELECT page_id, octet_length(encode(html)) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM e"""

#: Classes by the exact similarity of all pairs of texts that share a shingle.
OP7 = """
WITH RECURSIVE u AS (SELECT coalesce(text, '') AS text, min(doc_id) AS rep, count(*) AS copies FROM documents GROUP BY 1),
w AS (SELECT rep, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM u),
s AS (SELECT rep, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w),
c AS (SELECT rep, sh, count(*) AS n FROM s GROUP BY 1, 2), z AS (SELECT rep, sum(n) AS n FROM c GROUP BY 1),
p AS (SELECT a.rep AS a, b.rep AS b, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.sh = b.sh AND a.rep < b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z za ON za.rep = a JOIN z zb ON zb.rep = b WHERE m / (za.n + zb.n - m) >= 0.8),
e AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
r(node, root) AS (SELECT rep, rep FROM u UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node),
k AS (SELECT node, min(root) AS class_id FROM r GROUP BY 1), q AS (SELECT class_id, CAST(sum(copies) AS BIGINT) AS class_size FROM k JOIN u ON rep = node GROUP BY 1)
SELECT doc_id, class_id, class_size FROM documents JOIN u ON u.text = coalesce(documents.text, '') JOIN k ON node = rep JOIN q USING (class_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_arc_to_warc": OP2, "op6_license_scan": licenses.oracle(), "op7_dartminhash_classes": OP7}
