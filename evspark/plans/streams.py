"""Streaming queries run to their end over the events table, with the batch result as oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.session import shared_dir
from evspark.streaming import windows as W

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


def _run(df: DataFrame, mode: str) -> DataFrame:
    """All that a stream makes of what there is, through a written table."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/evspark/stream-{uuid.uuid4().hex}"
    if mode == "append":
        df.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    else:

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/out")

        df.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).outputMode("complete").start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def _events(spark, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events, CAST(round(sum(value) * 100) AS BIGINT) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    out = _run(W.tumbling(_events(spark, sf_dir).withColumn("value", F.col("value").cast("decimal(18,6)")), "ts", ["event_type"]), "complete")
    return out.withColumn("total", F.round(F.col("total") * 100).cast("long")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS events FROM s GROUP BY user_id, k""")
def batch_sessions(spark, sf_dir):
    """The same operator over the whole table as one batch."""
    return W.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", ["user_id"])


@query("SELECT count(DISTINCT event_type) AS contents FROM events")
def stream_first_contents(spark, sf_dir):
    events = _events(spark, sf_dir).select("ts", F.col("event_type").alias("content"))
    return _run(W.first_contents(events, "ts", late="3650 days"), "append").agg(F.count("*").alias("contents"))
