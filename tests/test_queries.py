"""Every query with oracle SQL gives DuckDB's rows; the others run."""

from __future__ import annotations

import duckdb
import pytest

from pyspark.sql import functions as F

from evspark.operators import triples as T
from evspark.plans import metadata
from evspark.queries import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(round(float(r[i]), 9) if isinstance(r[i], float) else None if r[i] is None else str(r[i]) for i in order)) for r in values)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, sf, duck, name):
    df = queries()[name](spark, sf)
    want = duck.execute(oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0


def test_whole_reach(spark, sf, duck):
    edges = {}
    for sql in ("select 'n' || n_nationkey, 'r' || n_regionkey from nation", "select 'c' || c_custkey, 'n' || c_nationkey from customer", "select 'o' || o_orderkey, 'c' || o_custkey from orders"):
        for a, b in duck.execute(sql).fetchall():
            edges.setdefault(a, set()).add(b)
            edges.setdefault(b, set()).add(a)
    depth, front = {"n1": 0}, ["n1"]
    while front:
        front = [b for a in front for b in edges[a] if b not in depth and not depth.update({b: depth[a] + 1})]
    assert {r["node"]: r["depth"] for r in queries()["bfs_reach"](spark, sf).collect()} == depth


def agrees(spark, folder, name, table, select):
    """Whether a query over one table, made by DuckDB SQL, gives the rows of its own SQL."""
    c = duckdb.connect()
    c.execute(f"copy ({select}) to '{folder}/{table}.parquet' (format parquet)")
    c.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df, want = queries()[name](spark, str(folder)), c.execute(oracle_sql()[name])
    return rows(df.columns, df.collect()) == rows([d[0] for d in want.description], want.fetchall())


def test_filler_of_large_keys(spark, tmp_path):
    near = "SELECT unnest(range(n - 50, n + 50)) AS p_partkey FROM (VALUES (1048576), (3145728), (6442450944)) v(n)"
    assert agrees(spark, tmp_path, "filler_bytes", "part", f"SELECT p_partkey, CAST(p_partkey % 50 + 1 AS INTEGER) AS p_size FROM ({near})")


def test_digests_of_every_row(spark, tmp_path):
    """Rows without bytes, nulls, ids that rows share and no id at all."""
    some = "(1, 'a'), (2, ''), (3, NULL), (4, repeat('é', 100)), (4, repeat('é', 100)), (4, 'b'), (NULL, 'c'), (NULL, NULL), (5, repeat('x', 64)), (5, '')"
    assert agrees(spark, tmp_path, "multi_digest", "documents", f"SELECT CAST(i AS BIGINT) AS doc_id, t AS text FROM (VALUES {some}) v(i, t)")


def test_grouped_statements_are_dealt(spark, sf, duck, monkeypatch):
    """However few files hold the tables, a task groups so many statements; a subject is one task's."""
    monkeypatch.setattr(T, "TASK", 100, raising=False)
    for name in ("triples_of_tables", "object_build"):
        df, want = queries()[name](spark, sf), duck.execute(oracle_sql()[name])
        assert rows(df.columns, df.collect()) == rows([d[0] for d in want.description], want.fetchall())
    held = queries()["object_build"](spark, sf).groupBy(F.spark_partition_id()).agg(F.count("*")).collect()
    assert max(n for _, n in held) < 60  # of 360 subjects
    made = T.unpivot_dealt(metadata._sources(spark, sf)).select("subject", F.spark_partition_id().alias("task")).distinct()
    assert made.count() == 360
