from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evspark.functions import raw
from evspark.functions import scalars as S
from evspark.operators import chunks as C
from evspark.operators import findings as D
from evspark.operators import graph as G
from evspark.operators import intervals as I
from evspark.operators import triples as T


def col(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_exactly_one(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    assert {r["k"]: r["value"] for r in T.exactly_one(df, ["k"], "v").collect()} == {"a": None, "b": 2}


def test_whole_numbers(spark):
    df = spark.createDataFrame([("5", "long"), ("5", "float"), ("x", "int"), ("18446744073709551615", "long"), ("-1", "int"), (None, "int")], "t string, d string")
    assert [r[0] for r in df.select(T.as_whole_number(F.col("t"), F.col("d"))).collect()] == [5, None, None, None, None, None]


def test_longest_prefix(spark):
    rows = spark.createDataFrame([("http://a/b",), ("ftp://",), (None,)], "t string")
    prefixes = spark.createDataFrame([("http://",), ("http://a",), ("http://a/bc",)], "p string")
    assert {r["t"]: r["best_prefix"] for r in T.longest_prefix(rows, "t", prefixes, "p", 8).collect()} == {"http://a/b": "http://a", "ftp://": None, None: None}


def test_coverage_and_fill(spark):
    e = spark.createDataFrame([(0, 5, 5, "a"), (0, 10, 5, "b"), (0, 12, 10, "c"), (0, 30, 1, "d")], "m int, offset long, length long, target string")
    assert I.coverage(e, ["m"], ["target"]).first().asDict() == {"m": 0, "entries": 4, "gaps": 2, "gap_bytes": 13, "overlaps": 1, "entry_bytes": 21, "map_end": 31}
    assert sorted((r["offset"], r["length"]) for r in I.gap_fill(e, ["m"], ["target"], "target", "Zero").filter("target = 'Zero'").collect()) == [(0, 5), (22, 8)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(1, 60)), min_size=1, max_size=12), st.integers(1, 64))
def test_lookups_by_brute_force(spark, entries, width):
    e = spark.createDataFrame([(0, o, n, i) for i, (o, n) in enumerate(entries)], "m int, offset long, length long, id int")
    points = spark.createDataFrame([(0, p) for p in range(0, 260, 13)], "m int, at long")
    got = sorted((r["at"], r["id"]) for r in I.point_lookup(points, e, ["m"], "at", width).collect() if r["id"] is not None)
    assert got == sorted((p, i) for p in range(0, 260, 13) for i, (o, n) in enumerate(entries) if o <= p < o + n)
    ranges = spark.createDataFrame([(0, 20, 90)], "m int, start long, stop long")
    clip = sorted((r["id"], r["clip_start"], r["clip_length"], r["into"]) for r in I.range_clip(ranges, e, ["m"], width).collect())
    assert clip == sorted((i, max(20, o), min(90, o + n) - max(20, o), max(20, o) - o) for i, (o, n) in enumerate(entries) if o < 90 and o + n > 20)


def test_islands_and_runs(spark):
    e = spark.createDataFrame([(0, 0, 5), (0, 5, 5), (0, 7, 1), (0, 20, 1)], "m int, offset long, length long")
    assert sorted((r["island_start"], r["island_length"], r["extents"]) for r in I.islands(e, ["m"], ["length"]).collect()) == [(0, 10, 3), (20, 1, 1)]
    r = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (0, 2, "a"), (1, 0, "a"), (1, 1, "a"), (2, 0, "a"), (2, 1, "b")], "m int, o int, t string")
    assert {x["m"]: x["layout"] for x in I.runs(r, ["m"], ["o"], "t").collect()} == {0: "striped", 1: "single", 2: "sequential"}


def test_stream_digests(spark):
    data = {"a": [b"x" * 10, b"y"], "b": [b""], "c": [b"\x00\xff"] * 5}
    df = spark.createDataFrame([(k, i, p) for k, v in data.items() for i, p in enumerate(v)], "k string, i int, d binary")
    got = {r["k"]: r for r in C.stream_digests(df, "k", "d", "i", ["md5", "sha512", "sha3_256", "shake_128", "blake2b", "blake3"]).collect()}
    for k, v in data.items():
        whole = b"".join(v)
        assert got[k]["md5"] == hashlib.md5(whole).hexdigest() and got[k]["sha512"] == hashlib.sha512(whole).hexdigest()
        assert got[k]["shake_128"] == hashlib.shake_128(whole).hexdigest(32) and got[k]["blake3"] is None and got[k]["bytes"] == len(whole)


def test_split_by_size(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate([5, 6, 1, 20, 1, 9, 2])], "k string, o int, n long")
    assert [r["part"] for r in C.split_by_size(df, "k", "o", "n", 10).orderBy("o").collect()] == [0, 0, 1, 1, 2, 2, 3]


def test_deconflicted(spark):
    names = ["a.txt", "a.txt", "a (2).txt", "a.txt", "d/b", "d/b", ".x", ".x"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, p string")
    got = [r["written"] for r in D.deconflicted(df, "p", ["i"]).orderBy("i").collect()]
    assert got == ["a.txt", "a (3).txt", "a (2).txt", "a (4).txt", "d/b", "d/b (2)", ".x", ".x (2)"]


def test_rules(spark):
    r = D.rules(spark)
    assert r.count() == 83 and r.filter("kind is not null").count() == 34 and r.filter("routine").count() == 1
    d = spark.createDataFrame([("MapGap",), ("NonGuidArn",), ("?",)], "kind string")
    got = {x["kind"]: (x["section"], x["other_specification"]) for x in D.cited(d, r, "alpha").collect()}
    assert got == {"MapGap": ("§4", None), "NonGuidArn": (None, "alpha §1.1"), "?": (None, None)}


def test_reach(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src int, dst int")
    assert {r["node"]: r["depth"] for r in G.reach(e, spark.createDataFrame([(1,)], "n int")).collect()} == {1: 0, 2: 1, 3: 1}


def test_scalars(spark):
    df = col(spark, ["part_10", "part_9", "part_09", "a1b", "a1", None])
    got = [r[0] for r in df.filter("x is not null").orderBy(S.natural_key(F.col("x"))).collect()]
    assert got == ["a1", "a1b", "part_9", "part_09", "part_10"]
    parts = col(spark, ["foo.aff4", "foo.aff4.1", "Base_1.aff4", "case_2024_007.aff4", "lz4.aff4", "image.001", "x"])
    assert [r[0] for r in parts.select(S.part_number(F.col("x"))).collect()] == [0, 1, 1, 7, 0, None, None]
    b = col(spark, ["QQ==", "QQ=", "QQ", "Q=Q=", "", "QUJD"])
    assert [None if r[0] is None else bytes(r[0]) for r in b.select(S.strict_base64(F.col("x"))).collect()] == [b"A", None, None, None, b"", b"ABC"]
    n = col(spark, [0, 1023, 1024, 1280, 1536, 1 << 40], "long")
    assert [r[0] for r in n.select(S.bytes_about(F.col("x"))).collect()] == ["0 B", "1023 B", "1.0 KiB", "1.2 KiB", "1.5 KiB", "1.0 TiB"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_component_round_trip(text):
    assert raw.unescape_text(raw.escape_component_text(text)) == text


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=3000), st.sampled_from(raw.CODECS))
def test_codecs(data, codec):
    full = (data * 20)[:4096].ljust(4096, b"\0")
    assert raw.decode_chunk(codec, raw.encode_chunk(codec, full, 4096), 4096) == full


@pytest.mark.parametrize("codec", ["zlib", "snappy", "lz4", "deflate"])
def test_bad_chunks(codec):
    with pytest.raises((ValueError, OSError, IndexError, Exception)):
        raw.decode_chunk(codec, b"\x07bad", 4096)


def test_order_in_two_levels(spark):
    """Gaps, sums, islands and places over one hot key and many small ones, dealt over many ranges, as by plain loops."""
    import random

    from evspark.operators import intervals as I

    rng = random.Random(4)
    rows = [("hot" if i % 3 else f"k{i % 50}" if i % 7 else None, i, rng.randrange(100_000), rng.randrange(1, 200)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, offset long, length long")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        gaps = {r["i"]: (r["gap"], r["overlap"]) for r in I.with_gaps(df, ["k"], ["i"]).collect()}
        sums = {r["i"]: r["at"] for r in I.running_offset(df, ["k"], ["i"], "length").collect()}
        islands = sorted(((r["k"] or "", r["island_start"], r["island_length"], r["extents"]) for r in I.islands(df, ["k"], ["i"]).collect()))
        places = {r["i"]: r["place"] for r in I.places(df, [F.col("offset"), F.col("i")]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    by_key = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        by_key.setdefault(r[0], []).append(r)
    merged = []
    for k, own in by_key.items():
        end, total, now = None, 0, None
        for _, i, offset, length in own:
            lead = offset if end is None else offset - end
            assert gaps[i] == (max(lead, 0), max(-lead, 0))
            if end is None or offset > end:
                now = [k or "", offset, offset, 0]
                merged.append(now)
            end = max(end or 0, offset + length)
            now[2], now[3] = max(now[2], offset + length), now[3] + 1
        for _, i, _, length in sorted(own, key=lambda r: r[1]):
            assert sums[i] == total
            total += length
    assert islands == sorted((k, a, b - a, n) for k, a, b, n in merged)
    assert places == {r[1]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[1])), 1)}


def test_long_entries(spark):
    """An entry of a terabyte takes as many rows as a small one."""
    from evspark.operators import intervals as I

    entries = spark.createDataFrame([(0, 0, 100, 1), (0, 100, 1 << 40, 2), (0, (1 << 40) + 100, 10, 3), (0, (1 << 41), 0, 4)], "m int, offset long, length long, id int")
    points = spark.createDataFrame([(0, p) for p in (0, 99, 100, 12345, 1 << 39, (1 << 40) + 99, (1 << 40) + 105, (1 << 40) + 110)], "m int, p long")
    found = {r["p"]: r["id"] for r in I.point_lookup(points, entries, ["m"], "p", 4096).collect()}
    assert found == {0: 1, 99: 1, 100: 2, 12345: 2, 1 << 39: 2, (1 << 40) + 99: 2, (1 << 40) + 105: 3, (1 << 40) + 110: None}
    assert I._levels(entries, 4096).count() <= 6
    ranges = spark.createDataFrame([(0, 7, 90, 110), (0, 8, 1 << 39, (1 << 39) + 5), (0, 9, 50, 50)], "m int, r int, start long, stop long")
    clipped = sorted((r["r"], r["id"], r["clip_start"], r["clip_length"], r["into"]) for r in I.range_clip(ranges, entries, ["m"], 4096).collect())
    assert clipped == [(7, 1, 90, 10, 90), (7, 2, 100, 10, 0), (8, 2, 1 << 39, 5, (1 << 39) - 100)]


def test_long_text_is_cut_in_linear_time(spark):
    import time

    from evspark.operators import chunks as C

    text = spark.createDataFrame([(1, "é" * 4_000_000)], "id int, text string")
    began = time.perf_counter()
    n, size = C.cut(text, ["id"], "text", 64, 8).agg(F.count("*"), F.sum("length")).head()
    assert (n, size) == (125_000, 8_000_000) and time.perf_counter() - began < 30
