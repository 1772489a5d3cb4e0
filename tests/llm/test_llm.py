"""The operators against brute force, round trips and defined cases."""

from __future__ import annotations

import base64
import gc
import hashlib
import math
import re
import weakref
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from evspark.llm import chat, dart, fertility, fingerprints, licenses, mixing, shards, spm, warc
from evspark.llm.common import join_groups
from evspark.llm.html_layout import extract, render

ODD = [
    (1, "a b c d e f g", "en", "s1"), (1, "a b c d e f g", "en", "s1"), (2, None, None, None), (3, "", "en", "s1"), (4, " \t\n", "xx", ""), (None, "null id", "fr", "s2"),
    (5, "word " * 5000, "en", "s2"), (6, "x" * 30000, "de", "s2"), (7, "日本語 テキスト ▁ \x00 \x85 <s>", None, "é"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("times", F.lit(1)).withColumn("size", F.lit("clash")).withColumn("key", F.lit(2)).withColumn("_row", F.lit(3))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", t or "")


# -- fingerprints


def weights(t):
    return {w: n * len(w) for w, n in Counter(words(t)).items()}


def likeness(a, b):
    a, b = weights(a), weights(b)
    both = a.keys() | b.keys()
    return sum(min(a.get(w, 0), b.get(w, 0)) for w in both) / (sum(max(a.get(w, 0), b.get(w, 0)) for w in both) or 1) if both else 1.0


def test_fingerprints(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in fingerprints.compared(docs).collect()}
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -r["doc_id"])
    errors = []
    for i, r in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)]["text"], len(r["text"]) // 2
        edited = r["text"][: len(r["text"]) - half] + after[:half]
        g = got[r["doc_id"]]
        assert g["n_chars"] == len(r["text"]) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        errors += [g["near_edited"] - likeness(r["text"], edited), g["near_next"] - likeness(r["text"], after)]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08
    by_text = defaultdict(set)
    for r in rows:
        by_text[r["text"]].add(got[r["doc_id"]]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprints_odd(odd, none):
    got = fingerprints.compared(odd).collect()
    assert len(got) == len(ODD) and fingerprints.compared(none).count() == 0
    empty = {r["fingerprint"] for r in got if r["doc_id"] in (2, 3, 4)}
    assert empty == {"0" * 8 * fingerprints.SAMPLES}


def test_fingerprint_error(odd):
    got = [r for r in fingerprints.compared(odd).collect() if r["doc_id"] == 5]
    samples = len(got[0]["fingerprint"]) // 8
    assert samples == 48 and 0.5 / math.sqrt(samples) < 0.0722 and (got[0]["near_edited"] * samples).is_integer()


# -- WARC


def test_warc(spark, sf):
    pages = [(1, "http://a/ b\n", "x" * 100), (2, None, "x" * 100), (3, "u", None), (4, "u", ""), (5, "u", "<p>é</p>"), (5, "u", "<p>é</p>"), (None, "u", "lone"), (9, "u", "y" * 5_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.round_trip(df).collect()
    assert len(got) == len(pages) and all(r["digest_ok"] for r in got)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((p or 0, len((h or "").encode()), sha(h)) for p, _, h in pages)
    by = defaultdict(list)
    for r in got:
        by[r["page_id"]].append((r["record_type"], r["refers_to"]))
    assert by[1] == [("revisit", 2)] and by[2] == [("response", None)] and by[3] == [("revisit", 4)] and by[4] == [("response", None)]
    assert sorted(by[5], key=str) == [("response", None), ("revisit", 5)]
    assert {r["record_type"] for r in warc.round_trip(df, least_bytes=10**9).collect()} == {"response"}
    assert warc.round_trip(df.filter("false")).count() == 0


def test_arc_versions():
    for version in (1, 2):
        body = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nhi\nhttp://trap 1.1.1.1 20200101000000 text/html 3\nabc"
        data = warc.arc_header(version, "n", "20200101000000") + warc.arc_record(version, "http://x/a b", "202001020304", "text/html", body, "n", 0) + warc.arc_record(version, "dns:x", "20200102030405", "text/dns", b"1.2.3.4", "n", 9)
        one, two = warc.arc_records(data)
        assert (one.url, one.body, two.kind) == ("http://x/a%20b", body, "text/dns")
        a, b = warc.synthesise("n", one), warc.synthesise("n", two)
        assert (a.kind, a.date, a.payload[:2], b.kind, b.content_type) == ("response", "2020-01-02T03:04:00Z", b"hi", "resource", "text/dns")
        *good, bad = warc.arc_records(data[:-3])
        assert len(good) == 1 and bad.malformed


def test_warc_malformed(spark):
    """What is broken is told as malformed, and what stands before it is kept."""
    good = warc.arc_header(1, "n", "20200101000000") + warc.arc_record(1, "http://x/a", "20200102030405", "text/html", b"hi", "n", 0)
    for tail in ("http://x/b 0.0.0.0 20200102030405 text/html ².\n", "http://x/b 0.0.0.0 20200102030405 text/html -5\nabc", "rubbish", "a b c d 99\nshort"):
        one, bad = warc.arc_records(good + tail.replace(".", "" if "²" in tail else ".").encode())
        assert one.body == b"hi" and bad.malformed
    for block in (b"10 0 x\nURL IP-address Archive-date Content-type Archive-length\n", b"3 0 x\nno fields Archive-length\n", b"", b"\n\n"):
        head = f"filedesc://n 0.0.0.0 20200101000000 text/plain {len(block)}\n".encode() + block + b"\n"
        assert [r.body for r in warc.arc_records(head + good.split(b"\n\n", 1)[1])] == [b"hi"]
    zipped = b"".join(map(warc._gz, (good[: good.index(b"http://x")], good[good.index(b"http://x") :])))
    assert [r.malformed for r in warc.arc_records(zipped + b"trailing bytes")] == [False, True] and len(list(warc.arc_records(zipped))) == 1
    assert next(iter(warc.arc_records(zipped[:-20]))) is not None
    record = warc.warc_record([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:a>"), ("Content-Type", "text/plain"), ("WARC-Payload-Digest", "sha1:" + warc.digest(b"x")), ("WARC-Block-Digest", "sha1:" + warc.digest(b"x"))], b"x")
    lying = warc.warc_record([("WARC-Type", "revisit"), ("WARC-Record-ID", "<urn:b>"), ("Content-Type", "application/http"), ("WARC-Refers-To", "<urn:a>"), ("X-Payload-Length", "1"), ("WARC-Payload-Digest", "sha1:" + warc.digest(b"y")), ("WARC-Block-Digest", "sha1:" + warc.digest(b""))], b"")
    broken = b"WARC/1.1\r\nWARC-Type: resource\r\n\r\nno length"
    rows = warc.read_warc(spark.createDataFrame([("n", bytearray(record + lying + lying.replace(warc.digest(b"y").encode(), warc.digest(b"x").encode()) + broken))], "archive string, data binary")).collect()
    assert sorted((r["record_type"], r["digest_ok"]) for r in rows) == [("malformed", False), ("resource", True), ("revisit", False), ("revisit", True)]


# -- fertility


def base(t):
    w = words(t)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[x] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é\x85", max_size=60), min_size=1, max_size=6))
def test_base_counts(texts):
    got = fertility.base_counts(pa.array(texts, pa.string()))
    assert [tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for i in range(len(texts))] == [base(t) for t in texts]


def test_fertility(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in fertility.score(docs).collect()}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    for r in docs.collect():
        g = rows[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == base(r["text"])
        assert g["base_failed"] == (g["n_words"] < 50 or 100 * g["n_repeat_words"] > 50 * g["n_words"])
        assert not (g["base_failed"] and g["kept"]) and (g["kept"] or g["base_failed"] or r["doc_id"] not in clean)
    assert fertility.score(odd).count() == len(ODD) and fertility.score(none).count() == 0
    assert fertility.keep(odd).columns == odd.columns


def test_fertility_languages(spark):
    russian = "Вчера вечером мы долго гуляли по старому городу и говорили о том, как быстро меняется жизнь. На площади играл небольшой оркестр, дети бегали вокруг фонтана, а взрослые сидели на скамейках и читали газеты. Потом пошёл дождь, и все спрятались под крышей рынка. Там пахло хлебом и яблоками. Старик рассказал нам историю моста, который построил его дед, и показал фотографии реки до войны. Домой мы вернулись поздно, усталые и довольные."
    french = "Hier soir, nous avons marché longtemps à travers la vieille ville et parlé de la vie qui change très vite. L'été dernier, les élèves étaient allés à la forêt près du château où un chêne immense a été abattu. "
    english = "Last night we walked for a long time through the old town and talked about how quickly life changes. A small band was playing in the square while children ran around the fountain and older people sat reading the paper. Then it began to rain and everybody went under the roof of the market. "
    texts = [(1, russian, "en"), (2, russian, "ru"), (3, english + french, "en"), (4, french + french.replace("Hier soir", "Le printemps précédent").replace("vite", "lentement").replace("L'été", "L'année").replace("forêt", "fête").replace("marché", "rêvé").replace("immense", "brûlé"), "en"), (5, " ".join(w if i % 3 else "ѯѱѳ" + "ѵѷѹ"[i % 9 // 3] for i, w in enumerate(russian.split())), "ru"), (6, english, "en")]
    kept = {r["doc_id"]: r["kept"] for r in fertility.score(spark.createDataFrame(texts, "doc_id long, text string, lang string")).collect()}
    assert kept == {1: False, 2: True, 3: True, 4: False, 5: False, 6: True}
    assert {fertility.script_of(t) for t in ("日本語 漢字", "한국어", "ελληνικά", "العربية", "héllo", "ქართული")} == {"cjk", "hangul", "greek", "arabic", "latin", "other"}


def test_fertility_measures():
    """Tokens, byte share, entropy and verdict against plain encoding and counting, long runs included."""
    import random

    gaps = [" ", "\n", "\t", "\u3000"]
    rng = random.Random(5)
    texts = ["word\n" * 1500, "x" * 7500, "a" + " " * 9000 + "b  c\n\n" + "\n" * 5000 + "d" + "\t" * 5000, " " * 5000 + "x", " " * 6000, "日本語 テキスト ▁ \x00 \x85 <s>", "".join(rng.choice(["ab", "é", "'s", "12", "#", *gaps]) for _ in range(500)) + "\u3000" * 4096 + "z"]
    for name in fertility.VOCABULARIES.values():
        with open(f"/opt/tokenizers/{name}", "rb") as f:
            encoder, partial = fertility._encoder(f.read())
        for text in texts:
            ids = encoder.encode_ordinary(text)
            count = Counter(ids)
            n, chars, share, entropy = fertility.measures(encoder, partial, text)
            whole = lambda i: encoder.decode_single_token_bytes(i).decode("utf-8", "ignore").encode() == encoder.decode_single_token_bytes(i)
            assert fertility.tokens(encoder, text).tolist() == ids and n == len(ids) and math.isclose(chars, len(text) / n)
            assert math.isclose(share, sum(not whole(i) for i in ids) / n) and math.isclose(entropy, -sum(c / n * math.log2(c / n) for c in count.values()), abs_tol=1e-12)
        # A look-ahead over a million characters would outgrow the pattern's stack.
        assert len(fertility.tokens(encoder, "\n" * 1_000_000 + "a")) > 1
    band = fertility.Band(2.0, 6.0, 0.1, 4.0)
    assert [fertility.verdict(band, *m) for m in ((1.9, 0, 5), (6.1, 0, 5), (3, 0.2, 5), (3, 0, 3), (2.0, 0.1, 4.0))] == ["few characters per token", "many characters per token", "byte fallback", "low entropy", ""]


# -- shards


def test_shards(spark, odd, none, tmp_path):
    store = shards.sharded(odd.repartition(3), waves=5, target_bytes=1 << 20, least_bytes=1 << 10, fanout=2)
    got, want = (sorted(map(repr, df.collect())) for df in (store.read(), odd))
    assert got == want and len(store.current().shards) < 5
    assert shards.sharded(none).read().count() == 0
    one = shards.Store(spark, str(tmp_path / "s"))
    assert one.commit(shards.Manifest(1, odd.schema.json(), ())) and not one.commit(shards.Manifest(1, odd.schema.json(), ()))
    assert store.vacuum() == 0


def test_shard_columns(spark):
    """Columns of any name and kind come back as they went in."""
    rows = spark.range(200).select("id", F.col("id").alias("_wave"), F.create_map(F.lit("k"), F.col("id")).alias("m"), F.array(F.struct(F.create_map(F.col("id"), F.lit("v")).alias("x"))).alias("deep"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("a`b"))
    back = shards.sharded(rows, waves=3).read()
    assert back.schema.names == rows.schema.names and sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))


def test_shard_versions(spark, tmp_path):
    """Every version reads as what had come till then, whatever was merged since, until it expires."""
    store = shards.Store(spark, str(tmp_path / "v"), target_bytes=1 << 20, least_bytes=1 << 10, fanout=2)
    rows = spark.range(400)
    store.commit(shards.Manifest(0, rows.schema.json(), ()))
    seen, want = {0: 0}, 0
    for k, folder in enumerate(shards.arrivals(rows, store, 20)):
        now = store.append(folder, rows.schema)
        want = store.read().count()
        seen[now.version] = want
        if k % 4 == 3 and (merged := store.merge()):
            seen[merged.version] = want
    assert want == 400 and len(store.versions()) > shards.WHOLE_EVERY and {v: store.read(v).count() for v in seen} == seen
    kept = store.versions()[-3:]
    assert store.expire(3) >= 0 and store.versions() == kept and all(store.read(v).count() == seen[v] for v in kept)
    with pytest.raises(FileNotFoundError):
        store.read(0)
    assert store.compact() and store.read().count() == 400


def test_op4(spark, sf):
    """The query against the table and the files themselves."""
    import pyarrow.parquet as pq

    from evspark.llm.queries import op4_size_tiered_shards

    rows = op4_size_tiered_shards(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert sorted((r["doc_id"], r["text_md5"], r["text_chars"]) for r in rows) == sorted((r["doc_id"], hashlib.md5((r["text"] or "").encode()).hexdigest(), len(r["text"])) for r in docs)
    held = Counter(r["shard"] for r in rows)
    assert all(held[r["shard"]] == r["shard_rows"] for r in rows) and len({r["version"] for r in rows}) == 1 and pq is not None


def test_tiers(spark, tmp_path):
    store = shards.Store(spark, str(tmp_path), target_bytes=1000, least_bytes=10, fanout=3)
    runs = store.runs(tuple(shards.Shard(str(i), n, 1) for i, n in enumerate([5, 6, 7, 200, 210, 220, 900, 60])))
    assert [sorted(s.bytes for s in r) for r in runs] == [[5, 6, 7], [200, 210, 220]]


# -- mixing


def brute_targets(sizes, weight, total):
    low, high = 0.0, 1e18
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * s, mid * w) for s, w in zip(sizes, weight, strict=True)) < total else (low, mid)
    return [min(3 * s, high * w) for s, w in zip(sizes, weight, strict=True)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=8))
def test_targets(sizes):
    weight = [1 + i % 3 for i in range(len(sizes))]
    assert np.allclose(mixing.weighted_targets(sizes, weight, sum(sizes)), brute_targets(sizes, weight, sum(sizes)), rtol=1e-6)


def test_flow():
    # a is in both sources: its words go where only they can, and repeats are the last resort.
    patterns = {("x",): 10, ("x", "y"): 10, ("y",): 2}
    given_ = mixing.min_cost_flow(patterns, {"x": 12, "y": 10})
    assert given_ == {("x",): 10, ("x", "y"): 10, ("y",): 2}
    given_ = mixing.min_cost_flow(patterns, {"x": 40, "y": 40})
    assert sum(given_.values()) == 66 and given_[("y",)] == 6


def brute_flow(patterns, quotas, costs):
    """Greatest flow and its least cost, by cheapest paths found edge by edge."""
    edges = []
    for p, size in patterns.items():
        edges += [["S", p, size, c] for c in costs] + [[p, q, 10**9, 0] for q in p if q in quotas]
    edges += [[q, "T", n, 0] for q, n in quotas.items()]
    edges += [[b, a, 0, -c] for a, b, _, c in edges]
    half, flow, cost = len(edges) // 2, 0, 0
    while True:
        best, via = {"S": 0}, {}
        for _ in range(len(edges)):
            new = False
            for i, (a, b, n, c) in enumerate(edges):
                if n and a in best and best[a] + c < best.get(b, 10**9):
                    best[b], via[b], new = best[a] + c, i, True
            if not new:
                break
        if "T" not in best:
            return flow, cost
        path, at = [], "T"
        while at != "S":
            path.append(via[at])
            at = edges[via[at]][0]
        n = min(edges[i][2] for i in path)
        for i in path:
            edges[i][2] -= n
            edges[(i + half) % (2 * half)][2] += n
        flow, cost = flow + n, cost + n * best["T"]


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.sets(st.sampled_from("abcd"), min_size=1).map(lambda s: tuple(sorted(s))), st.integers(0, 20), min_size=1, max_size=6), st.dictionaries(st.sampled_from("abcd"), st.integers(0, 60), max_size=4))
def test_flow_is_least(patterns, quotas):
    got = mixing.min_cost_flow(patterns, quotas)
    cost = sum(max(0, min(g - k * size, size)) * c for (p, size), g in zip(patterns.items(), got.values(), strict=True) for k, c in enumerate(mixing.REPEAT_COSTS))
    assert got.keys() == patterns.keys() and all(0 <= got[p] <= 3 * n for p, n in patterns.items())
    assert (sum(got.values()), cost) == brute_flow(patterns, quotas, mixing.REPEAT_COSTS)


def test_flow_at_scale():
    rng = np.random.default_rng(3)
    chain = {(f"{i:05d}", f"{i + 1:05d}"): int(rng.integers(1, 1000)) for i in range(2000)}
    assert sum(mixing.min_cost_flow(chain, {f"{i:05d}": 500 for i in range(2001)}).values()) > 0
    patterns = {tuple(sorted({f"s{a}", f"s{b}", f"s{c}"})): int(a + b + c + 1) for a, b, c in rng.integers(0, 300, (20000, 3))}
    quotas = {f"s{i}": sum(patterns.values()) // 200 for i in range(300)}
    assert sum(mixing.min_cost_flow(patterns, quotas).values()) == sum(quotas.values())


def test_mixing(spark, sf, odd, none):
    from evspark.llm.queries import op5_source_mixing

    sf = sf.replace("0.001", "0.01")
    rows = op5_source_mixing(spark, sf).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = {i: len(words(r["text"])) for i, r in docs.items()}
    sources = sorted({r["source"] for r in docs.values()})
    totals = [sum(size[i] for i, r in docs.items() if r["source"] == s) for s in sources]
    want = dict(zip(sources, brute_targets(totals, [1 + k % 3 for k in range(len(sources))], sum(totals)), strict=True))
    taken = Counter()
    for r in rows:
        s = docs[r["doc_id"]]["source"]
        taken[s] += r["taken"]
        assert r["size"] == size[r["doc_id"]] and r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"] and math.isclose(r["target"], want[s], rel_tol=1e-6)
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in sources)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op5_source_mixing(spark, sf).collect()))
    assert mixing.mixed(odd).columns == odd.columns and mixing.mixed(none).count() == 0


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, 10, ["=a", "=b"] if i % 2 else ["=a"]) for i in range(100)], "doc_id long, size long, pattern array<string>")
    rows = mixing.mix(docs, {"=a": 500, "=b": 1000}).collect()
    used = Counter()
    for r in rows:
        used[len(r["pattern"])] += r["times"] * r["size"]
    assert used == {1: 500, 2: 1000}


# -- licenses


def test_licenses(spark, odd, none):
    templates = licenses.template_table(spark)
    texts = {i: t for i, (_, t) in enumerate(licenses.TEMPLATES)}
    filler = " ".join(f"w{i}" for i in range(300))
    docs = spark.createDataFrame([(i * 10 + k, filler[: 7 * k + 1] + " " + t.upper() + "\n" + filler) for i, t in texts.items() for k in range(4)] + [(999, filler)], "doc_id long, text string")
    found = {(r["doc_id"] // 10, r["template"]) for r in licenses.scan(docs, templates).collect()}
    assert {(i, i) for i in texts} <= found and not any(d == 99 for d, _ in found)
    assert licenses.scan(odd, templates).count() == 0 and licenses.scan(none, templates).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, spark.createDataFrame([(0, "X", "too short")], "template int, license_id string, text string"))


def test_license_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {r["doc_id"] for r in docs.collect() if re.search(r"(?i)\b(licensed|released) under\b", r["text"] or "")}
    found = {r["doc_id"]: r["license_id"] for r in licenses.scan(docs, licenses.template_table(spark)).collect()}
    assert lines and lines <= found.keys() and "CC-BY-NC-4.0" in found.values()


def test_license_wordings(spark):
    texts = {"CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0", "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE\n Version 3, 19 November 2007", "CC-BY-4.0": "Licensed under CC BY 4.0"}
    docs = spark.createDataFrame([(i, f"words before it {t} and some words after") for i, t in enumerate(texts.values())], "doc_id long, text string")
    found = licenses.scan(docs, licenses.template_table(spark)).collect()
    assert sorted((r["doc_id"], r["license_id"]) for r in found) == list(enumerate(texts))


def test_licenses_apart(spark):
    of = dict(reversed(licenses.TEMPLATES[:16]))
    gpl3, gpl2, later = of["GPL-3.0"], of["GPL-2.0"], of["GPL-3.0-or-later"].replace("published by", "issued by")
    cc0, by = of["CC0-1.0"], of["CC-BY-4.0"]
    gap = " ".join(f"w{i}" for i in range(200))
    docs = [f"{gpl3} {gap} {later}", f"{gpl3} {gap} {gpl2}", f"{cc0} {gap} {by}", f"{gpl3} {gap} {gpl3} {gpl3}", f"{gpl2} {gpl3}"]
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = sorted((r["doc_id"], r["license_id"]) for r in licenses.scan(docs, licenses.template_table(spark)).collect())
    assert found == [(0, "GPL-3.0"), (0, "GPL-3.0-or-later"), (1, "GPL-2.0"), (1, "GPL-3.0"), (2, "CC-BY-4.0"), (2, "CC0-1.0"), (3, "GPL-3.0"), (4, "GPL-2.0"), (4, "GPL-3.0")]


# -- near duplicates


def exact(a, b):
    x, y = (Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else Counter() for t in (a, b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abc \n", max_size=80), st.text(alphabet="abc \n", max_size=80))
def test_similarity(a, b):
    assert math.isclose(dart.similarity(a, b), exact(a, b)) and math.isclose(dart._similarities(pa.array([a]), pa.array([b]))[0], exact(a, b))


def test_dart_estimate():
    rng = np.random.default_rng(0)
    a = rng.uniform(0.1, 9, 300)
    b = np.where(rng.random(300) < 0.6, a, rng.uniform(0.1, 9, 300))
    ids = dart.mix64(np.arange(300, dtype=np.uint64))
    s = dart.signatures(np.repeat([0, 1], 300), np.concatenate([ids, ids]), np.concatenate([a, b]), 2, 4096)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_classes(spark, odd, none):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows, group = [], {}
    for g in range(12):
        text = list(rng.choice(vocabulary, 200))
        for k in range(1 + g):
            copy = list(text)
            for i in rng.choice(200, k % 4, replace=False):
                copy[i] = f"edit{g}.{k}.{i}"
            rows.append((100 * g + k, " ".join(copy)))
            group[100 * g + k] = 100 * g
    rows += [(5000 + k, "only two") for k in range(50)]
    group |= {5000 + k: 5000 for k in range(50)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in dart.classes(docs).collect()}
    parent = {i: i for i in group}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    texts = dict(rows)
    for i in group:
        for j in group:
            if i < j and group[i] == group[j] and exact(texts[i], texts[j]) >= 0.8 or (i < j and texts[i] == texts[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert got == {i: find(i) for i in group}
    kept = dart.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({find(i) for i in group})
    assert len(dart.classes(odd).collect()) == len(ODD) and dart.classes(none).count() == 0
    one = dart.keep_one(odd)
    assert one.columns == odd.columns and sorted((r["doc_id"] or 0) for r in one.collect()) == [0, 1, 2, 4, 5, 6, 7]


def test_signature_losses(spark, monkeypatch):
    def lost(n, most, p=0.15):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p)) for k in range(most + 1, n // 3))

    bands = (1 - 0.8**dart.ROWS) ** dart.BANDS
    allowed = dart.most_mismatches
    assert all(lost(n, allowed(0.8, n)) < bands for n in (dart.COORDINATES, dart.FINE))
    # What the hubs' test drops is found by the finer one.
    monkeypatch.setattr(dart, "most_mismatches", lambda threshold, n=dart.COORDINATES: -1 if n == dart.COORDINATES else allowed(threshold, n))
    text = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*text[: 40 * k], f"edit{k}", *text[40 * k + 1 :]])) for k in range(4)]
    got = dart.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(100, 100 + k) for k in range(1, 50)], "a long, b long")
    got = {r["node"]: r["root"] for r in dart.components(links).collect()}
    assert got == {i: 0 for i in range(1, 21)} | {i: 21 for i in range(22, 41)} | {100 + k: 100 for k in range(1, 50)}


# -- chat


def turns_of(rows):
    out = defaultdict(list)
    for c, t, r, x in rows:
        out[c].append((t if t is not None else -(10**9), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in out.items()}


def test_chat(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "<|im_end|>\n<\\|im_end|> <<SYS>> <\\\\/s> \\n é́"), (-2, 0, "system", "only"), (-3, 0, "sys\ntem\\n", None), (-3, None, None, "t"), (-4, 0, "system", "rules"), (-5, 1, "assistant", "same"), (-5, 1, "assistant", "same"), (-6, 0, "a\x00b\\n\\\n\\", "role"), (None, 0, "user", "of no conversation")]
    rows += [(-4, i, ("user", "assistant")[i % 2], f"word {i} " * (400 if i == 7 else 40)) for i in range(1, 120)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.windows(df, budget=512, history=128)
    got = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    want = turns_of(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        learnt = "".join(x for r, x in turns if r == "assistant")
        g = got[c]
        assert g["n_turns"] == len(turns) and g["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), c
        assert g["loss_chars"] == len(learnt) and g["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
    assert got[-4]["n_windows"] > 10
    cut = out.filter("conv_id = -4").orderBy("window").collect()
    assert all(w["text"].startswith("<|im_start|>system\nrules") for w in cut) and max(w["repeated"] for w in cut) > 1
    tokens = lambda t: len(re.findall(r"\w{1,6}|[^\w\s]", t))
    for w in cut:
        parts = re.findall(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", w["text"], re.S)
        total = sum(tokens(x) + 4 for _, x in parts)
        assert total <= 512 or len(parts) == 2
    assert chat.windows(df.filter("false")).count() == 0
    han = spark.createDataFrame([(1, 0, "user", "漢字" * 2000), (1, 1, "assistant", "かな" * 2000)], "conv_id long, turn long, role string, text string")
    assert chat.windows(han).count() == 2


# -- SentencePiece


@pytest.fixture(scope="module")
def encoder():
    return spm.Encoder(spm.load())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" ▁ab\n", max_size=30))
def test_spm_round_trip(encoder, text):
    assert spm.decode(encoder.pieces, encoder.encode(text)) == text or not text


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="the andiong▁éxq漢", min_size=1, max_size=25))
def test_viterbi(encoder, text):
    """Against plain dynamic programming over all pieces."""
    text = text.replace(" ", spm.MARK)
    score = encoder.pieces.score
    best = [0.0] + [-math.inf] * len(text)
    for e in range(1, len(text) + 1):
        best[e] = best[e - 1] + spm.BYTE_SCORE * len(text[e - 1].encode())
        for s in range(max(0, e - 20), e):
            if text[s:e] in score:
                best[e] = max(best[e], best[s] + score[text[s:e]][1])
    ids = spm.viterbi(encoder.automaton, encoder.pieces, text)
    by_id = {i: x for i, x in score.values()}
    got = sum(by_id.get(i, spm.BYTE_SCORE) for i in ids)
    assert math.isclose(got, best[-1], rel_tol=1e-9)


def test_spm_column(spark, odd, none, encoder):
    rows = spm.encode_column(odd).collect()
    assert len(rows) == len(ODD) and spm.encode_column(none).count() == 0
    for r in rows:
        assert (r["ids"] is None) == (r["text"] is None) and (not r["text"] or spm.decode(encoder.pieces, r["ids"]) == r["text"])
    whole = encoder.ids(pa.array(["ab cd ", "", "x"]))
    assert list(whole[1]) == [len(encoder.encode("ab cd ")), 1, len(encoder.encode("x"))]


def test_op9(spark, sf, encoder):
    """The query's columns against its own encoder, text by text, and a plain round trip."""
    from evspark.llm.queries import op9_sentencepiece

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op9_sentencepiece(spark, sf).collect():
        text = docs[r["doc_id"]]
        ids = encoder.encode(text)
        assert (r["n_ids"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest())
        assert r["n_byte_ids"] == sum(i in encoder.pieces.byte_ids for i in ids) and r["round_trip"] and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


# -- HTML


def test_html():
    page = """<!doctype html><html><head><title>T</title><style>x</style></head><body><h1>Head &amp; er</h1><p>one <b>two
 three<p>four<br>five<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul><div style="display: none">no<div>no</div></div><p hidden>no</p>
<table><caption>cap</caption><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td colspan=2>wide<tr><td>fig<td><p>1</p><p>2</p></table>after<script>var t="</p>";</script><pre>
 a
   b
</pre><dl><dt>t<dd>d</dl>end <span>x</span> <i>y</i>z<details><summary>s</summary>no</details><!-- no --><noscript>no</noscript>"""
    assert render(page).split("\n") == [
        "Head & er", "", "one two three", "", "four", "five", "", "- a", "- b", "  3. x", "  4. y", "- c", "", "cap", "", "Name       Qty", "apple pie  3", "wide", "fig        1", "",
        "           2", "", "after", "", " a", "   b", "", "t", "    d", "", "end x yz", "s",
    ]
    assert "no" not in re.sub(r"\bno\w+", "", render(page)).split() and render("") == "" and render("a < b &lt; c") == "a < b < c"


def test_html_hostile():
    for page in ("<div>" * 50_000 + "x", "<table><tr><td>" * 2000 + "x", "<" * 50_000 + "x", "<p a='" * 5000, "<a b" * 20_000 + ">x", "</p></div></table>x", "<!--x"):
        assert isinstance(render(page), str)


def test_html_bounds():
    """Wide, deep and spanning pages take time and give text of the order of their length."""
    import time

    for page in ("<table><tr>" + "<td>x" * 20_000, "<ul><li>a" * 20_000, "<tr><td colspan=1000 rowspan=60000>a".join(["<table>"] * 3000), "<table><tr>" + "<td rowspan=9000>a" * 1000 + "<tr><td>b" * 1000):
        began = time.perf_counter()
        assert len(render(page)) < 60 * len(page) and time.perf_counter() - began < 20


def visible(page):
    """Words of a page's text by the standard library's parser, for pages without foreign or broken markup."""
    from html.parser import HTMLParser

    unseen, void = {"head", "script", "style", "template", "title", "noscript", "iframe"}, {"br", "hr", "img", "input", "link", "meta", "wbr", "area", "base", "col", "embed", "source", "track"}

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            if tag not in void and (self.skip or tag in unseen or "hidden" in dict(attrs) or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", dict(attrs).get("style") or "")):
                self.skip += 1

        def handle_endtag(self, tag):
            if self.skip and tag not in void:
                self.skip -= 1

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    reader = Reader()
    reader.feed(page)
    reader.close()
    return "".join(re.findall(r"\w", "".join(reader.out)))


def test_op10(spark, sf):
    """All letters of the pages' visible text, in some order, by a plainer parser: marks and numbers of lists aside."""
    from evspark.llm.queries import op10_html_layout

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op10_html_layout(spark, sf).collect()
    letters = lambda t: Counter(re.findall(r"[^\W\d]", t or ""))
    same = [letters(r["text"]) == letters(visible(pages[r["page_id"]])) for r in rows]
    assert len(rows) == len(pages) and np.mean(same) > 0.95, np.mean(same)


def test_html_quotes():
    assert render("<p title=x'>hello, it's here</p><p>more") == "hello, it's here\n\nmore"
    assert render('<p title=x">a "b" c</p>d') == 'a "b" c\n\nd' and render("<p 'hidden'>a</p 'x'>b") == "a\n\nb"
    assert render("""<a title = "x>y" alt='>' href=z/>in</a>""") == "in" and render("<i a='>'b=\">\">x<b =>y<i a=>z") == "xyz"
    assert render("<p hidden=''>no</p><p style=display:none;a:'b'>no</p>x") == "x"
    assert render("a<p b='c>d" + "<p a='>" * 3000).startswith("a")


def test_html_foreign():
    assert render("<p>so <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation>no</annotation></math> holds") == "so E=m c 2 holds"
    svg = "<svg><title>no</title><desc>no <b>no</b></desc><defs><text>no</text></defs><metadata>no</metadata><style>no</style><path d='M0'/><title/><style/><g><text>left <tspan>part</tspan></text><text>right</text></g></svg>"
    assert render(f"a{svg}b") == "a left part right b"
    assert render("<div>a<svg width=5 />b<math/>c</div>d") == "abc\n\nd".replace("\n\n", "\n") and render("<div/>a<p/>b") == "a\n\nb"
    assert render("<svg><path><p>out</p>x") == "out\n\nx" and render("<svg><text display='none'>no</text><![CDATA[a < b > c]]></svg>") == "a < b > c"
    assert render("<svg><foreignObject><ul><li>x<li>y</ul></foreignObject></svg>z") == "- x\n- y\n\nz" and isinstance(render("<svg><g>" * 20_000 + "x"), str)


def test_html_table(spark):
    rows = [(1, "u", "<p>a"), (1, "u", "<p>a"), (2, None, None), (3, "u", "")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")))
    assert sorted((r["page_id"], r["text"]) for r in got.fillna("-", ["text"]).collect()) == [(1, "a"), (1, "a"), (2, "-"), (3, "")]


# -- joins and the pipeline


def test_join_groups(spark):
    left = spark.createDataFrame([(0 if i < 700 else i, i) for i in range(1000)], "k long, v long")
    groups = left.groupBy("k").agg(F.count("*").alias("n"))
    assert sorted(r["v"] for r in join_groups(left, groups, "k", "n", 1000).collect()) == list(range(1000))


def brute_classes(texts):
    """The least id of each text's component of links between equal texts and those of similarity 0.8 or more."""
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = defaultdict(set)
    for i, t in texts.items():
        w = words(t)
        for k in range(max(1, len(w) - 4) if w else 0):
            by_shingle[tuple(w[k : k + 5])].add(i)
    pairs = {(a, b) for ids in by_shingle.values() for a in ids for b in ids if a < b}
    same = defaultdict(list)
    for i, t in texts.items():
        same[t].append(i)
    pairs |= {(ids[0], b) for ids in same.values() for b in ids[1:]}
    for a, b in pairs:
        if texts[a] == texts[b] or exact(texts[a], texts[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in texts}


def brute_quality(rows):
    kept = set()
    encoders = {}
    for lang, name in fertility.VOCABULARIES.items():
        with open(f"/opt/tokenizers/{name}", "rb") as f:
            encoders[lang] = fertility._encoder(f.read())
    for r in rows:
        n, _, _, _, repeated = base(r["text"])
        if n < 50 or 100 * repeated > 50 * n:
            continue
        encoder, partial = encoders.get(r["lang"]) or encoders[""]
        ids = encoder.encode_ordinary(r["text"])
        share = float(np.mean(partial[ids]))
        p = np.array(list(Counter(ids).values())) / len(ids)
        band = fertility.BANDS.get(r["lang"]) or fertility.BANDS.get(fertility.script_of(r["text"])) or fertility.BANDS[""]
        if r["lang"] in fertility.BANDS and share > band.max_byte_share and fertility.mixed(encoder, partial, band, r["text"]):
            band = fertility.BANDS["mixed"]
        chars, entropy = len(r["text"]) / len(ids), -(p * np.log2(p)).sum()
        if band.min_chars_per_token <= chars <= band.max_chars_per_token and share <= band.max_byte_share and entropy >= band.min_entropy:
            kept.add(r["doc_id"])
    return kept


class _OneWorker:
    """Stands in for a table: gives the function that mapInArrow would run in a worker."""

    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType())])
    sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value)))

    def drop(self, *names):
        return self

    def mapInArrow(self, work, schema):
        return work


def test_worker_keeps_one_stage():
    """A worker outlives the pipeline's stages; the vocabularies of an earlier one don't stay beside a later one's."""
    import tiktoken

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a few words of a text " * 30, None], "lang": ["en", "de"]})
    encoders = lambda: [o for o in gc.get_objects() if isinstance(o, tiktoken.Encoding)]
    list(spm.encode_column(_OneWorker())(iter([])))  # what tests before this one left goes
    others = encoders()
    list(fertility.keep(_OneWorker())(iter([batch])))
    made = [weakref.ref(o) for o in encoders() if not any(o is x for x in others)]
    assert made
    out = pa.Table.from_batches(spm.encode_column(_OneWorker())(iter([batch])))
    gc.collect()
    assert not any(r() for r in made)
    assert out.column("ids").to_pylist() == [spm.Encoder(spm.load()).encode(batch.column("text")[0].as_py()), None]


def test_pipeline(spark, sf, encoder):
    """Each stage on what the one before it kept, against brute force."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    one = corpus_pipeline.quality(spark, docs, sf)
    kept = brute_quality(rows.values())
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == sorted(kept)
    two = corpus_pipeline.near_duplicates(spark, one, sf)
    classes = brute_classes({i: rows[i]["text"] for i in kept})
    firsts = set(classes.values())
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(firsts)
    three = corpus_pipeline.mix(spark, two, sf)
    assert two.columns == three.columns == docs.columns
    used = Counter(r["doc_id"] for r in three.collect())
    size = {i: len(words(rows[i]["text"])) for i in firsts}
    sources = sorted({rows[i]["source"] for i in firsts})
    totals = [sum(size[i] for i in firsts if rows[i]["source"] == s) for s in sources]
    for s, want in zip(sources, brute_targets(totals, [1 + k % 3 for k in range(len(sources))], sum(totals)), strict=True):
        own = [i for i in firsts if rows[i]["source"] == s]
        # Near the target to the size of a document, and none is repeated where another has not come as often but once.
        assert abs(sum(used[i] * size[i] for i in own) - want) <= max(size[i] for i in own) and max(used[i] for i in own) - min(used[i] for i in own) <= 1
    assert used.keys() <= firsts and max(used.values()) <= 3
    out = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r["doc_id"] for r in out) == used
    assert all(spm.decode(encoder.pieces, r["ids"]) == rows[r["doc_id"]]["text"] for r in out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "mixing sources", "sentencepiece"]


def test_pipeline_odd(spark, odd, none):
    """Every stage takes nulls, empty and long texts, repeated rows, clashing columns and empty tables."""
    import corpus_pipeline

    for docs in (odd, none.withColumn("times", F.lit(1))):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            assert out.count() <= 3 * max(1, docs.count()) and set(docs.columns) - {"text"} <= set(out.columns)


@pytest.mark.parametrize("pretest", [True, False])
def test_recall_by_similarity(spark, pretest):
    """Of the pairs of each band of similarity from 0.8 on, all are in one class, with the test by signatures or without."""
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = []
    for g in range(60):
        text = list(rng.choice(vocabulary, 300))
        rows.append((10 * g, " ".join(text)))
        for k, edits in enumerate((1, 3, 5, 6, 7, 12)):
            copy = list(text)
            for i in range(edits):
                copy[i * 300 // edits] = f"e{g}.{k}.{i}"
            rows.append((10 * g + 1 + k, " ".join(copy)))
    texts = dict(rows)
    got = {r["doc_id"]: r["class_id"] for r in dart.classes(spark.createDataFrame(rows, "doc_id long, text string"), pretest=pretest).collect()}
    bands = defaultdict(list)
    for a, _ in rows:
        for b in range(a + 1, a - a % 10 + 7):
            if (s := exact(texts[a], texts[b])) >= 0.8:
                bands[int(s * 20)].append(got[a] == got[b])
    assert len(bands) >= 4 and all(np.mean(x) == 1.0 for x in bands.values()) and got == brute_classes(texts)
