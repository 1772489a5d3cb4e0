from __future__ import annotations

import hashlib
import json
import os
import random

import pytest

from evspark import __main__ as cli
from evspark.api import Image
from evspark.plans import containers as P
from evspark.plans import volumes as V
from evspark.sources import container as K
from evspark.sources import files as S
from evspark.sources.writer import ContainerWriter


def test_acquire_and_export(spark, tmp_path, capsys):
    source = tmp_path / "source"
    (source / "d").mkdir(parents=True)
    (source / "a.txt").write_bytes(b"abc" * 1000)
    (source / "d" / "tab\t%.bin").write_bytes(os.urandom(300))
    (source / "empty").write_bytes(b"")
    os.symlink("a.txt", source / "link")
    out = str(tmp_path / "c.aff4")
    assert cli.main(["acquire", str(source), out]) == cli.SKIPPED
    assert cli.main(["verify", out]) == cli.OK
    assert "6 checked, 6 matched" in capsys.readouterr().out
    assert cli.main(["verify", out, "--format", "json", "--digests", str(tmp_path / "digests")]) == cli.OK
    x = json.loads(capsys.readouterr().out)
    assert len(x["checks"]) == 6 and x["counters"][0]["matched"] == 6 and x["notes"] == []
    heading, *lines = [line.split("\t") for line in (tmp_path / "digests").read_text().splitlines()]
    assert [line[heading.index("recorded")] for line in lines] == ["a.txt", "d/tab%09%25.bin", "empty"]  # the display form
    assert lines[0][heading.index("md5_actual")] == hashlib.md5(b"abc" * 1000).hexdigest()
    assert cli.main(["info", out, "--format", "json"]) == cli.OK
    x = json.loads(capsys.readouterr().out)
    assert len(x["containers"][0]["objects"]) == 3 and x["errors"] == []
    assert cli.main(["info", out, "--brief"]) == cli.OK
    text = capsys.readouterr().out
    assert "3 FileImage" in text and "2.1, written by evspark, files" in text
    assert cli.main(["conformance", out]) == cli.OK
    target = tmp_path / "target"
    assert cli.main(["export", str(target), out]) == cli.OK
    assert (target / "a.txt").read_bytes() == b"abc" * 1000 and len(list((target / "d").iterdir())) == 1
    assert cli.main(["rules"]) == cli.OK and "of 83 rules" in capsys.readouterr().out


@pytest.fixture
def many(tmp_path):
    """Files of every storage form, with chunks that are alike, and their bytes."""
    random.seed(3)
    same, files = random.randbytes(32768 * 3), {"empty": b"", "small": b"few bytes", "text": b"line\n" * 3000}
    files |= {"one": same + b"tail of one", "two": same + b"of two", "d/large": random.randbytes(1_300_000), "d/huge": bytes(17 << 20) + b"end"}
    for name, data in files.items():
        path = tmp_path / "source" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
        os.utime(path, (1_600_000_000, 1_600_000_000))
    return tmp_path / "source", files


@pytest.mark.parametrize("options", [[], ["--dedupe"], ["--part-size", "200000"]])
def test_storage_forms(spark, tmp_path, capsys, many, options):
    source, files = many
    out = str(tmp_path / "c.aff4")
    assert cli.main(["--log", str(tmp_path / "log"), "acquire", str(source), out, "--verify", *options]) == cli.OK
    text = capsys.readouterr().out
    checked = 2 * (len(files) + ("--dedupe" not in options))  # a stream of one file has digests of its own
    assert f"{checked} checked, {checked} matched" in text and (tmp_path / "log").read_text() == text
    names = [out] + sorted(str(p) for p in tmp_path.glob("c.aff4.*"))
    assert (len(names) > 1) == ("--part-size" in options)
    forms = {"/".join(sorted({t.rsplit("#", 1)[-1] for t in r["types"]} & {"Map", "ZipSegment"})) for r in P.info(spark, names).filter("role = 'FileImage'").collect()}
    assert forms == {"", "Map", "ZipSegment"}
    found = {r["kind"] for r in P.conformance(spark, names).filter("not coalesce(routine, false)").collect()}
    assert not found
    if "--dedupe" in options:
        assert P.streams(spark, names).agg({"size": "max"}).head()[0] < 3 << 20  # zeros are one chunk
    target = tmp_path / "target"
    assert cli.main(["export", str(target), *names]) == cli.OK
    assert {str(p.relative_to(target)): p.read_bytes() for p in target.rglob("*") if p.is_file()} == files
    assert {int(p.stat().st_mtime) for p in target.rglob("*") if p.is_file()} == {1_600_000_000}


def test_mapped_damage(spark, tmp_path):
    """A file whose stream lacks bytes isn't verifiable, and one whose recorded digest is another's mismatches."""
    path = str(tmp_path / "c.aff4")
    w = ContainerWriter(path, chunk_size=512, per_segment=2)
    w.mapped("whole", [b"a" * 700], "shared_map")
    w.mapped("beyond", [b"b" * 700], "shared_map")
    name, folder = w.member_of("lost")
    w._map_members(folder, [(0, 100, 0, 0)], ["aff4://nowhere"], name)
    w._file(name, ("Map",), 100, "lost", None, None, {"sha256": hashlib.sha256(b"")})
    name, folder = w.member_of("wrong")
    w._map_members(folder, [(10, 90, 0, 0)], [w.shared["shared_map"].name], name)
    w._file(name, ("Map",), 110, "wrong", None, None, {"sha256": hashlib.sha256(b"\0" * 10 + b"a" * 90)})
    name, folder = w.member_of("filled")
    w._map_members(folder, [(10, 90, 0, 0)], [w.shared["shared_map"].name], name)
    w._file(name, ("Map",), 110, "filled", None, None, {"sha256": hashlib.sha256(b"\0" * 10 + b"a" * 90 + b"\0" * 10)})
    w.close()
    got = {r["subject"]: r["outcome"] for r in P.verify(spark, [path]).collect()}
    assert {n: got[w.member_of(n)[0]] for n in ("whole", "beyond", "lost", "wrong", "filled")} == {"whole": "matched", "beyond": "matched", "lost": "not_verifiable", "wrong": "mismatch", "filled": "matched"}


def test_attributes(spark, tmp_path, monkeypatch):
    (tmp_path / "source").mkdir()
    (tmp_path / "source" / "a").write_bytes(b"abc" * 900)
    values = {"user.few": b"few \xff bytes", "user.many": bytes(range(256)) * 20}
    monkeypatch.setattr(S, "attributes", lambda path: values)
    out = str(tmp_path / "c.aff4")
    assert cli.acquire(spark, str(tmp_path / "source"), out) == ([out], 0)
    found = {}
    for r in P.info(spark, [out]).filter("exists(types, t -> t like '%FileExtendedAttribute')").collect():
        found[next(p["value"] for p in r["properties"] if p["name"] == "name")] = (r["subject"], r["size"])
    assert {k: n for k, (_, n) in found.items()} == {k: len(v) for k, v in values.items()}
    few = P.object_bytes(spark, [out], P.info(spark, [out]).filter(P.F.col("subject") == found["user.few"][0])).collect()
    assert [bytes(r["data"]) for r in few] == [values["user.few"]]
    members = {r["name"]: bytes(r["data"]) for r in K.read(spark, [out], "members", kinds="file").collect()}
    assert values["user.many"] in members.values()
    assert cli.main(["verify", out]) == cli.OK and cli.main(["conformance", out]) == cli.OK


def test_acquired_image(spark, tmp_path):
    data = random.Random(4).randbytes((1 << 20) + 700)
    (tmp_path / "disk.raw").write_bytes(data)
    out = str(tmp_path / "disk.aff4")
    assert cli.main(["acquire", "--image", "--verify", str(tmp_path / "disk.raw"), out]) == cli.OK
    assert Image(spark, [out]).read(0, len(data)) == data
    with pytest.raises(FileExistsError):
        cli.main(["acquire", "--image", str(tmp_path / "disk.raw"), out])
    listing = tmp_path / "listing"
    assert cli.main(["info", out, "--full-listing", str(listing)]) == cli.OK and "DiskImage" in listing.read_text()


def test_image_with_bad_sectors(spark, tmp_path, monkeypatch):
    data, whole = random.Random(6).randbytes(9 * 512 + 100), S.read_tolerantly
    (tmp_path / "disk.raw").write_bytes(data)

    def failing(read, size):
        def bad(at, n):
            if at < 5 * 512 and at + n > 3 * 512:
                raise OSError("bad")
            return read(at, n)

        return whole(bad, size)

    monkeypatch.setattr(S, "read_tolerantly", failing)
    out = str(tmp_path / "disk.aff4")
    assert cli.acquire_image(str(tmp_path / "disk.raw"), out) == [(3 * 512, 2 * 512)]
    image = Image(spark, [out])
    unread = (b"UNREADABLEDATA" * 400)[3 * 512 % 14 :][:1024]
    assert image.read(0, len(data)) == data[: 3 * 512] + unread + data[5 * 512 :]
    assert image.read(0, len(data), "report") == data[: 3 * 512]


def test_walk_and_split(spark, tmp_path):
    for k in (1, 2, 3):
        (tmp_path / f"image.00{k}").write_bytes(bytes([k]) * k * 10)
    rows = S.walk(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r["kind"] for r in rows] == ["folder", "file", "file", "file"]
    parts = S.split_image(spark, [str(tmp_path / f"image.00{k}") for k in (1, 2, 3)]).orderBy("ord").collect()
    assert [(r["at"], r["size"]) for r in parts] == [(0, 10), (10, 20), (30, 30)]
    with pytest.raises(ValueError):
        S.numbered(["x.001", "x.003"])


def test_bad_sectors():
    data, bad = bytes(range(256)) * 40, {3, 4, 9}

    def read(at, n):
        if any(s in bad for s in range(at // 512, -(-(at + n) // 512))):
            raise OSError("bad")
        return data[at : at + n]

    blocks, extents = S.read_tolerantly(read, len(data), block=2048)
    got = b"".join(blocks)
    assert extents == [(1536, 1024), (4608, 512)] and got[:1536] == data[:1536] and got[1536:1540] == (b"UNREADABLEDATA" * 200)[1536 % 14 :][:4]


def test_volume_sets(spark, tmp_path):
    one, two = str(tmp_path / "v1.aff4"), str(tmp_path / "v2.aff4")
    a, b = ContainerWriter(one, chunk_size=512), ContainerWriter(two, chunk_size=512)
    image, stream = "aff4://image", "aff4://stream"
    s, _ = a.stream([b"x" * 2000])
    for w in (a, b):
        w._common(image, ("DiskImage", "Image"), 2000)
        w.state(image, "dataStream", stream)
    a._common(stream, ("ImageStream",), 2000)
    b._common(stream, ("ImageStream",), 1999)
    a.state("aff4://x", "stored", "aff4://elsewhere")
    b._digests(image, {"sha256": __import__("hashlib").sha256(b"")})
    a.close()
    b.close()
    paths = [one, two]
    assert [r["subject"] for r in V.shared_images(spark, paths).collect()] == [image]
    c = V.stream_conflicts(spark, paths).collect()
    assert [(r["subject"], r["name"], r["first_value"], r["other_value"]) for r in c] == [(stream, "size", "2000", "1999")]
    best = {r["subject"]: r["container"] for r in V.merged_objects(spark, paths).collect()}
    assert best[image] == two and best[stream] == one
    assert {r["stream"]: r["container"] for r in V.holders(spark, paths).collect()} == {s: one}
    assert [r["stored"] for r in V.missing_volumes(spark, paths).collect()] == ["aff4://elsewhere"]
    assert {r["node"]: r["depth"] for r in V.spine(spark, paths).collect()} == {image: 0, stream: 1}
    assert V.work_estimate(spark, paths).filter("streams = 2").count() == 1
    stripes = spark.createDataFrame([("b", "m1", "s2", "aa"), ("a", "m2", "s1", "bb")], "file string, map string, stream string, digest string")
    import hashlib

    assert V.striped_root(stripes, hashlib.sha256(bytes.fromhex("aabb")).hexdigest()) == ("matched", "map")
    assert V.striped_root(stripes, "00")[0] == "mismatch"
    assert K.kind_of("x/00000000.index") == "bevy_index"
