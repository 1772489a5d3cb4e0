from __future__ import annotations

import hashlib
import random
import zipfile

import pytest

from evspark.plans import containers as P
from evspark.sources import container as K
from evspark.sources import turtle
from evspark.sources.writer import ContainerWriter


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    random.seed(3)
    folder, out = tmp_path_factory.mktemp("containers"), {}
    for codec in ("stored", "zlib", "snappy", "lz4"):
        path = str(folder / f"{codec}.aff4")
        w = ContainerWriter(path, version=(2, 1), chunk_size=512, per_segment=4, codec=codec, algorithms=("md5", "sha256"))
        data = b"abc" * 1000 + random.randbytes(3000) + b"\0" * 2000
        stream, _ = w.stream([data[:700], data[700:]])
        image = w.image([(0, 1000, 100, 0), (1000, 500, 0, 1), (1500, 3000, 2000, 0)], [stream, K.SCHEMA_NS + "Zero"], 4500)
        files = {w.file_member("a/b.txt", b"hello" * 100): b"hello" * 100, w.file_member("nul", b""): b""}
        w.close()
        out[codec] = (path, data, stream, image, files)
    return out


@pytest.mark.parametrize("codec", ["stored", "zlib", "snappy", "lz4"])
def test_verify(spark, made, codec):
    path, data, stream, _, files = made[codec]
    checks = P.verify(spark, [path]).collect()
    assert {c["outcome"] for c in checks} == {"matched"} and len(checks) == 2 + 2 * len(files)
    assert {c["expected"] for c in checks if c["subject"] == stream} == {hashlib.md5(data).hexdigest(), hashlib.sha256(data).hexdigest()}
    blocks = P.block_checks(spark, [path]).first()
    assert blocks["blocks"] == blocks["matched"] == -(-len(data) // 512)


def test_altered(spark, made, tmp_path):
    path = made["stored"][0]
    other = str(tmp_path / "altered.aff4")
    with zipfile.ZipFile(path) as a, zipfile.ZipFile(other, "w") as b:
        for info in a.infolist():
            x = a.read(info)
            b.writestr(info, x[:5] + bytes([x[5] ^ 1]) + x[6:] if info.filename.endswith("/00000001") else x)
        b.comment = a.comment
    assert {c["outcome"] for c in P.verify(spark, [other]).filter("role = 'ImageStream'").collect()} == {"mismatch"}
    blocks = P.block_checks(spark, [other]).first()
    assert blocks["matched"] == blocks["blocks"] - 1


@pytest.mark.parametrize("codec", ["stored", "lz4"])
def test_export(spark, made, codec, tmp_path):
    path, data, _, image, files = made[codec]
    out = str(tmp_path / "image.raw")
    assert P.export_image(spark, [path], image + "/data", 4500, out) == 4500
    assert open(out, "rb").read() == data[100:1100] + b"\0" * 500 + data[2000:5000]
    got = {r["written"]: bytes(r["data"]) for r in P.export_files(spark, [path]).collect()}
    assert got == {"a/b.txt": b"hello" * 100, "nul_": b""}
    with pytest.raises(FileExistsError):
        P.export_image(spark, [path], image + "/data", 4500, out)


def test_info_and_conformance(spark, made, tmp_path):
    path = made["zlib"][0]
    roles = {r["role"]: r["n"] for r in P.info(spark, [path]).groupBy("role").count().withColumnRenamed("count", "n").collect()}
    assert roles == {"DiskImage": 1, "Map": 1, "ImageStream": 1, "FileImage": 2}
    assert P.conformance(spark, [path]).count() == 0
    bad = str(tmp_path / "bad.aff4")
    w = ContainerWriter(bad, version=(2, 1))
    w.state(f"{w.volume}/notguid", turtle.RDF_TYPE, K.SCHEMA_NS + "FileImage")
    w.state(f"{w.volume}/notguid", turtle.RDF_TYPE, K.SCHEMA_NS + "ZipSegment")
    w.state(f"{w.volume}/notguid", "stored", w.volume)
    w.state(f"{w.volume}/notguid", "size", "x", turtle.XSD + "long")
    w.state(f"{w.volume}/notguid", "hash", "abc", K.SCHEMA_NS + "SHA256")
    w.state(f"{w.volume}/notguid", "dataStream", "aff4://nowhere")
    w.close()
    kinds = {r["kind"] for r in P.conformance(spark, [bad]).collect()}
    odd = str(tmp_path / "odd.aff4")
    w = ContainerWriter(odd, version=(2, 1))
    w.state(f"{w.volume}/x", "http://aff4.org/Schema/2022/#size", "1", turtle.XSD + "long")
    w.state(f"{w.volume}/x", "dataStream", "QUJD" * 500, turtle.XSD + "base64Binary")
    w.state(f"{w.volume}/x[0x0:0x10]", "stored", "aff4://elsewhere")
    w.image([(10, 5, 0, 0)], ["http://aff4.org/Schema#Zero"], 15)
    w.state(w.statements[-1].subject.removesuffix("/data"), turtle.RDF_TYPE, K.SCHEMA_NS + "Image")
    w.close()
    with zipfile.ZipFile(odd, "a") as z:
        z.comment = b"  aff4://other"
    found = {r["kind"] for r in P.deviations(spark, [odd]).collect()}
    assert found == {"WrongTermNamespace", "OversizedResidentStream", "ByteRangeArn", "ExternalReference", "ArnNotAtCommentStart", "InconsistentVolumeArn"}
    assert kinds == {"NonGuidArn", "MissingRecordedPath", "UnexpectedDatatype", "DigestLengthMismatch", "DanglingReference", "StorageFormNotFound"}


def test_broken(spark, tmp_path):
    broken = tmp_path / "broken.aff4"
    broken.write_bytes(b"PK\x03\x04 not an archive")
    assert K.read(spark, [str(broken)], "segments").count() == 0
    assert [r["severity"] for r in K.read(spark, [str(broken)], "problems").collect()] == ["malformed"]


def test_turtle():
    text = '''@prefix a: <http://x/> . # note
    <s> a a:T, a:U ; a:p "q\\n\\u00e9"^^a:d , 5, true ; a:n "m"@en .
    _:b a:p <o> . <s2> a:p _:b ; a:q """long "x" text""" .
    PREFIX b: <http://y#>
    b:x <http://x/p> <http://z[0x10:0x20]> .'''
    got = [tuple(s)[1:] for s in turtle.parse(text)]
    assert got == [
        ("s", turtle.RDF_TYPE, "iri", "http://x/T", None), ("s", turtle.RDF_TYPE, "iri", "http://x/U", None), ("s", "http://x/p", "literal", "q\né", "http://x/d"),
        ("s", "http://x/p", "literal", "5", turtle.XSD + "integer"), ("s", "http://x/p", "literal", "true", turtle.XSD + "boolean"), ("s", "http://x/n", "literal", "m", turtle.LANG),
        ("s2", "http://x/q", "literal", 'long "x" text', turtle.XSD + "string"), ("http://y#x", "http://x/p", "iri", "http://z[0x10:0x20]", None),
    ]
    again = list(turtle.parse(turtle.serialize(turtle.parse(text), {"a": "http://x/", "xsd": turtle.XSD})))
    assert sorted(s[1:5] for s in again) == sorted(g[:4] for g in got)
    for wrong in ("<a> <b> .", "<a> x:y 5 .", "<a> <b> 5", '<a> <b> "x .'):
        with pytest.raises(turtle.Malformed):
            list(turtle.parse(wrong))


def test_regions_that_are_not_stored(spark, tmp_path):
    """Holes, unknown regions and block hashes against the bytes that they stand for."""
    from evspark.api import Image, UnknownRegion

    random.seed(9)
    data, path = random.randbytes(4000), str(tmp_path / "holes.aff4")
    w = ContainerWriter(path, chunk_size=512, per_segment=2)
    stream, _ = w.stream([data])
    block = "aff4:sha512:" + "ab" * 32
    w.state(block, "dataStream", f"{stream}[0x200:0x100]")
    targets = [stream, K.SCHEMA_NS + "UnknownData", K.SCHEMA_NS + "UnreadableData", block, "aff4:sha512:nowhere"]
    mib = 1 << 20
    entries = [(100, 1000, 50, 0), (2000, 30, 3, 1), (2030, 40, mib - 20, 2), (3000, 256, 0, 3), (5000, 3, 0, 4)]
    name = w.image(entries, targets, 6000)
    w.state(name + "/data", "mapGapDefaultStream", K.SCHEMA_NS + "SymbolicStream7F")
    w.close()
    whole = bytearray(b"\x7f" * 6000)
    whole[100:1100] = data[50:1050]
    whole[2000:2030] = (b"UNKNOWN" * 10)[3:33]
    fill = b"UNREADABLEDATA" * mib
    whole[2030:2050], whole[2050:2070] = fill[mib - 20 : mib], fill[:20]
    whole[3000:3256] = data[512 : 512 + 256]
    image = Image(spark, [path])
    for offset, length in ((0, 5000), (90, 20), (1999, 80), (2040, 3), (3100, 300), (5003, 5000), (4000, 1)):
        assert image.read(offset, length) == bytes(whole[offset : min(6000, offset + length)]), offset
    with pytest.raises(ValueError, match="no bytes at 5000"):
        image.read(4999, 10)
    assert image.read(1990, 100, unknown="report") == bytes(whole[1990:2000])
    with pytest.raises(UnknownRegion):
        image.read(2035, 5, unknown="report")
    counted = P.read_accounting(spark, [path], name + "/data", 6000).first().asDict()
    assert counted == {"stored": 1256, "described": 0, "unknown_placeholder": 70, "gap_filled": 6000 - 1256 - 70 - 3}
    with pytest.raises(ValueError):
        P.export_image(spark, [path], name + "/data", 6000, str(tmp_path / "out"))


def test_composite_digests(spark, tmp_path):
    """Digests of a map's parts, of block hashes and of both, and one that is wrong."""
    random.seed(11)
    path = str(tmp_path / "maps.aff4")
    w = ContainerWriter(path, chunk_size=512, per_segment=2, algorithms=())
    stream, _ = w.stream([random.randbytes(3000)])
    image = w.image([(0, 3000, 0, 0)], [stream], 3000)
    of_map, folder, bevies = image + "/data", (image + "/data")[len(w.volume) + 1 :], stream[len(w.volume) + 1 :]
    w.zip.close()
    with zipfile.ZipFile(path) as z:
        parts = [z.read(f"{folder}/{n}") for n in ("map", "idx", "mapPath")]
        blocks = b"".join(z.read(n) for n in sorted(z.namelist()) if n.startswith(bevies) and n.endswith(".blockHash.sha256"))
    w.file = open(path, "r+b")
    w.zip = zipfile.ZipFile(w.file, "a")
    sha = lambda b: hashlib.sha256(b).digest()
    whole = hashlib.sha512(b"".join(hashlib.sha512(x).digest() for x in (blocks, *parts))).hexdigest()
    wanted = {(of_map, "mapPointHash"): sha(parts[0]), (of_map, "mapIdxHash"): sha(parts[1]), (of_map, "mapPathHash"): b"wrong".ljust(32), (of_map, "mapHash"): sha(b"".join(parts)), (stream + "/blockhash.sha256", "hash"): sha(blocks)}
    for (subject, prop), d in wanted.items():
        w.state(subject, prop, d.hex(), K.SCHEMA_NS + "SHA256")
    for subject in (of_map, image):
        w.state(subject, "blockMapHash", whole, K.SCHEMA_NS + "SHA512")
    w.state(stream + "/blockhash.sha256", turtle.RDF_TYPE, K.SCHEMA_NS + "BlockHashes")
    w.close()
    got = {(r["subject"], r["property"]): r["outcome"] for r in P.verify(spark, [path]).collect()}
    assert got == {k: "matched" for k in [*wanted, (of_map, "blockMapHash"), (image, "blockMapHash")]} | {(of_map, "mapPathHash"): "mismatch"}
    assert P.undigested_images(spark, [path]).count() == 0


def test_damage_is_a_finding(spark, made, tmp_path):
    """A damaged index, a map that reaches too far, a short bevy and bad metadata are rows; all else is still verified."""
    good, bad = made["zlib"][0], str(tmp_path / "damaged.aff4")
    image = made["zlib"][3]
    with zipfile.ZipFile(good) as a, zipfile.ZipFile(bad, "w") as b:
        for info in a.infolist():
            x = a.read(info)
            if info.filename.endswith("/00000001.index"):
                x = x[:-3]
            elif info.filename.endswith("/00000002"):
                x = x[:4]
            elif info.filename.endswith("/map"):
                x = (1 << 63).to_bytes(8, "little") + x[8:28] + x[28:52] + (9).to_bytes(4, "little") + x[56:]
            elif info.filename == "information.turtle":
                x += b"\n<broken <"
            elif info.filename == "version.txt":
                x = b"major=x\n"
            b.writestr(info, x)
        b.comment = a.comment
    found = {r["name"].rsplit("/", 1)[-1]: r["detail"] for r in K.read(spark, [bad], "problems").collect()}
    assert found.keys() == {"00000001.index", "00000002.index", "map", "information.turtle", "version.txt"}
    outcomes = {(r["role"], r["outcome"]) for r in P.verify(spark, [bad, good]).filter(f"container = '{bad}'").collect()}
    assert outcomes >= {("FileImage", "matched")} and image
    assert K.read(spark, [bad], "map_entries").count() == 2
    assert P.block_checks(spark, [bad]).first()["not_verifiable"] > 0


def test_generations(spark, tmp_path):
    """A rule of the layered standard applies to containers of its generation alone; conflicts reach across volumes."""
    paths = []
    for version in ((1, 0), (1, 1), (2, 1), (3, 0)):
        path = str(tmp_path / f"v{version[0]}{version[1]}.aff4")
        w = ContainerWriter(path, version=version)
        name = f"{w.volume}/notguid"
        for kind in ("FileImage", "ZipSegment"):
            w.state(name, turtle.RDF_TYPE, K.SCHEMA_NS + kind)
        w.state(name, "size", "x", turtle.XSD + "long")
        w.state(w.volume, "contains", f"{w.volume}/nothing")
        w.state("aff4://shared", "chunkSize", str(512 + version[0]), turtle.XSD + "int")
        w.close()
        paths.append(path)
    found = {}
    for r in P.conformance(spark, paths).collect():
        found.setdefault(r["container"], set()).add((r["kind"], r["section"], r["other_specification"]))
    kinds = {p: {k for k, _, _ in x} for p, x in found.items()}
    assert set(kinds) == set(paths[:3])
    assert kinds[paths[0]] == kinds[paths[1]] == {"UnexpectedDatatype", "DanglingReference"}
    assert kinds[paths[2]] >= {"UnexpectedDatatype", "DanglingReference", "NonGuidArn", "MissingRecordedPath", "ConflictingStreamValue"}
    assert ("UnexpectedDatatype", "§2.2", None) in found[paths[0]] and ("NonGuidArn", None, "alpha §1.1") in found[paths[2]]
    assert [r["generation"] for r in P.generations(spark, paths).orderBy("container").collect()] == ["standard10", "logical", "alpha", None]


def test_states_follow_from_what_is_found(spark):
    """Every kind that a rule calls detected is emitted by the plans, and no other is."""
    import inspect
    import re

    from evspark.functions import scalars
    from evspark.operators import findings as D

    emitted = set(re.findall(r'"([A-Z][A-Za-z0-9]+)"', inspect.getsource(P.deviations) + inspect.getsource(P._volume_rules) + inspect.getsource(scalars.name_pair_rule)))
    assert emitted >= D.DETECTED and {k for *_, s, k, _ in D.rule_rows() if s == "Detected"} == D.DETECTED
