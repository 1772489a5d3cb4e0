"""Evidence containers as tables.

A container is a ZIP archive with a description, a version, metadata in Turtle, and streams: chunks in
segments ("bevies") with an index each, maps of 28-byte entries with a list of targets, or whole files as
members. ContainerSource is a Python data source: the driver reads only the archive's directory and
deals members to partitions; workers read the bytes. Paths may be any that pyarrow's file systems open.

Tables (option `table`): segments, statements, members (name, kind, the resource that owns it, data), map_entries,
map_targets, chunk_index, stored_chunks (as they are stored; the plan that joins them to their streams decodes them)
and volumes. What can't be read is left out there and is a row of the table `problems`, never a failure.

Options prune what is opened: `kinds` names the kinds of members to read, and `only` lists streams with the first and
last bevy that is wanted. The driver deals out names from the directory, so what is pruned is never read.
"""

from __future__ import annotations

import contextlib
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from evspark.sources import turtle

#: Namespace of the terms, and the fixed names of members. Fixed values of the format.
SCHEMA_NS = "http://aff4.org/Schema#"
SCHEME = "aff4://"
DESCRIPTION, VERSION, METADATA, METADATA_HASHES = "container.description", "version.txt", "information.turtle", "information.turtle.hashes"
CODEC_IRIS = {"http://code.google.com/p/snappy/": "snappy", "https://www.ietf.org/rfc/rfc1950.txt": "zlib", "https://code.google.com/p/lz4/": "lz4", SCHEMA_NS + "NullCompressor": "stored"}

#: Declared sizes beyond this, or ratios beyond the other, are refused.
MOST_BYTES, MOST_RATIO = 1 << 30, 1000

#: Bytes that metadata may hold itself. Fixed value.
MOST_RESIDENT = 1024

SCHEMAS = {
    "segments": "container string, pos long, name string, kind string, method int, compressed long, uncompressed long, header_offset long",
    "statements": "container string, seq long, subject string, predicate string, obj_kind string, obj_lexical string, obj_datatype string",
    "members": "container string, name string, kind string, owner string, data binary",
    "map_entries": "container string, map string, ord long, offset long, length long, target_offset long, target_id long",
    "map_targets": "container string, map string, target_id long, kind string, target string",
    "chunk_index": "container string, stream string, bevy long, place long, offset long, length long",
    "stored_chunks": "container string, stream string, bevy long, place long, data binary",
    "volumes": "container string, comment string, description string, major int, minor int, tool string, namespace string, metadata_hashes string",
    "problems": "container string, name string, severity string, detail string",
}

_KINDS = [
    ("description", r"container\.description"),
    ("version", r"version\.txt"),
    ("metadata", r"information\.turtle"),
    ("metadata_hashes", r"information\.turtle\.hashes"),
    ("bevy_index", r"(?:.*/)?\d{8}(?:\.index|/index)"),
    ("block_hash", r"(?:.*/)?\d{8}\.blockHash\.\w+"),
    ("bevy", r"(?:.*/)?\d{8}"),
    ("map_structure", r"(?:.*/)(?:map|idx|mapPath)"),
    ("file", r".*[^/]"),
    ("folder", r".*/"),
]


def kind_of(name: str) -> str:
    """What a member is, by the first rule that its name meets."""
    return next((kind for kind, pattern in _KINDS if re.fullmatch(pattern, name, re.S)), "other")


@contextlib.contextmanager
def opened(path: str) -> Iterator[zipfile.ZipFile]:
    """The archive at a path or URI."""
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with where.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
        yield z


def member(z: zipfile.ZipFile, name: str) -> bytes:
    """A member in full, within the bounds on size and ratio."""
    info = z.getinfo(name)
    if info.file_size > MOST_BYTES or info.file_size > MOST_RATIO * max(1, info.compress_size):
        raise ValueError(f"{name} declares {info.file_size} bytes from {info.compress_size}")
    return z.read(info)


def volume_name(z: zipfile.ZipFile) -> str | None:
    """The volume's name: its description's, else the archive comment's."""
    if DESCRIPTION in z.namelist():
        return member(z, DESCRIPTION).decode("utf-8", "replace").strip("\0 \r\n\t") or None
    return z.comment.decode("utf-8", "replace").strip("\0 \r\n\t") or None


def version_of(text: str) -> tuple[int | None, int | None, str | None]:
    """Major and minor number and tool of a version member: lines of key=value, a later one counts."""
    rows = dict(x.split("=", 1) for x in re.split(r"\r\n|\r|\n", text) if "=" in x)
    number = lambda k: int(rows[k].strip()) if rows.get(k, "").strip().isdigit() else None
    return number("major"), number("minor"), rows.get("tool")


def member_name(name: str, volume: str | None) -> str:
    """The member that a resource's name stands for."""
    if volume and name.startswith(volume.rstrip("/") + "/"):
        return name[len(volume.rstrip("/")) + 1 :].replace("%20", " ")
    from evspark.functions.raw import escape_component_text

    m = re.match(r"([a-z0-9+.-]+://[^/]*)/?(.*)", name, re.S)
    return name if not m else escape_component_text(m[1]) + (f"/{m[2]}" if m[2] else "")


def decode_entries(data: bytes) -> np.ndarray:
    """Entries of a map: offset, length, target_offset (u64) and target_id (u32), little-endian."""
    if len(data) % 28:
        raise ValueError(f"{len(data)} bytes are no whole number of map entries")
    return np.frombuffer(data, dtype=np.dtype([("offset", "<u8"), ("length", "<u8"), ("target_offset", "<u8"), ("target_id", "<u4")]))


def decode_index(data: bytes) -> np.ndarray:
    """Places of a bevy's chunks: offset (u64) and length (u32), little-endian."""
    if not data or len(data) % 12:
        raise ValueError(f"{len(data)} bytes are no whole number of index entries")
    return np.frombuffer(data, dtype=np.dtype([("offset", "<u8"), ("length", "<u4")]))


def target_kind(target: str) -> str:
    """What a map's target is."""
    tail = re.split(r"[#/]", target)[-1]
    if target.startswith("aff4:sha512:") or target.startswith("aff4:sha256:"):
        return "block_hash"
    if tail in ("Zero", "FF") or tail.startswith("SymbolicStream") or re.fullmatch(r"[0-9A-Fa-f]{2}", tail):
        return "repeated_byte"
    if tail in ("UnknownData", "UnreadableData"):
        return "unknown"
    return "stored" if target.startswith(SCHEME) else "unrecognised"


#: What may go wrong with a member that is read. A damaged one is a finding about it.
_DAMAGE = (ValueError, KeyError, EOFError, zipfile.BadZipFile, zlib.error, struct.error, NotImplementedError)


class _Part(InputPartition):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["paths"].split("\n") if p]
        self.table = options.get("table", "segments")
        self.members = int(options.get("members_per_partition", 64))
        self.kinds = set(options["kinds"].split(",")) if options.get("kinds") else None
        self.only = {s: (first, last) for s, first, last in json.loads(options["only"])} if options.get("only") else None

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        wanted = {"members": None, "map_entries": r"(?:.*/)?map", "map_targets": r"(?:.*/)?idx", "chunk_index": r"(?:.*/)?\d{8}(?:\.index|/index)", "stored_chunks": r"(?:.*/)?\d{8}"}
        for path in self.paths:
            if self.table not in wanted:
                out.append(_Part(path, []))
                continue
            try:
                with opened(path) as z:
                    names = [n for n in dict.fromkeys(z.namelist()) if wanted[self.table] is None or re.fullmatch(wanted[self.table], n, re.S)]
                    names = [n for n in names if self._asked(z, n)]
            except (OSError, pa.ArrowException, *_DAMAGE):
                continue
            out += [_Part(path, names[i : i + self.members]) for i in range(0, len(names), self.members)]
        return out or [_Part("", [])]

    def _asked(self, z: zipfile.ZipFile, name: str) -> bool:
        if self.kinds is not None and kind_of(name) not in self.kinds:
            return False
        if self.only is None or self.table != "stored_chunks":
            return True
        first, last = self.only.get(self._owner(z, name), (1, 0))
        return first <= int(name[-8:]) <= last

    def read(self, partition: _Part) -> Iterator[tuple]:
        if not partition.path:
            return
        try:
            with opened(partition.path) as z:
                yield from getattr(self, f"_{self.table}")(z, partition)
        except (OSError, pa.ArrowException, *_DAMAGE) as e:
            if self.table == "problems":
                yield partition.path, None, "io" if isinstance(e, OSError) else "malformed", str(e)[:500]

    def _segments(self, z, p):
        for i, info in enumerate(z.infolist()):
            yield p.path, i, info.filename, kind_of(info.filename), info.compress_type, info.compress_size, info.file_size, info.header_offset

    def _statements(self, z, p):
        """The statements up to the first error, which is a problem."""
        if METADATA in z.NameToInfo:
            with contextlib.suppress(*_DAMAGE):
                for s in turtle.parse(member(z, METADATA).decode("utf-8", "replace")):
                    yield p.path, s.seq, s.subject, s.predicate, s.obj_kind, s.obj_lexical, s.obj_datatype

    def _members(self, z, p):
        for name in p.names:
            with contextlib.suppress(*_DAMAGE):
                yield p.path, name, kind_of(name), self._owner(z, name), member(z, name)

    def _owner(self, z, path: str) -> str:
        if not hasattr(self, "_volume") or self._volume[0] is not z:
            self._volume = z, volume_name(z) or ""
        folder = path.rsplit("/", 1)[0]
        return f"{self._volume[1].rstrip('/')}/{folder}" if not folder.startswith("aff4%3A") else folder.replace("%3A", ":").replace("%2F", "/")

    def _map_entries(self, z, p):
        for name in p.names:
            with contextlib.suppress(*_DAMAGE):
                owner = self._owner(z, name)
                for i, r in enumerate(decode_entries(member(z, name)).tolist()):
                    if max(r[:3]) < 1 << 63:
                        yield p.path, owner, i, *r

    def _map_targets(self, z, p):
        for name in p.names:
            with contextlib.suppress(*_DAMAGE):
                lines = [x.strip() for x in member(z, name).decode("utf-8", "replace").splitlines()]
                for i, target in enumerate(x for x in lines if x):
                    yield p.path, self._owner(z, name), i, target_kind(target), target

    def _chunk_index(self, z, p):
        for name in p.names:
            with contextlib.suppress(*_DAMAGE):
                bevy = name.removesuffix(".index").removesuffix("/index")
                for i, (offset, length) in enumerate(decode_index(member(z, name)).tolist()):
                    yield p.path, self._owner(z, bevy), int(bevy[-8:]), i, offset, length

    def _stored_chunks(self, z, p):
        for name in p.names:
            with contextlib.suppress(*_DAMAGE):
                index = next(n for n in (f"{name}.index", f"{name}/index", "") if n in z.NameToInfo or not n)
                places = decode_index(member(z, index)).tolist() if index else []
                data = member(z, name) if places else b""
                for i, (offset, length) in enumerate(places):
                    # A place beyond the bevy has no bytes: null, as what can't be decoded will be.
                    yield p.path, self._owner(z, name), int(name[-8:]), i, data[offset : offset + length] if offset + length <= len(data) else None

    def _volumes(self, z, p):
        names = z.NameToInfo
        text = lambda n: member(z, n).decode("utf-8", "replace") if n in names else None
        major, minor, tool = version_of(text(VERSION) or "")
        head = text(METADATA) or ""
        # The algorithms that the companion of the metadata names, or null where there is none.
        try:
            rows = list(turtle.parse(text(METADATA_HASHES))) if METADATA_HASHES in names else None
        except ValueError:
            rows = []
        hashes = None if rows is None else ",".join(re.split("[#/]", s.obj_datatype or "")[-1].lower() for s in rows if re.split("[#/]", s.predicate)[-1] == "hash" and s.obj_kind == "literal")
        yield p.path, z.comment.decode("utf-8", "replace") or None, text(DESCRIPTION), major, minor, tool, turtle.prefixes(head).get("aff4"), hashes

    def _problems(self, z, p):
        for name in dict.fromkeys(z.namelist()):
            try:
                yield from ((p.path, name, "malformed", detail) for detail in self._faults(z, name))
            except _DAMAGE as e:
                yield p.path, name, "unsupported" if isinstance(e, NotImplementedError) else "malformed", str(e)[:500]
        if VERSION not in z.NameToInfo:
            yield p.path, VERSION, "unsupported", "no version is declared: older than the standard"

    def _faults(self, z, name: str) -> Iterator[str]:
        data = member(z, name)
        if name == METADATA:
            for _ in turtle.parse(data.decode("utf-8", "replace")):
                pass
        elif name == VERSION:
            major, minor, _ = version_of(data.decode("utf-8", "replace"))
            if major is None or minor is None:
                yield "no whole numbers for major and minor"
        elif kind_of(name) == "bevy_index":
            bevy = z.NameToInfo.get(name.removesuffix(".index").removesuffix("/index"))
            beyond = sum(o + n > bevy.file_size for o, n in decode_index(data).tolist()) if bevy else 0
            if beyond:
                yield f"{beyond} chunks lie beyond the bevy's {bevy.file_size} bytes"
        elif kind_of(name) == "bevy":
            if not {f"{name}.index", f"{name}/index"} & z.NameToInfo.keys():
                yield "a bevy without an index"
        elif re.fullmatch(r"(?:.*/)?map", name):
            rows = decode_entries(data)
            idx = name[:-3] + "idx"
            n = sum(1 for x in member(z, idx).splitlines() if x.strip()) if idx in z.NameToInfo else 0
            for i, r in enumerate(rows.tolist()):
                if max(r[:3]) >= 1 << 63 or r[0] + r[1] >= 1 << 63:
                    yield f"entry {i} reaches beyond 2^63"
                elif r[3] >= n:
                    yield f"entry {i} names target {r[3]} of {n}"


class ContainerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evidence"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "segments")]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, paths: list[str], table: str, kinds: str | None = None, only: list | None = None) -> DataFrame:
    """A table of containers; of members those of the kinds (a list with commas), of stored chunks those of the
    streams and bevies (stream, first, last)."""
    spark.dataSource.register(ContainerSource)
    reader = spark.read.format("evidence").option("paths", "\n".join(paths)).option("table", table)
    if kinds is not None:
        reader = reader.option("kinds", kinds)
    return (reader if only is None else reader.option("only", json.dumps(only))).load()
