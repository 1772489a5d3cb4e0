"""Sharding by size-tiered compaction.

A store is a folder with immutable Parquet shards under data/ and a versioned manifest under
manifest/. Each arrival is appended as small shards. Shards of similar size, those of one tier (the
power of `fanout` that their size over the least size has), are merged when a tier holds `fanout` of
them, in runs that come near the target size and don't exceed it; shards of the target size or nearly so
are left alone. So a row is rewritten once for each tier, a logarithm of the target over an arrival's size.

A version is committed by writing its manifest under a temporary name and renaming it to v<number>.json;
a rename that finds the name taken fails, and the writer reads the new version and tries again. Readers
see a whole version or none. A manifest says what it adds to the version before and removes from it, and every
WHOLE_EVERY-th lists all shards, so that a commit costs what it changes. A merge commits only if the shards that it
read are still current. They stay, for readers of older versions, until expire() deletes the versions that name them.
A job that dies leaves files that no manifest names; vacuum() removes them.

Bytes never pass the driver: it holds the list of shards. A round of merges is one
Spark job in which each task reads the shards of one run and writes one file; nothing is shuffled.

Defined cases. Any columns that Parquet can hold, whatever their names, and any nulls are kept as they are; repeated
rows stay. An empty arrival commits a version without new shards, and an empty store reads as an empty table. Row
order is not kept. Reading a version that has expired raises FileNotFoundError.
"""

from __future__ import annotations

import json
import math
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from evspark.llm.common import new_path

#: Every so many versions a manifest lists all shards.
WHOLE_EVERY = 16


class Shard(NamedTuple):
    path: str  # relative to the store
    bytes: int
    rows: int


class Manifest(NamedTuple):
    version: int
    schema: str  # of the rows, as JSON
    shards: tuple[Shard, ...]


class Conflict(Exception):
    """Another writer has changed the shards that a merge has read."""


class Store:
    """target_bytes: size of finished shards; least_bytes: below which all shards are of the lowest
    tier; fanout: how many shards of a tier are merged, and the factor between tiers."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, least_bytes: int = 1 << 20, fanout: int = 4):
        self.spark, self.root, self.target, self.least, self.fanout = spark, root, target_bytes, least_bytes, fanout

    # -- files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[tuple[str, int]]:
        fs, p = self._fs(f"{self.root}/{folder}")
        return [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(p)] if fs.exists(p) else []

    def _read_text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    # -- versions

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n, _ in self._names("manifest") if n.startswith("v") and n.endswith(".json"))

    def _manifest(self, version: int) -> dict:
        return json.loads(self._read_text(f"{self.root}/manifest/v{version:010d}.json"))

    def at(self, version: int) -> Manifest:
        """A version, put together from the last whole list and what came after it."""
        if version not in self.versions():
            raise FileNotFoundError(f"{self.root}, version {version}")
        later = [self._manifest(version)]
        while "shards" not in later[-1]:
            later.append(self._manifest(later[-1]["version"] - 1))
        shards = {s[0]: Shard(*s) for s in later[-1]["shards"]}
        for x in reversed(later[:-1]):
            for path in x["removed"]:
                del shards[path]
            shards |= {s[0]: Shard(*s) for s in x["added"]}
        return Manifest(version, later[0]["schema"], tuple(shards.values()))

    def current(self) -> Manifest | None:
        versions = self.versions()
        return self.at(versions[-1]) if versions else None

    def commit(self, manifest: Manifest, before: Manifest | None = None) -> bool:
        """Whether the manifest became its version; false if another one has. `before` is the version that it
        follows, without which all shards are listed."""
        body: dict = {"version": manifest.version, "schema": manifest.schema}
        if before is None or before.version != manifest.version - 1 or manifest.version % WHOLE_EVERY == 0:
            body["shards"] = manifest.shards
        else:
            old, new = {s.path for s in before.shards}, {s.path for s in manifest.shards}
            body |= {"added": [s for s in manifest.shards if s.path not in old], "removed": sorted(old - new)}
        fs, _ = self._fs(self.root)
        path = lambda p: self.spark._jvm.org.apache.hadoop.fs.Path(p)
        final, temporary = path(f"{self.root}/manifest/v{manifest.version:010d}.json"), path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        try:
            out.write(bytearray(json.dumps(body).encode()))
        finally:
            out.close()
        try:
            done = not fs.exists(final) and fs.rename(temporary, final)
        except Exception:  # file systems differ in how they refuse
            done = False
        if not done:
            fs.delete(temporary, False)
        return bool(done)

    # -- data

    def _sizes(self, folder: str) -> list[Shard]:
        """The shards that a job has written into a folder, with rows counted by their footers."""
        files = {n: size for n, size in self._names(folder) if n.endswith(".parquet")}
        if not files:
            return []
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
        rows = {r[0]: r[1] for r in self.spark.read.parquet(f"{self.root}/{folder}").groupBy(name.alias("f")).count().collect()}
        return [Shard(f"{folder}/{n}", size, rows.get(n, 0)) for n, size in sorted(files.items()) if rows.get(n, 0)]

    def append(self, folder: str, schema: StructType) -> Manifest:
        """Commits the files that a job has written into a folder of the store."""
        new = self._sizes(folder)
        while True:
            now = self.current()
            nxt = Manifest(now.version + 1, now.schema, (*now.shards, *new)) if now else Manifest(0, schema.json(), tuple(new))
            if self.commit(nxt, now):
                return nxt

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(1, size) / self.least, self.fanout)) + 1) if size > self.least else 0

    def runs(self, shards: tuple[Shard, ...]) -> list[list[Shard]]:
        """Shards to merge now: by tier, smallest first, in runs of `fanout` or more up to the target."""
        tiers: dict[int, list[Shard]] = {}
        for s in sorted(shards, key=lambda s: (s.bytes, s.path)):
            if s.bytes * 2 <= self.target:
                tiers.setdefault(self.tier(s.bytes), []).append(s)
        out = []
        for same in tiers.values():
            run: list[Shard] = []
            size = 0
            for s in same:
                if run and size + s.bytes > self.target:
                    out.append(run)
                    run, size = [], 0
                run.append(s)
                size += s.bytes
            if len(run) >= self.fanout:
                out.append(run)
        return [r for r in out if len(r) > 1]

    def merge(self) -> Manifest | None:
        """One round of merges, or None if no tier is full."""
        now = self.current()
        runs = self.runs(now.shards) if now else []
        if not runs:
            return None
        schema, folder = StructType.fromJson(json.loads(now.schema)), f"data/{uuid.uuid4().hex}"
        parts = [self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in run]).coalesce(1) for run in runs]
        for k in range(0, len(parts), 200):  # a plan of some hundred scans is enough for one job
            whole = parts[k]
            for p in parts[k + 1 : k + 200]:
                whole = whole.unionByName(p)
            whole.write.mode("append").option("compression", "zstd").parquet(f"{self.root}/{folder}")
        new, old = self._sizes(folder), {s.path for run in runs for s in run}
        if sum(s.rows for s in new) != sum(s.rows for run in runs for s in run):
            raise RuntimeError("a merge must keep all rows")
        while True:
            now = self.current()
            if not old <= {s.path for s in now.shards}:
                raise Conflict(folder)
            nxt = Manifest(now.version + 1, now.schema, (*(s for s in now.shards if s.path not in old), *new))
            if self.commit(nxt, now):
                return nxt

    def compact(self) -> Manifest | None:
        """Merges until no tier is full."""
        while self.merge():
            pass
        return self.current()

    def expire(self, keep: int = 2) -> int:
        """Deletes all versions but the last `keep`, and the shards that only those name; their readers must be
        done. Returns how many shards."""
        versions = self.versions()
        gone, kept = versions[:-keep], versions[-keep:]
        if not gone:
            return 0
        named = {s.path for v in kept for s in self.at(v).shards}
        dead = {s.path for v in gone for s in self.at(v).shards} - named
        whole = self.at(kept[0])
        for path in sorted(dead):
            fs, p = self._fs(f"{self.root}/{path}")
            fs.delete(p, False)
        # The first version that is kept must stand by itself. Readers find the old text or the new one.
        if "shards" not in self._manifest(kept[0]):
            self._replace(whole)
        for v in gone:
            fs, p = self._fs(f"{self.root}/manifest/v{v:010d}.json")
            fs.delete(p, False)
        return len(dead)

    def _replace(self, manifest: Manifest) -> None:
        """The same version listed whole."""
        fs, p = self._fs(f"{self.root}/manifest/v{manifest.version:010d}.json")
        out = fs.create(p, True)
        try:
            out.write(bytearray(json.dumps({"version": manifest.version, "schema": manifest.schema, "shards": manifest.shards}).encode()))
        finally:
            out.close()

    def vacuum(self) -> int:
        """Deletes files under data/ that no version names; only when no writer is at work."""
        n = 0
        kept = {s.path for v in self.versions() for s in self.at(v).shards}
        for folder, _ in self._names("data"):
            for name, _ in self._names(f"data/{folder}"):
                if f"data/{folder}/{name}" not in kept:
                    fs, p = self._fs(f"{self.root}/data/{folder}/{name}")
                    n += bool(fs.delete(p, False))
        return n

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the current version or an older one."""
        now = self.current() if version is None else self.at(version)
        if now is None:
            raise FileNotFoundError(self.root)
        schema = StructType.fromJson(json.loads(now.schema))
        if not now.shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in now.shards])


def arrivals(table: DataFrame, store: Store, waves: int) -> list[str]:
    """The rows of a table as `waves` folders of small files, in one pass. A row's wave is a hash of the
    row, so every wave has a like share of every source."""
    quoted = [(f.dataType, F.col("`" + f.name.replace("`", "``") + "`")) for f in table.schema.fields]
    # Maps have no hash.
    values = [F.to_json(F.struct(c)) if _has_map(kind) else c for kind, c in quoted]
    root = f"{store.root}/data"
    name = uuid.uuid4().hex
    key = f"_wave_{name}"  # no column of the table's
    rows = table.withColumn(key, F.pmod(F.xxhash64(*values), F.lit(waves)))
    rows.write.option("compression", "zstd").partitionBy(key).parquet(f"{root}/{name}")
    fs, _ = store._fs(root)
    out = []
    for k in range(waves):
        old, new = (store._fs(p)[1] for p in (f"{root}/{name}/{key}={k}", f"{root}/{name}-{k}"))
        if fs.exists(old) and fs.rename(old, new):
            out.append(f"data/{name}-{k}")
    fs.delete(store._fs(f"{root}/{name}")[1], True)
    return out


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType) or (isinstance(kind, ArrayType) and _has_map(kind.elementType))


def sharded(table: DataFrame, waves: int = 8, **parameters) -> Store:
    """A new store in the shared folder to which the table's rows have come in waves, merged after each."""
    spark = table.sparkSession
    store = Store(spark, new_path(spark, "shards"), **parameters)
    store.commit(Manifest(0, table.schema.json(), ()))
    for folder in arrivals(table, store, waves):
        store.append(folder, table.schema)
        store.merge()
        store.expire()
    store.compact()
    store.expire()
    store.vacuum()
    return store
