"""Commands: info, verify, conformance, acquire, export, rules."""

from __future__ import annotations

import argparse
import contextlib
import os
import sys
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import TextIO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from evspark.operators import findings as D
from evspark.operators import objects as O
from evspark.plans import containers as P
from evspark.plans import render
from evspark.sources import container as K
from evspark.sources import files as S
from evspark.sources.writer import ContainerWriter

#: Exit codes: all well, a mismatch, something not verifiable, deviations, skipped files. Fixed values.
OK, MISMATCH, NOT_VERIFIABLE, DEVIATES, SKIPPED = 0, 3, 2, 4, 9


#: What one read asks of a file, and the parts that a set may have.
PIECE, MOST_PARTS = 1 << 20, O.MOST_PARTS


def part_name(out: str, k: int) -> str:
    """The name of a part of a set: the first has the set's own."""
    return out if k == 0 else f"{out}.{k}"


def _pieces(path: str) -> Iterator[bytes]:
    with open(path, "rb") as f:
        while piece := f.read(PIECE):
            yield piece


def acquire(spark: SparkSession, source: str, out: str, version: tuple[int, int] = (2, 1), dedupe: bool = False, part_size: int | None = None) -> tuple[list[str], int]:
    """A folder's files as a logical container, each in the form that its size asks for; the containers written and the
    number of files that had to be skipped. With `dedupe`, files too large for the metadata share a stream of distinct
    chunks. With `part_size` a container is ended after the file with which it reaches that size, and its set goes on
    in the next: each part holds its own files in whole. Files are read a piece at a time."""
    files = S.walk(spark, source).withColumn("form", O.storage_choice(F.col("size")))
    if part_size:
        parts = files.filter("kind = 'file'").agg(O.part_plan(F.sum("size"), F.lit(part_size))[0].alias("n")).head()["n"] or 0
        if parts > MOST_PARTS:
            raise ValueError(f"{parts} parts of {part_size} bytes are more than {MOST_PARTS}")
    new = lambda: ContainerWriter(part_name(out, len(names)), version=version, algorithms=("sha256", "md5"), codec="zlib")
    names, skipped = [], 0
    w = new()
    names.append(out)
    for r in files.orderBy("seq").toLocalIterator():
        skipped += r["kind"] == "skipped"
        if r["kind"] != "file":
            continue
        if part_size and w.written_bytes() >= part_size:
            w.close()
            w = new()
            names.append(part_name(out, len(names)))
        try:
            with open(r["path"], "rb"):  # one that can't be opened leaves no trace in the container
                pass
        except OSError:
            skipped += 1
            continue
        path = os.path.relpath(r["path"], source)
        raw, times = os.fsencode(path), {"lastWritten": datetime.fromtimestamp(r["modified"], UTC).isoformat().replace("+00:00", "Z")}
        if r["form"] == "in_metadata":
            with open(r["path"], "rb") as f:
                name = w.resident(path, f.read(), raw, times)
        elif r["form"] in ("no_content", "zip_segment") and not (dedupe and r["size"]):
            name = w.file_member(path, _pieces(r["path"]), raw, times)
        else:
            name = w.mapped(path, _pieces(r["path"]), "deduplicated" if dedupe else r["form"], raw, times)
        if version >= (2, 1):
            w.attributes(name, S.attributes(r["path"]))
    w.close()
    return names, skipped


def acquire_image(source: str, out: str) -> list[tuple[int, int]]:
    """A device or raw image as a disk image; the extents that could not be read, which its map leaves unknown."""
    w, sink = ContainerWriter(out, algorithms=("sha256", "md5"), codec="zlib"), None
    with open(source, "rb", buffering=0) as f:

        def read(at: int, n: int) -> bytes:
            f.seek(at)
            data = b"".join(iter(lambda: f.read(n - f.tell() + at), b""))
            if len(data) != n:
                raise OSError(f"{len(data)} of {n} bytes at {at}")
            return data

        size = f.seek(0, os.SEEK_END)
        blocks, bad = S.read_tolerantly(read, size)
        sink = w.open_stream()
        for block in blocks:
            sink.append(block)
    sink.close()
    entries, at = [], 0
    for start, length in bad:
        entries += [(at, start - at, at, 0)] * (start > at) + [(start, length, start, 1)]
        at = start + length
    w.image(entries + [(at, size - at, at, 0)] * (size > at), [sink.name, K.SCHEMA_NS + "UnreadableData"], size)
    w.close()
    return bad


def export(spark: SparkSession, paths: list[str], target: str) -> int:
    """Logical files below a target folder, with the times that are recorded; the number of files without bytes."""
    skipped, now, f = 0, None, None

    def done() -> None:
        if f:
            f.close()
            if now["lastWritten"]:
                with contextlib.suppress(ValueError):
                    t = datetime.fromisoformat(now["lastWritten"]).timestamp()
                    os.utime(f.name, (t, t))

    # Pieces of a file follow each other, so that one is open at a time.
    for r in P.export_files(spark, paths).repartitionByRange("written", "chunk_no").sortWithinPartitions("written", "chunk_no").toLocalIterator():
        if r["data"] is None:
            skipped += 1
            continue
        if now is None or r["written"] != now["written"]:
            done()
            path = os.path.join(target, r["written"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            now, f = r, open(path, "xb")
        f.write(r["data"])
    done()
    return skipped


class Tee:
    """What is printed, in a log file too."""

    def __init__(self, out: TextIO, path: str):
        self.out, self.log = out, open(path, "x", encoding="utf-8")

    def write(self, text: str) -> int:
        self.log.write(text)
        return self.out.write(text)

    def flush(self) -> None:
        self.log.flush()
        self.out.flush()


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="evspark")
    sub = a.add_subparsers(dest="command", required=True)
    for name in ("info", "verify", "conformance"):
        s = sub.add_parser(name)
        s.add_argument("paths", nargs="+")
        s.add_argument("--format", choices=("text", "json"), default="text")
        s.add_argument("--brief", action="store_true")
        if name == "info":
            s.add_argument("--full-listing", metavar="FILE", help="write the whole listing to a new file")
        if name == "verify":
            s.add_argument("--digests", metavar="FILE", help="write a table of the files' digests to a new file")
        s.add_argument("--generation", choices=tuple(D.GOVERNING), default=None, help="cite by this one instead of each container's own")
    s = sub.add_parser("acquire")
    s.add_argument("source")
    s.add_argument("out")
    s.add_argument("--image", action="store_true", help="the source is a device or raw image")
    s.add_argument("--dedupe", action="store_true", help="store chunks that are alike once")
    s.add_argument("--part-size", type=int, help="bytes after which a container is ended and the next begun")
    s.add_argument("--verify", action="store_true", help="verify what was written")
    s = sub.add_parser("export")
    s.add_argument("target")
    s.add_argument("paths", nargs="+")
    s.add_argument("--image", help="the map to export as a raw image, instead of files")
    sub.add_parser("rules")
    a.add_argument("--log", metavar="FILE", help="write what is printed to a new file too")
    o = a.parse_args(argv)
    if not o.log:
        return run(o)
    tee = Tee(sys.stdout, o.log)
    with contextlib.redirect_stdout(tee), tee.log:
        return run(o)


def _verified(spark: SparkSession, paths: list[str], as_json: bool, digests: str | None = None) -> int:
    checks, notes = P.verify(spark, paths).persist(), P.notes(spark, paths)
    for line in render.rows_json(checks=checks, notes=notes, counters=D.report_counters(checks)) if as_json else render.verification_text(checks, notes):
        print(line)
    if digests:
        with open(digests, "x", encoding="utf-8") as f:
            f.writelines(f"{line}\n" for line in render.digests_text(spark, paths, checks))
    worst = checks.agg(F.max(D.severity(F.col("outcome")))).head()[0] or 0
    return {2: MISMATCH, 1: NOT_VERIFIABLE}.get(worst, OK)


def run(o: argparse.Namespace) -> int:
    if o.command == "rules":
        print(render.rules_markdown())
        return OK
    spark = SparkSession.builder.appName("evspark").getOrCreate()
    if o.command == "info":
        if o.full_listing:
            with open(o.full_listing, "x", encoding="utf-8") as f:
                f.writelines(f"{line}\n" for line in render.info_text(spark, o.paths, False))
        if o.format == "json":
            print(render.info_json(spark, o.paths))
        else:
            for line in render.info_text(spark, o.paths, o.brief):
                print(line)
        return OK
    if o.command == "verify":
        return _verified(spark, o.paths, o.format == "json", o.digests)
    if o.command == "conformance":
        found = P.conformance(spark, o.paths, o.generation).persist()
        for line in render.rows_json(deviations=found) if o.format == "json" else render.conformance_text(found):
            print(line)
        return DEVIATES if found.filter("not coalesce(routine, false)").limit(1).count() else OK
    if o.command == "acquire":
        names, skipped = ([o.out], len(acquire_image(o.source, o.out))) if o.image else acquire(spark, o.source, o.out, dedupe=o.dedupe, part_size=o.part_size)
        worst = _verified(spark, names, False) if o.verify else OK
        return MISMATCH if worst == MISMATCH else SKIPPED if skipped else worst
    if o.image:
        size = K.read(spark, o.paths, "map_entries").filter(F.col("map") == o.image).agg(F.max(F.col("offset") + F.col("length"))).head()[0] or 0
        P.export_image(spark, o.paths, o.image, size, o.target)
        return OK
    return SKIPPED if export(spark, o.paths, o.target) else OK


if __name__ == "__main__":
    sys.exit(main())
