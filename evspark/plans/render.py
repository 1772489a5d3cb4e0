"""Reports as text, JSON and Markdown. Reports are of metadata, a row at a time from Spark."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.functions import scalars as S
from evspark.operators import findings as D
from evspark.operators import objects as O
from evspark.plans import containers as P
from evspark.sources import container as K


def info_text(spark: SparkSession, paths: list[str], brief: bool = False) -> Iterator[str]:
    """Objects by container and role; a brief report counts, and shows three of each role."""
    o = P.info(spark, paths)
    yield from _identity(spark, paths, o)
    counts = o.groupBy("container", "role").count().orderBy("container", F.desc("count"), "role")
    for r in counts.toLocalIterator():
        yield f"{r['container']}: {r['count']} {r['role']}"
    rows = o
    if brief:
        rows = O.first_of_each(o, ["container", "role"], ["first_seq"], 3)
    for r in rows.orderBy("container", "first_seq").toLocalIterator():
        yield f"{r['subject']}  {r['role']}" + (f"  {r['size']} bytes" if r["size"] is not None else "")
        for d in r["digests"]:
            yield f"    {d['algorithm']} {d['digest']}"
        for p in r["properties"]:
            yield f"    {p['name']}: {p['value']}"


def _identity(spark: SparkSession, paths: list[str], objects: DataFrame) -> Iterator[str]:
    """What each container is: its name, version, tool and content."""
    content = F.get(F.filter("properties", lambda p: p["name"] == "contentType"), F.lit(0))["value"]
    kinds = O.content_types(objects, ["container"], content)
    for r in K.read(spark, paths, "volumes").join(kinds, "container", "left").orderBy("container").toLocalIterator():
        version = f"{r['major']}.{r['minor']}" if r["major"] is not None and r["minor"] is not None else "no version"
        yield f"{r['container']}: {r['description'] or r['comment'] or 'no name'}, {version}, written by {r['tool'] or 'no tool'}, {r['content_type'] or 'not stated'}"


def rows_json(**tables: DataFrame) -> Iterator[str]:
    """One JSON document with a list for each table, a row a line, from Spark a partition at a time."""
    yield "{"
    for i, (name, rows) in enumerate(tables.items()):
        yield f'{", " if i else ""}"{name}": ['
        held = None
        for line in rows.toJSON().toLocalIterator():
            if held is not None:
                yield held + ","
            held = line
        yield from () if held is None else (held,)
        yield "]"
    yield "}"


def digests_text(spark: SparkSession, paths: list[str], checks: DataFrame) -> Iterator[str]:
    """Recorded and computed digests of logical files as tab-separated lines below a heading, by container and recorded path."""
    algorithms = [r[0] for r in checks.filter("role = 'FileImage'").select("algorithm").distinct().orderBy("algorithm").collect()]
    named = P.recorded_paths(spark, paths)
    wide = D.digest_table(checks.filter("role = 'FileImage' and property = 'hash'").withColumn("file", F.struct("container", "subject")), "file", algorithms)
    wide = wide.select("file.*", *[c for c in wide.columns if c != "file"]).join(named, ["container", "subject"], "left")
    columns = ["container", "recorded", "subject", *[c for c in wide.columns if c not in ("container", "recorded", "subject")]]
    yield "\t".join(columns)
    line = F.concat_ws("\t", *[F.coalesce(S.tsv_escape(F.col(c)), F.lit("")) for c in columns])
    for r in wide.orderBy("container", "recorded", "subject").select(line.alias("line")).toLocalIterator():
        yield r["line"]


def info_json(spark: SparkSession, paths: list[str]) -> str:
    """{"containers": [...], "errors": [...]}, both always there."""
    objects: dict[str, list] = {p: [] for p in paths}
    for line in P.info(spark, paths).orderBy("container", "first_seq").select("container", F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        objects[line["container"]].append(json.loads(line["j"]))
    errors = [{"container": r["container"], "member": r["name"], "severity": r["severity"], "detail": r["detail"]} for r in K.read(spark, paths, "problems").collect()]
    return json.dumps({"containers": [{"path": p, "objects": x} for p, x in objects.items()], "errors": errors})


def verification_text(checks: DataFrame, notes: DataFrame | None = None) -> Iterator[str]:
    for r in checks.orderBy("container", "subject", "algorithm").toLocalIterator():
        yield f"{r['outcome']:15} {r['algorithm']:8} {r['subject']}" + (f"  expected {r['expected']} found {r['actual']}" if r["outcome"] == "mismatch" else "")
    for r in notes.toLocalIterator() if notes is not None else ():
        yield f"note: {r['kind']} {r['subject']}: {r['detail']}"
    c = D.report_counters(checks).head()
    yield f"{c['checked']} checked, {c['matched']} matched, {c['mismatched']} mismatched, {c['not_verifiable']} not verifiable"


def conformance_text(deviations: DataFrame) -> Iterator[str]:
    for r in deviations.orderBy("container", "kind", "subject").toLocalIterator():
        where = r["section"] or r["other_specification"] or "no clause"
        yield f"{r['kind']} ({where}): {r['subject'] or r['container']}" + (f": {r['detail']}" if r["detail"] else "")


def rules_markdown() -> str:
    """The catalogue of rules by document, and how many of them something checks."""
    rows, out = D.rule_rows(), []
    for document in dict.fromkeys(r[0] for r in rows):
        out += [f"## {document}", "", "| clause | requirement | state | kind |", "| --- | --- | --- | --- |"]
        out += [f"| {c} ({n}) | {q} | {s} | {k or ''} |" for d, c, n, q, s, k, _ in rows if d == document] + [""]
    out.append(f"{sum(r[4] == 'Detected' for r in rows)} of {len(rows)} rules have a check.")
    return "\n".join(out)
