"""Findings: hash checks, deviations, and the rules that they cite.

A finding is a row, never an exception. Rules are a fixed table of 83 rows, which is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rules: document, clause, number, requirement, the kind of deviation that cites it, and whether that is routine.
#: Documents: a standard 1.0a, paper 2019, standard 1.0 alpha. Fixed values.
RULES = """
standard|§1.1|1|Must||
standard|§1.1|2|Must||
standard|§2.2|1|Should|UntypedNumericLiteral|
standard|§2.2|2|Should|NonstandardDatatype|
standard|§2.2|3|Must|UnexpectedDatatype|
standard|§4|1|May|MapGap|
standard|§5|1|Must|DuplicateSegmentName|
standard|§5.1|1|Must|ByteRangeArn|
standard|§5.4|1|Must|ArnNotAtCommentStart|
standard|§5.4|2|Must|InconsistentVolumeArn|
standard|§5.4|3|Must|DescriptionNotFirst|
standard|§6.1|1|Must|DigestLengthMismatch|
standard|§6.2|1|May||
standard|§6.2|2|Must||
standard|§6.2|3|Must||
standard|§6.2|5|Must||
standard|§6.2|6|Must||
standard|§6.2|7|Must||
standard|§6.2|8|Must||
standard|§6.2|9|Must||
standard|§6.2|10|May||
standard|§6.2|11|Must||
standard|§6.2|12|Must||
standard|§6.2|13|May||
standard|§6.2|14|May||
standard|§6.2|15|Must||
standard|§7.1|1|May|ExternalReference|routine
standard|§7.1|2|Must|ConflictingStreamValue|
paper|§3.8|1|Must|MissingZipSegmentType|
standard|none|1|May|ContentAddressedSubject|
standard|none|2|May|DanglingReference|
standard|none|3|May||
alpha|§1.1|1|Must|NonGuidArn|
alpha|§1.1|2|Must|MissingRecordedPath|
alpha|§1.2|1|Must|EscapedV21MemberName|
alpha|§2|1|Must|UppercaseGuidArn|
alpha|§2|2|May||
alpha|§4.1|1|Must|WrongTermNamespace|
alpha|§4.1|2|May||
alpha|§4.2|1|May||
alpha|§4.2|2|May||
alpha|§4.3|1|May||
alpha|§4.3|2|May||
alpha|§4.3|3|May||
alpha|§4.3|4|May||
alpha|§4.3|5|May||
alpha|§4.3|6|May||
alpha|§4.4|1|May||
alpha|§4.4|2|Must||
alpha|§4.4|3|May||
alpha|§5|1|Must|RedundantRawName|
alpha|§5|2|Must|MissingRawName|
alpha|§5|3|Must|MalformedRawName|
alpha|§5|4|Must|ContradictoryRawName|
alpha|§5|5|Must|LowercaseNameEscape|
alpha|§5|6|May||
alpha|§6|1|Must||
alpha|§6|2|Must||
alpha|§6|3|Must|StorageFormNotFound|
alpha|§6|4|Must|AmbiguousStorageForm|
alpha|§6.1|1|Must|UnsupportedSegmentCompression|
alpha|§6.1|2|ShouldNot|OversizedZipSegment|
alpha|§6.1|3|Must|MissingZipSegmentHash|
alpha|§6.2|1|MustNot|OversizedResidentStream|
alpha|§6.2|2|May||
alpha|§6.3|1|May||
alpha|§6.3.1|1|Must||
alpha|§6.3.1|2|Must||
alpha|§6.4|1|May||
alpha|§7|1|May||
alpha|§8|1|Should|MultiPartNamingScheme|
alpha|§9|1|Must||
alpha|§9a|1|May||
alpha|§9a|2|May||
alpha|§9a.1|1|Must||
alpha|§10.1|1|Must|MissingMetadataHash|
alpha|§10.1|2|Must|WeakMetadataHash|
alpha|§10.2|1|May||
alpha|§10.2|2|Must||
alpha|§10.2|3|Must||
alpha|§10.2|4|Must||
alpha|§10.3|1|Must||
alpha|§10.3|2|Must||
""".strip().splitlines()

#: By generation of container, the document that governs it and the one layered over that. Fixed values.
GOVERNING = {"standard10": ("standard", None), "logical": ("standard", "paper"), "alpha": ("standard", "alpha")}

#: The kinds of deviations that this engine looks for; a rule's state follows from them.
DETECTED = frozenset("""
AmbiguousStorageForm ArnNotAtCommentStart ByteRangeArn ConflictingStreamValue ContentAddressedSubject ContradictoryRawName
DanglingReference DescriptionNotFirst DigestLengthMismatch DuplicateSegmentName EscapedV21MemberName ExternalReference
InconsistentVolumeArn LowercaseNameEscape MalformedRawName MissingMetadataHash MissingRawName MissingRecordedPath
MissingZipSegmentHash MissingZipSegmentType MultiPartNamingScheme NonGuidArn OversizedResidentStream OversizedZipSegment
RedundantRawName StorageFormNotFound UnexpectedDatatype UnsupportedSegmentCompression UppercaseGuidArn WeakMetadataHash
WrongTermNamespace
""".split())
#: Kinds that a verification notes, as they are no fault of the container.
NOTED = frozenset({"MapGap"})

RULE_COLUMNS = "document string, clause string, ordinal int, requirement string, state string, kind string, routine boolean"


def state_of(kind: str | None) -> str:
    """What this engine does about a rule."""
    return "Detected" if kind in DETECTED else "Noted" if kind in NOTED else "Unchecked"


def rule_rows() -> list[tuple]:
    return [(d, c, int(n), q, state_of(k or None), k or None, r == "routine") for d, c, n, q, k, r in (x.split("|") for x in RULES)]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), RULE_COLUMNS)


def governing(generation: Column, place: int) -> Column:
    """The document that governs a generation (0), or the one layered over that (1)."""
    out = F.lit(None).cast("string")
    for name, documents in GOVERNING.items():
        out = F.when(generation == name, F.lit(documents[place])).otherwise(out)
    return out


def in_force(deviations: DataFrame, rule_table: DataFrame) -> DataFrame:
    """deviations(kind, generation, ...) less those of kinds that are only a rule of the layered standard of another
    generation, and those of containers whose generation isn't known."""
    own = F.broadcast(rule_table.filter("kind is not null and document = 'alpha'").select("kind", F.lit(True).alias("_alpha")))
    out = deviations.filter("generation is not null").join(own, "kind", "left")
    return out.filter(F.col("_alpha").isNull() | (governing(F.col("generation"), 1) == "alpha")).drop("_alpha")


def cited(deviations: DataFrame, rule_table: DataFrame, generation: str | Column) -> DataFrame:
    """deviations(kind, ...) with the section of the governing document that they cite, or that of the
    document layered over it; null where neither has one. The generation is one for all, or a column."""
    g = F.lit(generation) if isinstance(generation, str) else generation
    r = F.broadcast(rule_table.filter("kind is not null").select("kind", "document", "clause", "requirement", "routine"))
    out = deviations.join(r, "kind", "left")
    section = F.when((F.col("document") == governing(g, 0)) & (F.col("clause") != "none"), F.col("clause"))
    other = F.when(F.col("document") == governing(g, 1), F.concat_ws(" ", "document", "clause"))
    return out.withColumn("section", section).withColumn("other_specification", other).drop("document", "clause")


def coverage_gaps(rule_table: DataFrame, generation: str) -> DataFrame:
    """Rules in scope that nothing detects, and whether any is binding."""
    scope = [d for d in GOVERNING[generation] if d]
    gaps = rule_table.filter(F.col("document").isin(*scope) & (F.col("state") != "Detected"))
    return gaps.groupBy("document", "state").agg(F.count("*").alias("rules"), F.bool_or(F.col("requirement").isin("Must", "MustNot")).alias("any_binding"))


def compare_digests(recorded: DataFrame, computed: DataFrame, keys: list[str]) -> DataFrame:
    """Checks by key (subject and algorithm): matched, mismatch, or not_verifiable where nothing was
    computed; what was computed without a record is no check. Digests are compared without case."""
    both = recorded.join(computed, keys, "left")
    outcome = F.when(F.col("actual").isNull(), "not_verifiable").when(F.lower("expected") == F.lower("actual"), "matched").otherwise("mismatch")
    return both.withColumn("outcome", outcome)


def severity(outcome: Column) -> Column:
    return F.when(outcome == "mismatch", 2).when(outcome == "not_verifiable", 1).otherwise(0)


def verdicts(checks: DataFrame, keys: list[str]) -> DataFrame:
    """By subject the worst outcome: any mismatch, else any that can't be verified, else a match."""
    worst = F.max(severity(F.col("outcome")))
    return checks.groupBy(*keys).agg(F.when(worst == 2, "mismatch").when(worst == 1, "not_verifiable").otherwise("matched").alias("verdict"), F.count("*").alias("checks"))


def digest_table(checks: DataFrame, subject: str, algorithms: list[str]) -> DataFrame:
    """A row for each subject, with recorded, computed and outcome for each algorithm."""
    cells = [F.first(F.when(F.col("algorithm") == a, F.col(c)), ignorenulls=True).alias(f"{a}_{c}") for a in algorithms for c in ("expected", "actual", "outcome")]
    return checks.groupBy(subject).agg(*cells)


def report_counters(checks: DataFrame) -> DataFrame:
    o = F.col("outcome")
    return checks.agg(F.count("*").alias("checked"), F.count_if(o == "matched").alias("matched"), F.count_if(o == "mismatch").alias("mismatched"), F.count_if(o == "not_verifiable").alias("not_verifiable"), F.count_distinct("algorithm").alias("algorithms"))


def undigested(images: DataFrame, checks: DataFrame, arn: str, subject: str) -> DataFrame:
    """Images that are neither the subject of a check nor the parent of one."""
    parent = F.regexp_extract(subject, r"^(.*)/[^/]*$", 1)
    named = checks.select(F.col(subject).alias(arn)).union(checks.select(parent.alias(arn))).distinct()
    return images.join(named, arn, "left_anti")


def deconflicted(files: DataFrame, path: str, order: list[str], into: str = "written") -> DataFrame:
    """files with a path that no other file has: the first of a path keeps it, later ones get " (2)", " (3)"
    and so on before the extension, passing over numbers whose path is another file's own."""
    pieces = F.regexp_extract(path, r"^(.*/)?([^/]*)$", 2)
    folder = F.left(F.col(path), F.length(path) - F.length(pieces))
    stem = F.regexp_extract(pieces, r"^(.+?)(\.[^.]*)?$", 1)
    end = F.substring(pieces, F.length(stem) + 1, F.length(path))
    # Numbers that files of their own already take, by the path that they would collide with.
    own = files.select(F.col(path).alias("_p")).distinct()
    m = r"^(.*) \((\d{1,9})\)(\.[^./]*)?$"
    number = F.regexp_extract("_p", m, 2)
    taken = own.filter(number != "").select(F.concat(F.regexp_extract("_p", m, 1), F.regexp_extract("_p", m, 3)).alias(path), number.try_cast("long").alias("_n"), number.alias("_text")).filter((F.col("_n") >= 2) & (F.col("_text") == F.col("_n").cast("string")))
    taken = taken.groupBy(path).agg(F.array_sort(F.collect_set("_n")).alias("_taken"))
    k = F.row_number().over(Window.partitionBy(path).orderBy(*order)).cast("long")
    rows = files.withColumn("_k", k).join(taken, path, "left")
    # The k-th number from 2 on that isn't taken.
    n = F.aggregate(F.coalesce("_taken", F.array().cast("array<bigint>")), F.col("_k"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    written = F.when(F.col("_k") == 1, F.col(path)).otherwise(F.concat(folder, stem, F.lit(" ("), n.cast("string"), F.lit(")"), end))
    return rows.withColumn(into, written).drop("_k", "_taken")
