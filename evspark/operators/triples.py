"""Metadata triples: rows (subject, predicate, obj_kind, obj_lexical, obj_datatype, seq).

obj_kind is iri or literal, seq the place in the source. Subjects are grouped by one shuffle; every
look-up of another subject is an equi join, and every "is it there" a semi or anti join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Local names of the XSD datatypes that hold whole numbers. Fixed values.
INTEGERS = ("long", "int", "unsignedLong", "unsignedInt", "short", "byte", "integer")


#: Statements that a task makes and groups. Fixed value.
TASK = 500_000


def unpivot(rows: DataFrame, subject: Column, order: Column, values: list[tuple[str, str, Column, str]], tasks: int | None = None) -> DataFrame:
    """A triple for each (predicate, kind, value, datatype) of each row; seq is the row's order times 16
    plus the place in the list. Null values make no triple. With `tasks`, rows are first dealt by subject to so many."""
    if len(values) > 16:
        raise ValueError("16 values at most")
    names = [f"_v{i}" for i in range(len(values))]
    named = rows.select(subject.alias("subject"), order.cast("long").alias("o"), *[v.cast("string").alias(n) for n, (_, _, v, _) in zip(names, values, strict=True)])
    each = [F.struct(F.lit(p).alias("predicate"), F.lit(k).alias("obj_kind"), F.col(n).alias("obj_lexical"), F.lit(d).alias("obj_datatype"), F.lit(i).alias("i")) for i, (n, (p, k, _, d)) in enumerate(zip(names, values, strict=True))]
    out = (named.repartition(tasks, "subject") if tasks else named).select("subject", "o", F.explode(F.array(*each)).alias("t"))
    return out.filter("t.obj_lexical is not null").select("subject", "t.predicate", "t.obj_kind", "t.obj_lexical", "t.obj_datatype", (F.col("o") * 16 + F.col("t.i")).alias("seq"))


def unpivot_dealt(sources: list[tuple[DataFrame, Column, Column, list[tuple[str, str, Column, str]]]]) -> DataFrame:
    """The triples of several tables, for grouping by subject: a subject is one task's, and a task has TASK statements or
    so at most, however few files the tables are in. Tables of equal numbers of tasks are united task by task."""
    tasks = -(-sum(rows.count() * len(values) for rows, _, _, values in sources) // TASK)
    tasks = max(tasks, sources[0][0].sparkSession.sparkContext.defaultParallelism)
    return reduce(DataFrame.unionByName, [unpivot(*source, tasks=tasks) for source in sources])


def count_by_predicate(statements: DataFrame) -> DataFrame:
    """By predicate and kind: statements, distinct subjects and distinct objects. Each distinct count is an aggregate of
    its own, so no statement is held for both; that of subjects stays where they are, if dealt by subject."""
    by = ["predicate", "obj_kind"]
    subjects = statements.groupBy(*by, "subject").agg(F.count("*").alias("n")).groupBy(*by).agg(F.sum("n").alias("statements"), F.count("subject").alias("subjects"))
    objects = statements.select(*by, "obj_lexical").distinct().groupBy(*by).agg(F.count("obj_lexical").alias("objects"))
    return subjects.join(objects, by)


def exactly_one(statements: DataFrame, keys: list[str], value: str) -> DataFrame:
    """By keys, the value if there is exactly one statement, else null; and how many there are."""
    out = statements.groupBy(*keys).agg(F.count("*").alias("n"), F.first(value).alias("v"))
    return out.select(*keys, "n", F.when(F.col("n") == 1, F.col("v")).alias("value"))


def as_whole_number(lexical: Column, datatype: Column) -> Column:
    """The number of a literal whose datatype is a whole number's and whose text is one of 64 bits; null
    otherwise. Numbers beyond a long stay null, as findings."""
    wide = F.when(datatype.isin(*INTEGERS) & lexical.rlike(r"^\+?[0-9]{1,20}$"), lexical.try_cast("decimal(20,0)"))
    return F.when(wide < F.lit("9223372036854775808").cast("decimal(20,0)"), wide.cast("long"))


def build_objects(statements: DataFrame, type_predicate: str = "type", size_predicate: str = "size") -> DataFrame:
    """An object for each subject: types (in order), size (the last one stated wins), properties in order
    of statement, and the place of its first statement."""
    s = statements
    is_type, is_size = s["predicate"] == type_predicate, s["predicate"] == size_predicate
    prop = F.struct("seq", F.concat_ws("=", "predicate", "obj_lexical").alias("text"))
    out = s.groupBy("subject").agg(
        F.min("seq").alias("first_seq"),
        F.array_sort(F.collect_list(F.when(is_type, F.struct("seq", "obj_lexical")))).alias("types"),
        F.max(F.when(is_size, F.struct("seq", as_whole_number(F.col("obj_lexical"), F.col("obj_datatype")).alias("v")))).alias("size"),
        F.array_sort(F.collect_list(F.when(~is_type & ~is_size, prop))).alias("props"),
    )
    return out.select("subject", "first_seq", F.transform("types", lambda t: t["obj_lexical"]).alias("types"), F.col("size.v").alias("size"), F.transform("props", lambda p: p["text"]).alias("properties"))


def subjects_of_type(statements: DataFrame, kind: str) -> DataFrame:
    """Statements of the subjects that have the type."""
    typed = statements.filter((F.col("predicate") == "type") & (F.col("obj_lexical") == kind)).select("subject").distinct()
    return statements.join(typed, "subject", "left_semi")


def dangling(statements: DataFrame, predicates: list[str], subjects: DataFrame) -> DataFrame:
    """Statements that refer by one of the predicates to an IRI that no subject has."""
    refs = statements.filter(F.col("predicate").isin(*predicates) & (F.col("obj_kind") == "iri"))
    return refs.join(subjects.select(F.col("subject").alias("obj_lexical")).distinct(), "obj_lexical", "left_anti")


def merge_declarations(rows: DataFrame, key: list[str], strength: str, order: list[str]) -> DataFrame:
    """Of several declarations of a key the strongest; of equally strong ones the first in order."""
    w = Window.partitionBy(*key).orderBy(F.col(strength).desc(), *order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def first_conflict(rows: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """By key, the first value and the first value that differs from it, where there is one."""
    w = Window.partitionBy(*key).orderBy(*order)
    marked = rows.withColumn("first_value", F.first(value).over(w)).withColumn("_n", F.row_number().over(w))
    other = marked.filter(F.col(value) != F.col("first_value"))
    return other.groupBy(*key).agg(F.min_by("first_value", "_n").alias("first_value"), F.min_by(value, "_n").alias("other_value"))


def held_by_all(rows: DataFrame, holder: str, item: str) -> DataFrame:
    """Items that every holder has. The number of holders is one row, joined by broadcast."""
    n = rows.agg(F.count_distinct(holder).alias("n"))
    return rows.groupBy(item).agg(F.count_distinct(holder).alias("held")).join(F.broadcast(n), F.col("held") == F.col("n"), "left_semi").select(item)


def longest_prefix(rows: DataFrame, text: str, prefixes: DataFrame, prefix: str, longest: int) -> DataFrame:
    """rows with the longest of the prefixes that the text starts with, or null. Prefixes are looked up
    by equality: each text offers its starts, which are `longest` at most, not each prefix each text."""
    sizes = [r[0] for r in prefixes.select(F.length(prefix)).distinct().limit(longest + 1).collect()]
    if len(sizes) > longest:
        raise ValueError(f"more than {longest} lengths of prefixes")
    if not sizes:
        return rows.withColumn("best_prefix", F.lit(None).cast("string"))
    starts = rows.select(text).distinct().select(text, F.explode(F.array(*[F.substring(text, 1, n) for n in sorted(sizes)])).alias(prefix)).filter(F.length(prefix) > 0)
    found = starts.join(prefixes.select(prefix).distinct(), prefix).groupBy(text).agg(F.max_by(prefix, F.length(prefix)).alias("best_prefix"))
    return rows.join(found, text, "left")
