"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its words, each weighted by how often it occurs times its length, so that
long words tell more than the short ones that all texts share. For each of `samples` samples every
word owns, by hash alone, r and c from Gamma(2, 1) and b from U(0, 1). With weight w the sample gives
t = floor(ln w / r + b), y = exp(r (t - b)) and a = c / (y exp(r)); the word with the least a, with its
t, is the sample. Two texts agree in a sample with the probability of their generalised Jaccard
similarity, sum of least over sum of greatest weights, so the share of samples in which fingerprints
agree estimates it with a standard error of 0.5 / sqrt(samples) at most.

All is DataFrame expressions. ln a is scaled to an integer whose low bits are a hash of (word, t),
so that a sample is a plain min() over longs, computed by generated code in a hash aggregate. A word's row
is repeated for every AT_ONCE samples, so that this code stays small enough for the JVM to compile. Texts are
dealt by their key once, and all aggregates use that partitioning.

Defined cases. A null text counts as an empty one. Texts without words have the fingerprint of zeros,
which is like itself (1) and unlike any other (0). Equal texts have equal fingerprints, and so have
texts with the same words as often. Fingerprints need no unique ids: rows are keyed by the caller.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.llm.common import WORD_GAPS, drop_written, null_safe_text, written

SAMPLES = 48
#: Samples that one row computes: the code generated for more outgrows what the JVM compiles.
AT_ONCE = 8
_HASH = (1 << 31) - 1
#: ln a, which lies between -128 and 4, in steps of 2^-23.
_SCALE, _LEAST = float(1 << 23), 128.0
_LOW32, _MID21, _LOW22 = (1 << 32) - 1, (1 << 21) - 1, (1 << 22) - 1


def _uniform(bits: Column, n: int) -> Column:
    """Uniform in (0, 1) from an integer of n bits."""
    return (bits.cast("double") + F.lit(0.5)) * F.lit(1.0 / (1 << n))


def _seeds(i: int) -> tuple[int, int]:
    """Two fixed 62-bit numbers for each sample."""
    digest = hashlib.sha256(f"sample {i}".encode()).digest()
    return int.from_bytes(digest[:8], "big") >> 2, int.from_bytes(digest[8:16], "big") >> 2


def _samples(i: int, weights: list[str]) -> list[Column]:
    """The packed (ln a, hash of word and t) of a row's term for sample i of its turn, for each column of the
    logarithm of a weight; null where that is null. One hash holds the two uniforms of r, another those of c and b, and all
    weights share them; ln needs no guard, as no uniform is 0."""
    h1, h2 = (F.xxhash64(F.col("term").bitwiseXOR(F.lit(seed))) for seed in _seeds(i))
    r = -F.ln(_uniform(F.shiftrightunsigned(h1, 32), 32) * _uniform(h1.bitwiseAND(F.lit(_LOW32)), 32))
    c = -F.ln(_uniform(F.shiftrightunsigned(h2, 43), 21) * _uniform(F.shiftrightunsigned(h2, 22).bitwiseAND(F.lit(_MID21)), 21))
    b = _uniform(h2.bitwiseAND(F.lit(_LOW22)), 22)

    def sample(ln_w: Column) -> Column:
        t = F.floor(ln_w / r + b)
        ln_a = F.ln(c) - r * (t.cast("double") - b) - r
        scaled = ((ln_a + F.lit(_LEAST)) * F.lit(_SCALE)).cast("long")
        word_and_t = h1.bitwiseXOR(F.shiftleft(t, 20)).bitwiseAND(F.lit(_HASH))
        return F.shiftleft(scaled, 31).bitwiseOR(word_and_t)

    return [sample(F.col(w)) for w in weights]


def fingerprints(parts: DataFrame, keys: list[str], sides: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and, for each of `sides`, the signature (array of `samples` ints) of a set of words.

    `parts`(keys..., text, one boolean column for each of `sides`) holds the texts that the sets are made of and
    to which of them each belongs, so that a part of several sets is counted once. It should be partitioned by
    some of the keys. A set without words has the signature null; keys without any words aren't returned."""
    words = parts.select(*keys, *sides, F.explode(F.split(F.col("text"), WORD_GAPS)).alias("word")).filter("word <> ''")
    letters = F.length("word")
    counted = words.groupBy(*keys, F.xxhash64("word").alias("term")).agg(*[F.sum(F.when(F.col(s), letters).otherwise(F.lit(0))).alias(s) for s in sides])
    # The logarithm of no weight is null, and min() passes over it. Each turn has hashes of its own of the term.
    turns = -(-samples // AT_ONCE)
    weighted = counted.select(*keys, "term", *[F.ln(F.col(s).cast("double")).alias(s) for s in sides], F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
    weighted = weighted.select(*keys, "turn", F.xxhash64("term", "turn").alias("term"), *sides)
    packed = [F.min(x).alias(f"{s}{i}") for i in range(AT_ONCE) for s, x in zip(sides, _samples(i, sides), strict=True)]
    least = weighted.groupBy(*keys, "turn").agg(*packed)
    part = lambda s: F.when(F.col(f"{s}0").isNotNull(), F.array(*[F.col(f"{s}{i}").bitwiseAND(F.lit(_HASH)).cast("int") for i in range(AT_ONCE)])).alias(s)
    turned = least.select(*keys, F.struct("turn", *[part(s) for s in sides]).alias("x")).groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return turned.select(*keys, *[F.when(F.col("x")[0][s].isNotNull(), F.slice(F.flatten(F.col(f"x.{s}")), 1, samples)).alias(s) for s in sides])


def as_text(signature: Column, samples: int = SAMPLES) -> Column:
    """A fingerprint as 8 hex digits for each sample."""
    digits = F.transform(signature, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0"))
    return F.when(signature.isNull(), F.lit("0" * 8 * samples)).otherwise(F.concat_ws("", digits))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples in which two fingerprints' signatures agree; null is an empty text's."""
    agree = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(agree / F.lit(float(samples)))


def successors(keys: DataFrame, by: list[str]) -> DataFrame:
    """keys with next_<c> for each of the columns `by`: those of the next row in descending order of the
    first and ascending order of the rest, nulls last; the last row's next is the first.

    Rows are dealt by ranges, ordered inside each, and only the heads of the ranges, one for each
    partition, pass through the driver."""
    order = [F.col(by[0]).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in by[1:]]]
    ranged = written(keys.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    whole = Window.partitionBy("_range").orderBy(*order)
    inside = ranged.withColumn("_row", F.row_number().over(whole)).withColumn("_next", F.lead(F.struct(*by)).over(whole))
    inside = written(inside, "inside")
    drop_written(ranged)
    heads = [(r["_range"], r["head"]) for r in inside.filter("_row = 1").select("_range", F.struct(*by).alias("head")).orderBy("_range").collect()]
    after = [(a, b) for (a, _), (_, b) in zip(heads, heads[1:] + heads[:1], strict=True)]
    follows = keys.sparkSession.createDataFrame(after, f"_range int, _head {inside.schema['_next'].dataType.simpleString()}")
    out = inside.join(F.broadcast(follows), "_range").withColumn("_next", F.coalesce("_next", "_head"))
    return out.select(*keys.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in by])


#: Characters of text that a task of the fingerprint query holds about, with the edited text's.
TASK_CHARS = 6_000_000


def edited(docs: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Each document of docs(doc_id, text) with its edited text: the last half of it, rounded down, is
    replaced by as much of the front of the next document in descending doc_id.

    Returns (name, tag, text, half, front), dealt by name (the id, or the least long for null) and tag (a hash of
    the text), where `front` replaces the last `half` characters, and the table of keys: doc_id, name, tag, n_chars,
    copies, next_name, next_tag. Rows alike in id and text are one document. Only the front that is needed is sent to the document that it goes into;
    every use of the dealt texts asks for the same columns, so they are shuffled once."""
    text = null_safe_text()
    name = lambda c: F.coalesce(F.col(c), F.lit(-(1 << 63)))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tag", F.xxhash64("text"))
    keys = written(base.groupBy("doc_id", "tag").agg(F.first(F.length("text").cast("long")).alias("n_chars"), F.count("*").alias("copies")), "keys")
    facts = keys.agg(F.sum("n_chars"), F.max("copies")).head()
    if (facts[1] or 1) > 1:
        base = base.dropDuplicates(["doc_id", "tag"])
    tasks = tasks or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(facts[0] or 0) // TASK_CHARS))
    order = successors(keys, ["doc_id", "tag"]).withColumn("name", name("doc_id")).withColumn("next_name", name("next_doc_id")).drop("next_doc_id")
    order = written(order, "order")
    drop_written(keys)
    dealt = base.select(name("doc_id").alias("name"), "tag", "text").repartition(tasks, "name", "tag")
    wanted = order.select(F.col("name").alias("to_name"), F.col("tag").alias("to_tag"), F.col("next_name").alias("name"), F.col("next_tag").alias("tag"), F.floor(F.col("n_chars") / 2).cast("int").alias("half")).repartition(tasks, "name", "tag")
    fronts = dealt.join(wanted.hint("shuffle_hash"), ["name", "tag"]).select(F.col("to_name").alias("name"), F.col("to_tag").alias("tag"), "half", F.expr("left(text, half)").alias("front"))
    both = dealt.join(fronts.repartition(tasks, "name", "tag").hint("shuffle_hash"), ["name", "tag"])
    return both.select("name", "tag", "text", "half", "front"), order


#: All of a text up to its last white space.
_HEAD = r"(?s)^.*[\x20\x09-\x0D]"


def compared(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Per row of docs(doc_id, text): n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next.

    What a text and its edited text have in common, up to the last white space, is cut into words and counted once."""
    texts, order = edited(docs)
    kept = F.expr("left(text, length(text) - half)")
    plain = texts.select("name", "tag", F.sha2(F.concat(kept, "front").cast("binary"), 256).alias("edited_sha256"))
    cut = texts.select("name", "tag", "text", "front", kept.alias("kept"), F.regexp_extract(kept, _HEAD, 0).alias("head"))
    after = F.length("head") + 1
    part = lambda text, a, b: F.struct(text.alias("text"), F.lit(a).alias("plain"), F.lit(b).alias("edited"))
    three = F.array(part(F.col("head"), True, True), part(F.substring("text", after, F.length("text")), True, False), part(F.concat(F.substring("kept", after, F.length("kept")), "front"), False, True))
    parts = cut.select("name", "tag", F.explode(three).alias("x")).select("name", "tag", "x.*")
    signed = fingerprints(parts, ["name", "tag"], ["plain", "edited"], samples)
    table = written(plain.join(signed, ["name", "tag"], "left"), "signatures")
    nexts = table.select(F.col("name").alias("next_name"), F.col("tag").alias("next_tag"), F.col("plain").alias("next"))
    full = table.join(order, ["name", "tag"]).join(nexts, ["next_name", "next_tag"])
    full = full.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return full.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("plain"), samples).alias("fingerprint"), as_text(F.col("edited"), samples).alias("edited_fingerprint"), likeness(F.col("plain"), F.col("edited"), samples).alias("near_edited"), likeness(F.col("plain"), F.col("next"), samples).alias("near_next"))
