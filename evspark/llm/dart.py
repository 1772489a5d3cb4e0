"""Near-duplicate documents by DartMinHash.

A text is the weighted set of its five-word shingles, weighted by their counts. Each shingle owns a
region of weight and rank, cut into strips of doubling width, and hashed darts fall into each strip as
a Poisson process along the rank. A dart below the shingle's weight counts; it is dealt to one of
`coordinates` coordinates, and each coordinate keeps its earliest dart. Darts are thrown up to a rank
that gives all coordinates one, so a signature costs about k log k darts whatever the text's length,
and the share of coordinates in which two signatures agree estimates the generalised Jaccard
similarity: sum of least counts over sum of greatest counts.

Classes. Equal texts are one text, known by a 128-bit hash. Different texts that share a band of
signature coordinates are candidates. In each band's bucket all are held against two hubs, the member
that has most company over all its bands (as the original of a group of copies has) and a random one,
with the exact similarity of whole texts. Members of a bucket that this hasn't brought into one class
are then held against all members of other classes, so no candidate link between classes is left
untried, while a large group of copies costs a few comparisons a member. Before texts are fetched, a
pair's coordinates are compared by two bits each, 256 for hubs and 2048 for the rest, to which a hub's pair that
fails belongs too; a pair of similarity 0.8 fails either test more seldom than it shares no band, and the parameter
pretest leaves the test out. Of the rest, the three likeliest partners of a text are tried
first, and the others only if it is still in another class. Classes are the components of all links.

Defined cases. A null text counts as an empty one, and all texts without words are one class of
copies if equal, never near. A text of fewer than five words is one shingle. Repeated rows are exact
copies. A class's id is its least doc_id; a row with a null doc_id has no class of its own and takes
that of its text. Rows that share a doc_id are one document and so of one class. An empty table gives an empty one; columns besides doc_id and text don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.llm.common import drop_written, in_worker, join_groups, null_safe_text, numbered, slices, words_of, written

SHINGLE = 5
THRESHOLD = 0.8
#: 20 bands of 4: texts of similarity 0.8 share a band with probability 0.99998, of 0.4 with 0.4.
BANDS, ROWS = 20, 4
#: All coordinates of a signature; the bands take the first of them. Two bits of each, in longs of 32
#: coordinates, estimate a similarity to 0.03.
COORDINATES = 256
#: Coordinates of the finer signatures of texts in buckets of several classes; they estimate to 0.011.
FINE = 2048
#: Standard errors by which a pair's mismatches may pass those of similar texts: fewer are lost than by the bands.
MARGIN = 4.5
#: A random hub besides the central one in one of so many bands.
RANDOM_HUBS = 4

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def unit(h: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1)."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The weighted shingles of the texts: row, 64-bit hash, count; by row."""
    words, n = words_of(texts)
    code, known = numbered(words)
    names = pd.util.hash_array(known.to_numpy(zero_copy_only=False), categorize=False) if len(known) else np.zeros(0, np.uint64)
    h = names.astype(np.uint64)[code]
    start = np.cumsum(n) - n
    # Position by position over the first five words that remain in the row.
    m = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    at = np.arange(int(m.sum())) + np.repeat(start - (np.cumsum(m) - m), m)
    of = np.repeat(np.arange(len(texts)), m)
    length = np.minimum(n, SHINGLE)[of]
    out = mix64(length.astype(np.uint64) * _GOLD)
    for k in range(SHINGLE):
        inside = k < length
        nxt = h[np.minimum(at + k, len(h) - 1)] if len(h) else np.zeros(0, np.uint64)
        out = np.where(inside, mix64(out * _GOLD + nxt), out)
    # Equal shingles of a row become one with a count.
    order = np.lexsort((out, of))
    of, out = of[order], out[order]
    first = np.ones(len(out), bool)
    first[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
    ends = np.flatnonzero(np.append(first, True))
    return of[first], out[first], np.diff(ends)


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rows: int, coordinates: int) -> np.ndarray:
    """The DartMinHash signatures of `rows` weighted sets, as 64-bit ids of darts; zeros for a set
    without weight. Weights may be any positive numbers."""
    sums = np.bincount(row, weights=weight, minlength=rows)
    out = np.zeros((rows, coordinates), np.uint64)
    todo = np.flatnonzero(sums > 0)
    # The least power of two that gives each coordinate a dart with probability 0.9 or so.
    need = coordinates * (math.log(coordinates) + 2.0)
    limit = np.zeros(rows)
    limit[todo] = 2.0 ** np.ceil(np.log2(need / sums[todo]))
    while len(todo):
        chosen = np.zeros(rows, bool)
        chosen[todo] = True
        pick = chosen[row]
        best, ids = _throw(row[pick], element[pick], weight[pick], limit, rows, coordinates)
        done = todo[np.isfinite(best.reshape(rows, coordinates)[todo]).all(axis=1)]
        out[done] = ids.reshape(rows, coordinates)[done]
        todo = np.setdiff1d(todo, done, assume_unique=True)
        limit[todo] *= 2
    return out


def _throw(row, element, weight, limit, rows, coordinates):
    """All darts up to each row's limit of rank: the earliest rank by row and coordinate, and its dart."""
    best = np.full(rows * coordinates, np.inf)
    ids = np.zeros(rows * coordinates, np.uint64)
    level = 0
    while len(row):
        low, width = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
        a_row, seed, a_weight = row, mix64(element + np.uint64((level + 1) * int(_GOLD) % 2**64)), weight
        rank, turn = np.zeros(len(row)), 0
        while len(a_row):
            # Some turns at once where a strip has many darts to come; the darts are the same.
            left = (limit[a_row] - rank) * width
            turns = int(min(64, max(1.0, left.mean()), max(1, 400_000 // len(a_row))))
            seeds = mix64(seed[:, None] + np.arange(turn + 1, turn + turns + 1, dtype=np.uint64)[None, :] * _GOLD)
            ranks = np.cumsum(np.concatenate([rank[:, None], np.log(unit(seeds)) / -width], axis=1), axis=1)[:, 1:]
            alive = ranks <= limit[a_row][:, None]
            of, _ = np.nonzero(alive)
            dart, when = seeds[alive], ranks[alive]
            hit = low + unit(mix64(dart ^ _M2)) * width < a_weight[of]
            dart, when, of = mix64(dart[hit] ^ _M1), when[hit], of[hit]
            slot = a_row[of] * coordinates + (dart % np.uint64(coordinates)).astype(np.int64)
            np.minimum.at(best, slot, when)
            won = best[slot] == when
            ids[slot[won]] = dart[won]
            on, turn = alive[:, -1], turn + turns
            a_row, seed, rank, a_weight = a_row[on], seed[on], ranks[on, -1], a_weight[on]
        more = weight > low + width
        row, element, weight, level = row[more], element[more], weight[more], level + 1
    return best, ids


def bands(signature: np.ndarray, n_bands: int, n_rows: int) -> np.ndarray:
    """One 64-bit key for each band, in which the band's number takes part."""
    parts = signature.reshape(len(signature), n_bands, n_rows)
    key = np.broadcast_to(mix64(np.arange(1, n_bands + 1, dtype=np.uint64) * _GOLD), parts.shape[:2]).copy()
    for k in range(n_rows):
        key = mix64(key * _GOLD + parts[:, :, k])
    return key


def two_bits(signature: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, 32 coordinates to a long."""
    part = ((signature >> np.uint64(20)) & np.uint64(3)).reshape(len(signature), -1, 32)
    return (part << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64).view(np.int64)


def mismatches(a: Column, b: Column, coordinates: int = COORDINATES) -> Column:
    """In how many of the first coordinates two_bits() of two texts differ."""

    def differ(k: int) -> Column:
        z = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    return sum((differ(k) for k in range(1, coordinates // 32)), differ(0))


def most_mismatches(threshold: float, coordinates: int = COORDINATES) -> int:
    """MARGIN standard errors above what texts of similarity `threshold` have."""
    p = (1 - threshold) * 0.75
    return math.ceil(coordinates * p + MARGIN * math.sqrt(coordinates * p * (1 - p)))


def similarity(a: str, b: str) -> float:
    """Exact generalised Jaccard similarity of two texts."""
    row, element, count = shingles(pa.array([a, b]))
    x, y = (pd.Series(count[row == k], index=element[row == k]) for k in (0, 1))
    both = pd.concat([x, y], axis=1).fillna(0)
    total = both.max(axis=1).sum()
    return float(both.min(axis=1).sum() / total) if total else 0.0


def _text_key(text: Column) -> Column:
    return F.md5(text)


def sketches(docs: DataFrame, n_bands: int = BANDS, n_rows: int = ROWS) -> DataFrame:
    """doc_id, text_key (hash of the whole text), keys (array of band keys, empty without words) and bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20, 1000):
            row, element, count = shingles(batch.column("text"))
            n = batch.num_rows
            signed = signatures(row, element, count.astype(np.float64), n, COORDINATES)
            keys, bits = bands(signed[:, : n_bands * n_rows], n_bands, n_rows), two_bits(signed)
            has = np.bincount(row, minlength=n) > 0
            ends = np.concatenate([[0], np.cumsum(np.where(has, n_bands, 0))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[has].ravel().view(np.int64)))
            bits = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bits.shape[1], pa.int32()), pa.array(bits.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), lists, bits], names=["doc_id", "text_key", "keys", "bits"])

    text = null_safe_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _text_key(text).alias("text_key"))
    return rows.mapInArrow(in_worker("dart", work), "doc_id long, text_key string, keys array<long>, bits array<long>")


def finer(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and `fine`, the two_bits() of FINE coordinates, of the texts whose id is in ids(doc_id)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20, 64):
            row, element, count = shingles(batch.column("text"))
            bits = two_bits(signatures(row, element, count.astype(np.float64), batch.num_rows, FINE))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * bits.shape[1], pa.int32()), pa.array(bits.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "fine"])

    out = texts.join(ids, "doc_id", "left_semi").mapInArrow(in_worker("dart", work), "doc_id long, fine array<long>")
    # Of texts that share an id, one; they are one document.
    return written(out.groupBy("doc_id").agg(F.first("fine").alias("fine")), "fine")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents whose id is in ids(doc_id), written. Both sides grow with the
    corpus, so neither is broadcast at any size."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_safe_text().alias("text"))
    return written(texts.join(ids.hint("merge"), "doc_id", "left_semi"), "texts")


def linked(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs(a, b) of doc_ids whose whole texts are as similar as `threshold` or more.

    Texts, a written table, are joined to the pairs' ends, another, so that adaptive execution can
    split the many pairs of one hub."""
    b, a = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in ("b", "a"))
    both = pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), "text_a", 1 << 20):
                for part in slices(iter([batch]), "text_b", 1 << 20):
                    yield part.select(["a", "b"]).filter(pa.array(_similarities(part.column("text_a"), part.column("text_b")) >= threshold))

    return written(both.mapInArrow(in_worker("dart", work), "a long, b long"), "links")


def _similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    n = len(left)
    row, element, count = shingles(pa.concat_arrays([left, right]))
    side, row = row >= n, row % n
    order = np.lexsort((side, element, row))
    row, element, count, side = row[order], element[order], count[order], side[order]
    same = np.flatnonzero((row[1:] == row[:-1]) & (element[1:] == element[:-1]))
    least = np.bincount(row[same], weights=np.minimum(count[same], count[same + 1]), minlength=n)
    total = np.bincount(row, weights=count, minlength=n) - least
    return np.divide(least, total, out=np.zeros(n), where=total > 0)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, root (least node of its component) for all nodes of links(a, b).

    Alternating large and small stars: each round every node hands its neighbours the least node it
    knows. Only minima are gathered for a node, partly before the shuffle, so a node with a third of
    all links is no burden."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name)
    while True:
        before = edges.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        # Large star: larger neighbours of a node are linked to the least of its neighbourhood.
        both = edges.union(edges.select("v", "u"))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, name)
        # Small star: a node's smaller neighbours and the node itself are linked to the least of them.
        least2 = written(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least2.select("u", F.col("m").alias("v"))).distinct()
        nxt = written(small, name)
        drop_written(edges, least, large, least2)
        edges = nxt
        after = edges.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if before == after:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, class_id (least doc_id of the class) and class_size for each row of docs(doc_id, text).

    With pretest=False no pair of candidates is dropped by its signatures: every one that isn't yet in a class is
    held against its partner by exact similarity, at the cost of fetching their texts."""
    return classified(docs, **parameters).drop("text_key")


def classified(docs: DataFrame, threshold: float = THRESHOLD, n_bands: int = BANDS, n_rows: int = ROWS, pretest: bool = True) -> DataFrame:
    """classes() with text_key."""
    sketch = written(sketches(docs, n_bands, n_rows), "sketches")
    total = sketch.count()
    by_key = written(sketch.groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first(F.struct("keys", "bits")).alias("sketch")).select("text_key", "rep", "copies", "sketch.*"), "reps")
    reps = by_key.filter("rep is not null")
    members = reps.select(F.col("rep").alias("id"), F.explode("keys").alias("key"))
    full = written(members.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")).filter("n > 1"), "buckets")
    rows = total * n_bands
    inside = written(join_groups(members, full, "key", "n", rows).select("id", "key", "n"), "members")
    # A text's company: the members of all its buckets. The hub of a bucket has most of it.
    company = written(inside.groupBy("id").agg(F.sum("n").alias("company")), "company")
    ranked = written(inside.join(company, "id"), "ranked")
    central = F.max(F.struct("company", (-F.col("id")).alias("minus")))
    anyone = F.max(F.when(F.pmod("key", F.lit(RANDOM_HUBS)) == 0, F.struct(F.xxhash64("key", "id").alias("order"), "id")))
    hubs = ranked.groupBy("key").agg(central.alias("central"), anyone.alias("anyone"), F.count("*").alias("n")).select("key", F.array_distinct(F.array_compact(F.array(-F.col("central.minus"), F.col("anyone.id")))).alias("hubs"), "n")
    hubs = written(hubs, "hubs")
    bits = written(reps.join(company, reps["rep"] == company["id"]).select("id", "bits", "keys"), "bits")
    most = most_mismatches(threshold)
    star = join_groups(inside.select("id", "key"), hubs, "key", "n", rows).select("id", F.explode("hubs").alias("hub")).filter("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    side = lambda c: bits.select(F.col("id").alias(c), F.col("bits").alias(f"bits_{c}"))
    star = written(star.join(side("a"), "a").join(side("b"), "b").filter((mismatches(F.col("bits_a"), F.col("bits_b")) <= most) if pretest else F.lit(True)).select("a", "b"), "star")
    texts = texts_of(docs, company.select(F.col("id").alias("doc_id")))
    links = linked(star, texts, threshold)
    roots = components(links)
    # What a bucket holds besides its main class is held against all else in the bucket.
    named = written(inside.select("id", "key").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "key", F.coalesce("root", "id").alias("root")), "named")
    parts = written(named.groupBy("key", "root").agg(F.count("*").alias("n")), "parts")
    main = parts.groupBy("key").agg(F.max(F.struct("n", (-F.col("root")).alias("minus"))).alias("main"), F.count("*").alias("classes")).filter("classes > 1").select("key", (-F.col("main.minus")).alias("main"))
    main = written(main, "main")
    several = written(named.join(main, "key"), "unresolved")
    fine = finer(texts, several.select(F.col("id").alias("doc_id")).distinct())
    keyed = fine.join(bits.select(F.col("id").alias("doc_id"), "keys"), "doc_id").withColumnRenamed("doc_id", "id")
    unresolved, several = several, written(several.join(keyed, "id"), "several")
    drop_written(unresolved, fine)
    x = several.filter("root <> main").select("key", F.col("id").alias("x"), F.col("root").alias("x_root"), F.col("fine").alias("x_bits"), F.col("keys").alias("x_keys"))
    y = several.select("key", F.col("id").alias("y"), F.col("root").alias("y_root"), "main", F.col("fine").alias("y_bits"), F.col("keys").alias("y_keys"))
    # A pair is made in the first bucket that it shares, and only if its signatures may be near enough.
    shared = F.get(F.filter(F.arrays_zip("x_keys", "y_keys"), lambda z: z["x_keys"] == z["y_keys"]), F.lit(0))["x_keys"]
    near = (F.col("x_root") != F.col("y_root")) & ((F.col("y_root") == F.col("main")) | (F.col("x") < F.col("y")))
    if pretest:
        near = near & (mismatches(F.col("x_bits"), F.col("y_bits"), FINE) <= most_mismatches(threshold, FINE))
    apart = mismatches(F.col("x_bits"), F.col("y_bits"), FINE).alias("apart")
    pairs = x.withColumnRenamed("key", "x_key").join(y, (F.col("x_key") == F.col("key")) & near & (shared == F.col("key"))).select("x", "y", apart)
    pairs = written(pairs.withColumn("a", F.least("x", "y")).withColumn("b", F.greatest("x", "y")).join(star, ["a", "b"], "left_anti"), "pairs")
    # The likeliest partners come first: a text that one of them brings into a class needs no others there.
    likeliest = F.row_number().over(Window.partitionBy("x").orderBy("apart", "y")) <= 3
    first = written(pairs.withColumn("_first", likeliest).filter("_first").select("a", "b").distinct(), "first")
    second = linked(first, texts, threshold)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(second))
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    rest = pairs.select("a", "b").distinct().join(first, ["a", "b"], "left_anti").join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    rest = written(rest.filter("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b"), "rest")
    third = linked(rest, texts, threshold)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(third))
    named_texts = by_key.join(roots, by_key["rep"] == roots["node"], "left").select("text_key", "copies", F.coalesce("root", "rep").alias("class_id"))
    sizes = written(named_texts, "named_texts")
    size = sizes.groupBy("class_id").agg(F.sum("copies").alias("class_size"))
    by_text = written(sizes.join(size, "class_id", "left").withColumn("class_size", F.coalesce("class_size", "copies")), "by_text")
    out = join_groups(sketch.select("doc_id", "text_key"), by_text, "text_key", "copies", total)
    drop_written(full, inside, company, ranked, hubs, bits, star, links, named, parts, main, several, pairs, first, second, rest, third, texts, by_key, sizes)
    return out.select("doc_id", "text_key", "class_id", "class_size")


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """One row of docs for each class: that with the least doc_id, and of rows that share it, one. Texts
    that only rows without a doc_id have keep one such row each."""
    named = written(classified(docs, **parameters), "classified")
    kept = written(named.filter("doc_id = class_id").groupBy(F.col("doc_id").alias("_evspark_id")).agg(F.count("*").alias("_evspark_n")), "kept")
    any_repeat = kept.filter("_evspark_n > 1").limit(1).count()
    any_null = named.filter("doc_id is null and class_id is null").limit(1).count()
    own = F.col("doc_id").cast("long") == F.col("_evspark_id")
    # What is kept grows with the corpus, so it isn't broadcast at any size.
    out = docs.join(kept.filter("_evspark_n = 1").hint("merge"), own, "left_semi")
    if any_repeat:
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        several = docs.join(kept.filter("_evspark_n > 1").hint("merge"), own, "left_semi").groupBy(F.col("doc_id").cast("long"))
        out = out.unionByName(several.agg(F.min_by(row, F.xxhash64("text")).alias("_evspark_row")).select("_evspark_row.*"))
    if any_null:
        lone = named.filter("doc_id is null and class_id is null").select(F.col("text_key").alias("_evspark_text")).distinct()
        nameless = docs.filter("doc_id is null").withColumn("_evspark_key", _text_key(null_safe_text()))
        out = out.unionByName(nameless.join(lone, F.col("_evspark_key") == F.col("_evspark_text"), "left_semi").dropDuplicates(["_evspark_key"]).drop("_evspark_key"))
    return out
