"""Mixing overlapping sources to target weights by min-cost flow.

A document may belong to several sources, and a source wants so many words. Documents are aggregated
by membership pattern (the sorted set of their sources); only that small table reaches the driver.
There a flow network joins each pattern to its sources and each source to its quota. A pattern offers
its words once for nothing, a second time at a cost, a third time at a higher one, so that the
cheapest full flow repeats as little as it can. Each pattern's flow is then turned into documents:
every document is taken the whole number of times, and a seeded order takes documents once more until
the rest is met, the last place going to the document that fits it best.

Sizes are words (runs of anything but ASCII white space). The seeded order is found through a
histogram of hash buckets, so no task sorts the documents of one pattern.

Defined cases. A null text has size 0 and is never taken. A null source is a source of its own, after
all others. Repeated rows all count; rows alike in id, size and pattern are chosen or left together. A table without words takes
nothing, an empty table gives an empty one. Other columns don't matter.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.llm.common import WORD_GAPS, drop_written, null_safe_text, written

#: A document's words are used so many times at most.
MAX_REPEATS = 3
#: What the first, second and third use of a word cost: convex.
REPEAT_COSTS = (0, 1, 3)


def words(text: str = "text") -> Column:
    """Number of words, by the lengths of the text with and without its gaps' runs made one."""
    t = F.trim(F.regexp_replace(null_safe_text(text), WORD_GAPS, " "))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def weighted_targets(sizes: list[int], weights: list[int], total: int, most: int = MAX_REPEATS) -> list[float]:
    """total dealt out by weight, no part above `most` times its size; the excess is dealt anew by
    weight among the others until none is above."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        all_weights = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / all_weights > most * sizes[i]}
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / all_weights
            break
        for i in over:
            targets[i] = float(most * sizes[i])
        left -= sum(targets[i] for i in over)
        open_ -= over
    return targets


def min_cost_flow(patterns: dict[tuple, int], quotas: dict, costs: tuple[int, ...] = REPEAT_COSTS) -> dict[tuple, int]:
    """Words that each pattern gives, so that the quotas get as much as they can for the least cost.

    An edge from the source to a pattern has one parallel part for each use of its words, with that use's cost;
    no other edge costs anything. A cheapest augmenting path therefore costs what the use that it begins with
    does, and taking cheapest paths first means: a maximum flow over first uses, augmented by one with second
    uses, then by one with third uses. Each is Dinic's, on one connected part of the network at a time.
    """
    given = {p: 0 for p in patterns}
    for part in _connected(patterns, quotas):
        given |= _flow_of(part, {q: int(quotas[q]) for p in part for q in p if q in quotas}, len(costs), sorted(range(len(costs)), key=lambda k: costs[k]))
    return given


def _connected(patterns: dict[tuple, int], quotas: dict) -> list[dict[tuple, int]]:
    """The patterns in groups that have no source in common; those without words or quota are left out."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for p, size in patterns.items():
        own = [q for q in p if q in quotas] if size else []
        for q in own:
            root.setdefault(q, q)
            root[find(q)] = find(own[0])
    parts: dict = defaultdict(dict)
    for p, size in patterns.items():
        if own := [q for q in p if q in quotas] if size else []:
            parts[find(own[0])][p] = size
    return list(parts.values())


def _flow_of(patterns: dict[tuple, int], quotas: dict, uses: int, order: list[int]) -> dict[tuple, int]:
    """The flow of one connected part, use by use."""
    names = list(patterns)
    place = {q: len(names) + k for k, q in enumerate(quotas)}
    left = [quotas[q] for q in quotas]  # of each source's edge to its quota
    offered = [0] * len(names)  # words of a pattern that may still flow
    # Edges between a pattern and a source: capacity is no limit that way; `back` flows against it.
    ends: list[list[int]] = [[] for _ in range(len(names) + len(place))]
    to: list[int] = []
    flow: list[int] = []
    for i, p in enumerate(names):
        for q in p:
            if q in place:
                ends[i].append(len(to))
                ends[place[q]].append(len(to))
                to.append(place[q])
                flow.append(0)
    start = [i for i, p in enumerate(names) for q in p if q in place]
    given = [0] * len(names)
    for _ in order[:uses]:
        for i, p in enumerate(names):
            offered[i] += patterns[p]
        while _blocking(len(names), ends, start, to, flow, offered, left, given):
            pass
    return dict(zip(names, given, strict=True))


def _blocking(n: int, ends: list, start: list, to: list, flow: list, offered: list, left: list, given: list) -> bool:
    """One phase of Dinic's algorithm: levels from all patterns with words on offer, then a blocking flow."""
    level = [-1] * len(ends)
    front = [i for i in range(n) if offered[i]]
    for i in front:
        level[i] = 0
    first, reached = list(front), False
    while front and not reached:
        after = []
        for a in front:
            for e in ends[a]:
                b = to[e] if a < n else start[e]
                if level[b] < 0 and (a < n or flow[e]):
                    level[b] = level[a] + 1
                    after.append(b)
        front = after
        reached = any(b >= n and left[b - n] for b in front)
    if not reached:
        return False
    at = [0] * len(ends)
    for i in first:
        while offered[i]:
            path, a = [], i
            while True:
                if a >= n and left[a - n]:
                    most = min([offered[i], left[a - n], *(flow[e] for e, down in path if not down)])
                    for e, down in path:
                        flow[e] += most if down else -most
                    offered[i] -= most
                    left[a - n] -= most
                    given[i] += most
                    break
                while at[a] < len(ends[a]):
                    e = ends[a][at[a]]
                    b = to[e] if a < n else start[e]
                    if level[b] == level[a] + 1 and (a < n or flow[e]):
                        path.append((e, a < n))
                        a = b
                        break
                    at[a] += 1
                else:
                    if not path:
                        break
                    e, down = path.pop()
                    a = start[e] if down else to[e]
                    at[a] += 1
            if not path and at[i] >= len(ends[i]):
                break
    return True


def order_of(seed: int) -> Column:
    """A document's place in the seeded order: a hash of its id and size."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))


#: Bits of the order that name its bucket: 4096 buckets for each pattern, in 64 blocks.
BUCKET_BITS = 12
#: Filling ends when what is left of a pattern's rest is below this share of it, or fits no document.
CLOSE = 0.0005
LAST = (1 << 63) - 1


def choice(docs: DataFrame, given: dict[tuple, int], sizes: dict[tuple, int], seed: int) -> DataFrame:
    """By pattern, what tells how often a document of docs(doc_id, size, pattern) is used: `whole`, how
    often every document is; `rounds`, by which documents are used once more, those of size `most` or
    less whose order is `upto` or less; and `last`, the order of one more such document.

    Each round fills what is left with the documents that it could hold, in their order, until the next
    one would be too many; what then is left is less than that document, and the next round passes over
    such. The table, as small as that of patterns, is made by the driver.
    """
    spark, whole, left, rounds, last = docs.sparkSession, {}, {}, {}, {}
    for p, size in sizes.items():
        whole[p] = min(MAX_REPEATS, given[p] // size) if size else 0
        left[p] = given[p] - whole[p] * size if whole[p] < MAX_REPEATS else 0
        rounds[p] = []
    rest = dict(left)
    # Rows alike in id and size have one place and stand or fall together.
    able = docs.filter("size > 0").withColumn("order", order_of(seed)).groupBy("pattern", "order").agg(F.sum("size").alias("size"), F.max("size").alias("one"))
    able = written(able.withColumn("bucket", F.shiftright("order", 64 - BUCKET_BITS)), "order")

    def free(open_: list[tuple]) -> DataFrame:
        state = spark.createDataFrame([(list(p), left[p], rounds[p]) for p in open_], "pattern array<string>, left long, rounds array<struct<most:long,upto:long>>")
        return able.join(F.broadcast(state), "pattern").filter(~_in_rounds(F.col("one")))

    open_ = [p for p in sizes if left[p]]
    while open_:
        fit = free(open_).filter("one <= left")
        # The bucket at which a pattern is full is found by sums over blocks of buckets, then over those of one block.
        held = written(fit.groupBy("pattern", "left", "bucket").agg(F.sum("size").alias("held")), "held")
        blocks = held.groupBy("pattern", "left", F.shiftright("bucket", BUCKET_BITS // 2).alias("block")).agg(F.sum("held").alias("held"))
        found = _edges(blocks, ["pattern"], "block", F.lit(0)).collect()
        edge_blocks = spark.createDataFrame([(r["pattern"], r["edge"]["block"], r["edge"]["before"]) for r in found if r["edge"]], "pattern array<string>, block long, before long")
        inside = held.withColumn("block", F.shiftright("bucket", BUCKET_BITS // 2)).join(F.broadcast(edge_blocks), ["pattern", "block"])
        edge_of = {tuple(r["pattern"]): r["edge"] for r in _edges(inside, ["pattern", "block"], "bucket", F.col("before")).collect()}
        edges = spark.createDataFrame([(list(p), e["bucket"], e["before"]) for p, e in edge_of.items()], "pattern array<string>, bucket long, before long")
        within = Window.partitionBy("pattern", "bucket").orderBy("order")
        inside = fit.join(F.broadcast(edges), ["pattern", "bucket"]).withColumn("upto", F.sum("size").over(within) + F.col("before")).filter("upto <= left")
        cuts = {tuple(r["pattern"]): r for r in inside.groupBy("pattern").agg(F.max("upto").alias("filled"), F.max("order").alias("cut")).collect()}
        done = set(open_)
        for r in found:
            p = tuple(r["pattern"])
            if r["edge"] is None:
                filled, cut = r["all"], LAST
            elif p in cuts:
                filled, cut = cuts[p]["filled"], cuts[p]["cut"]
            else:
                filled, cut = edge_of[p]["before"], (edge_of[p]["bucket"] << (64 - BUCKET_BITS)) - 1
            rounds[p].append((left[p], max(cut, -LAST - 1)))
            left[p] -= filled
            if r["edge"] is not None and filled and left[p] > CLOSE * rest[p]:
                done.discard(p)
        open_ = [p for p in open_ if p not in done]
        drop_written(held)
    if short := [p for p in sizes if left[p]]:
        gap = F.abs(F.col("left") - F.col("size"))
        best = free(short).groupBy("pattern", "left").agg(F.min(F.struct(gap.alias("gap"), "order")).alias("best")).filter("best.gap < left")
        last = {tuple(r["pattern"]): r["best"]["order"] for r in best.collect()}
    return spark.createDataFrame([(list(p), whole[p], rounds[p], last.get(p)) for p in sizes], "pattern array<string>, whole long, rounds array<struct<most:long,upto:long>>, last long")


def _edges(held: DataFrame, by: list[str], place: str, before: Column) -> DataFrame:
    """Per pattern, `all` that is held and, if that is more than `left`, the place at which it becomes so and what
    is held before it."""
    upto = held.withColumn("upto", F.sum("held").over(Window.partitionBy(*by).orderBy(place)) + before)
    return upto.groupBy("pattern").agg(F.max("upto").alias("all"), F.min(F.when(F.col("upto") > F.col("left"), F.struct(place, (F.col("upto") - F.col("held")).alias("before")))).alias("edge"))


def _in_rounds(size: Column) -> Column:
    return F.exists("rounds", lambda r: (size <= r["most"]) & (F.col("order") <= r["upto"]))


def times(docs: DataFrame, chosen: DataFrame, seed: int) -> DataFrame:
    """docs(doc_id, size, pattern, ...) with `times`. No row moves: the small table is broadcast."""
    more = _in_rounds(F.col("size")) | F.coalesce(F.col("order") == F.col("last"), F.lit(False))
    value = F.when(F.col("size") > 0, F.col("whole") + more.cast("int")).otherwise(F.lit(0)).cast("int")
    return docs.withColumn("order", order_of(seed)).join(F.broadcast(chosen), "pattern").withColumn("times", value).drop("order", "whole", "rounds", "last")


#: Patterns that the driver's network holds at most; a table with more is refused, not cut.
MAX_PATTERNS = 1_000_000


def mix(docs: DataFrame, quotas: dict[str, int], seed: int = 17) -> DataFrame:
    """docs(doc_id, size, pattern) with `times` for the given quotas (words by source). A pattern's
    sources that have no quota get nothing."""
    sizes = pattern_sizes(docs)
    return times(docs, choice(docs, min_cost_flow(sizes, quotas), sizes, seed), seed)


def pattern_sizes(docs: DataFrame) -> dict[tuple, int]:
    rows = docs.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    return {tuple(r["pattern"]): r["size"] for r in sorted(rows, key=lambda r: r["pattern"])}


#: How a source that is null is written in patterns, and the mark before those that aren't.
NULL_SOURCE, SOURCE_MARK = "null", "="


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size and pattern of docs(doc_id, text, source), of which a document has one."""
    return docs.select(*_sized_columns())


def _sized_columns() -> list[Column]:
    source = F.col("source").cast("string")
    pattern = F.array(F.when(source.isNull(), F.lit(NULL_SOURCE)).otherwise(F.concat(F.lit(SOURCE_MARK), source)))
    return [F.col("doc_id").cast("long").alias("doc_id"), words().alias("size"), pattern.alias("pattern")]


def choice_by_weight(table: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 17) -> tuple[DataFrame, dict[str, tuple[int, float]]]:
    """The choice for a written table of sized(), in which sources, in the order of code points and
    null last, weigh as `weights` say in turn and share as many words as there are; and by source its
    size and target."""
    sizes = pattern_sizes(table)
    order = sorted((p[0] for p in sizes), key=lambda s: (s == NULL_SOURCE, s))
    targets = weighted_targets([sizes[s,] for s in order], [weights[i % len(weights)] for i in range(len(order))], sum(sizes.values()))
    given = min_cost_flow(sizes, {s: round(t) for s, t in zip(order, targets, strict=True)})
    return choice(table, given, sizes, seed), {s: (sizes[s,], t) for s, t in zip(order, targets, strict=True)}


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """The rows of docs as often as the mix by weight takes them, with docs' own columns."""
    chosen, _ = choice_by_weight(written(sized(docs), "sized"), weights, seed)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(whole, *_sized_columns())
    taken = times(keyed, chosen, seed).filter("times > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("_row.*")
