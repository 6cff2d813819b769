"""Mixing overlapping sources to target weights by min-cost flow.

A document counts for every source of its membership pattern, and documents are aggregated by pattern. Word
capacity flows from patterns to source quotas: the first use of a pattern's words is free, each repetition costs
more than the one before (convex), so quotas are met with as few repeats as possible.

Quotas are found on the table of sources: a rate of words for a unit of weight, raised until no source above its limit
shares in the rest. Where all patterns of a source have no other source, its flow is forced and follows in the table, for
any number of sources. Only patterns of several sources, and those that share a source with them, go to the driver's
network, as arrays (about 100 bytes of each); equal patterns are one node, whatever the number of documents. The costs of uses
rise by levels, so flow is sent level by level, each by blocking flows: of all ways that meet the quotas, that is a cheapest.

A pattern's flow becomes documents: every document is taken as often as the flow covers the whole pattern, and the rest
goes to documents in the order of a seeded hash; the last one gives only as many words as are left, so flows are met
exactly. ``mixed_documents`` makes texts, and takes that last document whole or not at all, whichever comes nearer.

The seeded order is cut in buckets by leading digits of the hash, so many that a bucket of all patterns holds about BUCKET_ROWS rows.
Sums per pattern and bucket tell in which bucket a pattern's rest ends; only that bucket is put in order, without texts.

Null text: size 0, taken 0. Null source: a source of its own, the last. Equal rows are
interchangeable; rows with equal doc_id are ordered by size and text hash. An empty table gives an
empty result. Extra columns, whatever their names, are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, left_join, materialize

#: Weights of the sources in code-point order, repeating; the words to take as a share of all; uses of a document at most.
WEIGHTS, SHARE, MOST_USES = (3, 1, 2), 1.5, 2
SEED = 7
#: Rows of a bucket on average.
BUCKET_ROWS = 4_096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quotas(sizes: dict, weights: dict, share: float = SHARE, uses: int = MOST_USES) -> dict:
    """Words for each source: share of all words by weight, none above uses * size, the excess shared again."""
    left, weight = share * sum(sizes.values()), sum(weights.values())
    out = {}
    rest = sorted(sizes, key=lambda s: (uses * sizes[s] / weights[s], weights[s], sizes[s]))
    for k, s in enumerate(rest):
        if left / weight * weights[s] <= uses * sizes[s]:
            return out | {t: left / weight * weights[t] for t in rest[k:]}
        out[s] = float(uses * sizes[s])
        left, weight = left - uses * sizes[s], weight - weights[s]
    return out


class Flow:
    """A network whose flow grows by blocking flows (Dinic); capacities are whole words. Nodes 0 and 1 are the ends."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for at, to, r in ((a, b, room), (b, a, 0)):
            self.arcs[at].append(len(self.to))
            self.to.append(to)
            self.room.append(r)
        return len(self.to) - 2

    def _levels(self) -> list[int]:
        level = [-1] * len(self.arcs)
        level[0], todo = 0, [0]
        for at in todo:
            for e in self.arcs[at]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[at] + 1
                    todo.append(self.to[e])
        return level

    def send(self) -> None:
        """As much more as fits, from what is there."""
        while (level := self._levels())[1] >= 0:
            tried = [0] * len(self.arcs)
            path: list[int] = []
            at = 0
            while True:
                if at == 1:
                    words = min(self.room[e] for e in path)
                    cut = len(path)
                    for k, e in enumerate(path):
                        self.room[e] -= words
                        self.room[e ^ 1] += words
                        if not self.room[e] and cut > k:
                            cut = k
                    at = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                arcs, k = self.arcs[at], tried[at]
                while k < len(arcs) and not (self.room[arcs[k]] and level[self.to[arcs[k]]] == level[at] + 1):
                    k += 1
                tried[at] = k
                if k < len(arcs):
                    path.append(arcs[k])
                    at = self.to[arcs[k]]
                elif path:
                    level[at] = -1
                    at = self.to[path.pop() ^ 1]
                else:
                    break


def routed(patterns: dict[tuple, int], goals: dict, uses: int = MOST_USES) -> dict[tuple, dict]:
    """Words from each pattern to each of its sources, at least cost. Each use of a pattern costs more than the one before,
    and a path has one use, so the flow is sent by uses: first with every pattern's words once, then with once more, and so on."""
    names, sources = list(patterns), list(goals)
    number = {s: 2 + len(names) + k for k, s in enumerate(sources)}
    flow = Flow(2 + len(names) + len(sources))
    entry = [flow.arc(0, 2 + k, 0) for k in range(len(names))]
    links = {p: [(s, flow.arc(2 + k, number[s], uses * patterns[p])) for s in dict.fromkeys(p)] for k, p in enumerate(names)}
    for s, words in goals.items():
        flow.arc(number[s], 1, words)
    for _ in range(uses):
        for e, p in zip(entry, names, strict=True):
            flow.room[e] += patterns[p]
        flow.send()
    return {p: {s: flow.room[e ^ 1] for s, e in links[p]} for p in names}


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, uses: int = MOST_USES) -> DataFrame:
    """source, source_size, target, goal (whole words) from source, words; sources may be as many as rows.

    Weights go by a source's number in code-point order, null last. Each round shares what capped sources leave over by
    weight; those above their limit are capped; none is left to cap after few rounds, as rates only rise."""
    spark = sizes.sparkSession
    order = [F.col("source").asc_nulls_last()]
    dealt = materialize(sizes.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part")), "mix-sources")
    counts = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}  # one row for each written range
    firsts, before = [], 0
    for part in sorted(counts):
        firsts.append((part, before))
        before += counts[part]
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    numbered = dealt.withColumn("inside", inside).join(F.broadcast(spark.createDataFrame(firsts, "part int, first long")), "part")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("first") + F.col("inside"), F.lit(len(weights))) + 1).cast("int"))
    known = materialize(numbered.select("source", "words", weight.alias("weight"), (F.lit(uses) * F.col("words")).alias("limit")), "mix-weights")
    total = known.agg(F.sum("words")).first()[0] or 0
    rate = 0.0
    while True:
        capped = F.col("limit") < F.lit(rate) * F.col("weight")
        used, weighed, weighs = known.agg(F.sum(F.when(capped, F.col("limit")).otherwise(0)), F.sum(F.when(capped, F.col("weight")).otherwise(0)), F.sum("weight")).first()
        if not weighs or weighed == weighs:
            break
        rate, last = (share * total - used) / (weighs - weighed), rate
        if rate == last:
            break
    capped = F.col("limit") < F.lit(rate) * F.col("weight")
    target = F.when(capped, F.col("limit").cast("double")).otherwise(F.lit(rate) * F.col("weight"))
    return known.select("source", F.col("words").alias("source_size"), target.alias("target")).withColumn("goal", F.floor(F.col("target") + 0.5))


def _prepared(docs: DataFrame, sources: Column | None) -> tuple[DataFrame, dict[str, str]]:
    """The documents with working columns, and the names of these, which docs doesn't have."""
    names = {c: free_name(f"__{c}", docs.columns) for c in ("size", "pattern", "order", "bucket", "full", "rest", "last", "before", "source_size", "target", "extra")}
    digits, n = 1, docs.count()
    while n > BUCKET_ROWS * 16**digits:
        digits += 1
    pattern = F.coalesce(F.array("source") if sources is None else sources, F.array().cast("array<string>"))
    order = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = docs.withColumns({names["size"]: word_count(F.col("text")), names["pattern"]: F.array_sort(F.array_distinct(pattern)), names["order"]: order})
    return rows.withColumn(names["bucket"], F.conv(F.substring(names["order"], 1, digits), 16, 10).cast("long")), names


def plan(sums: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, uses: int = MOST_USES) -> DataFrame:
    """What is taken of each pattern, from pattern, bucket, words, n: pattern, n (rows), full (uses of every document), rest (words beyond), last
    (the bucket in which the rest ends, -1 if there is none), before (words of the buckets before that), source_size and target (of its first source)."""
    spark = sums.sparkSession
    patterns = materialize(sums.groupBy("pattern").agg(F.sum("words").alias("words"), F.sum("n").alias("n")), "mix-patterns")
    member = patterns.select("pattern", "words", F.explode("pattern").alias("source"))
    targets = materialize(source_targets(member.groupBy("source").agg(F.sum("words").alias("words")), weights, share, uses), "mix-targets")
    # only patterns that compete for a source are routed; the others' flow is what their source asks for
    shared = materialize(member.where(F.size("pattern") > 1).select(F.col("source").alias("of")).distinct(), "mix-shared")
    here = F.col("source").eqNullSafe(F.col("of"))
    contested = {tuple(r["pattern"]): r["words"] for r in member.join(shared, here, "left_semi").select("pattern", "words").distinct().collect()}
    goals = {r["source"]: r["goal"] for r in targets.join(shared, here, "left_semi").select("source", "goal").collect()}
    flows = [(list(p), sum(to.values())) for p, to in routed(contested, goals, uses).items()]
    flows = spark.createDataFrame(flows, f"pattern {patterns.schema['pattern'].dataType.simpleString()}, flow long")
    first = targets.select(F.col("source").alias("of"), "source_size", "target", "goal")
    told = patterns.join(first, (F.size("pattern") > 0) & F.get("pattern", F.lit(0)).eqNullSafe(F.col("of")), "left").join(flows, "pattern", "left")
    told = told.select(
        "pattern", "n", F.when(F.col("words") > 0, F.coalesce("flow", "goal", F.lit(0))).otherwise(0).alias("flow"), F.greatest("words", F.lit(1)).alias("words"),
        F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"),
    )
    totals = told.selectExpr("pattern", "n", "flow div words as full", "flow % words as rest", "source_size", "target")
    upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket"))
    ends = sums.select("pattern", "bucket", "words", upto.alias("upto")).join(totals.select("pattern", "rest"), "pattern")
    ends = ends.where((F.col("upto") - F.col("words") < F.col("rest")) & (F.col("rest") <= F.col("upto")))
    ends = ends.select("pattern", F.col("bucket").alias("last"), (F.col("upto") - F.col("words")).alias("before"))
    out = totals.join(ends, "pattern", "left").withColumns({"last": F.coalesce("last", F.lit(-1)), "before": F.coalesce("before", F.lit(0))})
    return materialize(out.select("pattern", "n", "full", "rest", "last", "before", "source_size", "target"), "mix-plan")


def _selected(rows: DataFrame, names: dict[str, str], **settings) -> DataFrame:
    """With full uses, extra words taken beyond them, source_size and target. Only documents in a pattern's last bucket are ordered."""
    own = rows.select(F.col(names["pattern"]).alias("pattern"), F.col(names["bucket"]).alias("bucket"), F.col(names["size"]).alias("size"))
    sums = materialize(own.groupBy("pattern", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")), "mix-sums")
    totals = plan(sums, **settings)
    renamed = totals.select(F.col("pattern").alias(names["pattern"]), "n", *[F.col(c).alias(names[c]) for c in ("full", "rest", "last", "before", "source_size", "target")])
    known = left_join(rows, renamed.drop("n"), names["pattern"], renamed.select(names["pattern"], "n"), F.xxhash64(names["order"]))
    bucket, last, size, extra = (F.col(names[c]) for c in ("bucket", "last", "size", "extra"))
    plain = known.where(bucket != last).withColumn(names["extra"], F.when(bucket < last, size).otherwise(F.lit(0)))
    by = Window.partitionBy(names["pattern"]).orderBy(names["order"], names["size"], F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col(names["before"]) + F.coalesce(F.sum(size).over(by), F.lit(0))
    border = known.where(bucket == last).withColumn(names["extra"], F.greatest(F.lit(0), F.least(size, F.col(names["rest"]) - upto)))
    return plain.unionByName(border)


def mix(docs: DataFrame, sources: Column | None = None, weights: Sequence[float] = WEIGHTS, share: float = SHARE, uses: int = MOST_USES) -> DataFrame:
    """doc_id, size, source_size, target (those of its first source), taken."""
    rows, names = _prepared(docs, sources)
    chosen = _selected(rows.select("doc_id", "text", *[names[c] for c in ("size", "pattern", "order", "bucket")]), names, weights=weights, share=share, uses=uses)
    size, full, extra, source_size, target = (F.col(names[c]) for c in ("size", "full", "extra", "source_size", "target"))
    return chosen.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), source_size.alias("source_size"), target.alias("target"), (full * size + extra).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, sources: Column | None = None) -> DataFrame:
    """The mix itself with the columns of docs: a row per use of a document with words; one that the mix takes in part is taken if that is half of it or more."""
    rows, names = _prepared(docs, sources)
    chosen = _selected(rows, names)
    more = (F.col(names["extra"]) > 0) & (2 * F.col(names["extra"]) >= F.col(names["size"]))
    times = F.when(F.col(names["size"]) > 0, (F.col(names["full"]) + more.cast("int")).cast("int")).otherwise(F.lit(0))
    return chosen.withColumn(names["full"], F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)
