"""Reads of an epoch-versioned log: newest-wins views, point, multi-key, range and as-of lookups.

Log columns are seq, k, v, epoch (payload optional). `latest` keeps one row per key; a key
predicate on its result is pushed below the aggregation to the scan by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import floor_div

#: Which insert of a key's newest epoch counts: the last, or the first (later ones of the epoch are ignored).
MODES = {"latest": F.max, "reference": F.min}


def first_in_epoch(log: DataFrame) -> DataFrame:
    """epoch, k, v: of several inserts of a key in one epoch, the first. A partial aggregate, so hot keys are reduced before the shuffle."""
    return log.groupBy("epoch", "k").agg(F.min(F.struct("seq", "v")).alias("x")).select("epoch", "k", "x.v")


def latest(log: DataFrame, mode: str = "latest") -> DataFrame:
    """k, v, epoch, seq: the row that answers each key."""
    if mode == "latest":
        best = F.max(F.struct("epoch", "seq", "v"))
        return log.groupBy("k").agg(best.alias("x")).select("k", "x.v", "x.epoch", "x.seq")
    if mode == "reference":
        best = F.max(F.struct("epoch", (-F.col("seq")).alias("back"), "v"))
        return log.groupBy("k").agg(best.alias("x")).select("k", "x.v", "x.epoch", (-F.col("x.back")).alias("seq"))
    raise ValueError(f"mode is one of {sorted(MODES)}")


def point(rows: DataFrame, key: int) -> DataFrame:
    """The row of a key, or none."""
    return rows.where(F.col("k") == F.lit(key))


def point_or_missing(rows: DataFrame, keys: DataFrame, missing: int = -1) -> DataFrame:
    """k, v for every asked key; `missing` where there is none."""
    return keys.select("k").distinct().join(rows.select("k", "v"), "k", "left").select("k", F.coalesce("v", F.lit(missing)).alias("v"))


def multi_get(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is among the asked ones."""
    return rows.join(keys.select("k"), "k", "left_semi")


def absent(keys: DataFrame, rows: DataFrame) -> DataFrame:
    """Asked keys without a row."""
    return keys.select("k").distinct().join(rows.select("k"), "k", "left_anti")


def within(low: int, high: int, column: str = "k") -> Column:
    """Both ends inclusive; nothing if low > high."""
    return F.col(column).between(F.lit(low), F.lit(high))


def range_keys(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Keys in a range, once each."""
    return rows.where(within(low, high)).select("k").distinct()


def range_bag(log: DataFrame, low: int, high: int) -> DataFrame:
    """epoch, k: a row for each tier that holds a key of the range."""
    return log.where(within(low, high)).select("epoch", "k").distinct()


def range_latest(log: DataFrame, low: int, high: int, mode: str = "latest") -> DataFrame:
    return latest(log.where(within(low, high)), mode)


#: Cells that a range is listed in at most, but for the one at its end; a level's cells are as many times as wide as those below.
SPAN = 16


def _listed(ranges: DataFrame, width: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Ranges with level and cell, a row for each cell, and the levels that occur, each with its cells' width.

    A range stands on the lowest level at which SPAN cells hold it, so a wide one has as few cells as a narrow one."""
    widths = [width]
    while widths[-1] <= (1 << 62) // SPAN:
        widths.append(widths[-1] * SPAN)
    widths.append(1 << 62)
    wide = lambda c, w: floor_div(F.col(c), w).cast("decimal(20,0)")
    level = F.coalesce(*[F.when(wide("high", w) - wide("low", w) < SPAN, k) for k, w in enumerate(widths)])
    told = ranges.where(F.col("low") <= F.col("high")).distinct().withColumn("level", level)
    used = sorted(r["level"] for r in told.select("level").distinct().collect())  # as many as levels at most
    cell = lambda c: F.coalesce(*[F.when(F.col("level") == k, floor_div(F.col(c), widths[k])) for k in used]) if used else F.lit(0)
    return told.withColumn("cell", F.explode(F.sequence(cell("low"), cell("high")))), [(k, widths[k]) for k in used]


def _celled(rows: DataFrame, levels: list[tuple[int, int]]) -> DataFrame:
    """A row for each level that ranges use, with the row's cell there."""
    places = F.array(*[F.struct(F.lit(k).alias("level"), floor_div(F.col("k"), w).alias("cell")) for k, w in levels])
    return rows.withColumn("x", F.explode(places)).select(*rows.columns, "x.level", "x.cell")


def multi_range(ranges: DataFrame, rows: DataFrame, width: int = 1024) -> DataFrame:
    """(low, high) with every key of `rows` in it; ranges without one are left out, repeated ranges count once.

    An equi-join on cells of keys, of `width` keys or, for wide ranges, of more; ranges may be as wide as the keys' domain."""
    listed, levels = _listed(ranges.select("low", "high"), width)
    if not levels:
        return ranges.select("low", "high").join(rows, F.lit(False))
    inside = F.col("k").between(F.col("low"), F.col("high"))
    return listed.join(_celled(rows, levels), ["level", "cell"]).where(inside).drop("level", "cell")


def multi_range_counts(ranges: DataFrame, rows: DataFrame, width: int = 1024) -> DataFrame:
    """low, high, n: keys in each range, 0 where there is none. Cells that lie whole in a range are counted once for all ranges."""
    listed, levels = _listed(ranges.select("low", "high"), width)
    wanted = ranges.select("low", "high").distinct()
    if not levels:
        return wanted.withColumn("n", F.lit(0).cast("long"))
    edge = F.coalesce(*[F.when(F.col("level") == k, (F.col("cell") == floor_div(F.col("low"), w)) | (F.col("cell") == floor_div(F.col("high"), w))) for k, w in levels])
    listed = listed.withColumn("edge", edge)
    keys = _celled(rows.select("k"), levels)
    ends = listed.where("edge").join(keys, ["level", "cell"]).where(F.col("k").between(F.col("low"), F.col("high"))).groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"))
    cells = keys.groupBy("level", "cell").agg(F.count(F.lit(1)).alias("n"))
    inner = listed.where(~F.col("edge")).join(cells, ["level", "cell"]).groupBy("low", "high").agg(F.sum("n").alias("n"))
    found = ends.unionByName(inner).groupBy("low", "high").agg(F.sum("n").alias("n"))
    return wanted.join(found, ["low", "high"], "left").select("low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def as_of(log: DataFrame, epoch: int, mode: str = "latest") -> DataFrame:
    """The newest-wins view at the end of an epoch."""
    return latest(log.where(F.col("epoch") <= F.lit(epoch)), mode)


def tier_of_key(log: DataFrame) -> DataFrame:
    """k, the epoch that answers it, and the number of epochs that hold it."""
    return log.groupBy("k").agg(F.max("epoch").alias("answering_epoch"), F.countDistinct("epoch").alias("tiers_with_key"))
