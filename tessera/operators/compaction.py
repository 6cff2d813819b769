"""Merges of sorted runs, routing of keys to children, splits and compaction policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import floor_div, pages_for
from ..sources.config import StoreConfig


def merge_override(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Both runs' rows by key; where both have a key, the parent's. Runs hold a key once each.

    One aggregation over the union: rows of a key meet by one shuffle, and one that is already
    partitioned by key needs none.
    """
    tagged = parent.withColumn("__newer", F.lit(1)).unionByName(child.withColumn("__newer", F.lit(0)))
    columns = [c for c in parent.columns if c != "k"]
    return tagged.groupBy("k").agg(F.max_by(F.struct(*columns), "__newer").alias("x")).select(*[F.col(c) if c == "k" else F.col(f"x.{c}") for c in parent.columns])


def route(pivots: list[int], key: str = "k") -> Column:
    """Number of the child that owns a key: the first whose pivot is not below it, else the last."""
    out = F.lit(len(pivots))
    for number in reversed(range(len(pivots))):
        out = F.when(F.col(key) <= F.lit(pivots[number]), F.lit(number)).otherwise(out)
    return out


def overlapping_children(pivots: list[int], low: int, high: int) -> list[int]:
    """Children that a range can touch; a pivot belongs to the child before it."""
    return [] if low > high else [i for i in range(len(pivots) + 1) if (i == len(pivots) or low <= pivots[i]) and (i == 0 or pivots[i - 1] < high)]


def children(rows: DataFrame, width: int, key: str = "k", config: StoreConfig = StoreConfig()) -> DataFrame:
    """child, n, pages: rows by key range of `width`."""
    by = floor_div(F.col(key), width).alias("child")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).withColumn("pages", pages_for(F.col("n"), config))


def oversized(kids: DataFrame, config: StoreConfig = StoreConfig()) -> DataFrame:
    """Children with more pages than a node may have."""
    return kids.where(F.col("pages") > F.lit(config.snode_size))


def largest_oversized(kids: DataFrame, config: StoreConfig = StoreConfig()) -> DataFrame:
    """The largest of them (the first of equals), as the policy that pushes down one child at a time takes it."""
    best = oversized(kids, config).agg(F.max_by(F.struct("child", "n", "pages"), F.struct("pages", (-F.col("child")).alias("back"))).alias("x"))
    return best.where(F.col("x").isNotNull()).select("x.*")


def sampled_oversized(kids: DataFrame, share: float, seed: int, config: StoreConfig = StoreConfig()) -> DataFrame:
    """A seeded share of them, decided by the child's number, so that a retry decides alike."""
    draw = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("child").cast("string"))), 1, 8)
    return oversized(kids, config).where(draw < F.lit(f"{int(share * (1 << 32)):08x}"))


def push_down_prefix(run: DataFrame, config: StoreConfig = StoreConfig()) -> DataFrame:
    """The part of a run (with positions) that one push-down moves: its first 2 * SNODE_SIZE pages."""
    return run.where(F.col("pos") < F.lit(2 * config.snode_size * config.page_rows))


def median_key(run: DataFrame) -> DataFrame:
    """split_key: the key at the middle position of a run with positions."""
    return run.where(F.col("pos") == floor_div(F.col("n"), 2)).select(F.col("k").alias("split_key"))


def split_pivots(pivots: list[int], fanout: int) -> tuple[list[int], int, list[int]] | None:
    """A node with more than `fanout` children is cut at its middle pivot, which moves up."""
    if len(pivots) + 1 <= fanout:
        return None
    middle = len(pivots) // 2
    return pivots[:middle], pivots[middle], pivots[middle + 1 :]


def merge_pages(kids: DataFrame, config: StoreConfig = StoreConfig()) -> DataFrame:
    """est_pages: pages that a merge over children without children of their own reads and writes."""
    return kids.agg((F.lit(2 * config.snode_size) + F.coalesce(F.sum(F.col("pages") * 2), F.lit(0))).cast("long").alias("est_pages"))


def merge_seconds(pages: Column, config: StoreConfig = StoreConfig()) -> Column:
    """Whole seconds of disk time."""
    return floor_div(pages * config.rnode_size, config.bytes_per_second)


def insert_delay(pages: Column, epoch_rows: int, config: StoreConfig = StoreConfig(), free_slots: int | None = None) -> Column:
    """Microseconds to wait for each insert while a merge runs; more where few slots of the buffer are free."""
    wait = floor_div(merge_seconds(pages, config) * 1_000_000, epoch_rows) + 5
    return wait if free_slots is None else wait + F.lit(200 // (free_slots // 5 + 1))
