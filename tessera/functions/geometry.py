"""Positions in a sorted run, and the pages, nodes and levels that they fall in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.config import StoreConfig


def with_positions(run: DataFrame, key: str = "k") -> DataFrame:
    """Rank of every row by key (from 0) and number of rows, without a single-task sort.

    Rows are cut into key ranges at approximate quantiles; a rank is the number of rows in the
    ranges before plus the rank within its own. Ranges hold about as many rows each, and their
    number follows the session's shuffle partitions.
    """
    spark = run.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = run.select(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000)).first()[0] or []
    cut = sorted(set(bounds))
    ranged = run.withColumn("__range", F.size(F.filter(F.lit(cut).cast("array<long>"), lambda b: b < F.col(key))) if cut else F.lit(0))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"))
    whole = Window.orderBy("__range")  # over as many rows as ranges
    before = sizes.select("__range", (F.sum("__rows").over(whole) - F.col("__rows")).alias("__before"), F.sum("__rows").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(key))
    return ranged.withColumn("__inside", inside).join(F.broadcast(before), "__range").withColumn("pos", F.col("__before") + F.col("__inside") - 1).drop("__range", "__inside", "__before")


def floor_div(value: Column, by: int) -> Column:
    """Whole division downwards of longs by a positive number; no step goes through doubles or overflows."""
    value = value.cast("long")
    return F.call_function("div", value, F.lit(by).cast("long")) - F.when((value < 0) & (value % F.lit(by) != 0), 1).otherwise(0)


def ceil_div(value: Column, by: int) -> Column:
    value = value.cast("long")
    return F.call_function("div", value, F.lit(by).cast("long")) + F.when((value > 0) & (value % F.lit(by) != 0), 1).otherwise(0)


def page_of(pos: Column, config: StoreConfig = StoreConfig()) -> Column:
    return floor_div(pos, config.page_rows)


def node_of(pos: Column, config: StoreConfig = StoreConfig()) -> Column:
    return floor_div(pos, config.node_rows)


def pages_for(rows: Column, config: StoreConfig = StoreConfig()) -> Column:
    return ceil_div(rows, config.page_rows)


def levels(leaves: Column, config: StoreConfig = StoreConfig()) -> Column:
    """Pages of the level above."""
    return ceil_div(leaves, config.page_children)
