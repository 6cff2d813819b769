"""Layout and lookup statistics as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.geometry import levels, node_of, page_of, pages_for
from ..sources.config import RECORD_OVERHEAD, StoreConfig


def leaf_pages(run: DataFrame, config: StoreConfig = StoreConfig()) -> DataFrame:
    """page_no, lo, hi, n of a run with positions."""
    return run.groupBy(page_of(F.col("pos"), config).alias("page_no")).agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count(F.lit(1)).alias("n"))


def inner_levels(rows: DataFrame, config: StoreConfig = StoreConfig()) -> DataFrame:
    """leaves, l1: leaf pages of a run and pages of the level above."""
    leaves = rows.agg(pages_for(F.count(F.lit(1)), config).alias("leaves"))
    return leaves.select("leaves", levels(F.col("leaves"), config).alias("l1"))


def node_sizes(run: DataFrame, config: StoreConfig = StoreConfig()) -> DataFrame:
    """snode, pages of a run with positions."""
    return run.groupBy(node_of(F.col("pos"), config).alias("snode")).agg(pages_for(F.count(F.lit(1)), config).alias("pages"))


def flush_sizes(log: DataFrame) -> DataFrame:
    """epoch, n_ops, n_keys: what each flush moves."""
    return log.groupBy("epoch").agg(F.count(F.lit(1)).alias("n_ops"), F.countDistinct("k").alias("n_keys"))


def memory(log: DataFrame, config: StoreConfig = StoreConfig()) -> DataFrame:
    """epoch, bytes: footprint of each memtable."""
    return log.groupBy("epoch").agg((F.countDistinct("k") * (config.max_val_size + RECORD_OVERHEAD)).alias("bytes"))


def tree_height(rows: DataFrame, config: StoreConfig = StoreConfig()) -> DataFrame:
    """height: levels of pages above and with the leaves."""
    counted = rows.agg(pages_for(F.count(F.lit(1)), config).alias("leaves"))
    # each level divides by the children of a page, so few steps reach one page at any size
    height, pages = F.lit(1), F.col("leaves")
    for _ in range(8):
        pages_above = levels(pages, config)
        height, pages = height + F.when(pages > 1, 1).otherwise(0), pages_above
    return counted.select(height.cast("long").alias("height"))


def insert_rate(events: DataFrame, unit: str = "hour", column: str = "ts") -> DataFrame:
    """w, n: inserts in each time unit."""
    return events.groupBy(F.date_trunc(unit, column).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def lookup_counters(probed: DataFrame, rows: DataFrame) -> DataFrame:
    """searches, false_positives, false_negatives of a membership filter's answers (k, maybe)."""
    told = probed.join(rows.select("k").distinct().withColumn("here", F.lit(True)), "k", "left").withColumn("here", F.coalesce("here", F.lit(False)))
    return told.agg(
        F.count(F.lit(1)).alias("searches"), F.count_if(F.col("maybe") & ~F.col("here")).alias("false_positives"), F.count_if(~F.col("maybe") & F.col("here")).alias("false_negatives")
    )


def progress(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """batch, rows, rows_per_second, and milliseconds of each part of the last micro-batches of a stream."""
    rows = [
        (p["batchId"], p["numInputRows"], float(p["processedRowsPerSecond"] or 0), {k: int(v) for k, v in p["durationMs"].items()})
        for p in query.recentProgress
    ]
    return spark.createDataFrame(rows, "batch long, rows long, rows_per_second double, millis map<string,long>")
