"""Sources: insert logs, sorted runs, operation files, and files in the page format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import floor_div
from ..schema import OPERATION
from .config import StoreConfig


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_epochs(inserts: DataFrame, config: StoreConfig = StoreConfig()) -> DataFrame:
    """An insert log cut by size: a memtable is frozen after as many inserts as fill its budget."""
    return inserts.withColumn("epoch", floor_div(F.col("seq"), config.epoch_rows))


def event_log(spark: SparkSession, sf_dir: str, config: StoreConfig = StoreConfig()) -> DataFrame:
    """The events table as an insert log: seq, k, v, payload, epoch."""
    value = F.round(F.col("value") * 100).cast("int")
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("k"), value.alias("v"), F.col("props").cast("binary").alias("payload"))
    return with_epochs(log, config)


def order_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders table as a run of unique keys."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("int").alias("v"))


def operations(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A workload from a file of operations."""
    return spark.read.format(kind).schema(OPERATION).load(path)


def keys(spark: SparkSession, path: str) -> DataFrame:
    """Query keys, one in each line of text."""
    return spark.read.text(path).select(F.trim("value").cast("long").alias("k")).where(F.col("k").isNotNull())


def pages(spark: SparkSession, path: str, config: StoreConfig = StoreConfig()) -> DataFrame:
    """file, page_no, page: the fixed-size pages of binary files."""
    size = config.rnode_size
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    last = (F.ceil(F.length("content") / F.lit(size)) - 1).cast("int")
    numbered = files.where(F.length("content") > 0).select("file", "content", F.explode(F.sequence(F.lit(0), last)).alias("page_no"))
    return numbered.select("file", "page_no", F.substring("content", F.col("page_no") * size + 1, F.lit(size)).alias("page"))
