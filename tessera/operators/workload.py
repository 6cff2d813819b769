"""Workloads of inserts, point and range queries: generation with fixed seeds, and execution against a store."""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lookup import multi_get, multi_range_counts

if TYPE_CHECKING:
    from ..plans.store import Store


@dataclass(frozen=True)
class Workload:
    """Settings of a workload."""

    no_ops: int = 1000
    no_insertions: int = 0
    insert_prop: float = 0.5
    prop_workload: bool = True
    perform_query: bool = True
    zipfian_query: bool = False
    measure_insertion_rate: bool = False
    measure_insertion_time: bool = False
    insert_per_second: int = 0
    expected_query_match: int = 10
    query_freq: int = 0
    print_query_result: bool = False
    total_queries: int = 0
    measure_freq: int = 0
    max_key: int = 1_000_000
    seed: int = 1


def _uniform(salt: int, seed: int, of: Column | None = None) -> Column:
    """A number in [0, 1) from the operation's number, so that retries and partitions don't matter."""
    drawn = F.md5(F.concat(F.lit(f"{seed}:{salt}:"), (F.col("op_no") if of is None else of).cast("string")))
    return F.conv(F.substring(drawn, 1, 10), 16, 10).cast("long") / F.lit(float(1 << 40))


def zipf_key(u: Column, max_key: int, exponent: float = 1.0) -> Column:
    """Inverse of the continuous Zipf distribution over 1..max_key, from 0."""
    if exponent == 1.0:
        rank = F.pow(F.lit(float(max_key)), u)
    else:
        e = 1 - exponent
        rank = F.pow(u * (float(max_key) ** e - 1) + 1, F.lit(1 / e))
    return F.least(F.floor(rank), F.lit(max_key)).cast("long") - 1


def operations(spark: SparkSession, work: Workload, first: int = 0) -> DataFrame:
    """op_no, is_query, is_range, is_insertion, key, high, val."""
    rows = spark.range(first, first + work.no_ops).withColumnRenamed("id", "op_no")
    if work.prop_workload:
        insertion = _uniform(0, work.seed) < F.lit(work.insert_prop)
    elif work.query_freq:
        insertion = (F.col("op_no") + 1) % work.query_freq != 0
    else:
        insertion = F.col("op_no") < work.no_insertions
    if not work.perform_query:
        insertion = F.lit(True)
    uniform = F.floor(_uniform(1, work.seed) * work.max_key).cast("long")
    # queries ask for `total_queries` keys, one after the other, or each for one of its own
    drawn = _uniform(1, work.seed, F.col("op_no") % work.total_queries if work.total_queries else None)
    asked = zipf_key(drawn, work.max_key) if work.zipfian_query else F.floor(drawn * work.max_key).cast("long")
    ranged = ~insertion & (_uniform(2, work.seed) < 0.5)
    key = F.when(insertion, uniform).otherwise(asked)
    return rows.select(
        "op_no", (~insertion).alias("is_query"), ranged.alias("is_range"), insertion.alias("is_insertion"), key.alias("key"),
        F.when(ranged, key + work.expected_query_match - 1).alias("high"), F.when(insertion, F.floor(_uniform(3, work.seed) * 1_000_000).cast("int")).alias("val"),
    )


def inserts(ops: DataFrame) -> DataFrame:
    return ops.where("is_insertion").select(F.col("op_no").alias("seq"), F.col("key").alias("k"), F.col("val").alias("v"), F.lit(None).cast("binary").alias("payload"))


def answers(ops: DataFrame, rows: DataFrame, width: int = 1024) -> DataFrame:
    """op_no, n: rows that each query finds in `rows` (k, v); all queries of a batch are answered by two joins."""
    points = ops.where("is_query and not is_range").select("op_no", F.col("key").alias("k"))
    found = points.join(multi_get(rows, points), "k", "left").select("op_no", F.col("v").isNotNull().cast("long").alias("n"))
    ranges = ops.where("is_range").select("op_no", F.col("key").alias("low"), "high")
    counts = multi_range_counts(ranges, rows, width)
    return found.unionByName(ranges.join(counts, ["low", "high"]).select("op_no", "n"))


@dataclass
class Execution:
    """answers: op_no, n of every query. stats: a row for each batch of operations."""

    answers: DataFrame
    stats: DataFrame


_STATS = "first_op long, inserts long, queries long, insert_seconds double, query_seconds double, inserts_per_second double, pages_read long"


def execute(store: Store, work: Workload, width: int = 1024) -> Execution:
    """Run a workload against a store, `measure_freq` operations at a time (all at once, if 0): its queries see the inserts of the
    batches before theirs; then its inserts become an epoch, no faster than `insert_per_second`. Times and rates are told if asked for."""
    spark, every = store.spark, work.measure_freq or work.no_ops
    stats, found = [], None
    for first in range(0, work.no_ops, every):
        ops = operations(spark, work).where((F.col("op_no") >= first) & (F.col("op_no") < first + every)).persist()
        began = time.time()
        low, high, queries = ops.where("is_query").agg(F.min("key"), F.max(F.coalesce("high", "key")), F.count(F.lit(1))).first()
        pages = sum(r["n_pages"] for r in store.touched(low, high)) if queries else 0
        told = spark.createDataFrame(answers(ops, store.latest(), width).collect(), "op_no long, n long")  # a row for each query of the batch
        found = told if found is None else found.unionByName(told)
        asked, added = time.time(), ops.where("is_insertion").count()
        if added:
            store.ingest(inserts(ops))
            store.maintain()
        if work.insert_per_second:
            time.sleep(max(0.0, added / work.insert_per_second - (time.time() - asked)))
        took = time.time() - asked
        stats.append((first, added, queries, took if work.measure_insertion_time else None, asked - began, added / took if work.measure_insertion_rate else None, pages))
        ops.unpersist()
        if work.print_query_result:
            told.show(truncate=False)
    return Execution(found if found is not None else spark.createDataFrame([], "op_no long, n long"), spark.createDataFrame(stats, _STATS))
