"""Continuous ingestion: micro-batches of a stream become epochs of a store."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.geometry import floor_div, with_positions
from ..plans.shared import file_system
from ..plans.store import Store
from ..sources.config import StoreConfig


def _stream_id(store: Store, checkpoint: str) -> str:
    """The query's id, which Spark keeps in its checkpoint; another checkpoint folder, or one made anew, has another."""
    fs, file = file_system(store.spark, f"{checkpoint}/metadata")
    stream = fs.open(file)
    try:
        return json.loads(store.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def by_size(batch: DataFrame, first: int, config: StoreConfig) -> DataFrame:
    """A batch cut into epochs from `first` on: one is full after as many inserts, in the order of seq, as fill a memtable's budget."""
    ranked = with_positions(batch, "seq")
    return ranked.withColumn("epoch", floor_div(F.col("pos"), config.epoch_rows) + F.lit(first)).drop("pos", "n")


def waits(store: Store, rows: int) -> float:
    """Seconds that a batch of so many rows should take at least while the next merges are done: the delay of one insert, for each."""
    seconds = store.merge_pages() * store.config.rnode_size // store.config.bytes_per_second
    return rows * (seconds / max(1, store.node_rows))


def start(
    stream: DataFrame, store: Store, checkpoint: str, available_now: bool = True, every: str = "10 seconds", maintain: bool = True, flush_by_size: bool = False, throttle: bool = False
) -> StreamingQuery:
    """Append each micro-batch (seq, k, v, payload) to the store, as the next free epoch, or with `flush_by_size` as an epoch for
    each memtable that it fills.

    The manifest keeps each stream's last batch number, so a batch that is repeated after a failure is written
    once, and streams and batches of any number may share a store. Back-pressure is the source's
    (maxFilesPerTrigger, rowsPerSecond): batches are taken one after another, so a slow merge delays the next batch instead of
    queueing rows; with `throttle` a batch takes at least the time that the estimated merges ask for.
    """

    def write(batch: DataFrame, number: int) -> None:
        began = time.time()
        name = _stream_id(store, checkpoint)
        if flush_by_size:
            newest = max((r["epoch"] for r in store.runs()), default=-1)
            store.ingest(by_size(batch, newest + 1, store.config), batch=(name, number))
        else:
            store.ingest(batch, batch=(name, number))
        if maintain:
            store.maintain()
        if throttle:
            time.sleep(max(0.0, waits(store, batch.count()) - (time.time() - began)))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def running_latest(stream: DataFrame) -> DataFrame:
    """k, v, seq of the newest insert of each key so far, kept in the state store; for update mode."""
    return stream.groupBy("k").agg(F.max(F.struct("seq", "v")).alias("x")).select("k", "x.v", "x.seq")


def insertion_rate(stream: DataFrame, column: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, n: inserts in each window of event time, final once the watermark has passed."""
    timed = stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)
    return timed.groupBy(F.window(column, window).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def rows_per_second(delay_micros: int) -> int:
    """The source rate that a delay for each insert stands for."""
    return max(1, 1_000_000 // max(1, delay_micros))
