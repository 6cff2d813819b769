"""Shared helpers of the training-data operators.

Words are always taken on UTF-8 bytes: ``bytes.split()`` cuts exactly at
``\\x20`` and ``\\x09-\\x0D``, and a 256-entry translation turns every byte that is not a
letter, a digit or part of a multi-byte character into a space, so both word
definitions run at C speed over whole texts.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Lower-cases A-Z and maps every other byte outside [a-z0-9\x80-\xff] to a space.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

#: Rows that a worker has as Python objects at once.
ROWS = 2_000

#: White space of the word definition [^\x20\x09-\x0D]+.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def plain_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null has none."""
    return text.split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text after lower-casing A-Z; null has none."""
    return text.translate(ALNUM).split() if text else []


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, end: Callable[[], None] | None = None) -> DataFrame:
    """One output batch per input batch, or per ROWS rows of a larger one; `end` is called after a task's last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), ROWS):
                yield fn(batch.slice(at, ROWS))
        if end:
            end()

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and all run on one machine."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/tessera-checkpoints-{os.getuid()}"


def _file_system(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _file_system(spark, path)
    return files.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    files, target = _file_system(spark, path)
    files.delete(target, True)


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass

    atexit.register(clean)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so that a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_FREEING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Inside, an execution's shuffle files go when it ends; else they stay until the driver happens to collect its garbage.

    For frames that are run once, as ``materialize`` does; one that is run again would make its shuffles anew."""
    before = spark.conf.get(_FREEING, "false")
    spark.conf.set(_FREEING, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREEING, before)


class Scratch:
    """Tables that a query writes on its way; ``drop`` removes their files as soon as nothing will read them."""

    def __init__(self) -> None:
        self.paths: dict[DataFrame, str] = {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """As ``materialize``."""
        path = new_path(df.sparkSession, label)
        df.write.parquet(path)
        table = df.sparkSession.read.schema(df.schema).parquet(path)
        self.paths[table] = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            remove(table.sparkSession, self.paths.pop(table))


#: A key is hot with more than one in HOT of all rows; so there are fewer than HOT of them, which are broadcast.
HOT = 1_000


def salted_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, spread: Column) -> DataFrame:
    """rows, left-joined by key with table, which has a key once at most.

    counts has key and n, the rows of each key, and is read twice. A hot key's rows are dealt by `spread` over so many pieces
    that none holds more than one in HOT of all rows; the table's row of that key goes to each piece.
    """
    piece, pieces = (free_name(c, [*rows.columns, *table.columns]) for c in ("__piece", "__pieces"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * HOT > total).select(key, F.ceil(F.col("n") * HOT / F.lit(float(max(1, total)))).cast("int").alias(pieces))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn(piece, F.coalesce(F.pmod(spread, pieces), F.lit(0)).cast("int"))
    copies = table.join(F.broadcast(hot), key, "left").withColumn(piece, F.explode(F.sequence(F.lit(0), F.coalesce(pieces, F.lit(1)) - 1)))
    return dealt.drop(pieces).join(copies.drop(pieces), [key, piece], "left").drop(piece)


#: Rows up to which a table, which is counted, is broadcast.
BROADCAST_ROWS = 50_000


def left_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, spread: Column) -> DataFrame:
    """As salted_join, but for a table that is small, which goes to every executor; its rows are short."""
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, "left")
    return salted_join(rows, table, key, counts, spread)


def free_name(name: str, columns: list[str]) -> str:
    """The name, with as many underscores before it as keep it apart from the columns (letter case doesn't count)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
