"""Bytes of pointers, pages and signed element counts, as built-in expressions (little-endian)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.config import KEY_BYTES, StoreConfig

#: Bytes of a pointer's parts (fixed values).
DISK, LOCATION, FILE_NO = 1, 5, 3


def little_endian(value: Column, size: int) -> Column:
    """The low `size` bytes of a long as lower-case hex, least byte first."""
    one = [F.lpad(F.lower(F.hex(F.shiftrightunsigned(value.cast("long"), 8 * i).bitwiseAND(F.lit(255)))), 2, "0") for i in range(size)]
    return F.concat(*one)


def from_little_endian(raw: Column, start: int, size: int) -> Column:
    """An unsigned number of `size` bytes at offset `start` of a binary."""
    digits = F.hex(F.substring(raw, start + 1, size))
    turned = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    if size == 8:  # two halves, as a long is signed
        high, low = (F.conv(F.substring(turned, 8 * k + 1, 8), 16, 10).cast("long") for k in range(2))
        return F.shiftleft(high, 32).bitwiseOR(low)
    return F.conv(turned, 16, 10).cast("long")


def encode_pointer(disk: Column, location: Column, file_no: Column) -> Column:
    """Nine bytes as hex: disk, location, file number."""
    return F.concat(little_endian(disk, DISK), little_endian(location, LOCATION), little_endian(file_no, FILE_NO))


def decode_pointer(raw: Column) -> Column:
    disk = from_little_endian(raw, 0, DISK)  # a byte without sign
    return F.struct(
        F.when(disk >= 128, disk - 256).otherwise(disk).cast("tinyint").alias("disk"), from_little_endian(raw, DISK, LOCATION).alias("location"), from_little_endian(raw, DISK + LOCATION, FILE_NO).cast("int").alias("file_no")
    )


def pointer_order(pointer: Column) -> list[Column]:
    """Sort keys: disk, file, location."""
    return [pointer["disk"], pointer["file_no"], pointer["location"]]


def element_count(page: Column) -> Column:
    """The signed count that begins a page: positive in leaves, negative in inner pages."""
    raw = from_little_endian(page, 0, 4)
    return F.when(raw >= 1 << 31, raw - (1 << 32)).otherwise(raw).cast("int")


def is_leaf(page: Column) -> Column:
    return element_count(page) > 0


def is_end(page: Column) -> Column:
    """Sixteen bytes of FF close a file."""
    return F.hex(F.substring(page, 1, 16)) == F.lit("F" * 32)


def decode_leaf(page: Column, config: StoreConfig = StoreConfig()) -> Column:
    """Array of (k, v, payload) of a leaf page."""
    width = KEY_BYTES + config.max_val_size
    cells = F.transform(F.sequence(F.lit(0), F.greatest(element_count(page), F.lit(1)) - 1), lambda i: F.substring(page, i * width + 5, F.lit(width)))

    def cell(raw: Column) -> Column:
        value = from_little_endian(raw, KEY_BYTES, 4)
        signed = F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value).cast("int")
        return F.struct(from_little_endian(raw, 0, 8).alias("k"), signed.alias("v"), F.substring(raw, F.lit(KEY_BYTES + 1), F.lit(config.max_val_size)).alias("payload"))

    return F.when(is_leaf(page), F.transform(cells, cell))


def decode_inner(page: Column) -> Column:
    """Array of (k, pointer) of an inner page; the last pointer has no key."""
    n = -element_count(page)
    width = KEY_BYTES + DISK + LOCATION + FILE_NO
    keyed = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(page, i * width + 5, F.lit(width)))
    last = F.substring(page, n * width + 5, F.lit(DISK + LOCATION + FILE_NO))
    rows = F.transform(keyed, lambda raw, i: F.struct(F.when(i < n, from_little_endian(raw, 0, 8)).alias("k"), decode_pointer(F.when(i < n, F.substring(raw, F.lit(KEY_BYTES + 1), F.lit(9))).otherwise(last)).alias("pointer")))
    return F.when((element_count(page) < 0) & ~is_end(page), rows)


def encode_leaf(rows: Column) -> Column:
    """A leaf page as hex from an array of (k, payload hex of the full value width)."""
    cells = F.transform(rows, lambda r: F.concat(little_endian(r["k"], 8), r["payload"]))
    return F.concat(little_endian(F.size(rows), 4), F.array_join(cells, ""))
