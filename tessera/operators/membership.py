"""Membership filters: a bit array with double hashing, built by aggregation, and Parquet's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import SEEDS, murmur3_64
from ..sources.config import StoreConfig


def _unsigned_mod(value: Column, by: int) -> Column:
    """An unsigned 64-bit number modulo a small one; longs are signed, so the halves are reduced one by one."""
    high, low = F.shiftrightunsigned(value, 32), value.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.pmod(F.pmod(high, F.lit(by)) * F.lit((1 << 32) % by) + low, F.lit(by))


def _with_bits(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """With `bit`, the bits of a key: (a + i * b) modulo bits for i below hashes."""
    hashed = keys.withColumns({f"__{i}": _unsigned_mod(murmur3_64(F.col("k"), seed), bits) for i, seed in enumerate(SEEDS)})
    numbers = F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(F.col("__0") + i * F.col("__1"), F.lit(bits)))
    return hashed.withColumn("bit", numbers).drop("__0", "__1")


def build(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """word, mask: the set bits of a filter over all keys, 32 to a word. Words are combined before the shuffle."""
    one = _with_bits(keys.select("k"), bits, hashes).select(F.explode("bit").alias("bit"))
    word, mask = F.floor(F.col("bit") / 32).cast("long"), F.expr("shiftleft(1L, cast(bit % 32 as int))")
    return one.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("mask"))


def probe(keys: DataFrame, built: DataFrame, bits: int, hashes: int) -> DataFrame:
    """k, maybe: whether all bits of a key are set. Never false for a key of the filter."""
    wanted = _with_bits(keys.select("k").distinct(), bits, hashes).select("k", F.explode("bit").alias("bit"))
    wanted = wanted.select("k", F.floor(F.col("bit") / 32).cast("long").alias("word"), F.expr("shiftleft(1L, cast(bit % 32 as int))").alias("want"))
    hit = F.coalesce(F.col("mask").bitwiseAND(F.col("want")) != 0, F.lit(False))
    return wanted.join(built, "word", "left").groupBy("k").agg(F.min(hit).alias("maybe"))


def sized(n: int, config: StoreConfig = StoreConfig()) -> tuple[int, int]:
    """Bits and hashes for n keys."""
    return max(8, n * config.bloom_bpe), config.bloom_hashes


def parquet_options(n: int, config: StoreConfig = StoreConfig(), key: str = "k") -> dict[str, str]:
    """Writer options for Parquet's Bloom filter on the key, which its reader uses to skip row groups."""
    if not config.use_bloom_filters:
        return {}
    # adaptive: files with fewer keys get smaller filters
    return {"parquet.bloom.filter.adaptive.enabled": "true", f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": str(max(1, n)), f"parquet.bloom.filter.fpp#{key}": f"{config.bloom_error:.6f}"}
