"""MurmurHash functions of 64-bit keys, with any seed.

They multiply modulo 2**64 or 2**32, which Spark's expressions cannot do while ANSI mode is
on, so they are vectorised Arrow functions over numpy's unsigned integers. The algorithms are
the public MurmurHash2 and MurmurHash3, specialised to the eight little-endian bytes of a key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

U32, U64 = np.uint32, np.uint64
#: Seeds of the membership filter's two hashes (fixed values).
SEEDS = (0x9747B28C, 0x248C893E)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    bits = x.dtype.itemsize * 8
    kind = x.dtype.type
    return (x << kind(by)) | (x >> kind(bits - by))


def _final64(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> U64(33))) * U64(factor)
    return x ^ (x >> U64(33))


def _final32(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x = (x ^ (x >> U32(shift))) * U32(factor)
    return x ^ (x >> U32(16))


def murmur3_x64(keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Both 64-bit halves of the 128-bit hash."""
    k = _rotated(keys.astype(np.int64).view(U64) * U64(0x87C37B91114253D5), 31) * U64(0x4CF5AD432745937F)
    size = U64(8)
    one, two = (k ^ U64(seed)) ^ size, np.full(len(k), U64(seed) ^ size)
    one = one + two
    two = two + one
    one, two = _final64(one), _final64(two)
    one = one + two
    return one, two + one


def _halves(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = keys.astype(np.int64).view(U64)
    return (raw & U64(0xFFFFFFFF)).astype(U32), (raw >> U64(32)).astype(U32)


def murmur3_x86_32(keys: np.ndarray, seed: int) -> np.ndarray:
    h = np.full(len(keys), U32(seed))
    for part in _halves(keys):
        h = _rotated(h ^ (_rotated(part * U32(0xCC9E2D51), 15) * U32(0x1B873593)), 13) * U32(5) + U32(0xE6546B64)
    return _final32(h ^ U32(8))


def murmur3_x86_128(keys: np.ndarray, seed: int) -> list[np.ndarray]:
    """Four 32-bit words."""
    factors = [U32(c) for c in (0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93)]
    low, high = _halves(keys)
    h = [np.full(len(keys), U32(seed)) for _ in range(4)]
    h[0] = h[0] ^ (_rotated(low * factors[0], 15) * factors[1])
    h[1] = h[1] ^ (_rotated(high * factors[1], 16) * factors[2])
    h = [x ^ U32(8) for x in h]
    for finish in (True, False):
        h[0] = h[0] + h[1] + h[2] + h[3]
        h = [h[0], *(x + h[0] for x in h[1:])]
        if finish:
            h = [_final32(x) for x in h]
    return h


def murmur2(keys: np.ndarray, seed: int) -> np.ndarray:
    factor = U32(0x5BD1E995)
    h = np.full(len(keys), U32(seed) ^ U32(8))
    for part in _halves(keys):
        k = part * factor
        h = (h * factor) ^ ((k ^ (k >> U32(24))) * factor)
    h = (h ^ (h >> U32(13))) * factor
    return h ^ (h >> U32(15))


def _function(kind: str, compute: Callable) -> Callable[[Column, int], Column]:
    """A Column function of (key, seed), made once for each seed; null keys give null."""

    @cache
    def made(seed: int) -> Callable[[Column], Column]:
        @F.pandas_udf(kind)
        def hashed(keys: pd.Series) -> pd.Series:
            here = keys.notna().to_numpy()
            out = pd.Series(np.zeros(len(keys), np.int64)).astype("Int64")
            out[:] = compute(keys.fillna(0).to_numpy(np.int64), seed).astype(np.int64)
            return out.where(pd.Series(here), other=pd.NA)

        return hashed

    return lambda key, seed: made(seed)(key.cast("long"))


#: First 64 bits of MurmurHash3 x64-128, as a signed long.
murmur3_64 = _function("long", lambda k, s: murmur3_x64(k, s)[0].view(np.int64))
#: 32-bit hashes as non-negative longs; of MurmurHash3 x86-128 the word of that number.
murmur3_32 = _function("long", murmur3_x86_32)
murmur2_32 = _function("long", murmur2)
murmur3_128_words = [_function("long", lambda k, s, word=word: murmur3_x86_128(k, s)[word]) for word in range(4)]
