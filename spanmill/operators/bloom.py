"""Bloom filters as tables, in plain expressions.

A filter is at most ``blocks`` rows (block, _w0 ... _w7): a key sets one bit in each of the eight
64-bit words of its block. So its size is set by ``blocks``, whatever the number of keys, and a
lookup is one equality join. A key that was added is always found; with ten bits per key about
one in a hundred others is found as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, BITS_PER_KEY = 8, 10
WORD_NAMES = [f"_w{k}" for k in range(WORDS)]
FILTER_SCHEMA = "block bigint, " + ", ".join(f"{w} bigint" for w in WORD_NAMES)


def blocks_for(keys: int, largest: int = 1 << 31) -> int:
    """Power of two that gives each of ``keys`` keys about ten bits."""
    wanted = max(1, keys * BITS_PER_KEY // (64 * WORDS))
    return min(largest, 1 << (wanted - 1).bit_length() if wanted > 1 else 1)


def block_of(key: Column, blocks: int | Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks if isinstance(blocks, Column) else F.lit(blocks).cast("bigint"))


def _bits(key: Column) -> list[Column]:
    """One bit for each word, from a second hash."""
    second = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(second, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(WORDS)]


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter of all keys of a frame; null keys are not added. Combined before the shuffle."""
    known = keys.filter(F.col(key).isNotNull())
    bits = dict(zip(WORD_NAMES, _bits(F.col(key))))
    placed = known.select(block_of(F.col(key), blocks).alias("block"), *[b.alias(w) for w, b in bits.items()])
    return placed.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORD_NAMES])


def may_hold(key: Column) -> Column:
    """On a row joined with its key's block: may the key be among those added?"""
    hit = [F.col(w).bitwiseAND(b) != 0 for w, b in zip(WORD_NAMES, _bits(key))]
    return F.coalesce(reduce(lambda a, b: a & b, hit), F.lit(False))
