"""A reproducible shuffle into shards by a keyed permutation of global row numbers.

Every row gets a number from 0 to n - 1 that depends on the rows alone, not on their files or
partitions. A Feistel network permutes the smallest even power of two that holds n; values outside
0 to n - 1 are permuted again until they fall inside (cycle walking), which makes it a permutation
of the row numbers. Shard and slot are the remainder and the quotient of the permuted number by the
number of shards, so shard sizes are at most one apart, slots are gapless, and where a row goes
(``locate``) and which row is in a place (``row_at``) can be computed without looking at data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tripflow.sources.staging import settle

ROUNDS = 6
SEED = 11
SHARDS = 8
#: Rows numbered together in one task.
BLOCK = 20_000
#: Copies of a row that are written out together.
COPIES = 10_000
#: Names of the result.
ADDED = ("number", "shard", "slot")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit hash of each value, the round function."""
    x = (x + np.uint64(key)) * _ODD
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _keys(seed: int) -> list[int]:
    return np.random.default_rng(seed).integers(0, 1 << 63, ROUNDS).tolist()


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _feistel(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for key in keys:
        left, right = right, left ^ (_mix(right, key) & mask)
    return left << shift | right


def _feistel_back(x: np.ndarray, half: int, keys: list[int]) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for key in reversed(keys):
        left, right = right ^ (_mix(left, key) & mask), left
    return left << shift | right


def _walk(step, numbers, n: int, seed: int) -> np.ndarray:
    half, keys = _half_bits(n), _keys(seed)
    x = step(np.asarray(numbers).astype(np.uint64), half, keys)
    while (out := np.flatnonzero(x >= np.uint64(n))).size:
        x[out] = step(x[out], half, keys)
    return x.astype(np.int64)


def permute(numbers, n: int, seed: int = SEED) -> np.ndarray:
    """Places of row numbers below ``n``; a permutation of them."""
    return _walk(_feistel, numbers, n, seed)


def unpermute(places, n: int, seed: int = SEED) -> np.ndarray:
    return _walk(_feistel_back, places, n, seed)


def locate(numbers, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers."""
    places = permute(numbers, n, seed)
    return places % shards, places // shards


def row_at(shard, slot, n: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """The row numbers in given places."""
    return unpermute(np.asarray(slot) * shards + np.asarray(shard), n, seed)


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` reduced to ``keys`` and their global ``number``, 0 to n - 1.

    Rows are dealt to blocks by a hash of their keys and numbered inside a block by the keys'
    order. Equal rows are counted first and numbered as one, then written out again, so that a
    row repeated very often is no large group. Keys named like a result of ``shard`` tell rows apart too,
    but don't come out.
    """
    n = rows.count()
    blocks = n // BLOCK + 1
    # Names of our own inside, as keys may have any.
    inner = [f"key_{i}" for i in range(len(keys))]
    named = rows.select(*[F.col(k).alias(i) for k, i in zip(keys, inner, strict=True)])
    counted = named.groupBy(*inner).agg(F.count("*").alias("times")).withColumn(
        "block", F.pmod(F.xxhash64(*inner), F.lit(blocks))
    )
    counted = settle(counted, "counted")
    sizes = counted.groupBy("block").agg(F.sum("times").alias("rows"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row a block: a small table even for very many rows.
    starts = settle(
        sizes.select(
            "block", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start")
        ),
        "starts",
    )
    inside = Window.partitionBy("block").orderBy(*inner).rowsBetween(Window.unboundedPreceding, -1)
    first = counted.withColumn("inside", F.coalesce(F.sum("times").over(inside), F.lit(0)))
    start = F.col("start") + F.col("inside")
    runs = settle(first.join(starts, "block").select(*inner, start.alias("number"), "times"), "runs")
    # A long run is cut first and its pieces are dealt to tasks, so that none writes all copies.
    ends = F.sequence(F.col("number"), F.col("number") + F.col("times") - 1, F.lit(COPIES).cast("long"))
    left = F.col("last") - F.col("number") + 1
    pieces = (
        runs.where(F.col("times") > COPIES)
        .withColumn("last", F.col("number") + F.col("times") - 1)
        .withColumn("number", F.explode(ends))
        .withColumn("times", F.least(left, F.lit(COPIES).cast("long")))
        .drop("last")
        .repartition("number")
    )
    every = F.explode(F.sequence(F.col("number"), F.col("number") + F.col("times") - 1))
    whole = runs.where(F.col("times") <= COPIES).unionByName(pieces)
    kept = [F.col(i).alias(k) for k, i in zip(keys, inner, strict=True) if k not in ADDED]
    return whole.select(*kept, every.alias("number"))


def _places(n: int, seed: int):
    @F.pandas_udf(LongType())
    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(permute(batch.to_numpy(), n, seed))

    return places


def shard(rows: DataFrame, keys: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(keys, number, shard, slot) for every row of ``rows``, which should be a written table.

    ``keys`` are the columns that tell rows apart; nulls are values like any other. Rows equal in
    all of them are interchangeable. No rows: no rows. Keys named like a result are left out.
    """
    n = rows.count()
    place = _places(n, seed)(F.col("number"))
    kept = [k for k in keys if k not in ADDED]
    return numbered(rows, keys).select(F.struct(*kept).alias("key") if kept else F.lit(None).alias("key"), "number", place.alias("place")).select(
        *[F.col("key").getField(k).alias(k) for k in kept],
        "number",
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"),
    )
