"""Samples of a fixed rate taken before a percentile: random, and by hash of a key.

A sample is the feature here; no job takes one unless it is asked to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sampling rate and its seed.
SAMPLE_RATE = 0.02
SAMPLE_SEED = 42


def shared_hash(key: Column) -> Column:
    """A long below 2^32 from the MD5 of the key's text, which other SQL engines can compute too."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def seeded_hash(key: Column, seed: int = SAMPLE_SEED) -> Column:
    """A long from 0 to 2^60 - 1 for a key and a seed, by MD5, which other SQL engines can compute too."""
    text = F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def hash_sample(df: DataFrame, key: Column, one_in: int) -> DataFrame:
    """A repeatable sample of about one row in ``one_in``, by hash of a key alone."""
    return df.where(shared_hash(key) % one_in == 0)


def rate_sample(
    df: DataFrame, rate: float = SAMPLE_RATE, seed: int = SAMPLE_SEED
) -> DataFrame:
    """Random sample without replacement; repeatable only while the input splits stay the same."""
    return df.sample(False, rate, seed)
