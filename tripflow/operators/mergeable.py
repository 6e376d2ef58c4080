"""Aggregates with mergeable states: moments, and a bottom-k sample for percentiles with an error bound."""

from __future__ import annotations

import math
import struct

import numpy as np

from tripflow.operators.user_aggregates import UserAggregate


class Moments(UserAggregate):
    """Count, mean, sample variance, least and greatest of one column, merged without cancellation.

    The state is (n, mean, sum of squared deviations, least, greatest); two of them are merged by the
    distance of their means. Empty: null but for the count.
    """

    result = "rows long, mean double, variance double, least double, greatest double"
    _FORM = "<qdddd"

    def create(self):
        return 0, 0.0, 0.0, math.inf, -math.inf

    def update(self, state, values: np.ndarray):
        if not len(values):
            return state
        values = values.astype(np.float64)
        mean = float(values.mean())
        spread = float(((values - mean) ** 2).sum())
        return self.merge(state, (len(values), mean, spread, float(values.min()), float(values.max())))

    def merge(self, state, other):
        (n, mean, spread, low, high), (m, mean2, spread2, low2, high2) = state, other
        if not n or not m:
            return other if not n else state
        apart, total = mean2 - mean, n + m
        return (
            total, mean + apart * m / total, spread + spread2 + apart * apart * n * m / total,
            min(low, low2), max(high, high2),
        )

    def finish(self, state):
        n, mean, spread, low, high = state
        return (n, mean, spread / (n - 1) if n > 1 else None, low, high) if n else (0, None, None, None, None)

    def to_bytes(self, state) -> bytes:
        return struct.pack(self._FORM, *state)

    def from_bytes(self, data: bytes):
        return struct.unpack(self._FORM, data)


class BottomK(UserAggregate):
    """A uniform sample of at most ``k`` rows of a key: those whose hash is smallest, ties by value.

    Columns are the hash (a long that is spread evenly and does not depend on the value, such as
    ``seeded_hash`` of the row's id) and the value. The sample depends on the rows alone, not on how
    they are split, and two samples merge into that of all their rows. NaN values take no part.

    ``finish`` gives the number of rows seen, the sample's size, the sample's nearest-rank percentile
    and how far its rank among all rows may be off: with n rows and s of them sampled, the rank of the
    sample's quantile misses fraction * n by more than n * sqrt(ln(2 / risk) / (2 s)) with a
    probability of at most ``risk`` (the bound of Dvoretzky, Kiefer and Wolfowitz),
    and one step of the sample, n / s, for rounding. A sample of all rows has no error.
    """

    result = "rows long, sampled int, estimate double, rank_error double"

    def __init__(self, k: int, fraction: float, risk: float = 1e-9) -> None:
        if k < 1 or not 0 < fraction <= 1 or not 0 < risk < 1:
            raise ValueError("k must be positive, fraction and risk within 0..1")
        self.k, self.fraction, self.risk = k, fraction, risk

    def create(self):
        return 0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float64)

    def _least(self, seen: int, hashes: np.ndarray, values: np.ndarray):
        if len(hashes) > self.k:
            # Only the rows up to the k-th hash need to be put in order.
            near = hashes <= np.partition(hashes, self.k - 1)[self.k - 1]
            hashes, values = hashes[near], values[near]
            by = np.lexsort((values, hashes))[: self.k]
            hashes, values = hashes[by], values[by]
        return seen, hashes, values

    def update(self, state, hashes: np.ndarray, values: np.ndarray):
        there = ~np.isnan(values)
        hashes, values = hashes[there].astype(np.int64), values[there].astype(np.float64)
        seen, h, v = state
        return self._least(seen + len(hashes), np.concatenate([h, hashes]), np.concatenate([v, values]))

    def merge(self, state, other):
        (n, h, v), (m, h2, v2) = state, other
        return self._least(n + m, np.concatenate([h, h2]), np.concatenate([v, v2]))

    def finish(self, state):
        seen, _, values = state
        if not len(values):
            return 0, 0, None, None
        rank = max(1, math.ceil(self.fraction * len(values)))
        error = 0.0
        if len(values) < seen:
            error = seen * (math.sqrt(math.log(2 / self.risk) / (2 * len(values))) + 1 / len(values))
        return seen, len(values), float(np.sort(values)[rank - 1]), error

    def to_bytes(self, state) -> bytes:
        seen, hashes, values = state
        return struct.pack("<qq", seen, len(hashes)) + hashes.tobytes() + values.tobytes()

    def from_bytes(self, data: bytes):
        seen, n = struct.unpack_from("<qq", data)
        return seen, np.frombuffer(data, np.int64, n, 16), np.frombuffer(data, np.float64, n, 16 + 8 * n)
