"""Hard-negative mining by coordinate pruning over length buckets (LEMP).

Vectors become integers, so that every score is exact. Rows are dealt into buckets of similar length
and at most about ``BUCKET_ROWS`` rows; a bucket holds its rows as one matrix, with the ids of its
rows sorted along each coordinate of their directions. Anchors are dealt into blocks. Every block
meets every bucket once, in one task:

* An anchor that asks for scores of t or more needs directions whose cosine is at least
  t / (|anchor| |longest row|); a bucket where that is over 1 is skipped.
* On each of the anchor's ``FOCUS`` largest coordinates, that cosine leaves a range of feasible values.
  The shortest range of the sorted lists gives the first candidates, the other ranges cut them down.
* What is left is verified by its exact score.

Positives come first: in each bucket the longest rows of the anchor's label set t, then their best
over all buckets are kept. The positives' scores then bound the negatives.

A pair of a block and a bucket moves about (A + B) vectors for A B products, and neither the number of
rows in a task nor what it holds grows with the table; the number of pairs does with its square, as
any exact search of one row in a hundred against all. Nothing is collected or broadcast but the
number of rows by length class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripflow.operators.joins import broadcast_if_small
from tripflow.sources.staging import settle

SCALE = 256
#: Rows of a bucket and anchors of a block, on average at most.
BUCKET_ROWS, BLOCK_ROWS = 4096, 4096
#: Length classes for each doubling of the length.
CLASSES = 4
#: Coordinates of an anchor whose feasible ranges are looked up.
FOCUS = 4
#: Rounding of the ranges, far above that of a double: it only lets candidates in.
SLACK = 1e-9
#: Products of lengths below which sums of products of integers are exact in a double.
EXACT = 2.0**53
LIMIT = 2.0**1000
_LONG = (1 << 63) - 1


def integer_vectors(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, vector, length) of the rows that take part, each distinct one once.

    Components become floor(256 x) as doubles that hold integers. Rows without a key or label, and
    vectors that are null or hold a null, a component that is not finite or one of 2^1000 / 256 or more,
    take no part.
    """
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda x: x * SCALE)
    finite = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT))
    # Doubles from 2^53 on are integers already; floor() would squeeze the largest into a long.
    floored = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))
    valid = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    taken = valid.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), floored.alias("vector"))
    # Divided by the largest component first, so that no square overflows.
    top = F.greatest(F.coalesce(F.array_max(F.transform("vector", F.abs)), F.lit(0.0)), F.lit(1.0))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / F.col("top")) * (x / F.col("top")))
    return taken.distinct().withColumn("top", top).withColumn("length", F.col("top") * F.sqrt(square)).drop("top")


def _dealt(vectors: DataFrame, rows: int, classes: bool) -> DataFrame:
    """``vectors`` with dim and group: by length class, if asked, and by hash within it."""
    step = F.floor(F.log2(F.greatest("length", F.lit(2.0**-20))) * CLASSES).cast("int") if classes else F.lit(0)
    named = vectors.withColumns({"dim": F.size("vector"), "step": step})
    counts = named.groupBy("dim", "step").agg(F.ceil(F.count("*") / rows).alias("parts"))
    found = named.join(broadcast_if_small(settle(counts, "classes")), ["dim", "step"])
    part = F.pmod(F.xxhash64("key", "label", "vector"), F.col("parts"))
    return found.withColumn("group", F.concat_ws("/", "dim", "step", part)).drop("step", "parts")


_PACKED = "group string, dim int, longest double, keys binary, labels binary, vectors binary, lengths binary, targets binary"


def _pack(table: pa.Table) -> pa.Table:
    """One row for a group: its rows in order of label, longest first, as arrays."""
    n, dim = table.num_rows, table.column("dim")[0].as_py()
    keys, labels, lengths = (table.column(c).to_numpy() for c in ("key", "label", "length"))
    vectors = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
    by = np.lexsort((keys, -lengths, labels))
    targets = b""
    if "targets" in table.column_names:
        # Up to k (key, score) pairs an anchor, after their number.
        lists = [t or [] for t in table.column("targets").to_pylist()]
        flat = [[len(lists[i]), *(x for t in lists[i] for x in (t["key"], t["score"]))] for i in by]
        targets = np.array([x for row in flat for x in row], dtype=np.int64).tobytes()
    return pa.table({
        "group": [table.column("group")[0].as_py()], "dim": pa.array([dim], pa.int32()),
        "longest": [float(lengths.max())], "keys": [keys[by].tobytes()], "labels": [labels[by].tobytes()],
        "vectors": [np.ascontiguousarray(vectors[by]).tobytes()], "lengths": [lengths[by].tobytes()],
        "targets": [targets],
    })


def _packed(dealt: DataFrame) -> DataFrame:
    columns = ["group", "dim", "key", "label", "vector", "length", *(c for c in dealt.columns if c == "targets")]
    return settle(dealt.select(columns).groupBy("group").applyInArrow(_pack, _PACKED), "packed")


class Rows:
    """The rows of a packed group."""

    def __init__(self, side: dict):
        self.keys, self.labels = (np.frombuffer(side[c], dtype=np.int64) for c in ("keys", "labels"))
        self.lengths = np.frombuffer(side["lengths"], dtype=np.float64)
        self.vectors = np.frombuffer(side["vectors"], dtype=np.float64).reshape(len(self.keys), side["dim"])
        self.longest, self.targets, at = side["longest"], [], 0
        flat = np.frombuffer(side["targets"], dtype=np.int64).tolist()
        while at < len(flat):
            stop = at + 1 + 2 * flat[at]
            self.targets.append([*zip(flat[at + 1 : stop : 2], flat[at + 2 : stop : 2], strict=True)])
            at = stop


class Bucket(Rows):
    """A length bucket with its sorted coordinate lists, made when first asked for."""

    def __init__(self, side: dict):
        super().__init__(side)
        self.directions = self.vectors / np.maximum(self.lengths, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.exact = None

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.directions[:, f], kind="stable")
            self.lists[f] = order, self.directions[order, f]
        return self.lists[f]

    def candidates(self, vector: np.ndarray, length: float, least: float) -> np.ndarray | None:
        """Rows that can have a score of ``least`` or more; None for all of them."""
        if least <= 0 or not length:
            return None if least <= 0 else np.zeros(0, dtype=np.int64)
        cosine = least / (length * self.longest) - SLACK if self.longest else 2.0
        if cosine > 1:
            return np.zeros(0, dtype=np.int64)
        cosine = max(cosine, 0.0)
        unit = vector / length
        ranges = []
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS].tolist():
            spread = np.sqrt(max(0.0, 1 - unit[f] ** 2) * (1 - cosine**2)) + SLACK
            low = unit[f] * cosine - spread if cosine > -unit[f] else -1 - SLACK
            high = unit[f] * cosine + spread if cosine > unit[f] else 1 + SLACK
            order, values = self.sorted_list(f)
            a, b = np.searchsorted(values, low, side="left"), np.searchsorted(values, high, side="right")
            ranges.append((int(b - a), f, low, high, order[a:b]))
        ranges.sort(key=lambda r: r[0])
        if ranges[0][0] == len(self.keys):
            return None
        found = ranges[0][4]
        for _, f, low, high, _ in ranges[1:]:
            value = self.directions[found, f]
            found = found[(value >= low) & (value <= high)]
        return found

    def scores(self, vector: np.ndarray, length: float, found: np.ndarray | slice) -> np.ndarray:
        """Exact inner products, as 64-bit integers; as Python's where a double could not hold them."""
        if length * self.longest < EXACT:
            return (self.vectors[found] @ vector).astype(np.int64)
        if self.exact is None:
            self.exact = np.array([[int(x) for x in row] for row in self.vectors], dtype=object).reshape(self.vectors.shape)
        whole = np.array([int(x) for x in vector], dtype=object)
        found = [sum((row * whole).tolist(), 0) for row in self.exact[found]]
        return np.array([max(-_LONG - 1, min(_LONG, x)) for x in found], dtype=object)


def _order(keys: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Highest score first, then smallest key."""
    if scores.dtype == object:
        return np.array(sorted(range(len(keys)), key=lambda i: (-scores[i], keys[i])), dtype=np.int64)
    return np.lexsort((keys, -scores))


def _positives(anchors: Rows, bucket: Bucket, k: int) -> Iterator[tuple]:
    """(anchor, label, key, score): the k best rows here of each anchor's label."""
    for i, (key, label) in enumerate(zip(anchors.keys.tolist(), anchors.labels.tolist(), strict=True)):
        a, b = np.searchsorted(bucket.labels, [label, label + 1])
        if a == b:
            continue
        vector, length = anchors.vectors[i], float(anchors.lengths[i])
        # The anchor itself may be among the longest: one row more.
        seeds = np.arange(a, min(b, a + k + 1))
        seeds = seeds[bucket.keys[seeds] != key]
        found = np.arange(a, b)
        if len(seeds) >= k:
            least = sorted(bucket.scores(vector, length, seeds).tolist())[-k]
            some = bucket.candidates(vector, length, float(least))
            found = found if some is None else some[(some >= a) & (some < b)]
        found = found[bucket.keys[found] != key]
        scores = bucket.scores(vector, length, found)
        for j in _order(bucket.keys[found], scores)[:k].tolist():
            yield key, label, int(bucket.keys[found[j]]), int(scores[j])


def _negatives(anchors: Rows, bucket: Bucket, k: int, least: tuple[int, int]) -> Iterator[tuple]:
    """(anchor, label, positive, positive's score, key, score): for each positive the k best rows here of
    other labels, from ``least`` of its score up to its score."""
    above, below = least
    for i, (key, label) in enumerate(zip(anchors.keys.tolist(), anchors.labels.tolist(), strict=True)):
        wanted = [t for t in anchors.targets[i] if t[1] >= 0]
        if not wanted:
            continue
        vector, length = anchors.vectors[i], float(anchors.lengths[i])
        lowest = min(score for _, score in wanted) * above / below
        found = bucket.candidates(vector, length, lowest)
        found = np.arange(len(bucket.keys)) if found is None else found
        found = found[bucket.labels[found] != label]
        scores = bucket.scores(vector, length, found)
        most = max(score for _, score in wanted)
        near = (scores <= most) & (scores >= lowest - 1)
        found, scores = found[near.astype(bool)], scores[near.astype(bool)]
        by = _order(bucket.keys[found], scores)
        keys, scores = bucket.keys[found[by]].tolist(), scores[by].tolist()
        down = np.array([-s for s in scores], dtype=object)
        for positive, score in wanted:
            first = int(np.searchsorted(down, -score))
            for other, s in zip(keys[first : first + k], scores[first : first + k], strict=True):
                if below * s >= above * score:
                    yield key, label, positive, score, other, s


def _meet(find, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = None, None
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                if held != b["group"]:
                    held, bucket = b["group"], Bucket(b)
                columns = [*zip(*find(Rows(a), bucket), strict=True)] or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def _pairs(anchors: DataFrame, buckets: DataFrame) -> DataFrame:
    """(a, b): every block of anchors with every bucket of its dimension, buckets one after the other."""
    blocks = anchors.select("dim", F.col("group").alias("block"))
    # Names of groups only; the arrays join those pairs afterwards.
    named = settle(buckets.select("dim", "group").join(blocks, "dim").drop("dim"), "pairs")
    one = anchors.select(F.col("group").alias("block"), F.struct("*").alias("a"))
    two = buckets.select("group", F.struct("*").alias("b"))
    both = named.join(one, "block").join(two, "group")
    tasks = min(max(1, named.count()), int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return both.repartition(tasks, "group", "block").sortWithinPartitions("group")


def _found(pairs: DataFrame, find, names: list[str]) -> DataFrame:
    return pairs.select("a", "b").mapInArrow(_meet(find, names), ", ".join(f"{n} long" for n in names))


def _best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    place = Window.partitionBy(*by).orderBy(F.desc("score"), "key")
    return rows.select("*", F.row_number().over(place).alias("rank")).where(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 5,
    least: tuple[int, int] = (80, 100),
) -> DataFrame:
    """(anchor_id, anchor_label, positive_id, positive_score, rank, negative_id, negative_score).

    For every anchor and each of its ``positives`` best rows of its label (other keys than its own), the
    ``negatives`` best rows of other labels whose score is at least least[0] / least[1] of the
    positive's and not over it. Scores are inner products of the integer vectors, ties go to the
    smaller key; fewer rows than asked for give what there is, a positive without such negatives and
    an anchor without positives give nothing. Below 0 that range is empty.

    Vectors of different dimension are never compared; those of all zeros or no components score 0.
    Rows alike in key, label and vector count once; rows that share a key are rows of their own, but
    never positives of an anchor of that key, and its anchors are told apart by their label only. Scores
    are exact; those beyond a 64-bit integer count as the nearest one. Other columns are not read. Labels and keys are whole numbers. Empty tables give no rows.
    """
    vectors = settle(integer_vectors(rows, key, vector, label), "vectors")
    buckets = _packed(_dealt(vectors, BUCKET_ROWS, classes=True))
    chosen = settle(_dealt(vectors.withColumnRenamed("key", key).where(is_anchor).withColumnRenamed(key, "key"), BLOCK_ROWS, classes=False), "anchors")
    names = ["anchor", "anchor_label", "key", "score"]
    pairs = _pairs(_packed(chosen), buckets)
    found = _found(pairs, lambda a, b: _positives(a, b, positives), names)
    first = _best(found, ["anchor", "anchor_label"], positives)
    targets = first.groupBy(F.col("anchor").alias("key"), F.col("anchor_label").alias("label")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "key", "score"))).alias("targets")
    )
    wanted = _packed(chosen.join(settle(targets, "targets"), ["key", "label"]))
    names = ["anchor", "anchor_label", "positive_id", "positive_score", "key", "score"]
    found = _found(_pairs(wanted, buckets), lambda a, b: _negatives(a, b, negatives, least), names)
    best = _best(found, ["anchor", "anchor_label", "positive_id", "positive_score"], negatives)
    return best.select(
        F.col("anchor").alias("anchor_id"), "anchor_label", "positive_id", "positive_score", "rank",
        F.col("key").alias("negative_id"), F.col("score").alias("negative_score"),
    )
