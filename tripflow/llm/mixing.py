"""Mixing sources to target weights by exact document lengths.

1. Targets: each source's share of all words by weight, capped at ``MAX_REPEATS`` times its size,
   the excess shared again by weight among the rest until none is above (closed form below).
2. A histogram (source, length) -> documents. Everything that follows reads this, not documents.
3. Per source: the whole repeats its target holds, then for the remaining budget how many more
   times documents of each length are taken. The bulk is taken in proportion to the histogram; the last words,
   about ``DP_WORDS`` / 2, are fitted by bounded-knapsack dynamic programming over the documents
   still free, so the budget is met exactly wherever their lengths allow it.
4. Within a length the documents of smallest seeded hash are taken. A large class is cut by
   hash bucket first, so that only one bucket of about ``BUCKET`` rows has to be ranked.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripflow.llm.common import WORD
from tripflow.sources.staging import settle

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
SEED = 7
BUCKET = 1000
#: Words up to which the rest of a budget goes to the dynamic programme; above, longest first.
DP_WORDS = 1 << 14


def word_count(text: Column) -> Column:
    """Words between ASCII white space; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources take the weights in turn, by code point, null last. Sources whose share is above
    their cap are those with the least cap per weight: walking up that order, a source is capped
    while what is left, shared by weight, still gives it more than its cap.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights)))
    table = sizes.select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1).alias("weight"),
    )
    cap = F.col("source_size") * F.lit(max_repeats)
    up = Window.orderBy((cap / F.col("weight")), F.col("source").asc_nulls_last())
    before, whole = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    rate = left / weight_left
    ranked = table.select("*", rate.alias("rate"), (F.col("weight") * rate > cap).alias("capped"))
    # Of the uncapped sources the first has the rate at which all capped ones have their cap.
    final = F.max(F.when(~F.col("capped"), F.col("rate"))).over(whole)
    target = F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("weight") * final)
    return ranked.select("source", "source_size", target.alias("target"))


def fit_rest(lengths: np.ndarray, free: np.ndarray, rest: int) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to ``rest``,
    of two equally near sums the smaller; ``free`` bounds the counts.

    The choice is exact for rests up to ``DP_WORDS``, but for sums that pass the rest by more than
    the shortest free document; larger rests are first brought down, longest documents first.
    """
    take, rest = np.zeros(len(lengths), dtype=np.int64), int(rest)
    for i in np.argsort(-lengths, kind="stable"):
        if lengths[i] == 0 or rest <= DP_WORDS:
            break
        take[i] = min(int(free[i]), rest // int(lengths[i]))
        rest -= int(take[i] * lengths[i])
    free = np.where(lengths > 0, free - take, 0)
    if not free.any():
        return take
    # Bit s of ``reach`` says that s words can be made of the items so far; binary splitting turns
    # a bounded count into a few items.
    limit = rest + int(lengths[free > 0].min())
    reach, steps, mask = 1, [], (1 << (limit + 1)) - 1
    usable = np.flatnonzero((free > 0) & (lengths <= limit))
    for i in np.random.default_rng(SEED).permutation(usable).tolist():
        if reach >> rest & 1:
            break
        count, lot = min(int(free[i]), limit // int(lengths[i])), 1
        while count:
            lot = min(lot, count)
            steps.append((i, lot, reach))
            reach |= reach << (lot * int(lengths[i])) & mask
            count -= lot
            lot *= 2
    at, above = (reach & (1 << (rest + 1)) - 1).bit_length() - 1, reach >> (rest + 1)
    over = rest + (above & -above).bit_length()
    if above and over - rest < rest - at:
        at = over
    for i, lot, earlier in reversed(steps):
        if not earlier >> at & 1:
            at -= lot * int(lengths[i])
            take[i] += lot
    return take


def plan_source(
    lengths: np.ndarray, counts: np.ndarray, target: float, max_repeats: int = MAX_REPEATS
) -> np.ndarray:
    """How many times documents of each length are taken, over all of the length together."""
    total = int((lengths * counts).sum())
    if not total:
        return np.zeros(len(lengths), dtype=np.int64)
    budget = round(target)
    best = None
    # One whole repeat less leaves more documents to choose from, should the first try miss.
    for repeats in dict.fromkeys((budget // total, max(0, budget // total - 1))):
        rest, most = budget - repeats * total, (max_repeats - repeats) * counts
        # Along the lengths, the words taken so far never fall a whole document behind their
        # share. Half of what the programme can fit is left to it, so that it has a choice.
        bulk, words = max(0, rest - DP_WORDS // 2), np.cumsum(lengths * counts)
        take, taken = np.zeros(len(lengths), dtype=np.int64), 0
        for i in np.flatnonzero(lengths > 0).tolist():
            due = int(words[i]) * bulk // total
            take[i] = min(int(most[i]), max(0, (due - taken) // int(lengths[i])))
            taken += int(take[i] * lengths[i])
        take += fit_rest(lengths, most - take, rest - taken) + repeats * counts
        missed = abs(int((take * lengths).sum()) - budget)
        if best is None or missed < best[0]:
            best = missed, take
        if not missed:
            break
    return best[1]


_PLAN = "source string, size long, n long, source_size long, target double, repeats long, more long"


def _plan(max_repeats: int):
    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size", kind="stable").reset_index(drop=True)
        lengths, counts = frame["size"].to_numpy(), frame["n"].to_numpy()
        times = plan_source(lengths, counts, float(frame["target"][0]), max_repeats)
        return frame.assign(repeats=times // counts, more=times % counts)[
            ["source", "size", "n", "source_size", "target", "repeats", "more"]
        ]

    return plan


def mix(
    docs: DataFrame,
    size: str = "size",
    source: str = "source",
    seed_columns: Iterable[str] = ("doc_id",),
    weights=WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with source_size, target and taken (words the mix takes of the row, with repeats).

    ``docs`` is read twice and should be a written table. ``size`` must not be null. A null source
    is a source of its own. Rows of no words take none. Which rows of a length are taken depends
    on ``seed`` and ``seed_columns`` alone; rows equal in those are told apart arbitrarily, which
    changes no total. Columns source_size, target and taken of ``docs`` are replaced.
    """
    histogram = docs.groupBy(F.col(source).alias("source"), F.col(size).cast("long").alias("size"))
    histogram = settle(histogram.agg(F.count("*").alias("n")), "histogram")
    sizes = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = settle(source_targets(settle(sizes, "sizes"), weights, max_repeats), "targets")
    known = histogram.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    plan = settle(known.drop("s").groupBy("source").applyInPandas(_plan(max_repeats), _PLAN), "plan")

    kept = [c for c in docs.columns if c not in ("source_size", "target", "taken")]
    buckets = F.ceil(F.col("p.n") / BUCKET)
    partial = (F.col("p.more") > 0) & (F.col("p.more") < F.col("p.n"))
    digest = F.xxhash64(F.lit(seed), *[F.col(f"d.{c}") for c in seed_columns])
    placed = docs.alias("d").join(
        plan.alias("p"),
        F.col(f"d.{source}").eqNullSafe(F.col("p.source")) & (F.col(f"d.{size}") == F.col("p.size")),
    ).select(
        F.struct(*[F.col(f"d.{c}") for c in kept]).alias("doc"),
        F.struct("p.*").alias("p"),
        digest.alias("digest"),
        F.when(partial, F.pmod(digest, buckets)).alias("bucket"),
    )

    # Large classes: rows of a bucket, and how many are still wanted when the bucket is reached.
    groups = ["source", "size"]
    counted = docs.select(F.col(source).alias("source"), F.col(size).alias("size"), *[
        F.col(c).alias(f"seed_{i}") for i, c in enumerate(seed_columns)
    ])
    large = plan.where(f"more > 0 and more < n and n > {BUCKET}").select(
        F.col("source").alias("s"), F.col("size").alias("z"), "n", "more"
    )
    in_large = counted.join(large, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    own = F.xxhash64(F.lit(seed), *[F.col(f"seed_{i}") for i, _ in enumerate(seed_columns)])
    per_bucket = in_large.groupBy(
        *groups, "more", F.pmod(own, F.ceil(F.col("n") / BUCKET)).alias("bucket")
    ).agg(F.count("*").alias("rows"))
    walk = Window.partitionBy(*groups).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("rows").over(walk), F.lit(0))
    wanted = settle(
        per_bucket.select(
            F.col("source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("b"),
            (F.col("more") - earlier).alias("wanted"), (F.col("more") - earlier >= F.col("rows")).alias("all"),
        ),
        "wanted",
    )

    key = F.col("p.source").eqNullSafe(F.col("s")) & (F.col("p.size") == F.col("z")) & (F.col("bucket") == F.col("b"))
    told = placed.join(wanted, key, "left").withColumn("wanted", F.coalesce("wanted", F.col("p.more")))
    # Only rows of the bucket in which the wanted number is reached have to be ranked; the others
    # are dealt by their hash, so that no large class meets in one task.
    ranks = F.col("bucket").isNotNull() & (F.col("wanted") > 0) & ~F.coalesce(F.col("all"), F.lit(False))
    told = told.select("doc", "p", "digest", "bucket", "wanted", ranks.alias("ranks")).withColumn(
        "salt", F.when(~F.col("ranks"), F.col("digest"))
    )
    place = Window.partitionBy("p.source", "p.size", "bucket", "salt").orderBy("digest")
    first = F.when(F.col("ranks"), F.row_number().over(place)).otherwise(1)
    rows = told.withColumn("extra", (first <= F.col("wanted")).cast("long"))
    copies = F.col("p.repeats") + F.col("extra")
    return rows.select(
        "doc.*", "p.source_size", "p.target", (copies * F.col("p.size")).alias("taken")
    )


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its word count as ``size`` and a hash of the text as ``text_hash``."""
    return docs.withColumns({"size": word_count(F.col(text)), "text_hash": F.xxhash64(text)})


def resample(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` as often as the mix takes them: rows not taken go, repeats are rows again."""
    packed = docs.select(F.struct("*").alias("doc"))
    value = F.col("doc").getField(text)
    narrow = packed.select(
        "doc", F.col("doc").getField(source).alias("source"),
        word_count(value).alias("size"), F.xxhash64(F.col("doc").getField("doc_id"), value).alias("row_hash"),
    )
    mixed = mix(narrow, "size", "source", ("row_hash",)).where("taken > 0")
    copies = F.array_repeat(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))
    return mixed.select("doc", F.explode(copies).alias("one")).select("doc.*")
