"""Approximate nearest neighbours by inner product over robust-pruned directed graphs.

Distinct vectors are dealt by length into bands and by a hash into shards of about ``SHARD`` vectors of
one band; equal vectors are one node that lists its smallest ids, as many as a result can hold. One
task builds a shard's graph: greedy beam searches from the middle propose neighbours, and pruning
keeps the nearest and then only those to which no kept neighbour is nearer by the factor ``ALPHA``, so
that edges point in all directions.

Inner products become distances by one more coordinate that levels the lengths. Over lengths that
differ much that coordinate would outweigh all others and the graph would order vectors by length
alone; within a band lengths differ by the factor ``BAND`` at most, and a vector far longer than the
rest has a band of its own. Distances are relative to the longest of the shard and the query, so that
no length overflows.

The query set is searched in blocks in every shard: a task reads a shard's graph once and then the
blocks one after the other. Scores are computed anew in double precision on the original vectors, and
the best of all shards are kept.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripflow.operators.joins import broadcast_if_small
from tripflow.sources.staging import settle

#: Vectors of a shard and queries of a block, on average. A block travels once a shard.
SHARD, BLOCK = 4096, 4096
#: Ratio of the longest to the shortest vector of a band; lengths of 1 are in the middle of one.
BAND = 1.25
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 64, 128, 1.2
#: Points searched and pruned at once, and nodes a search expands at once.
BATCH, EXPAND = 256, 4


def _lengths(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths, without overflow of the squares."""
    top = np.maximum(np.abs(vectors).max(axis=1, initial=0), np.finfo(np.float64).tiny)
    return top * np.sqrt(((vectors / top[:, None]) ** 2).sum(axis=1))


def _levelled(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1: nearest in them is largest in inner product with (query, 0)."""
    vectors = vectors / _lengths(vectors).max()
    last = np.sqrt(np.maximum(1 - (vectors**2).sum(axis=1), 0))
    return np.hstack([vectors, last[:, None]]).astype(np.float32)


def _distances(points: np.ndarray, ids: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Squared distances of targets[i] to points[ids[i, j]]; infinite for ids below 0."""
    found = points[ids]
    found -= targets[:, None, :]
    out = np.einsum("ijk,ijk->ij", found, found)
    out[ids < 0] = np.inf
    return out


def beam_search(points: np.ndarray, edges: np.ndarray, start: int, targets: np.ndarray, width: int):
    """(beam ids, expanded ids): the ``width`` nearest nodes met, nearest first, -1 where fewer."""
    rows = np.arange(len(targets))[:, None]
    beam = np.full((len(targets), width), -1, dtype=np.int64)
    beam[:, 0] = start
    dist = np.full(beam.shape, np.inf, dtype=np.float32)
    dist[:, 0] = _distances(points, beam[:, :1], targets)[:, 0]
    done = beam < 0
    seen = np.zeros((len(targets), len(points) + 1), dtype=bool)  # the last place stands for none
    seen[:, [start, -1]] = True
    expanded = []
    while not done.all():
        # The nearest nodes not yet expanded; their places come first in a stable sort.
        place = np.argsort(done, axis=1, kind="stable")[:, :EXPAND]
        ids = np.where(done[rows, place], -1, beam[rows, place])
        done[rows, place] = True
        expanded.append(ids)
        near = np.where(ids[:, :, None] >= 0, edges[ids], -1).reshape(len(targets), -1)
        near = np.where(seen[rows, near], -1, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        seen[rows, near] = True
        beam = np.hstack([beam, near])
        dist = np.hstack([dist, _distances(points, near, targets)])
        done = np.hstack([done, near < 0])
        order = np.argsort(dist, axis=1, kind="stable")[:, :width]
        beam, dist, done = beam[rows, order], dist[rows, order], done[rows, order]
    return beam, np.hstack(expanded)


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float):
    """For each point of ``own`` the kept ones of its candidates, nearest first, -1 where fewer."""
    candidates = np.where(candidates == own[:, None], -1, candidates)
    candidates = np.sort(candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    to_own = _distances(points, candidates, points[own])
    order = np.argsort(to_own, axis=1, kind="stable")[:, : 4 * degree]
    rows = np.arange(len(own))
    candidates, to_own = candidates[rows[:, None], order], to_own[rows[:, None], order]
    vectors, alive = points[candidates], candidates >= 0
    kept = np.full((len(own), degree), -1, dtype=np.int64)
    for k in range(degree):
        if not alive.any():
            break
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        kept[some, k] = candidates[rows, first][some]
        apart = vectors - vectors[rows, first][:, None, :]
        apart = np.einsum("ijk,ijk->ij", apart, apart)
        alive &= ~some[:, None] | (alpha * alpha * apart > to_own)
        alive[rows, first] = False
    return kept


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA):
    """(edges, start): neighbours of every point, padded with -1, and where searches begin."""
    n = len(points)
    rng = np.random.default_rng(n)
    start = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((n, degree), -1, dtype=np.int64)
    if n <= degree + 1:
        for i in range(n):
            edges[i, : n - 1] = np.delete(np.arange(n), i)
        return edges, start
    edges[:, : degree // 2] = rng.integers(0, n, (n, degree // 2))
    for factor in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            own = order[at : at + BATCH]
            found, expanded = beam_search(points, edges, start, points[own], beam)
            edges[own] = robust_prune(points, own, np.hstack([found, expanded, edges[own]]), degree, factor)
            _link_back(points, edges, own, factor)
    _adopt(edges, start)
    return edges, start


def _adopt(edges: np.ndarray, start: int) -> None:
    """Give every node without an incoming edge one from its nearest neighbour that can spare one."""
    incoming = np.bincount(edges[edges >= 0], minlength=len(edges))
    for node in np.flatnonzero(incoming == 0).tolist():
        for near in [] if node == start else edges[node][edges[node] >= 0].tolist():
            row = edges[near]
            spare = np.flatnonzero((row < 0) | (incoming[row] > 1))
            if len(spare):
                # The last that can go: empty, or the farthest that others lead to as well.
                place = int(spare[-1])
                if row[place] >= 0:
                    incoming[row[place]] -= 1
                row[place] = node
                incoming[node] = 1
                break


def _link_back(points: np.ndarray, edges: np.ndarray, own: np.ndarray, alpha: float) -> None:
    """Give the new neighbours of ``own`` an edge back; those with too many are pruned."""
    degree = edges.shape[1]
    to, source = edges[own].ravel(), np.repeat(own, degree)
    source, to = source[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    source, to = source[order], to[order]
    nodes, first, count = np.unique(to, return_index=True, return_counts=True)
    added = np.full((len(nodes), count.max(initial=0)), -1, dtype=np.int64)
    added[np.repeat(np.arange(len(nodes)), count), np.arange(len(to)) - np.repeat(first, count)] = source
    both = np.hstack([edges[nodes], added])
    both.sort(axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    full = (both >= 0).sum(axis=1) > degree
    fits = np.sort(both[~full], axis=1)[:, ::-1][:, :degree]
    edges[nodes[~full]] = fits
    for at in range(0, int(full.sum()), BATCH):
        part = np.flatnonzero(full)[at : at + BATCH]
        edges[nodes[part]] = robust_prune(points, nodes[part], both[part], degree, alpha)


def _dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _build(table: pa.Table) -> pa.Table:
    n = table.num_rows
    vectors = _matrix(table.column("embedding"), n)
    members = table.column("members").combine_chunks()
    edges, start = build_graph(_levelled(vectors))
    blob = _dump(
        vectors=vectors, edges=edges.astype(np.int32), start=np.array(start),
        members=members.flatten().to_numpy(zero_copy_only=False),
        counts=members.value_lengths().to_numpy(zero_copy_only=False),
    )
    return pa.table({
        "number": table.column("number").slice(0, 1), "dim": table.column("dim").slice(0, 1),
        "graph": pa.array([blob], pa.binary()),
    })


def _matrix(column, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)


def search_shard(graph: dict, ids: np.ndarray, queries: np.ndarray, k: int, beam: int):
    """(query place, vec_id, score) of the ``k`` best in a shard for each query but its own row."""
    vectors, counts, members = graph["vectors"], graph["counts"], graph["members"]
    offsets = np.concatenate([[0], np.cumsum(counts)])
    points, edges = _levelled(vectors), graph["edges"].astype(np.int64)
    targets = np.hstack([queries / _lengths(queries)[:, None], np.zeros((len(queries), 1))]).astype(np.float32)
    everyone = np.tile(np.arange(len(vectors)), (BATCH, 1)) if len(vectors) <= beam else None
    out = []
    for at in range(0, len(queries), BATCH):
        some = targets[at : at + BATCH]
        # A beam that holds the whole shard needs no search.
        found = beam_search(points, edges, int(graph["start"]), some, beam)[0] if everyone is None else everyone[: len(some)]
        for i, row in enumerate(found, start=at):
            row = row[row >= 0]
            # Ids of equal vectors share a score; one more than k, as one may be the query's.
            score = np.repeat(vectors[row] @ queries[i], counts[row])
            names = np.concatenate([members[offsets[r] : offsets[r + 1]] for r in row])
            own = names == ids[i]
            if own.any():
                own &= np.repeat((vectors[row] == queries[i]).all(axis=1), counts[row])
                score, names = score[~own], names[~own]
            best = np.lexsort((names, -score))[:k]
            out.append((np.full(len(best), i), names[best], score[best]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def valid_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, embedding, dim): every row with a usable vector; rows alike in id and vector are one.

    Null ids, and vectors that are null, empty, all zero or hold null, NaN or infinity, are left out.
    """
    value = F.col(vector).cast("array<double>")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.select(F.col(key).alias("vec_id"), value.alias("embedding"), bad.alias("bad")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.col("bad")
    )
    # Adding 0 turns -0 into 0, so that equal vectors are equal in every component's bits.
    plain = F.transform("embedding", lambda x: x + 0.0)
    kept = kept.where(F.exists("embedding", lambda x: x != 0.0)).select("vec_id", plain.alias("embedding")).distinct()
    return kept.withColumn("dim", F.size("embedding"))


def _banded(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the band of their length."""
    top = F.array_max(F.transform("embedding", F.abs))
    nodes = nodes.withColumn("top", top)
    share = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (x / F.col("top")) * (x / F.col("top")))
    log = F.ln("top") + F.ln(share) / 2
    return nodes.withColumn("band", F.floor(log / float(np.log(BAND)) + 0.5).cast("int")).drop("top")


def build_index(valid: DataFrame, k: int, shard: int = SHARD) -> DataFrame:
    """(number, dim, graph) of all of ``valid``; vectors of different dimensions or bands never share a
    graph, and shards are numbered from 0 without gaps."""
    same = Window.partitionBy("embedding").orderBy("vec_id")
    # No result can hold more than k others of equal vectors, and one may be the query itself.
    first = valid.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    nodes = first.groupBy("embedding").agg(
        F.array_sort(F.collect_list("vec_id")).alias("members"), F.first("dim").alias("dim")
    )
    nodes = settle(_banded(nodes), "nodes")
    sizes = nodes.groupBy("dim", "band").agg((F.floor(F.count("*") / shard) + 1).cast("int").alias("shards"))
    # One row a dimension and band: as few as lengths have powers of the ratio.
    before = F.sum("shards").over(Window.orderBy("dim", "band").rowsBetween(Window.unboundedPreceding, -1))
    sizes = settle(sizes.withColumn("before", F.coalesce(before, F.lit(0)).cast("int")), "bands")
    within = F.pmod(F.xxhash64("embedding"), F.col("shards")).cast("int")
    dealt = nodes.join(broadcast_if_small(sizes), ["dim", "band"]).withColumn("number", (F.col("before") + within).cast("int"))
    total = sizes.agg(F.sum("shards")).first()[0] or 1
    # Every shard has a task of its own.
    placed = dealt.select("number", "dim", "embedding", "members").repartitionById(total, F.col("number"))
    return settle(placed.groupBy("number").applyInArrow(_build, "number int, dim int, graph binary"), "graphs")


def nearest(valid: DataFrame, queries: DataFrame, k: int, shard: int = SHARD, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every row of ``queries``.

    Both frames are ``valid_vectors``. Ties go to the smaller id; with fewer candidates, fewer rows. Rows
    that share an id are queries of their own, and candidates of each other.
    """
    graphs = build_index(valid, k, shard)
    total = (graphs.agg(F.max("number")).first()[0] or 0) + 1
    blocks = queries.count() // BLOCK + 1
    packed = (
        queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int"))
        .groupBy("dim", "block")
        .agg(F.collect_list("vec_id").alias("ids"), F.flatten(F.collect_list("embedding")).alias("flat"))
    )
    # Numbers of shards by dimension; the blocks are sent to each, the graphs are not copied.
    everywhere = settle(packed, "blocks").join(graphs.select("number", "dim"), "dim")
    both = everywhere.select("number", "block", "ids", "flat", F.lit(None).cast("binary").alias("graph")).unionByName(
        graphs.select("number", F.lit(-1).alias("block"), "graph"), allowMissingColumns=True
    )
    placed = both.repartitionById(total, F.col("number")).sortWithinPartitions("number", "block")
    width = max(beam, 2 * (k + 1))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for batch in batches:
            for i in range(batch.num_rows):
                blob = batch.column("graph")[i].as_py()
                if blob is not None:
                    graph = dict(np.load(io.BytesIO(blob)))
                    continue
                ids = batch.column("ids")[i].values.to_numpy(zero_copy_only=False)
                flat = batch.column("flat")[i].values.to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                rows, names, scores = search_shard(graph, ids, flat, k, width)
                own = np.array([xxhash.xxh64_intdigest(v.tobytes(), 0) >> 1 for v in flat], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows]), pa.array(own[rows]), pa.array(names), pa.array(scores)],
                    names=["query_id", "own", "vec_id", "score"],
                )

    found = placed.mapInArrow(search, "query_id long, own long, vec_id long, score double")
    best = Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
