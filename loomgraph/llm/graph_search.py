"""Approximate nearest neighbours: robust-pruned directed graphs over shards of the vectors.

Equal vectors are one node that holds the smallest ids of its rows, as no other can be in a result. Nodes are dealt to shards
by a hash. In a shard's graph nodes are inserted in growing batches: a greedy search from the node next to the mean proposes
neighbours, and of these, nearest first, a node keeps those that no kept one lies much closer to (by the factor
SLACK), so its edges point in different directions. Each edge is offered backwards too. Queries are dealt to blocks; each
block meets each shard, walks its graph with a beam, and the nodes found are measured again in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.shared import cut

NEIGHBOURS = 10
#: Rows of a shard, and queries of a block, about.
SHARD_ROWS = 8192
BLOCK_QUERIES = 8192
#: Edges of a node, and by how much closer a kept neighbour must be to a candidate than the node itself to rule it out.
DEGREE = 32
SLACK = 1.2
#: Nodes kept in hand by a walk, while building and while searching, and how many of them it leaves at once.
BUILD_BEAM = 64
BEAM = 192
STEPS = 4
#: Walks side by side: this bounds the marks of met nodes to WALKS times the nodes of a shard.
WALKS = 256


def squared(vectors: np.ndarray, norms: np.ndarray, ids: np.ndarray, points: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Squared distances of ``points`` (b x d) to the vectors with ``ids`` (b x m)."""
    return norms[ids] - 2 * np.matmul(vectors[ids], points[:, :, None])[:, :, 0] + own[:, None]


def walk(vectors: np.ndarray, norms: np.ndarray, edges: np.ndarray, start: int, points: np.ndarray, beam: int, trail: bool = False):
    """(ids, distances) of the ``beam`` nearest nodes met on walks to ``points``, -1 and inf where fewer were met.

    With ``trail`` also those of the nodes left on the way.
    """
    b = len(points)
    rows = np.arange(b)[:, None]
    own = np.einsum("ij,ij->i", points, points)
    met = np.zeros((b, len(vectors) + 1), bool)  # the last column takes what is no node
    met[:, start] = met[:, -1] = True
    ids = np.full((b, beam), -1, np.int64)
    distances = np.full((b, beam), np.inf, np.float32)
    left = np.ones((b, beam), bool)
    ids[:, 0], left[:, 0] = start, False
    distances[:, 0] = squared(vectors, norms, ids[:, :1], points, own)[:, 0]
    steps, trails = min(STEPS, beam), []
    while True:
        active = np.flatnonzero(~left.all(axis=1))
        if not len(active):
            break
        at = np.argsort(np.where(left[active], np.inf, distances[active]), axis=1, kind="stable")[:, :steps]
        fresh = ~np.take_along_axis(left[active], at, axis=1)
        chosen = np.where(fresh, np.take_along_axis(ids[active], at, axis=1), -1)
        left[active[:, None], at] = True
        if trail:
            lengths = np.where(fresh, np.take_along_axis(distances[active], at, axis=1), np.inf)
            trails.append((active, chosen, lengths))
        next_ids = np.where(chosen[:, :, None] >= 0, edges[chosen], -1).reshape(len(active), -1)
        next_ids[met[active[:, None], next_ids]] = -1
        met[active[:, None], next_ids] = True
        # a node that two of the left ones lead to is met once
        next_ids.sort(axis=1)
        next_ids[:, 1:][next_ids[:, 1:] == next_ids[:, :-1]] = -1
        most = int((next_ids >= 0).sum(axis=1).max())
        if not most:
            continue
        next_ids.sort(axis=1)
        next_ids = next_ids[:, -most:]
        length = np.where(next_ids >= 0, squared(vectors, norms, next_ids, points[active], own[active]), np.inf)
        all_ids, all_lengths = np.concatenate([ids[active], next_ids], axis=1), np.concatenate([distances[active], length], axis=1)
        all_left = np.concatenate([left[active], next_ids < 0], axis=1)
        best = np.argsort(all_lengths, axis=1, kind="stable")[:, :beam]
        ids[active], distances[active], left[active] = (np.take_along_axis(x, best, axis=1) for x in (all_ids, all_lengths, all_left))
    if not trail:
        return ids, distances
    width = steps * max(np.bincount(np.concatenate([a for a, _, _ in trails]), minlength=b).max(), 1)
    gone, gone_lengths, used = np.full((b, width), -1, np.int64), np.full((b, width), np.inf, np.float32), np.zeros(b, np.int64)
    for active, chosen, lengths in trails:
        to = used[active][:, None] + np.arange(chosen.shape[1])
        gone[active[:, None], to], gone_lengths[active[:, None], to] = chosen, lengths
        used[active] += chosen.shape[1]
    return ids, distances, gone, gone_lengths


def prune(vectors: np.ndarray, norms: np.ndarray, ids: np.ndarray, lengths: np.ndarray, degree: int = DEGREE, slack: float = SLACK) -> np.ndarray:
    """Up to ``degree`` of each row's candidates (-1: none), nearest first; a kept one rules out those it is ``slack`` times closer to."""
    order = np.argsort(np.where(ids >= 0, lengths, np.inf), axis=1, kind="stable")
    ids, lengths = np.take_along_axis(ids, order, axis=1), np.take_along_axis(lengths, order, axis=1)
    width = max(1, int((ids >= 0).sum(axis=1).max()))
    ids, lengths = ids[:, :width], lengths[:, :width]
    v = vectors[ids]
    between = norms[ids][:, :, None] + norms[ids][:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive = ids >= 0
    rows = np.arange(len(ids))
    out = np.full((len(ids), degree), -1, np.int32)
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[rows, first]
        if not some.any():
            break
        out[some, k] = ids[rows, first][some]
        alive &= ~(some[:, None] & (slack**2 * between[rows, first] <= lengths))
        alive[rows[some], first[some]] = False
    return out


def unique_candidates(ids: np.ndarray, lengths: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The candidates with what repeats, and each row's own node, taken out."""
    order = np.argsort(ids, axis=1, kind="stable")
    ids, lengths = np.take_along_axis(ids, order, axis=1), np.take_along_axis(lengths, order, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    ids[ids == own[:, None]] = -1
    return ids, lengths


def graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM) -> tuple[np.ndarray, int]:
    """(edges, start): neighbours of each of n different vectors, -1 where there are fewer than ``degree``."""
    n = len(vectors)
    norms = np.einsum("ij,ij->i", vectors, vectors)
    start = int(np.argmin(np.linalg.norm(vectors - vectors.mean(axis=0), axis=1)))
    edges = np.full((n, degree), -1, np.int32)
    order = np.random.default_rng(0).permutation(n)
    order = order[order != start]
    at, size = 0, 1
    while at < len(order):
        batch = order[at : at + size]
        for k in range(0, len(batch), WALKS):
            part = batch[k : k + WALKS]
            ids, lengths, gone, gone_lengths = walk(vectors, norms, edges, start, vectors[part], beam, trail=True)
            edges[part] = prune(vectors, norms, *unique_candidates(np.concatenate([ids, gone], axis=1), np.concatenate([lengths, gone_lengths], axis=1), part), degree)
        offer_back(vectors, norms, edges, batch)
        at += len(batch)
        size = min(2 * size, max(WALKS, n // 50))
    return edges, start


def offer_back(vectors: np.ndarray, norms: np.ndarray, edges: np.ndarray, batch: np.ndarray) -> None:
    """Add the edges of ``batch`` backwards, pruning nodes that would have too many."""
    degree = edges.shape[1]
    source = np.repeat(batch, degree)
    to = edges[batch].ravel()
    source, to = source[to >= 0], to[to >= 0]
    order = np.lexsort((source, to))
    source, to = source[order], to[order]
    nodes, first, n = np.unique(to, return_index=True, return_counts=True)
    for k in range(0, len(nodes), WALKS):
        own, own_n, own_first = nodes[k : k + WALKS], n[k : k + WALKS], first[k : k + WALKS]
        offered = np.full((len(own), int(own_n.max())), -1, np.int64)
        where = np.arange(offered.shape[1])[None, :] < own_n[:, None]
        offered[where] = source[own_first[0] : own_first[0] + own_n.sum()]
        ids = np.concatenate([edges[own], offered], axis=1)
        points = vectors[own]
        lengths = squared(vectors, norms, ids, points, norms[own])
        ids, lengths = unique_candidates(ids, lengths, own)
        full = (ids >= 0).sum(axis=1) > degree
        if full.any():
            edges[own[full]] = prune(vectors, norms, ids[full], lengths[full], degree)
        if not full.all():
            kept = np.sort(ids[~full], axis=1)[:, ::-1][:, :degree]
            edges[own[~full], : kept.shape[1]] = kept


def local(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(vectors around their mean in single precision, mean, scale), so that neither size nor place costs precision."""
    scale = float(np.abs(vectors).max()) or 1.0
    mean = (vectors / scale).mean(axis=0)
    return (vectors / scale - mean).astype(np.float32), mean, scale


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): rows with an id and a vector without nulls and non-finite components that isn't zero."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))  # no negative zeros
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    plain = rows.select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    return plain.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))


def shard_of(v: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(v), F.lit(shards)).cast("int")


def index(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(size, shard, node, start, v, ids, edges): the graphs over all usable rows, one node for each different vector.

    ``ids`` has the ``k + 1`` smallest ids of a node's rows, ``start`` is where walks in its shard begin. Vectors of
    one length are in graphs of their own. Repeated ids stay. The result is cut, so it is built once.
    """
    plain = usable(rows, key, vector)
    shards = max(1, -(-plain.count() // shard_rows))
    # only the smallest ids of a vector leave the task that reads them
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    nodes = plain.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    dealt = nodes.select(F.size("v").alias("size"), shard_of(F.col("v"), shards).alias("shard"), "v", "ids")
    schema = pa.schema([("size", pa.int32()), ("shard", pa.int32()), ("node", pa.int32()), ("start", pa.int32()), ("v", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("edges", pa.list_(pa.int32()))])

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.take(np.argsort(np.array([x[0] for x in rows["ids"].to_pylist()]), kind="stable"))  # one order, whatever came first
        edges, start = graph(local(matrix(rows["v"]))[0])
        n = rows.num_rows
        columns = [rows["size"], rows["shard"], np.arange(n), np.full(n, start), rows["v"], rows["ids"], list(edges)]
        return pa.table([pa.chunked_array([pa.array(c, t)]) if not isinstance(c, pa.ChunkedArray) else c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)

    return cut(dealt.groupBy("size", "shard").applyInArrow(build, "size int, shard int, node int, start int, v array<double>, ids array<long>, edges array<int>"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def beam_search(rows: pa.Table, queries: pa.Table, k: int, beam: int) -> pa.Table:
    """(query_id, vec_id, score): the ``k`` nearest found in one shard for each query of one block, its own id left out."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not rows.num_rows or not queries.num_rows:
        return schema.empty_table()
    rows = rows.sort_by("node")
    exact, edges = matrix(rows["v"]), matrix(rows["edges"])
    vectors, mean, scale = local(exact)
    norms = np.einsum("ij,ij->i", vectors, vectors)
    start = rows["start"][0].as_py()
    owned = rows["ids"].combine_chunks()
    first, owned = owned.offsets.to_numpy(), owned.values.to_numpy()
    query_ids, points = queries["query_id"].to_numpy(), matrix(queries["v"])
    parts = []
    for at in range(0, len(points), WALKS):
        own, q = query_ids[at : at + WALKS], points[at : at + WALKS]
        found, _ = walk(vectors, norms, edges, start, (q / scale - mean).astype(np.float32), beam)
        i, j = np.nonzero(found >= 0)
        node = found[i, j]
        n = first[node + 1] - first[node]
        # all ids of the nodes found, each with the exact distance of its node
        score = np.repeat(np.sqrt(((exact[node] - q[i]) ** 2).sum(axis=1)), n)
        query = np.repeat(own[i], n)
        ids = owned[np.repeat(first[node] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        keep = ids != query
        query, ids, score = query[keep], ids[keep], score[keep]
        order = np.lexsort((ids, score, query))
        query, ids, score = query[order], ids[order], score[order]
        near = np.arange(len(query)) - np.searchsorted(query, query) < k
        parts.append(pa.table([query[near], ids[near], score[near]], schema=schema))
    return pa.concat_tables(parts)


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = NEIGHBOURS,
    beam: int = BEAM,
    shard_rows: int = SHARD_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """Per query its ``k`` nearest rows found: ``query_id, rank, vec_id, score``, by Euclidean distance, ties by smaller id.

    ``queries`` has the same two columns; a query's own id is no candidate. Rows and queries take no part without id or
    if the vector is null, zero or has a component that is null or not finite; only vectors of the query's length are
    compared. Repeated ids among the rows stay, repeated queries are answered once for the vector that sorts first; other
    columns are ignored. Fewer than ``k`` candidates are all given, as ``beam`` is over ``k`` and small shards are
    walked whole; empty tables give no rows.
    """
    nodes = index(rows, key, vector, k, shard_rows)
    asked = usable(queries, key, vector).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = cut(asked.select(F.col("vec_id").alias("query_id"), F.size("v").alias("size"), "v"))
    blocks = max(1, -(-asked.count() // block_queries))
    last_shard = nodes.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0]
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    left = nodes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last_shard))))
    keys = ["size", "shard", "block"]
    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(lambda a, b: beam_search(a, b, k, beam), "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
