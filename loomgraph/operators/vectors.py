"""Exact vector search and cluster vectors.

A bounded set of query vectors is collected into one matrix and broadcast; the rows are multiplied with it in blocks,
and each task keeps only its best rows for each query before they meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.shared import cut

#: Query vectors collected and broadcast for one pass over the rows.
QUERIES_AT_ONCE = 4096
BLOCK_ROWS = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if either is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def unit(v: Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def truncated(v: Column, dimensions: int) -> Column:
    """The first dimensions, of length 1 again."""
    return unit(F.slice(v, 1, dimensions))


def top_k(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, least: float = -1.0, skip_self: bool = True) -> DataFrame:
    """(query, key, similarity, place): the ``k`` rows with the highest cosine for each query vector, ties by key.

    ``queries`` has the same two columns. Up to QUERIES_AT_ONCE of them are searched in one pass over the rows, more in
    several passes, in order of their keys. Rows and queries without key or vector are left out, as are rows whose
    vector is not as long as the query's. A zero vector has cosine 0 with all. Keys of queries must differ.
    """
    found = f"query long, {key} long, similarity double"
    known = cut(queries.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector)).where(F.col(key).isNotNull() & F.col(vector).isNotNull()))
    usable = rows.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector)).where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    parts, last, size = [], None, None
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    while True:
        rest = known if last is None else known.where((F.size(vector) > size) | ((F.size(vector) == size) & (F.col(key) > last)))
        # one length at a time, the shortest first: this side is bounded by the limit
        picked = rest.orderBy(F.size(vector), key).limit(QUERIES_AT_ONCE).toArrow()
        if not picked.num_rows:
            break
        vectors = picked.column(vector).to_pylist()
        size = len(vectors[0])
        vectors = [v for v in vectors if len(v) == size]
        ids = np.array(picked.column(key).to_pylist()[: len(vectors)], np.int64)
        last = int(ids[-1])
        shared = rows.sparkSession.sparkContext.broadcast((ids, unit_rows(np.array(vectors, np.float64).reshape(len(ids), size))))
        near = usable.where(F.size(vector) == size).mapInArrow(lambda batches, shared=shared: best_rows(batches, *shared.value, k, least, skip_self), found)
        near = near.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
        done = picked.num_rows < QUERIES_AT_ONCE and len(vectors) == picked.num_rows
        if done and not parts:
            return near
        parts.append(cut(near))
        if done:
            break
    return reduce(DataFrame.union, parts) if parts else rows.sparkSession.createDataFrame([], found + ", place int")


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def best_rows(batches: Iterator[pa.RecordBatch], ids: np.ndarray, matrix: np.ndarray, k: int, least: float, skip_self: bool) -> Iterator[pa.RecordBatch]:
    """Each task's best rows (query, key, similarity) for all queries at once.

    A block's product is cut at what is the k-th best so far or in the block, whichever is higher, with all ties; what
    passes is sorted by query, similarity and key.
    """
    floor = np.full(len(ids), least)
    q, own, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    name = "key"
    for batch in batches:
        name = batch.schema.names[0]
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            keys = part.column(0).to_numpy(zero_copy_only=False)
            product = unit_rows(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)) @ matrix.T
            if skip_self:
                product[keys[:, None] == ids[None, :]] = -np.inf
            n = min(k, len(keys))
            cutoff = np.maximum(floor, np.partition(product, len(keys) - n, axis=0)[len(keys) - n])
            i, j = np.nonzero((product >= cutoff) & (product > -np.inf))
            q, own, s = np.concatenate([q, j]), np.concatenate([own, keys[i]]), np.concatenate([s, product[i, j]])
            order = np.lexsort((own, -s, q))
            q, own, s = q[order], own[order], s[order]
            first = np.searchsorted(q, q)  # where each row's query begins
            kept = np.arange(len(q)) - first < k
            q, own, s = q[kept], own[kept], s[kept]
            ends = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == k - 1)
            floor[q[ends]] = np.maximum(least, s[ends])
    schema = pa.schema([("query", pa.int64()), (name, pa.int64()), ("similarity", pa.float64())])
    if len(q):
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own), pa.array(s)], schema=schema)


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, centroid): mean of the unit vectors by position, of length 1 again."""
    places = df.select(group, F.posexplode(unit(F.col(vector))).alias("at", "x"))
    means = places.groupBy(group, "at").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    joined = means.groupBy(group).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "m"))).alias("p"))
    return joined.select(group, "n", unit(F.transform("p", lambda p: p["m"])).alias("centroid"))


def mean_similarity(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, similarity): mean cosine over all pairs of different members, 1 for a single one, within 0 and 1.

    The sum over pairs follows from the length of the summed unit vectors, so no pair is formed.
    """
    places = df.select(group, F.posexplode(unit(F.col(vector))).alias("at", "x"))
    sums = places.groupBy(group, "at").agg(F.sum("x").alias("s"), F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("own"))
    squared = sums.groupBy(group).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("all"), F.sum("own").alias("own"))
    mean = (F.col("all") - F.col("own")) / (F.col("n") * (F.col("n") - 1))
    return squared.select(group, "n", F.when(F.col("n") < 2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))).alias("similarity"))
