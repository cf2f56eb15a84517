"""Duplicate names: blocked candidate pairs, token overlap, close vectors, classes, merging and conflicts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.blocks import among, forest, runs
from loomgraph.operators.components import connected_components
from loomgraph.operators.vectors import unit
from loomgraph.plans.shared import cut

if TYPE_CHECKING:
    import pandas as pd

#: Nodes in a block.
BLOCK = 512


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct items; 0 for two empty arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def token_classes(names: DataFrame, key: str, tokens: str, least: float = 0.8) -> DataFrame:
    """(key, class, n_links): classes of rows whose token sets overlap at or over ``least``, and how many rows each is linked with.

    Equal sets are one node. Nodes meet on prefix tokens: with tokens in order of frequency, two sets that overlap enough
    share one of the rarest few of each. Under a token they are compared block by block, and a pair counts under the
    first of its shared prefix tokens only; tasks give links that span the classes, and sums, but no pairs. Rows with a
    null or empty set are left out.
    """
    sets = cut(names.select(key, F.array_sort(F.array_distinct(F.array_compact(tokens))).alias("set")).where(F.size("set") > 0))
    nodes = sets.groupBy("set").agg(F.count("*").alias("copies"))
    nodes = cut(nodes.select("set", "copies", F.xxhash64("set").alias("node")))
    counts = nodes.select(F.explode("set").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    spread = nodes.select("node", F.explode("set").alias("token")).join(counts, "token")
    ordered = spread.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    prefix = F.slice("t", F.lit(1), F.size("t") - F.ceil(F.size("t") * F.lit(least)).cast("int") + 1)
    keyed = ordered.select("node", F.transform(prefix, lambda x: x["token"]).alias("prefix")).join(nodes, "node")
    placed = keyed.select("node", "set", "copies", "prefix", F.explode("prefix").alias("place"))
    found = cut(meet(among(placed, BLOCK), least))
    classes = connected_components(found.where("dst is not null")).withColumnRenamed("id", "node")
    linked = found.where("dst is null").groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("to_others"))
    out = nodes.join(classes, "node", "left").join(linked, "node", "left").withColumn("class", F.coalesce("component", "node"))
    out = sets.join(out.select("set", "copies", "to_others", "class"), "set")
    first = out.groupBy("class").agg(F.min(key).alias("first"))
    return out.join(first, "class").select(key, F.col("first").alias("class"), (F.col("copies") - 1 + F.coalesce("to_others", F.lit(0))).alias("n_links"))


def meet(rows: DataFrame, least: float) -> DataFrame:
    """Links (src, dst, null) that span the classes of each pair of blocks, and sums (src, null, n) of linked rows."""
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["place", "i", "j"]):
            token, i, j = group["place"].iloc[0], group["i"].iloc[0], group["j"].iloc[0]
            node, copies, own = (group[c].to_numpy() for c in ("node", "copies", "own"))
            places: dict[str, int] = {}
            at = [[places.setdefault(t, len(places)) for t in s] for s in group["set"]]
            bits, early = (np.zeros((len(node), len(places)), np.float32) for _ in range(2))
            for r, (p, prefix) in enumerate(zip(at, group["prefix"])):
                bits[r, p] = 1
                early[r, [places[t] for t in prefix if t < token]] = 1  # shared ones make the pair count elsewhere
            shared, sizes = bits @ bits.T, bits.sum(axis=1)
            union = sizes[:, None] + sizes[None, :] - shared
            hit = (shared >= np.float32(least) * union - 1e-4) & (early @ early.T == 0) & (node[:, None] != node[None, :])
            if i != j:
                hit &= own[:, None] != own[None, :]
            x, y = np.nonzero(hit)
            exact = shared[x, y].astype(np.float64) / union[x, y] >= least
            x, y = x[exact], y[exact]
            if not len(x):
                continue
            keep = forest(node[x], node[y])
            sums = np.bincount(x, copies[y], len(node)).astype(np.int64)
            some = np.flatnonzero(sums)
            empty = lambda k: pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(node[x[keep]]), pa.array(node[y[keep]]), empty(int(keep.sum()))], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), empty(len(some)), pa.array(sums[some])], schema=schema)

    dealt = rows.repartition("place", "i", "j").sortWithinPartitions("place", "i", "j")
    return dealt.mapInArrow(run, "src long, dst long, n long")


def unit_vectors(names: DataFrame, key: str, vector: str, same: Sequence[str]) -> DataFrame:
    """(place, key, v): unit vectors of the rows that have a key, a vector other than zero and all columns of ``same``."""
    told = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (key, vector, *same)])
    place = F.to_json(F.array(*[F.col(c).cast("string") for c in same]))
    rows = names.where(told).select(place.alias("place"), F.col(key).alias("key"), F.transform(unit(F.col(vector)), lambda x: x + 0.0).alias("v"))
    return rows.where(F.exists("v", lambda x: x != 0))


def close_blocks(rows: DataFrame, least: float, found: Callable[[np.ndarray, np.ndarray, pd.DataFrame, np.ndarray], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """What ``found`` makes of the rows (x, y) of each two blocks whose cosines exceed ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["place", "i", "j"]):
            v, own = np.stack(group["v"].to_list()), group["own"].to_numpy()
            cosines = v @ v.T
            hit = (cosines > least) & ~np.eye(len(v), dtype=bool)
            if group["i"].iloc[0] != group["j"].iloc[0]:
                hit &= own[:, None] != own[None, :]
            x, y = np.nonzero(hit)
            if len(x):
                yield from found(x, y, group, cosines)

    dealt = among(rows, BLOCK).repartition("place", "i", "j").sortWithinPartitions("place", "i", "j")
    return dealt.mapInArrow(run, ddl)


def close_pairs(names: DataFrame, key: str, vector: str, same: Sequence[str], least: float) -> DataFrame:
    """(a, b, similarity): rows that agree in the columns ``same`` and whose vectors' cosine exceeds ``least``, a < b.

    Vectors are compared block by block, so only the pairs that are the result become rows; where these are many, take
    ``close_classes``. Rows that lack anything are left out; all vectors of a block must be of one length.
    """
    kind = names.schema[key].dataType.simpleString()

    def found(x: np.ndarray, y: np.ndarray, group: pd.DataFrame, cosines: np.ndarray) -> Iterator[pa.RecordBatch]:
        node = group["node"].to_numpy()
        kept = node[x] < node[y]
        x, y = x[kept], y[kept]
        yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y]), pa.array(cosines[x, y])], names=["a", "b", "similarity"])

    rows = unit_vectors(names, key, vector, same).withColumnRenamed("key", "node")
    return close_blocks(rows, least, found, f"a {kind}, b {kind}, similarity double")


def close_classes(names: DataFrame, key: str, vector: str, same: Sequence[str], least: float) -> DataFrame:
    """(key, class, n_links): classes of rows linked as in ``close_pairs``, and how many rows each is linked with; alone they are their own class.

    Equal vectors are one node; tasks give links that span the classes, and sums, but no pairs.
    """
    rows = cut(unit_vectors(names, key, vector, same))
    nodes = cut(rows.groupBy("place", "v").agg(F.count("*").alias("copies"), F.min("key").alias("node")))
    kind = names.schema[key].dataType.simpleString()

    def found(x: np.ndarray, y: np.ndarray, group: pd.DataFrame, _: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
        keep = forest(x, y)
        sums = np.bincount(x, copies[y], len(node)).astype(np.int64)
        some = np.flatnonzero(sums)
        type_ = pa.array(node).type
        ends = [(node[x[keep]], pa.array(node[y[keep]], type_), pa.nulls(int(keep.sum()), pa.int64())), (node[some], pa.nulls(len(some), type_), pa.array(sums[some]))]
        for src, dst, n in ends:
            yield pa.RecordBatch.from_arrays([pa.array(src, type_), dst, n], names=["src", "dst", "n"])

    links = cut(close_blocks(nodes, least, found, f"src {kind}, dst {kind}, n long"))
    classes = connected_components(links.where("dst is not null").select("src", "dst")).withColumnRenamed("id", "node")
    linked = links.where("dst is null").groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("to_others"))
    told = nodes.join(classes, "node", "left").join(linked, "node", "left")
    out = rows.join(told.select("place", "v", "copies", "to_others", F.coalesce("component", "node").alias("class")), ["place", "v"])
    return out.select(F.col("key").alias(key), "class", (F.col("copies") - 1 + F.coalesce("to_others", F.lit(0))).alias("n_links"))


def merged(df: DataFrame, key: Sequence[str], text: str, sources: str) -> DataFrame:
    """One row for each key: the longest text (ties by text) and all sources, sorted."""
    longest = F.max(F.struct(F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"), F.col(text).alias("text")))["text"]
    return df.groupBy(*key).agg(longest.alias(text), F.sort_array(F.array_distinct(F.flatten(F.collect_set(sources)))).alias(sources), F.count("*").alias("n_merged"))


def conflicts(df: DataFrame, key: str, strict: Sequence[str], loose: Sequence[str]) -> DataFrame:
    """Keys whose rows disagree: in ``strict`` columns null counts as a value, in ``loose`` ones it does not."""
    kinds = {c: F.count_distinct(F.col(c)) + F.max(F.col(c).isNull().cast("int")) for c in strict} | {c: F.count_distinct(F.col(c)) for c in loose}
    counted = df.groupBy(key).agg(*[k.alias(c) for c, k in kinds.items()])
    return counted.select(key, F.explode(F.filter(F.array(*[F.when(F.col(c) > 1, F.lit(c)) for c in kinds]), lambda x: x.isNotNull())).alias("conflict"))
