"""Groups compared block by block: every two rows of a group meet in one task, and no pair becomes a row.

Rows of a group are dealt to blocks of a bounded size by a hash, and each is sent to all blocks of the other side. So the
rows grow with a group's size over the size of a block, and a task holds two blocks at most. Where that is too many rows to
shuffle, ``packed`` makes each block one row, and ``crossed`` reads them for each other without a shuffle for pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.shared import cut

if TYPE_CHECKING:
    import pandas as pd


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of sorted batches, in one frame for each combination of ``keys``; a run may go on in the next batch."""
    import pandas as pd  # in tasks only

    left = None
    for batch in batches:
        frame = batch.to_pandas()
        if left is not None:
            frame = pd.concat([left, frame], ignore_index=True)
        if not len(frame):
            continue
        k = frame[keys].to_numpy()
        starts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1)]
        for begin, end in zip(starts, starts[1:]):
            yield frame.iloc[begin:end]
        left = frame.iloc[starts[-1] :]
    if left is not None:
        yield left


def forest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the edges (x, y) connect what those before them don't."""
    parent: dict[int, int] = {}

    def root(v):
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = parent[up]
            v = up
        return v

    keep = np.zeros(len(x), bool)
    for at in range(0, len(x), 1 << 16):  # few of the edges as Python's numbers at once
        for k, (p, q) in enumerate(zip(x[at : at + (1 << 16)].tolist(), y[at : at + (1 << 16)].tolist()), at):
            p, q = root(p), root(q)
            if p != q:
                parent[p] = q
                keep[k] = True
    return keep


def in_blocks(few: DataFrame, every: DataFrame, size: int) -> DataFrame:
    """Both sides of each group dealt to blocks of about ``size`` rows, and each row sent to all blocks of the other side.

    Sides have the columns ``place`` (the group) and node; ``few`` tells them apart in the result, whose rows of one
    (place, i, j) are a block of either side. So no pair becomes a row.
    """
    blocks = lambda n: F.ceil(F.col(n) / size).cast("int")
    count = lambda side, n: side.groupBy("place").agg(F.count("*").alias(n))
    sizes = cut(count(few, "n").join(count(every, "m"), "place").select("place", blocks("n").alias("a"), blocks("m").alias("b")))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = few.join(sizes, "place").select(*few.columns, F.lit(True).alias("few"), own("a").alias("i"), all_of("b").alias("j"))
    right = every.join(sizes, "place").select(*few.columns, F.lit(False).alias("few"), all_of("a").alias("i"), own("b").alias("j"))
    return left.unionByName(right)


def among(rows: DataFrame, size: int) -> DataFrame:
    """Like ``in_blocks``, for groups whose rows meet each other: both blocks of a pair are one side (``few`` is null), ``own`` is a row's block."""
    sizes = cut(rows.groupBy("place").agg(F.ceil(F.count("*") / size).cast("int").alias("a")))
    dealt = rows.join(sizes, "place").withColumn("own", F.pmod(F.xxhash64("node"), F.col("a")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("a") - 1)))
    return dealt.select(*rows.columns, "own", F.lit(None).cast("boolean").alias("few"), F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"))


#: Blocks in a partition of ``packed``, and partitions at least (if there are as many blocks) and at most; tasks of ``crossed`` are their square.
BLOCKS_IN_PART, LEAST_PARTS, MOST_PARTS = 8, 12, 200


def packed(rows: DataFrame, size: int, columns: list[str], vector: str) -> DataFrame:
    """(place, block, columns, vector): blocks of about ``size`` rows (place, node, ...) as one row each, columns as arrays, vectors end to end."""
    sizes = cut(rows.groupBy("place").agg(F.ceil(F.count("*") / size).cast("int").alias("_a")))
    blocks = sizes.agg(F.sum("_a")).first()[0] or 0
    parts = max(1, min(MOST_PARTS, blocks, max(LEAST_PARTS, math.ceil(blocks / BLOCKS_IN_PART))))
    dealt = rows.join(sizes, "place").withColumn("block", F.pmod(F.xxhash64("node"), F.col("_a")).cast("int"))
    held = dealt.groupBy("place", "block").agg(F.collect_list(F.struct(*columns, vector)).alias("_r"))
    arrays = [F.col(f"_r.{c}").alias(c) for c in columns]
    return cut(held.select("place", "block", *arrays, F.flatten(F.col(f"_r.{vector}")).alias(vector)).repartitionByRange(parts, "place", "block"))


def crossed(blocks: DataFrame) -> DataFrame:
    """Each two blocks of a place once, also a block with itself: the columns of one, and those of the other with an ending ``_of``.

    A task reads two partitions of the blocks, so nothing is shuffled or written for pairs.
    """
    others = blocks.select(*[F.col(c).alias(f"{c}_of") for c in blocks.columns])
    both = blocks.hint("shuffle_replicate_nl").join(others, (F.col("place") == F.col("place_of")) & (F.col("block") <= F.col("block_of")))
    return both.drop("place_of")


def arrays_of(batches: Iterator[pa.RecordBatch], columns: list[str], vector: str) -> Iterator[tuple]:
    """(place, block, other block, arrays of one, arrays of the other) of the pairs of ``crossed``; vectors are a matrix."""

    def side(row: dict, ending: str) -> dict:
        out = {c: row[c + ending].values.to_numpy(zero_copy_only=False) for c in columns}
        out[vector] = row[vector + ending].values.to_numpy(zero_copy_only=False).reshape(len(out[columns[0]]), -1)
        return out

    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(n)[k] for n, c in enumerate(batch.schema.names)}
            yield row["place"].as_py(), row["block"].as_py(), row["block_of"].as_py(), side(row, ""), side(row, "_of")
