"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.shared import cut

BATCH_ROWS = 10_000


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) with the same components: in each task one edge from every node to the smallest it reaches there."""
    names = edges.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(v):
            top = v
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[v] != top:
                parent[v], v = top, parent[v]
            return top

        schema = None
        for batch in batches:
            schema = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        tops = [root(v) for v in parent]
        several = {t for v, t in zip(parent, tops) if v != t}
        rows = [(t, v) for v, t in zip(parent, tops) if v != t or v not in several]
        for at in range(0, len(rows), BATCH_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at : at + BATCH_ROWS]], schema.types[k]) for k in (0, 1)], names=names)

    return edges.mapInArrow(run, edges.schema)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of the edges (src, dst): the smallest id that can be reached.

    Each task first contracts its own edges to stars. Then each round takes the smallest label among the neighbours and
    the label of that label, so long chains shrink by halves. Labels and edges stay in tables; only the number of
    changes comes to the driver. Null ends are ignored; no edges give no rows.
    """
    ends = contracted(edges.select("src", "dst").where("src is not null and dst is not null"))
    both = cut(ends.union(ends.select("dst", "src")).toDF("src", "dst").distinct())
    labels = cut(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("src")).alias("component")))
    for _ in range(most_rounds):
        seen = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(seen, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        above = labels.select(F.col("id").alias("component"), F.col("component").alias("higher"))
        moved = lower.join(above, "component").select("id", "old", F.least("component", "higher").alias("component"))
        moved = cut(moved)
        changed = moved.where("old <> component").limit(1).count()
        labels = moved.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components still change after {most_rounds} rounds")
