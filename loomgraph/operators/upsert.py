"""Keyed writes: the table after an upsert, edges without repeats, snapshots on disk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the last in order; an aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rest).alias("row")))["row"].alias("row"))
    return best.select(*keys, "row.*").select(df.columns)


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """``table`` after ``rows``: a new row replaces the old one with its key, and of several the last in order wins.

    A property that is null in the new row keeps its old value.
    """
    new = latest(rows, keys, order) if order else rows.dropDuplicates(list(keys))
    rest = [c for c in table.columns if c not in keys]
    renamed = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in rest if c in new.columns])
    both = table.join(renamed, list(keys), "full_outer")
    return both.select(*keys, *[F.coalesce(f"new_{c}", c).alias(c) if c in new.columns else F.col(c) for c in rest])


def edges(df: DataFrame, src: str, dst: str, properties: Sequence[str] = ()) -> DataFrame:
    """Edge table without repeats; edges that lack an end are dropped."""
    return df.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).alias("src"), F.col(dst).alias("dst"), *properties).distinct()


def resolved_edges(found: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Edges both of whose ends exist in the node table."""
    ids = nodes.select(F.col(key).alias("id"))
    return found.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, value: str) -> DataFrame:
    """Merge of two changed copies of a table: (key, value, origin); a change on one side wins over none, a
    change on both sides is a conflict that keeps ours."""
    sides = base.select(key, F.col(value).alias("b")).join(ours.select(key, F.col(value).alias("o")), key, "full_outer").join(theirs.select(key, F.col(value).alias("t")), key, "full_outer")
    o, t = ~F.col("o").eqNullSafe(F.col("b")), ~F.col("t").eqNullSafe(F.col("b"))
    agree = F.col("o").eqNullSafe(F.col("t"))
    origin = F.when(agree, "same").when(o & t, "conflict").when(t, "theirs").otherwise("ours")
    return sides.select(key, F.when(origin == "theirs", F.col("t")).otherwise(F.col("o")).alias(value), origin.alias("origin"))


def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a table; with partitions, only those that ``df`` holds are replaced."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def fanned_out(nodes: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """(src, dst, type): an edge for each given column that is not null, from one pass over the nodes."""
    each = F.array(*[F.struct(F.col(c).cast("string").alias("dst"), F.lit(t).alias("type")) for t, c in columns.items()])
    return nodes.select(F.col(key).alias("src"), F.explode(each).alias("e")).select("src", "e.dst", "e.type").where("dst is not null")


def replaced_or_deleted(table: DataFrame, changed: DataFrame, key: str, gone: Column) -> DataFrame:
    """``table`` without the changed rows for which ``gone`` holds, and with the others in place of the old ones."""
    kept = table.join(changed.select(key), key, "left_anti")
    return kept.unionByName(changed.where(~F.coalesce(gone, F.lit(False))).select(table.columns))
