"""Aggregations: grouped and conditional counts, independent counts, shares of cost, coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_counts(df: DataFrame, by: Sequence[str | Column], name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(name))


def counters(df: DataFrame, conditions: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """One count for each condition, all in one pass."""
    return df.groupBy(*by).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def counts_row(parts: Mapping[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each part; each is counted by itself, so none multiplies another."""
    rows = [df.select(F.lit(name).alias("part")) for name, df in parts.items()]
    union = rows[0]
    for r in rows[1:]:
        union = union.unionAll(r)
    return union.agg(*[F.count_if(F.col("part") == name).alias(name) for name in parts])


def apportioned(df: DataFrame, ids: str, cost: str) -> DataFrame:
    """(id, share): the cost of a row split evenly over its ids; rows without ids are skipped."""
    each = df.where(F.size(ids) > 0).select(F.explode(ids).alias("id"), (F.col(cost) / F.size(ids)).alias("part"))
    return each.groupBy("id").agg(F.sum("part").alias("share"))


def optional_collect(left: DataFrame, right: DataFrame, key: str, columns: Mapping[str, str], most: int | None = None) -> DataFrame:
    """Left join of values collected beforehand: sorted distinct values of each column, the first ``most`` of them.

    The many side is aggregated before the join, so several optional branches don't multiply.
    """
    first = (lambda c: F.slice(c, 1, most)) if most else (lambda c: c)
    collected = right.groupBy(key).agg(*[first(F.sort_array(F.collect_set(c))).alias(name) for name, c in columns.items()])
    return left.join(collected, key, "left")


def coverage(targets: DataFrame, mapped: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """total, mapped and percent of the targets that have a mapping."""
    flagged = targets.join(mapped.select(key).distinct().withColumn("hit", F.lit(1)), key, "left")
    out = flagged.groupBy(*by).agg(F.count("*").alias("total"), F.count("hit").alias("mapped"))
    return out.withColumn("percent", F.round(100.0 * F.col("mapped") / F.col("total"), 1))


def volatility(changes: DataFrame, key: str, kind: str, renamed: Column) -> DataFrame:
    """changes + 2 * kinds of change + 3 if renamed, for each key."""
    out = changes.groupBy(key).agg(F.count("*").alias("n_changes"), F.count_distinct(kind).alias("n_kinds"), F.max(F.when(renamed, 1).otherwise(0)).cast("long").alias("renamed"))
    return out.withColumn("volatility", F.col("n_changes") + 2 * F.col("n_kinds") + 3 * F.col("renamed"))


def buckets(df: DataFrame, value: Column, edges: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Counts and mean by bucket; bucket k holds values at or over edges[k], the last edge that applies."""
    named = F.lit(names[0])
    for edge, name in zip(edges[1:], names[1:]):
        named = F.when(value >= edge, name).otherwise(named)
    return df.groupBy(named.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"))
