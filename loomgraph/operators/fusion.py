"""Fusion of ranked streams: weighted blends, reciprocal ranks, tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.shared import cut


def blend(vector: DataFrame, text: DataFrame, key: str, weights: tuple[float, float] = (0.6, 0.4), bonus: float = 0.0, digits: int = 4) -> DataFrame:
    """(key, score): weighted sum; a stream that lacks the key counts 0, and both together earn the bonus."""
    both = vector.select(key, F.col("score").alias("v")).join(text.select(key, F.col("score").alias("t")), key, "full_outer")
    score = weights[0] * F.coalesce("v", F.lit(0.0)) + weights[1] * F.coalesce("t", F.lit(0.0))
    extra = F.when(F.col("v").isNotNull() & F.col("t").isNotNull(), bonus).otherwise(0.0)
    return both.select(key, "v", "t", F.round(score + extra, digits).alias("score"))


def boosted(score: Column, text: Column, words: Sequence[str], step: float = 0.015) -> Column:
    """Score times 1 + step for each query word in the text; a word of up to three letters must be a whole segment."""
    segment = lambda w: F.array_contains(F.split(F.lower(text), r"[/_\s]+"), w)
    hits = [segment(w.lower()) | (F.contains(F.lower(text), F.lit(w.lower())) if len(w) > 3 else F.lit(False)) for w in words]
    n = sum((h.cast("int") for h in hits[1:]), hits[0].cast("int")) if hits else F.lit(0)
    return F.round(score * (1 + step * n), 4)


def ranked(stream: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """(key, place): places from 0 by score and then key.

    With ``k`` only the top rows are ranked, after a limit that each task applies first. Without it rows are sorted in
    ranges, each range is ranked by itself, and the sizes of the ranges before are added.
    """
    order = [F.desc("score"), F.asc(key)]
    if k:
        return stream.orderBy(*order).limit(k).select(key, (F.row_number().over(Window.orderBy(*order)) - 1).alias("place"))
    sorted_ = cut(stream.select(key, "score").repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    sizes = sorted_.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    placed = sorted_.join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    return placed.select(key, (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1).alias("place"))


def reciprocal_ranks(streams: Sequence[DataFrame], key: str, k: int = 60) -> DataFrame:
    """(key, mass): sum of 1 / (k + place + 1) over the streams (key, place)."""
    union = streams[0].select(key, "place")
    for s in streams[1:]:
        union = union.unionByName(s.select(key, "place"))
    return union.groupBy(key).agg(F.sum(1.0 / (k + F.col("place") + 1)).alias("mass"))


def tier_gate(tiers: DataFrame, key: str, corroborated: DataFrame) -> DataFrame:
    """Keys with a tier 1 match that are also in ``corroborated`` or have a tier 3 match."""
    seen = tiers.groupBy(key).agg(F.bool_or(F.col("tier") == 1).alias("t1"), F.bool_or(F.col("tier") == 3).alias("t3"))
    marked = seen.join(corroborated.select(key).distinct().withColumn("also", F.lit(True)), key, "left")
    return marked.where("t1 and (also or t3)").select(key)
