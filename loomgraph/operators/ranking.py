"""Window operators: percentile ranks, top rows by bucket, neighbours in an order, epochs, outliers, drift."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile_rank(df: DataFrame, value: str, by: Sequence[str], name: str = "percentile") -> DataFrame:
    """Mean rank of ties from 0 over n - 1, to four places; 0.5 for a group of one.

    Values are counted first, so the window runs over distinct values and not over rows. Null values have a null rank
    and don't count in n; rows with a null group are one group. All rows stay.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("ties"))
    order = Window.partitionBy(*by).orderBy(value)
    below = F.coalesce(F.sum("ties").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("ties").over(Window.partitionBy(*by))
    rank = F.when(n > 1, F.round((below + (F.col("ties") - 1) / 2) / (n - 1), 4)).otherwise(F.lit(0.5))
    own = [*by, value]
    ranked = counted.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(own)], rank.alias(name))
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(ranked[f"_{i}"]) for i, c in enumerate(own)])
    return df.join(ranked, same, "left").select(*[df[c] for c in df.columns], name)


def top_per_group(df: DataFrame, by: Sequence[str | Column], order: Sequence[Column], k: int, name: str = "place") -> DataFrame:
    """The first ``k`` rows of each group in the given order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def calibration_samples(df: DataFrame, value: str, levels: Mapping[str, tuple[float, float]], k: int, tie: str) -> DataFrame:
    """For each level (from, to): the ``k`` rows in its range that are nearest to its middle. Levels may overlap."""
    level = F.array(*[F.struct(F.lit(name).alias("level"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for name, (a, b) in levels.items()])
    hit = df.withColumn("at", F.explode(F.filter(level, lambda x: F.col(value).between(x["a"], x["b"]))))
    hit = hit.select("*", F.col("at.level").alias("level"), F.abs(F.col(value) - (F.col("at.a") + F.col("at.b")) / 2).alias("distance")).drop("at")
    return top_per_group(hit, ["level"], [F.col("distance"), F.col(tie)], k)


def chain(df: DataFrame, by: Sequence[str], order: Sequence[Column], key: str, major: Column) -> DataFrame:
    """Previous and next key in an order, and whether ``major`` changed from the one before."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({"previous": F.lag(key).over(w), "next": F.lead(key).over(w), "is_boundary": F.coalesce(major != F.lag(major).over(w), F.lit(False))})


def epochs(df: DataFrame, by: Sequence[str], order: Sequence[Column], fingerprint: Column, place: str) -> DataFrame:
    """Runs of one fingerprint: epoch number, first and last place, rows. A null fingerprint is one like any other."""
    w = Window.partitionBy(*by).orderBy(*order)
    same = F.lag(fingerprint).over(w).eqNullSafe(fingerprint)
    starts = F.when((F.row_number().over(w) > 1) & same, 0).otherwise(1)
    changed = df.select("*", starts.alias("starts"), fingerprint.alias("fingerprint"))
    numbered = changed.withColumn("epoch", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "epoch", "fingerprint").agg(F.min(place).alias("first_place"), F.max(place).alias("last_place"), F.count("*").alias("n"))


def outliers(df: DataFrame, value: str, by: Sequence[str], least: int = 3) -> DataFrame:
    """Rows whose z-score in their group is under -1, with what to do; groups under ``least`` values are left out."""
    stats = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("spread"))
    scored = df.where(F.col(value).isNotNull()).join(stats.where((F.col("n") >= least) & (F.col("spread") > 0)), list(by))
    z = (F.col(value) - F.col("mean")) / F.col("spread")
    action = F.when(z < -2, "regenerate").when(z < -1.5, "review").otherwise("investigate")
    return scored.where(z < -1).withColumn("z", F.round(z, 4)).withColumn("action", action)


def drift(df: DataFrame, value: str, by: Sequence[str], least: int = 3, limit: float = 1.0) -> DataFrame:
    """Coefficient of variation by group, and whether it exceeds the limit."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("spread")).where(F.col("n") >= least)
    cv = F.when(F.col("mean") != 0, F.col("spread") / F.abs("mean"))
    return out.select(*by, "n", F.round(cv, 4).alias("cv"), F.coalesce(cv > limit, F.lit(False)).alias("drifts"))
