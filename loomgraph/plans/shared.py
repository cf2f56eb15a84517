"""Table access, lineage cutting and joins shared by all operators."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current:
        return current
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there from now on.

    The copy survives lost executors, and what follows no longer recomputes what led to it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A side is broadcast only if it has been counted and has at most this many rows.
BROADCAST_ROWS = 50_000


def join_counted(left: DataFrame, right: DataFrame, on: str | list[str], how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with ``right`` broadcast if it has at most ``limit`` rows, else by shuffle.

    ``right`` should be cut or otherwise cheap to count, and its rows short.
    """
    small = right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if small else right, on, how)


#: Pairs of rows that a task of ``join_dealt`` makes, about; and the most tasks.
PAIRS_IN_TASK, MOST_TASKS = 2_000_000, 20_000


def join_dealt(left: DataFrame, right: DataFrame, on: str, pairs: int | None = None) -> DataFrame:
    """Inner join of sides of which many rows share a key: a key's pairs are dealt to tasks as a grid of parts of either side.

    A key with ``n`` and ``m`` rows gets about n * m / ``pairs`` (PAIRS_IN_TASK) cells; each row is sent to the cells of its line or column only.
    Both sides are read twice, so they should be cut or cheap.
    """
    pairs = pairs or PAIRS_IN_TASK
    n, m = F.col("_n").cast("double"), F.col("_m").cast("double")
    count = lambda side, name: side.groupBy(on).agg(F.count("*").alias(name))
    cells = F.ceil(n * m / pairs)
    lines = F.least(F.greatest(F.round(F.sqrt(cells * n / m)), F.lit(1.0)), cells, n)
    sizes = count(left, "_n").join(count(right, "_m"), on)
    sizes = cut(sizes.withColumn("_a", lines.cast("int")).withColumn("_b", F.least(F.ceil(cells / F.col("_a")), m).cast("int")))
    every = sizes.agg(F.sum(n * m)).first()[0] or 0
    tasks = max(1, min(MOST_TASKS, math.ceil(every / pairs)))
    own = lambda side, parts: F.pmod(F.xxhash64(*side.columns), F.col(parts)).cast("int")
    all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    parts = sizes.select(on, "_a", "_b")
    lefts = join_counted(left, parts, on, "inner").select(*left.columns, own(left, "_a").alias("_i"), all_of("_b").alias("_j"))
    rights = join_counted(right, parts, on, "inner").select(*right.columns, all_of("_a").alias("_i"), own(right, "_b").alias("_j"))
    keys = [on, "_i", "_j"]
    # numbers of partitions that are given are kept, while those Spark chooses by the size of the sides would be too few for the pairs
    return lefts.repartition(tasks, *keys).hint("merge").join(rights.repartition(tasks, *keys), keys).drop("_i", "_j")
