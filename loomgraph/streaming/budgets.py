"""Budgets and backlogs: reservations in order, fair admission, retries, watermarks, oversized texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-9
#: A phase may go over its share of the budget by this factor.
PHASE_SLACK = 1.5


def reserved(requests: DataFrame, pool: float, caps: Mapping[str, float]) -> DataFrame:
    """Requests (run, at, phase, amount) with ``granted``, decided one after the other for each run.

    A request is refused if its phase would go over 1.5 times its cap, or the pool has too little left; what is refused
    uses up nothing. Rows of a run come to one task in order and are decided as they stream by; only the sums are kept.
    Ties of ``at`` go by phase and amount. Null amounts are refused.
    """
    schema = "run string, at long, phase string, amount double, granted boolean"
    arrow = pa.schema([("run", pa.string()), ("at", pa.int64()), ("phase", pa.string()), ("amount", pa.float64()), ("granted", pa.bool_())])
    limits = {k: v * PHASE_SLACK for k, v in caps.items()}

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, left, used = object(), pool, {}
        for batch in batches:
            granted = []
            for run, phase, amount in zip(batch.column("run").to_pylist(), batch.column("phase").to_pylist(), batch.column("amount").to_pylist()):
                if run != current:
                    current, left, used = run, pool, {}
                spent = used.get(phase, 0.0)
                ok = amount is not None and spent + amount <= limits.get(phase, float("inf")) + EPSILON and left >= amount - EPSILON
                if ok:
                    left -= amount
                    used[phase] = spent + amount
                granted.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(granted, pa.bool_())], schema=arrow)

    typed = requests.select(F.col("run").cast("string"), F.col("at").cast("long"), F.col("phase").cast("string"), F.col("amount").cast("double"))
    return typed.repartition("run").sortWithinPartitions("run", "at", "phase", "amount").mapInArrow(decide, schema)


def admitted(pools: DataFrame) -> DataFrame:
    """(pool, admit): whether each pool may take its next batch. ``pools`` is (pool, weight, spent, active).

    A pool whose share of all spending is under its share of the active pools' weights may; so may the only active pool,
    and every active one before anything is spent. Without active pools all may; pools without a weight never.
    """
    whole = Window.partitionBy()  # a row for each pool: few
    spent, n_active = F.sum(F.coalesce("spent", F.lit(0.0))).over(whole), F.count_if("active").over(whole)
    weights = F.sum(F.when(F.col("active"), F.col("weight"))).over(whole)
    fair = F.coalesce("spent", F.lit(0.0)) / spent < F.col("weight") / weights
    rule = F.when(F.col("weight").isNull(), False).when(n_active == 0, True).when(~F.coalesce("active", F.lit(False)), False).when(n_active == 1, True)
    return pools.select("pool", rule.when(spent < EPSILON, True).when(weights < EPSILON, True).otherwise(fair).alias("admit"))


def backlog(items: DataFrame, done: str, text: str, score: Column, least: float, k: int, key: str) -> DataFrame:
    """The next ``k`` rows with a text, without a result and with at least a score, best first."""
    return items.where(F.col(done).isNull() & (F.coalesce(text, F.lit("")) != "") & (score >= least)).orderBy(F.desc(score), key).limit(k)


def pending(items: DataFrame, condition: Column) -> bool:
    """Whether any row waits; the scan ends at the first."""
    return not items.where(condition).limit(1).isEmpty()


def recovered(items: DataFrame, most_attempts: int) -> DataFrame:
    """Items (id, status, error, attempts): failed ones that may be tried again are open again, without claim or error."""
    again = (F.col("status") == "failed") & (F.coalesce("attempts", F.lit(0)) < most_attempts)
    return items.withColumns({"error": F.when(~F.coalesce(again, F.lit(False)), F.col("error")), "status": F.when(again, "discovered").otherwise(F.col("status"))})


def after_watermark(rows: DataFrame, at: str, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rows, next watermark): rows later than the stored one-row ``watermark``, and what to store next."""
    low = F.broadcast(seen.agg(F.max("watermark").alias("watermark")))  # one row
    new = rows.crossJoin(low).where(F.col("watermark").isNull() | (F.col(at) > F.col("watermark")))
    last = rows.agg(F.max(at).alias("top")).crossJoin(low).select(F.greatest("top", "watermark").alias("watermark"))
    return new.drop("watermark"), last


#: Characters that are embedded at once.
MOST_CHARS = 4000


def segments(text: Column, most: int) -> Column:
    """A text as segments of at most ``most`` characters, cut at line ends where that is possible.

    Lines are added to a segment while they fit; a longer line is cut hard. The segments joined give the text again.
    """
    lines = F.filter(F.split(text, r"(?<=\n)"), lambda x: x != "")
    pieces = F.flatten(F.transform(lines, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / most)), lambda i: F.substr(x, i * most + 1, F.lit(most)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    fits = lambda a, x: F.length(a["open"]) + F.length(x) <= most
    step = lambda a, x: F.when(fits(a, x), F.struct(a["done"].alias("done"), F.concat(a["open"], x).alias("open"))).otherwise(F.struct(F.array_append(a["done"], a["open"]).alias("done"), x.alias("open")))
    return F.aggregate(pieces, start, step, lambda a: F.filter(F.array_append(a["done"], a["open"]), lambda x: x != ""))


def averaged_vectors(parts: DataFrame, key: str, vector: str, weight: Column | None = None) -> DataFrame:
    """(key, n, vector): the mean of the parts' vectors by position, each counting by ``weight`` (1 if not given).

    Places are averaged apart, so no row gathers a long text's vectors. Parts without key or vector, or with a weight that
    is null or not above 0, are left out; a place that only longer vectors have is averaged over those.
    """
    told = parts.select(key, F.col(vector).alias("v"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w")).where(F.col(key).isNotNull() & F.col("v").isNotNull() & (F.col("w") > 0))
    places = told.select(key, "w", F.posexplode("v").alias("at", "x"))
    means = places.groupBy(key, "at").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("m"), F.count("*").alias("n"))
    joined = means.groupBy(key).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "m"))).alias("p"))
    return joined.select(key, "n", F.transform("p", lambda p: p["m"]).alias(vector))


def embedded(rows: DataFrame, key: str, text: str, embed: Callable[[Column], Column], most: int = MOST_CHARS, by_length: bool = False) -> DataFrame:
    """``rows`` with ``n_segments`` and ``embedding``: texts over ``most`` characters are cut, each segment is embedded, and the vectors averaged.

    ``embed`` makes a vector of a text's column. With ``by_length`` a segment counts by its characters. Keys must differ; null and empty
    texts have no segments and a null embedding.
    """
    parts = rows.select(key, F.explode(segments(F.col(text), most)).alias("segment"))
    vectors = parts.select(key, embed(F.col("segment")).alias("embedding"), F.length("segment").alias("chars"))
    means = averaged_vectors(vectors, key, "embedding", F.col("chars") if by_length else None).withColumnRenamed("n", "n_segments")
    return rows.join(means, key, "left").withColumn("n_segments", F.coalesce("n_segments", F.lit(0)))
