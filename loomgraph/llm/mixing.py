"""Mix sources to target weights.

Every document gets a hash-random key. Keys are cut into ranges, and the documents are dealt out and sorted by
(source, range, key), so a hot source spreads over as many tasks as it has ranges. Prefix sums are taken in
two levels: sums of ranges first, then rows within one range. Each source is cut at its exact budget: whole
epochs first, then one more pass in key order that ends where the budget ends.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import word_count, words
from loomgraph.plans.shared import cut

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hash keys are 60-bit whole numbers.
KEY_SPACE = 16**15


def hash_key(doc_id: Column, seed: str = SEED) -> Column:
    """A 60-bit key, the same on every run."""
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("|" + seed))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(per_source: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to rows (src, source_size): one row per source.

    Sources in order of ``src`` get the weights in turn and share the total size by weight. No target exceeds
    ``max_epochs`` times its source's size; what lies above is shared again by weight among the others.
    The sources are ordered by the level at which they reach their cap; the first one that stays below its
    cap fixes the level of all that follow. The windows without partitions hold one row per source.
    """
    by_name = Window.orderBy("src")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = Window.orderBy("level_at_cap", "src").rowsBetween(Window.unboundedPreceding, -1)
    position = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = per_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), position + 1))
    weighed = weighed.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    weighed = weighed.withColumn("level_at_cap", F.col("cap") / F.col("weight"))
    left_size = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    levelled = weighed.withColumn("level", left_size / left_weight)
    free = F.when(F.col("level") <= F.col("level_at_cap"), F.struct("level_at_cap", "src", "level"))
    levelled = levelled.withColumn("common", F.min(free).over(everything)["level"])
    target = F.coalesce(F.least(F.col("weight") * F.col("common"), F.col("cap")), F.col("cap"))
    return levelled.select("src", "source_size", target.alias("target"))


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    with_row: bool = False,
) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, epochs, partial, taken``.

    ``with_row`` adds the whole input row as struct ``row``, so no input column can clash with these names.

    ``size`` is the number of words. ``epochs`` whole copies are taken and ``partial`` words of one more, so
    ``taken = epochs * size + partial``. Null texts have size 0 and give nothing; a null source is a source of
    its own, ordered last; rows that repeat a doc_id are documents of their own, ordered by text among
    themselves; equal rows can stand for one another. An empty table gives an empty plan.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    ranges = max(1, math.isqrt(docs.count()))
    sized = docs.select(
        "doc_id",
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))).alias("src"),
        word_count(F.col("text")).alias("size"),
        hash_key(F.col("doc_id"), seed).alias("key"),
        F.md5(text.cast("binary")).alias("tie"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if with_row else []),
    ).withColumn("range", F.floor(F.col("key") / F.lit(-(-KEY_SPACE // ranges))).cast("int"))
    range_sums = cut(sized.groupBy("src", "range").agg(F.sum("size").alias("range_size")))
    targets = source_targets(range_sums.groupBy("src").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    before = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        range_sums.withColumn("offset", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
        .join(targets, "src")
        .drop("range_size")
    )
    within = Window.partitionBy("src", "range").orderBy("key", "doc_id", "tie", "size")
    whole = F.least(F.round("target").cast("long"), F.col("source_size") * max_epochs)
    placed = (
        sized.join(offsets, ["src", "range"])
        .withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("epochs", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.expr(f"least(cast(round(target) as bigint), source_size * {int(max_epochs)}) div source_size")).cast("long"))
        .withColumn("rest", whole - F.col("epochs") * F.col("source_size"))
        .withColumn("partial", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start"))).cast("long"))
    )
    return placed.select(
        "doc_id", "size", "source_size", "target", "epochs", "partial",
        (F.col("epochs") * F.col("size") + F.col("partial")).alias("taken"),
        *(["row"] if with_row else []),
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself, in the columns of ``docs``: each document as often as taken.

    A partial copy holds the first ``partial`` words, joined by single spaces; ``n_chars``, if there, is set
    to its length. Documents without words are not taken.
    """
    plan = mix_plan(docs, weights, max_epochs, seed, with_row=True)
    copies = F.col("epochs") + F.when(F.col("partial") > 0, 1).otherwise(0)
    rows = plan.where((copies > 0) & (F.col("size") > 0)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    is_part = (F.col("copy") > F.col("epochs")) & (F.col("partial") < F.col("size"))
    text = F.col("row.text")
    text = F.when(is_part, F.array_join(F.slice(words(text), 1, F.col("partial").cast("int")), " ")).otherwise(text)
    rows = rows.withColumn("new_text", text)
    new = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(is_part, F.length("new_text").cast(kind)).otherwise(F.col("row.n_chars"))
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
