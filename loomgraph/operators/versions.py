"""Versions of a table: semantic order, validity, diffs, rename lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.shared import cut, join_counted

# What kind of change a field's change is; others are named after the field.
CHANGE_TYPES = {
    "units": "units", "documentation": "documentation", "data_type": "data_type", "node_type": "node_type",
    "cocos_transformation_type": "cocos_transformation_type", "lifecycle_status": "lifecycle_status",
    "coordinates": "coordinates", "timebasepath": "timebase", "maxoccur": "maxoccur_changed",
    "ndim": "structure_changed", "identifier_enum_name": "structure_changed",
}


def semver(version: Column) -> Column:
    """Version text as an array of whole numbers, which compares in version order; [0] if it can't be read."""
    numbers = F.transform(F.split(F.regexp_extract(version, r"^v?([0-9]+(?:\.[0-9]+)*)", 1), r"\."), lambda x: x.cast("int"))
    return F.when(F.regexp_like(version, F.lit(r"^v?[0-9]+(\.[0-9]+)*")), numbers).otherwise(F.array(F.lit(0)))


def active_in(introduced: Column, deprecated: Column, version: Column) -> Column:
    """Introduced at or before a version, and not deprecated at or before it."""
    return (semver(introduced) <= semver(version)) & (deprecated.isNull() | (semver(deprecated) > semver(version)))


def in_range(version: Column, low: Column, high: Column) -> Column:
    """After ``low`` and up to ``high``."""
    return (semver(version) > semver(low)) & (semver(version) <= semver(high))


def diff(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, change, field, old_value, new_value): rows added and removed, and each field that differs.

    Values are compared as text; null and empty text differ.
    """
    as_map = lambda df, name: df.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias(name))
    both = as_map(old, "o").join(as_map(new, "n"), key, "full_outer")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").alias("old_value"), F.col(f"n.{f}").alias("new_value")) for f in fields])
    changed = F.filter(each, lambda x: ~x["old_value"].eqNullSafe(x["new_value"]))
    none = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("old_value"), F.lit(None).cast("string").alias("new_value")))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed")
    rows = both.select(key, kind.alias("change"), F.explode(F.when(kind == "changed", changed).otherwise(none)).alias("x"))
    return rows.select(key, "change", "x.*")


def renames(old: DataFrame, new: DataFrame, key: str, previous: str) -> DataFrame:
    """(key, old_key): rows new in ``new`` whose declared previous name is gone."""
    added = new.join(old.select(key), key, "left_anti")
    removed = old.join(new.select(key), key, "left_anti").select(F.col(key).alias(previous))
    return added.join(removed, previous, "left_semi").select(key, F.col(previous).alias("old_key"))


def lineage(edges: DataFrame, most_hops: int = 10) -> DataFrame:
    """(src, dst, hops): every pair that a chain of at most ``most_hops`` edges joins, with the fewest hops.

    The frontier grows by one edge a round and drops pairs already known, so cycles end.
    """
    step = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    known = frontier = cut(step.withColumn("hops", F.lit(1)))
    for hop in range(2, most_hops + 1):
        further = frontier.select("src", F.col("dst").alias("mid")).join(step.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        frontier = cut(further.join(known, ["src", "dst"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        known = known.union(frontier)
    return known


def chains(edges: DataFrame) -> DataFrame:
    """(root, path, hops): paths from nodes without incoming edge to nodes without outgoing edge, of any length.

    A round adds one edge to every open path. A path visits no node twice, so cycles end.
    """
    step = cut(edges.select("src", "dst").distinct())
    roots = step.join(step.select(F.col("dst").alias("src")), "src", "left_anti")
    open_ = roots.select(F.col("src").alias("root"), F.array("src", "dst").alias("path"))
    done = None
    while True:
        grown = open_.withColumn("src", F.element_at("path", -1)).join(step, "src", "left")
        grown = cut(grown.withColumn("ends", F.col("dst").isNull() | F.array_contains("path", F.col("dst"))))
        ended = grown.where("ends").select("root", "path")
        done = ended if done is None else done.union(ended)
        open_ = grown.where("not ends").select("root", F.array_append("path", F.col("dst")).alias("path"))
        if open_.isEmpty():
            break
    return done.withColumn("hops", F.size("path") - 1)


def ancestors(path: Column, separator: str = "/") -> Column:
    """All proper ancestors of a path, nearest last: 'a/b/c' gives ['a', 'a/b']."""
    parts = F.split(path, F.lit(separator))
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, F.lit(1), k), separator))).otherwise(F.array().cast("array<string>"))


def subtree_counts(paths: DataFrame, path: str, separator: str = "/") -> DataFrame:
    """(ancestor, n_below, n_leaves): an equi-join on exploded ancestors, not a prefix comparison of all pairs."""
    below = paths.select(F.col(path).alias("lower"), F.explode(ancestors(F.col(path), separator)).alias("ancestor"))
    inner = below.select(F.col("ancestor").alias("lower")).distinct().withColumn("inner", F.lit(1))
    marked = below.join(inner, "lower", "left")
    return marked.groupBy("ancestor").agg(F.count_distinct("lower").alias("n_below"), F.count_distinct(F.when(F.col("inner").isNull(), F.col("lower"))).alias("n_leaves"))


def presence_changes(present: DataFrame, every: DataFrame, key: str) -> DataFrame:
    """(key, place, change): keys that are there in a version but not in the one before (added), or the reverse (removed).

    ``present`` is (key, version), ``every`` (version) has all versions; places count them from 1 in their order. What is
    there in the first version is not added. Versions are few, so they are ranked in one task; they are counted before they are broadcast.
    """
    order = every.select("version").where("version is not null").distinct()
    order = order.select("version", F.row_number().over(Window.orderBy(semver(F.col("version")))).alias("place"))
    at = present.select(key, "version").distinct()
    at = join_counted(at, order, "version", "inner").select(key, "place")
    w = Window.partitionBy(key).orderBy("place")
    near = at.select(key, "place", F.lag("place").over(w).alias("before"), F.lead("place").over(w).alias("after")).crossJoin(F.broadcast(order.agg(F.max("place").alias("last"))))  # one row
    came = (F.col("place") > 1) & ~F.col("before").eqNullSafe(F.col("place") - 1)
    went = (F.col("place") < F.col("last")) & ~F.col("after").eqNullSafe(F.col("place") + 1)
    each = F.array_compact(F.array(F.when(came, F.struct(F.col("place"), F.lit("added").alias("change"))), F.when(went, F.struct((F.col("place") + 1).alias("place"), F.lit("removed").alias("change")))))
    return near.select(key, F.explode(each).alias("x")).select(key, "x.*")
