"""Looking things up: path batches, lists by prefix, resolvers, links from mentions to nodes, neighbours in buckets.

Requests (paths asked for, references found in texts) are tables as well, so every lookup is a join. Rows with null keys
match nothing; empty tables give empty results, or requests without a hit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import fuzzy
from loomgraph.operators.migration import alive
from loomgraph.operators.versions import ancestors
from loomgraph.plans.shared import cut, join_dealt

# The weighted ratio that a suggested group and a suggested path need.
LEAST_GROUP, LEAST_PATH = 60, 50
# Segments that mark subtrees and names left out of search, by reason.
METADATA_SUBTREES = ("ids_properties", "code")
GRID_MARKERS = ("ggd", "grids_ggd", "grid_subset")
ERROR_SUFFIXES = ("_error_upper", "_error_lower", "_error_index")
STRINGS = "array<string>"


def suggest_paths(missing: DataFrame, nodes: DataFrame, k: int = 3) -> DataFrame:
    """(path, suggestions): up to ``k`` paths of the same group with the best weighted ratio, best first, ties by id.

    A group that isn't known is corrected to the nearest one first, in any case of letters; where none is near, there are
    no suggestions. Null paths are left out, repeated ones answered once.
    """
    groups = cut(nodes.select("grp").where("grp is not null").distinct())
    asked = missing.select("path", F.split("path", "/")[0].alias("grp")).where("path is not null").distinct()
    unknown = asked.join(groups, "grp", "left_anti").select(F.lower("grp").alias("name"), F.lit("").alias("same"))
    fixed = fuzzy.nearest(unknown, groups.select(F.lower("grp").alias("id"), F.lit("").alias("same")), 1, LEAST_GROUP)
    by_lower = groups.groupBy(F.lower("grp").alias("id")).agg(F.min("grp").alias("right"))
    fixed = fixed.join(by_lower, "id").select(F.col("name").alias("low"), "right")
    right = F.coalesce("right", "grp")
    corrected = asked.withColumn("low", F.lower("grp")).join(groups.select("grp", F.lit(True).alias("there")), "grp", "left").join(fixed, "low", "left")
    corrected = corrected.withColumn("right", F.when(F.col("there"), F.col("grp")).otherwise(F.col("right")))
    corrected = cut(corrected.select("path", right.alias("same"), F.concat(right, F.expr("substring(path, length(grp) + 1)")).alias("name")))
    near = fuzzy.nearest(corrected, nodes.select("id", F.col("grp").alias("same")), k, LEAST_PATH)
    listed = near.groupBy("name", "same").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("s"))
    return corrected.join(listed, ["name", "same"]).select("path", F.transform("s", lambda x: x["id"]).alias("suggestions"))


def check_paths(asked: DataFrame, nodes: DataFrame, edges: DataFrame, version: Column | None = None, k: int = 3) -> DataFrame:
    """For each path asked for: whether it exists (in a version), where it was renamed to, else similar paths.

    (path, found, grp, dtype, unit, renamed_to, rename_version, suggestions). Several renames of a path give the first
    by name. Paths asked for twice are answered once.
    """
    paths = asked.select("path").where("path is not null").distinct()
    there = (alive(nodes, version) if version is not None else nodes).select(F.col("id").alias("path"), "grp", "dtype", "unit")
    renamed = edges.join(nodes.select(F.col("id").alias("dst"), "introduced"), "dst").groupBy(F.col("src").alias("path")).agg(F.min(F.struct("dst", "introduced")).alias("r"))
    known = paths.join(there, "path", "left").join(renamed, "path", "left").withColumn("found", F.col("grp").isNotNull())
    lost = known.where("not found and r is null").select("path")
    out = known.join(suggest_paths(lost, nodes, k), "path", "left")
    hint = lambda c: F.when(~F.col("found"), F.col(c))
    return out.select("path", "found", "grp", "dtype", "unit", hint("r.dst").alias("renamed_to"), hint("r.introduced").alias("rename_version"), F.coalesce("suggestions", F.array().cast(STRINGS)).alias("suggestions"))


def list_paths(nodes: DataFrame, prefixes: DataFrame, k: int, leaf_only: bool = False) -> DataFrame:
    """(prefix, n, paths): how many nodes stand under each prefix (or are it), and the first ``k`` of them by id.

    Prefixes meet exploded ancestors by equality. Structures are no leaves.
    """
    kept = nodes.where(~F.col("dtype").isin("STRUCTURE", "STRUCT_ARRAY") | F.col("dtype").isNull()) if leaf_only else nodes
    under = kept.select("id", F.explode(F.array_append(ancestors(F.col("id")), F.col("id"))).alias("prefix")).join(prefixes.select("prefix").distinct(), "prefix")
    placed = under.withColumn("place", F.row_number().over(Window.partitionBy("prefix").orderBy("id")))
    counted = placed.groupBy("prefix").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("place") <= k, F.col("id")))).alias("paths"))
    return prefixes.select("prefix").distinct().join(counted, "prefix", "left").select("prefix", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("paths", F.array().cast(STRINGS)).alias("paths"))


def gathered(base: DataFrame, key: str, branches: Mapping[str, tuple[DataFrame, Column]]) -> DataFrame:
    """``base`` with one sorted array of distinct values for each branch (table with ``key``, value); none give an empty array.

    Each branch is aggregated before it is joined, so branches don't multiply. Null values are dropped.
    """
    out = base
    for name, (table, value) in branches.items():
        each = table.select(key, value.alias("v")).where("v is not null").groupBy(key).agg(F.sort_array(F.collect_set("v")).alias(name))
        out = out.join(each, key, "left")
    return out.withColumns({name: F.coalesce(F.col(name), F.array().cast(out.schema[name].dataType)) for name in branches})


def either(linked: Column, stored: Column) -> Column:
    """Linked values, or the stored ones where nothing is linked."""
    return F.when(F.size(linked) > 0, linked).otherwise(F.coalesce(stored, F.array().cast(STRINGS)))


def exclusion_reason(path: Column, grids: bool = False, errors: bool = False, metadata: bool = False, patterns: Sequence[str] = ()) -> Column:
    """Why a path is left out of search (metadata, ggd, error_field), else null."""
    segments, name = F.split(F.lower(path), "/"), F.element_at(F.split(path, "/"), -1)
    rules = [F.when(F.contains(path, F.lit(p)), "metadata") for p in patterns]
    if not metadata:
        rules.append(F.when(F.arrays_overlap(F.slice(segments, F.lit(2), F.size(segments)), F.array(*map(F.lit, METADATA_SUBTREES))), "metadata"))
    if not grids:
        rules.append(F.when(F.arrays_overlap(segments, F.array(*map(F.lit, GRID_MARKERS))), "ggd"))
    if not errors:
        rules.append(F.when(reduce(lambda a, b: a | b, [F.endswith(name, F.lit(s)) for s in ERROR_SUFFIXES]), "error_field"))
    return F.coalesce(*rules, F.lit(None).cast("string"))


def resolve(asked: DataFrame, name: str, steps: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """(name, method, matches): for each name the matches of the first step that has any.

    A step is (method, table of (key, value), how): ``equal`` joins the name with the key, ``within`` finds the keys that
    contain the name, by the rarest of its pairs of characters.
    """
    found = None
    for rank, (method, table, how) in enumerate(steps):
        own = table.select(F.col("key").alias("_key"), F.col("value").alias("_value")).where("_key is not null and _value is not null")
        if how == "equal":
            hit = asked.join(own, F.col(name) == F.col("_key"))
        else:
            pairs = fuzzy.containing(asked.select(F.col(name).alias("name")), own.select(F.col("_key").alias("id")))
            hit = pairs.select(F.col("name").alias(name), F.col("id").alias("_key")).join(own, "_key")
        part = hit.select(name, F.lit(rank).alias("rank"), F.lit(method).alias("method"), "_value")
        found = part if found is None else found.unionByName(part)
    listed = found.groupBy(name, "rank", "method").agg(F.sort_array(F.collect_set("_value")).alias("matches"))
    best = listed.groupBy(name).agg(F.min_by(F.struct("method", "matches"), "rank").alias("b"))
    out = asked.select(name).distinct().join(best, name, "left")
    return out.select(name, F.coalesce("b.method", F.lit("no_match")).alias("method"), F.coalesce("b.matches", F.array().cast(STRINGS)).alias("matches"))


def path_list(text: Column, normalise) -> Column:
    """Paths of a request: a JSON array, or names split at commas and white space; empty ones are dropped."""
    trimmed = F.trim(text)
    listed = F.when(F.startswith(trimmed, F.lit("[")) & F.endswith(trimmed, F.lit("]")), F.from_json(trimmed, STRINGS))
    split = F.split(F.regexp_replace(trimmed, ",", " "), r"\s+")
    return F.transform(F.filter(F.transform(F.coalesce(listed, split), lambda x: F.trim(x)), lambda x: x != ""), normalise)


def ruled(df: DataFrame, value: Column, rules: Sequence[tuple[str, str, str | None]]) -> DataFrame:
    """``df`` with ``rule`` and ``given``: name and value of the first rule whose pattern ``value`` matches.

    Patterns are globs over the whole text: ``*`` for anything, ``?`` for one character.
    """
    import re

    def regex(glob: str) -> str:
        return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"

    hits = [F.when(F.regexp_like(value, F.lit(regex(g))), F.struct(F.lit(name).alias("rule"), F.lit(given).cast("string").alias("given"))) for name, g, given in rules]
    first = F.coalesce(*hits, F.lit(None).cast("struct<rule:string,given:string>"))
    return df.withColumn("_hit", first).select(*df.columns, F.col("_hit.rule").alias("rule"), F.col("_hit.given").alias("given"))


def split_rejected(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): rows without a reason, and the others with their ``reason``."""
    judged = df.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def suffixes(path: Column, separator: str) -> Column:
    """All ends of a path that start at a segment: 'a/b/c' gives ['a/b/c', 'b/c', 'c']."""
    parts = F.split(path, F.lit(separator))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.lit(1_000_000)), separator))


def resolve_references(references: DataFrame, nodes: DataFrame, separator: str = "/") -> DataFrame:
    """(ref, id, method): each reference's node: with the same id, else one that ends with it, else one with its last segment.

    The later steps see only references without a node, and take the first node by id. Ends and last segments are keys,
    so every step is an equi-join; case does not matter in the last one.
    """
    asked = references.select("ref").where("ref is not null").distinct()
    ids = nodes.select("id").where("id is not null").distinct()
    exact = asked.join(ids, asked["ref"] == ids["id"]).select("ref", "id", F.lit("exact").alias("method"))
    rest = asked.join(exact.select("ref"), "ref", "left_anti")
    ends = ids.select("id", F.explode(suffixes(F.col("id"), separator)).alias("ref"))
    by_end = rest.join(ends, "ref").groupBy("ref").agg(F.min("id").alias("id")).withColumn("method", F.lit("suffix"))
    rest = rest.join(by_end.select("ref"), "ref", "left_anti")
    last = lambda c: F.lower(F.element_at(F.split(c, F.lit(separator)), -1))
    tails = ids.select("id", last(F.col("id")).alias("tail"))
    by_tail = rest.withColumn("tail", last(F.col("ref"))).join(tails, "tail").groupBy("ref").agg(F.min("id").alias("id")).withColumn("method", F.lit("last_segment"))
    return exact.unionByName(by_end).unionByName(by_tail)


def mention_links(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, id): each mention (key, path) linked with the node of that path and all nodes below it, once.

    Mentions below another one of their key find nothing new and are left out, so the links need no distinct() after the join.
    """
    above = nodes.select("id").distinct().select("id", F.explode(F.array_distinct(F.array_append(ancestors(F.col("id")), F.col("id")))).alias("path"))
    asked = cut(mentions.select("key", "path").where("path is not null").distinct())
    up = F.filter(ancestors(F.col("path")), lambda p: p != F.col("path"))
    below = asked.select("key", "path", F.explode(up).alias("up")).alias("x").join(asked.alias("y"), F.expr("x.key <=> y.key and x.up = y.path"), "left_semi")
    outer = asked.alias("x").join(below.alias("z"), F.expr("x.key <=> z.key and x.path = z.path"), "left_anti")
    return join_dealt(outer, cut(above), "path").select("key", "id")


def related_buckets(anchors: DataFrame, names: DataFrame, alike: Mapping[str, str], links: Mapping[str, DataFrame], k: int) -> DataFrame:
    """(anchor, bucket, place, name): up to ``k`` related names by id in each bucket.

    ``alike`` maps a bucket to the column whose non-null value anchor and name share; ``links`` maps one to edges
    (src, dst) from the anchor.
    """
    parts = []
    for bucket, column in alike.items():
        own = anchors.join(names.select(F.col("id").alias("anchor"), F.col(column).alias("_v")), "anchor")
        # an anchor's bucket needs the first k + 1 names of its value at most, as one of them may be the anchor itself
        others = names.select(F.col("id").alias("name"), F.col(column).alias("_v")).where("_v is not null").distinct()
        others = others.withColumn("_n", F.row_number().over(Window.partitionBy("_v").orderBy("name"))).where(F.col("_n") <= k + 1).drop("_n")
        parts.append(own.join(others, "_v").where("name <> anchor").select("anchor", F.lit(bucket).alias("bucket"), "name"))
    for bucket, edges in links.items():
        out = edges.select(F.col("src").alias("anchor"), F.col("dst").alias("name"))
        parts.append(anchors.select("anchor").join(out, "anchor").select("anchor", F.lit(bucket).alias("bucket"), "name"))
    every = reduce(DataFrame.unionByName, parts).distinct()
    return every.withColumn("place", F.row_number().over(Window.partitionBy("anchor", "bucket").orderBy("name"))).where(F.col("place") <= k)


def merged_clones(repos: DataFrame) -> DataFrame:
    """(root_commit, canonical, clones, n): repositories with one root commit as one.

    Canonical is the first id that doesn't start with ``root:``, else the first. Rows without a root commit are left alone.
    """
    known = repos.where("root_commit is not null")
    order = F.struct(F.startswith("id", F.lit("root:")), F.col("id"))
    out = known.groupBy("root_commit").agg(F.min_by("id", order).alias("canonical"), F.sort_array(F.collect_set("id")).alias("ids"), F.sum("clone_count").alias("s"), F.count("*").alias("m"))
    return out.select("root_commit", "canonical", F.filter("ids", lambda x: x != F.col("canonical")).alias("clones"), (F.col("s") - F.col("m") + 1).alias("n"))


def pattern_groups(members: DataFrame, shape: Column, owner: str, least: int) -> DataFrame:
    """(pattern, n, first_member): shapes that at least ``least`` different owners have a member of."""
    out = members.select(shape.alias("pattern"), F.col(owner).alias("owner"), "id").where("pattern is not null").groupBy("pattern")
    return out.agg(F.count_distinct("owner").alias("n"), F.min("id").alias("first_member")).where(F.col("n") >= least)


def many_to_one(bindings: DataFrame) -> DataFrame:
    """(target, n, kind): targets with several sources: one family of names, one domain, or mixed."""
    prefix = F.substring_index("source", "_", 1)
    counted = bindings.groupBy("target").agg(F.count_distinct("source").alias("n"), F.count_distinct(prefix).alias("p"), F.count_distinct("domain").alias("d")).where("n > 1")
    kind = F.when(F.col("p") == 1, "same_family").when(F.col("d") <= 1, "same_domain").otherwise("mixed")
    return counted.select("target", "n", kind.alias("kind"))


def inherited_keywords(nodes: DataFrame, keywords: DataFrame) -> DataFrame:
    """(parent, keywords): own keywords of a parent and those of its children, distinct and in order."""
    both = keywords.select(F.col("id").alias("node"), F.explode("keywords").alias("w"))
    up = both.join(nodes.select(F.col("id").alias("node"), "parent"), "node").select("parent", "w")
    own = both.join(nodes.select(F.col("parent").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("parent"), "w")
    return up.unionByName(own).where("parent is not null").groupBy("parent").agg(F.sort_array(F.collect_set("w")).alias("keywords"))


def error_edges(nodes: DataFrame) -> DataFrame:
    """(id, base, error_type): error fields and the field of the same parent that they belong to."""
    pattern = r"^(.*)_error_(upper|lower|index)$"
    fields = nodes.select("id", "parent", F.regexp_extract("name", pattern, 1).alias("of"), F.regexp_extract("name", pattern, 2).alias("error_type")).where("of <> ''")
    bases = nodes.select(F.col("id").alias("base"), "parent", F.col("name").alias("of"))
    return fields.join(bases, ["parent", "of"]).select("id", "base", "error_type")


def section_nodes(sections: DataFrame, nodes: DataFrame, edges: DataFrame, epoch_fields: Sequence[str]) -> DataFrame:
    """(section, id, sort_key): the nodes of each structural section in an epoch, to be listed by sort_key and id.

    ``sections`` is (section, epoch, facility, system, source, epoch_field, via). With ``via`` the nodes are those that the epoch
    points to by that relation; else those of the facility, system and data source whose column ``epoch_field``, one of
    ``epoch_fields``, is the epoch. ``nodes`` has id, sort_key, facility, system, source and the epoch fields, ``edges`` is (src, relation, dst).
    """
    linked = sections.where("via is not null").select("section", F.col("epoch").alias("src"), F.col("via").alias("relation"))
    by_edge = linked.join(edges, ["src", "relation"]).select("section", F.col("dst").alias("id")).distinct().join(nodes.select("id", "sort_key"), "id")
    # one row of a node for each of its epochs, so that sections meet them by equality
    told = F.explode(F.array(*[F.struct(F.lit(f).alias("epoch_field"), F.col(f).alias("epoch")) for f in epoch_fields]))
    placed = nodes.select("id", "sort_key", "facility", "system", "source", told.alias("e")).select("id", "sort_key", "facility", "system", "source", "e.*")
    keys = ["facility", "system", "source", "epoch_field", "epoch"]
    by_field = sections.where("via is null").select("section", *keys).join(placed, keys)
    return by_field.select("section", "id", "sort_key").unionByName(by_edge.select("section", "id", "sort_key"))


def edit_suggestions(asked: DataFrame, name: str, catalogue: DataFrame, same_base: Column) -> DataFrame:
    """(name, suggestion, edits): the catalogue's ``id`` with the fewest edits, of equal ones one with the same base, then by id."""
    return fuzzy.fewest_edits(asked, catalogue, ~same_base, name).withColumnRenamed("id", "suggestion")
