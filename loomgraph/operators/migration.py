"""What changed between two versions of a dictionary: the parts of a migration guide.

Tables: ``nodes`` (id, grp, introduced, deprecated and further columns), ``changes`` (id, node_id, version, change_type and
further columns), ``edges`` of renames (src, dst). Versions are compared as numbers. Null versions stand for "not known" and
"never". Empty tables give empty parts; rows with a null key take part in no join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.versions import ancestors, in_range, semver
from loomgraph.plans.shared import cut

# The kinds of a documentation change that alter what a value means.
SEMANTIC_KINDS = ("sign_convention", "coordinate_convention", "data_format_change")
# What an expression holds, and the label it stands for, in this order.
EXPRESSION_LABELS = {"fact_psi": "psi_like", "sigma_ip": "ip_like", "sigma_b0": "b0_like"}
LABEL_IN_EXPRESSION = r"\{(\w+_like)\}"
#: Changes shown for a path at most, in its history and beside a search hit; both also carry the true count.
HISTORY_ROWS, CONTEXT_ROWS = 20, 5
BULK_ROWS = 200


def level_of(level: Column) -> Column:
    return F.coalesce(level, F.lit("informational"))


def changes_between(changes: DataFrame, nodes: DataFrame, low: Column | str, high: Column | str, kind: str) -> DataFrame:
    """Changes of one type after ``low`` and up to ``high``, with their node's group."""
    picked = changes.where((F.col("change_type") == kind) & in_range(F.col("version"), F.lit(low), F.lit(high)))
    return picked.join(nodes.select(F.col("id").alias("node_id"), "grp"), "node_id").withColumn("level", level_of(F.col("level")))


def semantic_changes(changes: DataFrame, nodes: DataFrame, low: Column | str, high: Column | str) -> DataFrame:
    """Documentation changes that alter what a value means."""
    return changes_between(changes, nodes, low, high, "documentation").where(F.col("semantic_type").isin(*SEMANTIC_KINDS))


def bulk_changes(changes: DataFrame, nodes: DataFrame, low: Column | str, high: Column | str, kind: str, most: int = BULK_ROWS) -> DataFrame:
    """The first changes of one type by version and node: a report."""
    return changes_between(changes, nodes, low, high, kind).orderBy(semver(F.col("version")), "node_id", "id").limit(most)


def renames_between(edges: DataFrame, nodes: DataFrame, low: Column | str, high: Column | str) -> DataFrame:
    """(grp, src, dst): renames whose old node was deprecated or whose new one was introduced in the range, or neither is dated."""
    old = nodes.select(F.col("id").alias("src"), "grp", F.col("deprecated").alias("gone"))
    new = nodes.select(F.col("id").alias("dst"), F.col("introduced").alias("came"))
    within = lambda v: F.coalesce(in_range(v, F.lit(low), F.lit(high)), F.lit(False))
    both = edges.join(old, "src").join(new, "dst")
    undated = F.col("gone").isNull() & F.col("came").isNull()
    return both.where(within(F.col("gone")) | within(F.col("came")) | undated).select("grp", "src", "dst")


def removals_between(changes: DataFrame, nodes: DataFrame, edges: DataFrame, low: Column | str, high: Column | str) -> DataFrame:
    """(grp, node_id): removed nodes that were not renamed, and of whose ancestors none was.

    Ancestors are exploded and joined by equality, so no prefix is compared with all renamed nodes.
    """
    removed = changes_between(changes, nodes, low, high, "path_removed").select("grp", "node_id").distinct()
    renamed = edges.select(F.col("src").alias("above")).where("above is not null").distinct()
    own_or_above = F.array_append(ancestors(F.col("node_id")), F.col("node_id"))
    covered = removed.select("node_id", F.explode(own_or_above).alias("above")).join(renamed, "above", "left_semi").select("node_id").distinct()
    return removed.join(covered, "node_id", "left_anti")


def alive(nodes: DataFrame, version: Column | str) -> DataFrame:
    """Nodes not introduced after a version and not deprecated at or before it; undated ones count as there."""
    at = semver(F.lit(version))
    came, gone = F.col("introduced"), F.col("deprecated")
    return nodes.where((came.isNull() | (semver(came) <= at)) & (gone.isNull() | (semver(gone) > at)))


def lineages_between(edges: DataFrame, nodes: DataFrame, low: Column | str, high: Column | str, least: int = 2, most: int = 10) -> DataFrame:
    """(src, dst, hops, chain): chains of ``least`` to ``most`` renames from a node alive at ``low`` to one alive at ``high``.

    All chains between all their nodes count, as in a variable-length match; a chain visits no edge twice. ``chain`` holds
    (id, introduced) of its nodes in order.
    """
    step = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    starts = alive(nodes, low).select(F.col("id").alias("src"))
    grown = step.join(starts, "src", "left_semi").select(F.array("src", "dst").alias("path"))
    found = []
    for hops in range(2, most + 1):
        tip = grown.select("path", F.element_at("path", -1).alias("src"))
        pair = F.struct(F.col("src").alias("a"), F.col("dst").alias("b"))
        used = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.get("path", i - 1).alias("a"), F.get("path", i).alias("b")))
        grown = cut(tip.join(step, "src").where(~F.array_contains(used, pair)).select(F.array_append("path", F.col("dst")).alias("path")))
        if grown.isEmpty():
            break
        if hops >= least:
            found.append(grown)
    if not found:
        found = [grown.where("false")]
    paths = reduce(DataFrame.union, found).select(F.element_at("path", 1).alias("src"), F.element_at("path", -1).alias("dst"), "path")
    kept = paths.join(alive(nodes, high).select(F.col("id").alias("dst")), "dst", "left_semi")
    each = kept.select("path", F.posexplode("path").alias("place", "id")).join(nodes.select("id", "introduced"), "id", "left")
    chains = each.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("place", "id", "introduced"))).alias("c"))
    chain = F.transform("c", lambda x: F.struct(x["id"].alias("id"), x["introduced"].alias("introduced")))
    return chains.select(F.element_at("path", 1).alias("src"), F.element_at("path", -1).alias("dst"), (F.size("path") - 1).alias("hops"), chain.alias("chain"))


def inferred_label(label: Column, expression: Column) -> Column:
    """A label, else the one named in the expression, else that of the first known part the expression holds."""
    named = F.nullif(F.regexp_extract(expression, LABEL_IN_EXPRESSION, 1), F.lit(""))
    parts = [F.when(F.contains(expression, F.lit(k)), v) for k, v in EXPRESSION_LABELS.items()]
    return F.coalesce(F.nullif(label, F.lit("")), named, *parts)


def labelled_nodes(nodes: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """(grp, id, label, source) of the nodes with a label, given or inferred, in the given categories."""
    out = nodes.where(F.col("category").isin(*categories)).select("grp", "id", inferred_label(F.col("label"), F.col("expression")).alias("label"), F.coalesce("label_source", F.lit("xml")).alias("source"))
    return out.where("label is not null")


def backfilled_labels(nodes: DataFrame, reference: DataFrame, flipped: DataFrame) -> DataFrame:
    """(id, label, source): own label, else that of the last version with labels, else from the expression, else the sign flip.

    ``reference`` is (id, version, label); of several versions the last one counts. ``flipped`` is (id).
    """
    last = reference.where("label is not null").groupBy("id").agg(F.max_by("label", semver(F.col("version"))).alias("forward"))
    joined = nodes.join(last, "id", "left").join(flipped.select("id").distinct().withColumn("flips", F.lit(True)), "id", "left")
    own, told = F.nullif(F.col("label"), F.lit("")), inferred_label(F.lit(None).cast("string"), F.col("expression"))
    turned = F.when(F.col("flips"), "psi_like")
    source = F.when(own.isNotNull(), "xml").when(F.col("forward").isNotNull(), "forward_ported").when(told.isNotNull(), "expression").when(turned.isNotNull(), "sign_flip")
    return joined.select("id", F.coalesce(own, F.col("forward"), told, turned).alias("label"), source.alias("source")).where("label is not null")


def history(changes: DataFrame, nodes: DataFrame, most: int = HISTORY_ROWS) -> DataFrame:
    """(id, n_changes, changes): each node's first changes by version, and how many there are.

    Rows are ranked before they are collected, and a task passes on the first of its own only, so a node with very many changes
    neither builds a long list nor fills a task.
    """
    first = Window.partitionBy("node_id").orderBy(semver(F.col("version")), "id")
    counted = changes.groupBy("node_id").agg(F.count("*").alias("n"))
    ranked = changes.select("node_id", "id", "version", "change_type", F.row_number().over(first).alias("place")).where(F.col("place") <= most)
    listed = ranked.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("place", "version", "change_type"))).alias("c")).join(counted, "node_id")
    text = F.transform("c", lambda x: F.concat_ws(" ", x["version"], x["change_type"]))
    out = nodes.select("id").join(listed.withColumnRenamed("node_id", "id"), "id", "left")
    return out.select("id", F.coalesce("n", F.lit(0)).alias("n_changes"), F.coalesce(text, F.array().cast("array<string>")).alias("changes"))


def final_names(edges: DataFrame) -> DataFrame:
    """(id, final, hops): where the renames of each old node end; a node renamed to several has a row for each end."""
    from loomgraph.operators.versions import lineage

    reached = lineage(edges)
    last = reached.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_anti")
    return last.select(F.col("src").alias("id"), F.col("dst").alias("final"), "hops")


def first_additions(changes: DataFrame) -> DataFrame:
    """Change events without repeats: of several ``path_added`` for a node only the first by version stays."""
    again = F.row_number().over(Window.partitionBy("node_id", "change_type").orderBy(semver(F.col("version")), "id"))
    added = changes.where(F.col("change_type") == "path_added").withColumn("place", again).where("place = 1").drop("place")
    return changes.where(~F.col("change_type").eqNullSafe("path_added")).unionByName(added)


def guide(changes: DataFrame, nodes: DataFrame, edges: DataFrame, low: Column | str, high: Column | str, categories: tuple[str, ...]) -> DataFrame:
    """(section, grp, id, detail): all parts of a migration guide as rows."""
    arrow = lambda a, b: F.concat_ws(" -> ", F.coalesce(a, F.lit("none")), F.coalesce(b, F.lit("none")))
    between = lambda kind: changes_between(changes, nodes, low, high, kind)
    row = lambda df, section, key, detail: df.select(F.lit(section).alias("section"), "grp", F.col(key).alias("id"), detail.alias("detail"))
    change = arrow(F.col("old_value"), F.col("new_value"))
    parts = [
        row(between("units"), "units", "node_id", change),
        row(between("data_type"), "types", "node_id", change),
        row(removals_between(changes, nodes, edges, low, high), "removed", "node_id", F.lit("")),
        row(between("path_added"), "added", "node_id", F.lit("")),
        row(semantic_changes(changes, nodes, low, high), "meaning", "node_id", F.col("semantic_type")),
        row(renames_between(edges, nodes, low, high), "renamed", "src", F.col("dst")),
        row(labelled_nodes(nodes, categories), "labels", "id", F.col("label")),
    ]
    return reduce(DataFrame.unionByName, parts)


def changed_sections(old: Column, new: Column, sections: dict[str, str]) -> Column:
    """Names of the sections, each given by a pattern with one group, whose text differs between two texts."""
    part = lambda text, pattern: F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1)
    names = F.array(*[F.when(part(old, p) != part(new, p), name) for name, p in sections.items()])
    return F.array_compact(names)
