"""Audits and gates on names: row checks, checks between names, export gates, mapping validation, families.

A name is (id, description, unit, domain, links, ...). Checks give arrays of issues ``check: detail``; null values fail no
check unless it says so. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import names as naming
from loomgraph.operators.duplicates import close_classes, close_pairs

# Endings that name a way of processing; spellings; sets of forms of which a domain should use one.
PROCESSING = (
    "_reconstructed", "_measured", "_computed", "_simulated", "_estimated", "_interpolated", "_extrapolated", "_smoothed", "_averaged", "_filtered",
    "_normalised", "_normalized",
)
SPELLINGS = {"colour": "color", "behaviour": "behavior", "centre": "center", "fibre": "fiber", "ionisation": "ionization", "normalised": "normalized", "polarised": "polarized"}
POSITION_FORMS = {
    "axis": ("at_magnetic_axis", "on_axis", "magnetic_axis"),
    "boundary": ("at_boundary", "on_boundary", "at_separatrix"),
    "midplane": ("at_midplane", "midplane_low_field_side", "midplane_high_field_side"),
}
PLACEHOLDER = r"\{[a-z_]*\}|\bTODO\b|\bTBD\b|<[a-z_]+>"
MOST_LETTERS = 60
SYNONYM = 0.92
CRITICAL = ("placeholder", "repeated_token", "unit")
# Endings of error fields and the operator each stands for.
ERROR_OPERATORS = {"_error_upper": "upper_uncertainty", "_error_lower": "lower_uncertainty"}


def audit(name: Column, description: Column, unit: Column, known_units: Sequence[str]) -> Column:
    """Array of issues of one name: placeholders, repeated tokens, unknown units, tautologies, spelling, processing, length."""
    tokens = F.split(name, "_")
    words = F.filter(F.split(F.lower(F.coalesce(description, F.lit(""))), r"[^a-z]+"), lambda w: w != "")
    repeated = F.filter(F.zip_with(tokens, F.slice(tokens, F.lit(2), F.size(tokens)), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())
    spelling = F.filter(F.array_distinct(F.concat(tokens, words)), lambda w: w.isin(*SPELLINGS))
    same = F.array_join(words, "_") == F.lower(name)
    checks = [
        F.when(F.regexp_like(F.coalesce(description, F.lit("")), F.lit(PLACEHOLDER)), "placeholder: description"),
        F.when(F.size(repeated) > 0, F.concat(F.lit("repeated_token: "), F.array_join(repeated, ","))),
        F.when(unit.isNotNull() & ~unit.isin(*known_units), F.concat(F.lit("unit: "), unit)),
        F.when(same, "tautology: description repeats the name"),
        F.when(F.size(spelling) > 0, F.concat(F.lit("spelling: "), F.array_join(F.sort_array(spelling), ","))),
        F.when(ends_with_any(name, PROCESSING), "processing: name ends with a way of processing"),
        F.when(F.length(name) > MOST_LETTERS, "length: name is long"),
    ]
    return F.array_compact(F.array(*checks))


def ends_with_any(text: Column, endings: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(text, F.lit(e)) for e in endings])


def is_critical(issues: Column, critical: Sequence[str] = CRITICAL) -> Column:
    """Whether any issue is of a critical check."""
    return F.exists(issues, lambda x: F.substring_index(x, ":", 1).isin(*critical))


def synonyms(names: DataFrame, vector: str, least: float = SYNONYM) -> DataFrame:
    """(a, b, similarity): names of one domain and unit whose vectors are closer than ``least``; unknown units are never alike."""
    return close_pairs(names, "id", vector, ("domain", "unit"), least)


def synonym_classes(names: DataFrame, vector: str, least: float = SYNONYM) -> DataFrame:
    """(id, class, n_links): classes of synonyms, without a row for each pair."""
    return close_classes(names, "id", vector, ("domain", "unit"), least)


def mixed_positions(names: DataFrame, forms: Mapping[str, Sequence[str]] = POSITION_FORMS) -> DataFrame:
    """(domain, form, found): domains that use more than one way to name a position."""
    rules = F.array(*[F.struct(F.lit(f).alias("form"), F.lit(v).alias("position")) for f, vs in forms.items() for v in vs])
    hit = names.where("domain is not null").select("domain", "position", F.explode(rules).alias("r")).where(F.col("position") == F.col("r.position"))
    found = hit.groupBy("domain", F.col("r.form").alias("form")).agg(F.sort_array(F.collect_set("position")).alias("found"))
    return found.where(F.size("found") > 1)


def dangling_links(names: DataFrame) -> DataFrame:
    """(id, target): links to names that aren't there; what stands before a colon is dropped."""
    links = names.select("id", F.explode("links").alias("link")).select("id", F.substring_index("link", ":", -1).alias("target"))
    return links.join(names.select(F.col("id").alias("target")).distinct(), "target", "left_anti")


def gate_issues(names: DataFrame, convention: int, valid_name: str) -> DataFrame:
    """(id, issue, detail): other conventions than the export's, names that don't parse, links that lead nowhere."""
    row = lambda df, issue, detail: df.select("id", F.lit(issue).alias("issue"), detail.cast("string").alias("detail"))
    other = row(names.where(F.col("convention") != convention), "convention", F.col("convention"))
    broken = row(names.where(~F.regexp_like("id", F.lit(valid_name))), "parse", F.col("id"))
    return other.unionByName(broken).unionByName(row(dangling_links(names), "dangling_link", F.col("target")))


def gate_reason(score: Column, description_score: Column, least: float, least_description: float | None = None, unreviewed: bool = False) -> Column:
    """Why a name is left out of an export: unreviewed, below_score, below_description_score; null for what stays."""
    out = F.lit(None).cast("string")
    if least_description is not None:
        out = F.when(description_score < least_description, "below_description_score")
    out = F.when(score < least, "below_score").otherwise(out)
    return F.when(score.isNull(), F.lit(None).cast("string") if unreviewed else F.lit("unreviewed")).otherwise(out)


def fingerprint(*columns: str) -> Column:
    """Hash of what a review depends on; a null and an absent value are alike."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def diverged(names: DataFrame, protected: Sequence[str], stored: str) -> DataFrame:
    """(id): imported names whose protected columns no longer hash to what was stored at the import."""
    return names.where(F.col(stored).isNotNull() & (fingerprint(*protected) != F.col(stored))).select("id")


def error_siblings(names: DataFrame) -> DataFrame:
    """(id, source, unit): a name for each upper and lower error node of a name (``errors``).

    An index of uncertainty is bookkeeping and gets no name, nor do nodes with another ending.
    """
    each = names.select("id", "unit", F.explode("errors").alias("source"))
    operator = F.coalesce(*[F.when(F.endswith("source", F.lit(e)), o) for e, o in ERROR_OPERATORS.items()])
    return each.withColumn("operator", operator).where("operator is not null").select(F.concat("operator", F.lit("_of_"), "id").alias("id"), "source", "unit")


def families(items: DataFrame, geometric: Sequence[str] = ("position", "outline", "geometry")) -> DataFrame:
    """(parent, kind, n, unit_uniform): parents with two or more leaves named after axes, else by derivatives of one variable.

    ``items`` is (path, unit). A parent with axes is not looked at for derivatives.
    """
    leaf, parent = F.substring_index("path", "/", -1), F.regexp_replace("path", "/[^/]*$", "")
    rows = items.where(F.contains("path", F.lit("/"))).select(parent.alias("parent"), F.coalesce("unit", F.lit("")).alias("unit"), leaf.alias("leaf"))
    rows = rows.select("*", naming.axis(F.col("leaf")).alias("axis"), F.nullif(F.regexp_extract("leaf", r"^d(\w+?)_d(\w+)$", 2), F.lit("")).alias("by"))
    uniform = (F.count_distinct("unit") == 1).alias("unit_uniform")
    axes = rows.where("axis is not null").groupBy("parent").agg(F.count("*").alias("n"), uniform).where("n >= 2")
    is_geometric = F.substring_index("parent", "/", -1).isin(*geometric)
    vectors = axes.select("parent", F.when(is_geometric, "geometric_coordinate").otherwise("physical_vector").alias("kind"), "n", "unit_uniform")
    rest = rows.where("`by` is not null").join(axes.select("parent"), "parent", "left_anti")
    derived = rest.groupBy("parent", "by").agg(F.count("*").alias("n"), uniform).where("n >= 2")
    return vectors.unionByName(derived.select("parent", F.lit("derivative").alias("kind"), "n", "unit_uniform"))


def checked_bindings(bindings: DataFrame, sources: DataFrame, targets: DataFrame, flips: DataFrame, compatible: Column, transforms: Sequence[str]) -> DataFrame:
    """Bindings (source, target, transform, source_unit, target_unit, label) with ``issues``.

    Both ends must exist, the transform must be a known one, units must be ``compatible`` and, if they differ, not left as
    they are, and a target whose sign flips needs a label or a transform.
    """
    there = lambda df, key: df.select(F.col(key)).distinct().withColumn(f"has_{key}", F.lit(True))
    out = bindings.join(there(sources, "source"), "source", "left").join(there(targets, "target"), "target", "left").join(there(flips.select(F.col("target").alias("flip")), "flip"), F.col("target") == F.col("flip"), "left").drop("flip")
    given, plain = F.col("source_unit").isNotNull() | F.col("target_unit").isNotNull(), F.col("transform") == "value"
    issues = [
        F.when(F.col("has_source").isNull(), "no_source"),
        F.when(F.col("has_target").isNull(), "no_target"),
        F.when(~F.col("transform").isin(*transforms), "bad_transform"),
        F.when(given & ~F.coalesce(compatible, F.lit(False)), "units_incompatible").when(given & plain & (F.col("source_unit") != F.col("target_unit")), "units_not_converted"),
        F.when(F.col("has_flip") & plain & F.col("label").isNull(), "sign_not_handled"),
    ]
    return out.select(*bindings.columns, F.array_compact(F.array(*issues)).alias("issues"))


def conflicting_targets(bindings: DataFrame) -> DataFrame:
    """(target, kind): targets of several sources, and those that one source reaches by different transforms."""
    counted = bindings.groupBy("target").agg(F.count_distinct("source").alias("s"), F.count_distinct("transform").alias("t"))
    kind = F.when(F.col("s") > 1, "several_sources").when(F.col("t") > 1, "conflicting_transforms")
    return counted.select("target", kind.alias("kind")).where("kind is not null")


def structural_edges(names: DataFrame, operators: Sequence[str]) -> DataFrame:
    """(src, dst, relation): a name of form operator_of_base points to the base, and the base's first token names its family."""
    pattern = r"^(" + "|".join(operators) + r")_of_(.+)$"
    cut = names.select("id", F.regexp_extract("id", pattern, 1).alias("op"), F.regexp_extract("id", pattern, 2).alias("base")).where("op <> ''")
    return cut.select(F.col("id").alias("src"), F.col("base").alias("dst"), F.col("op").alias("relation"))


def by_tokens(results: DataFrame, tokens: str, order: Sequence[Column], by: Sequence[str], budget: int) -> DataFrame:
    """The first results of each group whose tokens, added up in order, stay within the budget."""
    running = F.sum(tokens).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return results.withColumn("used", running).where(F.col("used") <= budget)
