"""Composite scores and change classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Purposes of full and of medium value; all others are of low value.
HIGH_PURPOSES = ("data_source", "diagnostic", "code", "calibration", "data_access")
MEDIUM_PURPOSES = ("physics_analysis", "experimental_procedure", "tutorial", "reference")
# Phrases that make a change of documentation significant, by class, in order of priority.
DOC_CLASSES = {
    "sign_convention": ("upwards", "downwards", "increasing", "decreasing", "positive", "negative", "clockwise", "anti-clockwise", "normal vector", "surface normal", "sign convention"),
    "coordinate_convention": ("right-handed", "left-handed", "coordinate system", "reference frame"),
    "data_format_change": ("dimension", "second dimension", "first dimension", "column", "matrix elements", "encoding", "polarity", "format", "sides", "index convention"),
}
# How much a type of change breaks; types that are not listed are informational.
BREAKING = ("path_removed", "path_renamed", "data_type", "cocos_transformation_type", "convention_change")
ADVISORY = ("coordinates_changed", "lifecycle_status", "node_type", "maxoccur_changed", "structure_changed")


def max_composite(scores: Sequence[Column]) -> Column:
    return F.least(F.lit(1.0), F.greatest(*scores) if len(scores) > 1 else scores[0])


def purpose_weighted(scores: Sequence[Column], purpose: Column) -> Column:
    weight = F.when(purpose.isin(*HIGH_PURPOSES), 1.0).when(purpose.isin(*MEDIUM_PURPOSES), 0.8).otherwise(0.3)
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), best * weight))


def relevance(similarity: Column, mapping: Column, is_cross: Column, scope: Column, coherence: Column) -> Column:
    """Half the similarity, and bonuses for mapping relevance, reach, scope and coherence; at most 1."""
    mapped = F.when(mapping == "high", 0.25).when(mapping == "medium", 0.15).when(mapping == "low", 0.0).otherwise(0.1)
    scoped = F.when(scope == "global", 0.1).when(scope == "domain", 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 * similarity + mapped + F.when(is_cross, 0.1).otherwise(0.0) + scoped + 0.05 * coherence)


def doc_change(old: Column, new: Column) -> Column:
    """Class of a change of documentation: by phrases that are new, else by growth over half, else none."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    out = None
    for name, phrases in DOC_CLASSES.items():
        fresh = F.exists(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(low(new), p) & ~F.contains(low(old), p))
        out = F.when(fresh, name) if out is None else out.when(fresh, name)
    grown = (F.length(old) > 0) & (F.length(new) > 1.5 * F.length(old))
    return out.when(grown, "definition_clarification").otherwise("none")


def breaking_level(change: Column, unit_kind: Column, doc_kind: Column) -> Column:
    units = F.when(unit_kind == "dim_incompatible", "breaking").when(unit_kind == "dim_equivalent", "advisory").otherwise("informational")
    docs = F.when(doc_kind.isin("sign_convention", "data_format_change"), "breaking").when(doc_kind == "coordinate_convention", "advisory").otherwise("informational")
    out = F.when(change == "units", units).when(change == "documentation", docs)
    return out.when(change.isin(*BREAKING), "breaking").when(change.isin(*ADVISORY), "advisory").otherwise("informational")


def significance(options: Column) -> Column:
    """How much an enumeration branches, by its number of options."""
    return F.when(options > 10, "high").when(options > 5, "medium").otherwise("low")
