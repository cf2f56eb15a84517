"""Entities in free text: tree paths, two-part paths, units, conventions with context, tool mentions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.expr import let, positions, total

# What the entities look like.
TREE_PATH = r"(?i)\\{1,2}[A-Z_][A-Z_0-9]*::[A-Z_][A-Z_0-9:]*"
PAIR_PATH = r"\b([A-Z][A-Z0-9]{1,7})/([A-Z][A-Z0-9_]{0,9})\b"
UNIT = (
    r"(?i)\b(eV|keV|MeV|GeV|m\^?-?[123]|cm\^?-?[123]|mm|Tesla|T|Wb|Weber|Amp(?:ere)?s?|A|MA|kA|Ohm|ohm|Ω|Volt|V|kV|Watt|W|MW|kW|"
    r"m/s|m\.s\^-1|rad|radian|degrees?|°|seconds?|s|ms|μs|ns|Hz|kHz|MHz|GHz|Pa|kPa|MPa|bar|mbar|Torr)\b"
)
CONVENTION = r"(?i)COCOS\s*(?:=\s*)?[0-9]{1,2}|coordinate\s+conventions?\s+[0-9]{1,2}"
SIGN = (
    r"(?i)(?:positive|negative)\s+(?:clockwise|counter-?clockwise|outward|inward|upward|downward|toroidal|poloidal|radial)"
    r"|sign\s+convention|I_?p\s*[><]=?\s*0|B_?[tφ]\s*[><]=?\s*0"
)


def found(text: Column, pattern: str, change=lambda x: x) -> Column:
    """Sorted distinct matches, each changed by a column function."""
    return F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change)))


def tree_paths(text: Column) -> Column:
    """In upper case, with one leading backslash."""
    return found(text, TREE_PATH, lambda x: F.concat(F.lit("\\"), F.regexp_replace(F.upper(x), r"^\\+", "")))


def pair_paths(text: Column, known: Sequence[str]) -> Column:
    """Two-part paths whose first part is known."""
    first = lambda x: F.substring_index(x, "/", 1)
    return F.filter(found(text, PAIR_PATH), lambda x: first(x).isin(*[k.upper() for k in known]))


def units(text: Column) -> Column:
    return found(text, UNIT)


def with_context(text: Column, pattern: str, reach: int = 50) -> Column:
    """Array of (name, context): each match and up to ``reach`` characters on either side."""

    def all_of(m: Column, gaps: Column) -> Column:
        def one(i: Column) -> Column:
            start = total(F.slice(gaps, 1, i + 1), "int") + total(F.transform(F.slice(m, 1, i), lambda x: F.length(x)), "int")
            begin = lambda s: F.greatest(F.lit(0), s - reach)
            context = let(start, lambda s: F.substring(text, begin(s) + 1, s + F.length(F.get(m, i)) + reach - begin(s)))
            return F.struct(F.get(m, i).alias("name"), context.alias("context"))

        return F.transform(positions(F.size(m)), one)

    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(gaps, lambda g: all_of(m, g)))


def tool_mentions(text: Column, tools: Sequence[str], imports: Sequence[str]) -> Column:
    """Tools named as whole words in any case, and import patterns found anywhere."""
    words = [F.when(F.regexp_like(text, F.lit(rf"(?i)\b{re.escape(t)}\b")), F.lit(t)) for t in tools]
    parts = [F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in imports]
    return F.sort_array(F.array_distinct(F.array_compact(F.array(*words, *parts))))
