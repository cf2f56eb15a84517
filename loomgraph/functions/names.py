"""Names, links and texts of dictionary entries as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short and long names of axes.
AXES = {"r": "radial", "z": "vertical", "phi": "toroidal", "tor": "toroidal", "pol": "poloidal"} | {
    x: x for x in ("radial", "vertical", "toroidal", "poloidal", "parallel", "perpendicular", "diamagnetic", "x", "y")
}
# Parts of a person's name that don't tell persons apart.
TITLES = ("ext", "jr", "sr", "ii", "iii", "phd", "dr", "prof")
NAME_LINK = r"\[[^\]]*?\]\(name:([a-z0-9_]+)\)|\bname:([a-z0-9_]+)\b"
PATH_LINK = r"\[[^\]]*?\]\(dd:([^\)]+)\)|\bdd:([a-z0-9_/]+)\b"
DICTIONARY_PATH = r"\b[a-z][a-z0-9_]*(?:/[a-z][a-z0-9_]*(?:\([^)]*\)|\[[^\]]*\])?)+"
#: From this embedding size on, a text holds more than its main part.
RICH_DIMENSIONS = 512


def axis(suffix: Column) -> Column:
    """The axis that a leaf's name is or ends with, else null."""
    known = F.create_map(*[F.lit(x) for pair in AXES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, suffix), F.try_element_at(known, F.substring_index(suffix, "_", -1)))


def link_status(links: Column) -> Column:
    """resolved, unresolved if a link waits for a path, null without links."""
    return F.when(F.size(links) > 0, F.when(F.exists(links, lambda x: F.startswith(x, F.lit("dd:"))), "unresolved").otherwise("resolved"))


def doc_links(text: Column) -> Column:
    """``name:`` and then ``dd:`` references of a text, in order and without repeats; null if there are none."""
    def found(pattern: str, prefix: str) -> Column:
        first = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        return F.transform(F.zip_with(first, second, lambda a, b: F.concat(a, b)), lambda x: F.concat(F.lit(prefix), x))

    every = F.array_distinct(F.concat(found(NAME_LINK, "name:"), found(PATH_LINK, "dd:")))
    return F.when(F.size(every) > 0, every)


def signal_id(facility: Column, domain: Column, quantity: Column) -> Column:
    return F.concat(facility, F.lit(":"), domain, F.lit("/"), F.replace(F.lower(quantity), F.lit(" "), F.lit("_")))


def person_key(given: Column, family: Column) -> Column:
    """Lower-case name without titles and repeated spaces; null unless both parts are there."""
    plain = lambda c: F.regexp_replace(F.trim(F.lower(c)), r"[ -](" + "|".join(TITLES) + ")", "")
    full = F.trim(F.regexp_replace(F.concat_ws(" ", plain(given), plain(family)), r"\s+", " "))
    return F.when((given != "") & (family != ""), F.nullif(full, F.lit("")))


def embedding_text(description: Column, documentation: Column, keywords: Column, dimensions: int) -> Column:
    """Description, else documentation; from RICH_DIMENSIONS on also an excerpt of the latter and eight keywords."""
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    desc, doc = clean(description), clean(documentation)
    main = F.when(desc != "", desc).otherwise(doc)
    if dimensions < RICH_DIMENSIONS:
        return main
    excerpt = F.when((doc != "") & (doc != desc), F.substring(doc, 1, 300))
    words = F.when(F.size(keywords) > 0, F.array_join(F.slice(keywords, 1, 8), ", "))
    return F.when(main == "", "").otherwise(F.concat_ws(". ", main, excerpt, words))


def embedding_hash(text: Column, model: str) -> Column:
    """First 16 hex digits of the hash of model and text."""
    return F.substring(F.sha2(F.concat(F.lit(f"{model}:"), text), 256), 1, 16)


def dictionary_paths(text: Column, groups: tuple[str, ...] = ()) -> Column:
    """Sorted distinct dictionary paths of a text without their indices, of the given groups if any."""
    every = F.transform(F.regexp_extract_all(text, F.lit(DICTIONARY_PATH), F.lit(0)), lambda x: F.regexp_replace(x, r"\([^)]*\)|\[[^\]]*\]", ""))
    kept = F.filter(every, lambda x: F.substring_index(x, "/", 1).isin(*groups)) if groups else every
    return F.sort_array(F.array_distinct(kept))
