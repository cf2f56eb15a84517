"""Path and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.expr import let


def strip_annotations(path: Column) -> Column:
    """Without index notes in round or square brackets."""
    return F.regexp_replace(path, r"\([^)]*\)|\[[^\]]*\]", "")


def looks_like_path(text: Column) -> Column:
    """Lower-case segments parted by dots or slashes, at least one of them with a letter."""
    return F.regexp_like(text, F.lit(r"^[a-z0-9_./]*[./][a-z0-9_./]*$")) & F.regexp_like(text, F.lit("[a-z]"))


def normalise_path(path: Column) -> Column:
    """Trimmed, without index notes, single slashes, and with dots as slashes where it is a path."""
    clean = F.regexp_replace(strip_annotations(F.regexp_replace(path, r"^\s+|\s+$", "")), "/{2,}", "/")
    return F.regexp_replace(let(clean, lambda p: F.when(looks_like_path(p), F.replace(p, F.lit("."), F.lit("/"))).otherwise(p)), "^/+|/+$", "")


def parent_path(path: Column, separator: str = "/") -> Column:
    """Everything before the last segment; null for a single one."""
    return F.when(F.contains(path, F.lit(separator)), F.regexp_replace(path, f"{separator}[^{separator}]*$", ""))


def common_prefix(low: Column, high: Column, separator: str = "/") -> Column:
    """Longest common path of a group, given its smallest and largest path."""

    def shared(a: Column) -> Column:
        b = F.split(high, F.lit(separator))
        same = F.transform(a, lambda x, i: x.eqNullSafe(F.get(b, i)))
        stop = F.array_position(same, F.lit(False))
        return F.array_join(F.when(stop == 0, a).otherwise(F.slice(a, F.lit(1), (stop - 1).cast("int"))), separator)

    return let(F.split(low, F.lit(separator)), shared)


def name_key(name: Column) -> Column:
    """Lower case, runs of underscores as one, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "_+", "_"), "^_|_$", "")


def strip_accessor(path: Column, accessors: tuple[str, ...] = ("data", "time", "value", "validity")) -> Column:
    """Without a last segment that only names a way of access."""
    return F.regexp_replace(path, "/(" + "|".join(accessors) + ")$", "")


def escape_query(term: Column) -> Column:
    """With a backslash before each sign that full-text queries give a meaning."""
    return F.regexp_replace(term, r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1")


def content_hash(text: Column, digits: int = 16) -> Column:
    """First hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, digits)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def remote_url(url: Column) -> dict[str, Column]:
    """Host, owner and repository of a git remote in either notation."""
    part = lambda k: F.regexp_extract(url, r"^(?:[a-z+]+://)?(?:[^@/]+@)?([^:/]+)[:/](?:[0-9]+/)?(.+?)/([^/]+?)(?:\.git)?/?$", k)
    return {"host": part(1), "owner": part(2), "repository": part(3)}
