"""A query builder over node and edge tables: suffix predicates, traversals, projection, order and limit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Predicate suffixes and what they mean.
PREDICATES = {
    "contains": lambda c, v: F.contains(c, F.lit(v)),
    "starts_with": lambda c, v: F.startswith(c, F.lit(v)),
    "ends_with": lambda c, v: F.endswith(c, F.lit(v)),
    "in": lambda c, v: c.isin(*v),
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "ne": lambda c, v: c != v,
    "is_null": lambda c, v: c.isNull() if v else c.isNotNull(),
}


def predicate(key: str, value, columns: Sequence[str]) -> Column:
    """``name__suffix`` or ``name`` for equality; an unknown column or suffix is an error."""
    name, _, suffix = key.partition("__")
    if name not in columns:
        raise ValueError(f"no column {name!r}; there are {sorted(columns)}")
    if not suffix:
        return F.col(name) == F.lit(value)
    if suffix not in PREDICATES:
        raise ValueError(f"no predicate {suffix!r}; there are {sorted(PREDICATES)}")
    return PREDICATES[suffix](F.col(name), value)


def where(df: DataFrame, conditions: Mapping) -> DataFrame:
    """Rows that meet all conditions; they are plain expressions, so they reach the scan."""
    for key, value in conditions.items():
        df = df.where(predicate(key, value, df.columns))
    return df


@dataclass
class Graph:
    """Node tables by label, and edges by name: (from label, column, to label, column)."""

    nodes: Mapping[str, DataFrame]
    edges: Mapping[str, tuple[str, str, str, str]] = field(default_factory=dict)

    def traverse(self, start: DataFrame, label: str, steps: Sequence[str], optional: bool = False) -> DataFrame:
        """Follow steps ``EDGE>Label`` one after the other; inner joins, or left joins if optional."""
        at = label
        for step in steps:
            name, _, to = step.partition(">")
            source, column, target, key = self.edges[name]
            if (source, target) == (at, to):
                here, there = column, key
            elif (target, source) == (at, to):
                here, there = key, column
            else:
                raise ValueError(f"edge {name!r} does not lead from {at} to {to}")
            other = self.nodes[to]
            if here == there:
                start = start.join(other, here, "left" if optional else "inner")
            else:
                start = start.join(other, start[here] == other[there], "left" if optional else "inner")
            at = to
        return start

    def search(self, label: str, where_: Mapping | None = None, traverse: Sequence[str] = (), returns: Sequence[str] | None = None, order_by: Sequence[str] = (), limit: int | None = None) -> DataFrame:
        """Filter nodes, follow edges, project, order (``-name`` for descending) and cut."""
        found = self.traverse(where(self.nodes[label], where_ or {}), label, traverse)
        found = found.select(*(returns or self.nodes[label].columns))
        if order_by:
            found = found.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order_by])
        return found.limit(limit) if limit is not None else found
