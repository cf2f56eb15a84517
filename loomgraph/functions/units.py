"""Unit symbols: one notation, dimensions, conversion. The dictionary is a short table of symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.expr import let

# Texts that stand where a unit would but are none.
NO_UNIT = ("", "-", "1", "mixed", "as parent", "as_parent", "as_parent_level_2", "Toroidal angle", "dimensionless")
# Other spellings of a symbol.
ALIASES = {"Ohm": "ohm", "Ω": "ohm", "Tesla": "T", "Weber": "Wb", "Volt": "V", "Watt": "W", "Ampere": "A", "sec": "s", "meter": "m", "Joule": "J", "Pascal": "Pa"}
# Symbol -> factor to base units, and exponents of m, kg, s, A, K.
SYMBOLS = {
    "m": (1.0, (1, 0, 0, 0, 0)), "kg": (1.0, (0, 1, 0, 0, 0)), "s": (1.0, (0, 0, 1, 0, 0)), "A": (1.0, (0, 0, 0, 1, 0)), "K": (1.0, (0, 0, 0, 0, 1)),
    "mm": (1e-3, (1, 0, 0, 0, 0)), "cm": (1e-2, (1, 0, 0, 0, 0)), "ms": (1e-3, (0, 0, 1, 0, 0)), "kA": (1e3, (0, 0, 0, 1, 0)), "MA": (1e6, (0, 0, 0, 1, 0)),
    "Hz": (1.0, (0, 0, -1, 0, 0)), "N": (1.0, (1, 1, -2, 0, 0)), "Pa": (1.0, (-1, 1, -2, 0, 0)), "J": (1.0, (2, 1, -2, 0, 0)), "W": (1.0, (2, 1, -3, 0, 0)),
    "V": (1.0, (2, 1, -3, -1, 0)), "ohm": (1.0, (2, 1, -3, -2, 0)), "T": (1.0, (0, 1, -2, -1, 0)), "Wb": (1.0, (2, 1, -2, -1, 0)), "H": (1.0, (2, 1, -2, -2, 0)),
    "eV": (1.602176634e-19, (2, 1, -2, 0, 0)), "keV": (1.602176634e-16, (2, 1, -2, 0, 0)), "C": (1.0, (0, 0, 1, 1, 0)), "rad": (1.0, (0, 0, 0, 0, 0)),
}


def _named(of: int) -> Column:
    values = [F.lit(x) for name, (factor, e) in SYMBOLS.items() for x in (name, factor if of < 0 else float(e[of]))]
    return F.create_map(*values)


def terms(unit: Column) -> Column:
    """Array of (symbol, exponent): factors parted by dots, stars or slashes, as in ``A/m^2`` or ``m.s^-1``."""
    marked = F.regexp_replace(F.regexp_replace(unit, r"\*\*", "^"), r"/", "./")
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])

    def term(x: Column) -> Column:
        symbol = F.regexp_extract(x, r"^/?([^\^0-9/-]+)", 1)
        power = F.coalesce(F.nullif(F.regexp_extract(x, r"\^?(-?[0-9]+(?:\.[0-9]+)?)$", 1), F.lit("")).cast("double"), F.lit(1.0))
        return F.struct(F.coalesce(F.element_at(aliases, symbol), symbol).alias("symbol"), F.when(F.startswith(x, F.lit("/")), -power).otherwise(power).alias("power"))

    return F.transform(F.filter(F.split(marked, r"[.*\s]+"), lambda x: x != ""), term)


def is_unit(unit: Column) -> Column:
    return unit.isNotNull() & ~unit.isin(*NO_UNIT) & ~F.startswith(unit, F.lit("units given")) & ~F.startswith(unit, F.lit("as_parent"))


def normalise(unit: Column) -> Column:
    """Symbols joined by dots, with ``^n`` for exponents other than 1; null for texts that are no unit."""
    power = lambda p: F.when(p == F.floor(p), p.cast("long").cast("string")).otherwise(p.cast("string"))
    written = lambda t: F.concat(t["symbol"], F.when(t["power"] == 1, "").otherwise(F.concat(F.lit("^"), power(t["power"]))))
    known = let(terms(unit), lambda ts: F.when(F.forall(ts, lambda t: t["symbol"].isin(*SYMBOLS)), F.array_join(F.transform(ts, written), ".")))
    return F.when(is_unit(unit), known)


def factor(unit: Column) -> Column:
    """Factor to base units; null if a symbol is unknown."""
    named = _named(-1)
    return F.aggregate(terms(unit), F.lit(1.0), lambda a, t: a * F.pow(F.element_at(named, t["symbol"]), t["power"]))


def dimension(unit: Column) -> Column:
    """Exponents of m, kg, s, A, K."""
    maps = [_named(k) for k in range(5)]
    return let(terms(unit), lambda ts: F.array(*[_dimension(ts, m) for m in maps]))


def _dimension(ts: Column, named: Column) -> Column:
    return F.aggregate(ts, F.lit(0.0), lambda a, t: a + F.element_at(named, t["symbol"]) * t["power"])


def converted(value: Column, unit: Column, to: Column) -> Column:
    """Value in another unit; null if the dimensions differ."""
    return F.when(dimension(unit) == dimension(to), value * factor(unit) / factor(to))


def change_kind(old: Column, new: Column) -> Column:
    """cosmetic, sentinel_resolved, dim_equivalent or dim_incompatible."""
    a, b = normalise(old), normalise(new)
    out = F.when(a.eqNullSafe(b), "cosmetic").when(a.isNull() | b.isNull(), "sentinel_resolved")
    return out.when(dimension(a) == dimension(b), "dim_equivalent").otherwise("dim_incompatible")
