"""Coordinate conventions of magnetic equilibria: parameters, factors between conventions, inference from signs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Convention -> sign of the poloidal field, exponent of 2 pi, sign of (R, phi, Z), sign of (rho, theta, phi);
# table I of Sauter and Medvedev (2013).
CONVENTIONS = {
    1: (1, 0, 1, 1), 2: (1, 0, -1, 1), 3: (-1, 0, 1, -1), 4: (-1, 0, -1, -1),
    5: (1, 0, 1, -1), 6: (1, 0, -1, -1), 7: (-1, 0, 1, 1), 8: (-1, 0, -1, 1),
    11: (1, 1, 1, 1), 12: (1, 1, -1, 1), 13: (-1, 1, 1, -1), 14: (-1, 1, -1, -1),
    15: (1, 1, 1, -1), 16: (1, 1, -1, -1), 17: (-1, 1, 1, 1), 18: (-1, 1, -1, 1),
}
LABELS = ("one_like", "ip_like", "b0_like", "tor_angle_like", "pol_angle_like", "q_like", "psi_like", "dodpsi_like")


def parameters(spark: SparkSession) -> DataFrame:
    """(convention, bp, exponent, rpz, rtp): 16 rows."""
    return spark.createDataFrame([(k, *v) for k, v in CONVENTIONS.items()], "convention int, bp int, exponent int, rpz int, rtp int")


def factor(label: Column, a: str, b: str) -> Column:
    """Factor of a labelled quantity from convention ``a`` to ``b`` (structs of parameters); unknown labels have 1.

    All signs are their own inverse, so a quotient of signs is their product.
    """
    p = lambda side, name: F.col(f"{side}.{name}")
    sign = lambda *names: math.prod([p(side, n) for n in names for side in (a, b)][1:], start=p(a, names[0]))
    psi = sign("bp") * F.pow(F.lit(2 * math.pi), p(a, "exponent") - p(b, "exponent"))
    out = F.when(label == "ip_like", sign("rpz", "bp")).when(label.isin("b0_like", "tor_angle_like"), sign("rpz"))
    out = out.when(label == "pol_angle_like", sign("rtp")).when(label == "q_like", sign("rtp", "rpz"))
    return out.when(label == "psi_like", psi).when(label == "dodpsi_like", 1 / psi).otherwise(F.lit(1)).cast("double")


def from_version(version: Column) -> Column:
    """Convention of a dictionary version: 17 from major version 4 on, 11 before."""
    return F.when(F.regexp_extract(version, r"^([0-9]+)", 1).cast("int") >= 4, 17).otherwise(11)


def inferred(psi_axis: Column, psi_edge: Column, current: Column, field: Column, q: Column, per_radian: Column, right_handed: bool = True) -> dict[str, Column]:
    """Parameters that follow from the signs of an equilibrium's quantities."""
    s = lambda c: F.when(c >= 0, 1).otherwise(-1)
    rpz = F.lit(1 if right_handed else -1)
    return {"bp": s(psi_edge - psi_axis) * s(current) * 1, "exponent": F.when(per_radian, 0).otherwise(1), "rpz": rpz, "rtp": s(q) * s(current) * s(field)}


def _sign(value: Column) -> Column:
    """1 for zero and above, -1 below, null for null and NaN."""
    return F.when(value.isNull() | F.isnan(value), F.lit(None)).when(value >= 0, 1).otherwise(-1)


def _parameters(convention: Column) -> Column:
    """Struct of parameters of a convention; null for one that isn't known."""
    out = F.lit(None).cast("struct<bp:int,exponent:int,rpz:int,rtp:int>")
    for k, v in CONVENTIONS.items():
        out = F.when(convention == k, F.struct(*[F.lit(x).alias(n) for n, x in zip(("bp", "exponent", "rpz", "rtp"), v)])).otherwise(out)
    return out


def inferred_convention(psi_axis: Column, psi_edge: Column, current: Column, field: Column, q: Column, dp: Column, right_handed: bool = True) -> Column:
    """Struct (convention, confidence) that the signs of an equilibrium tell; ``q`` and ``dp`` may be null.

    A flux over half a weber counts as not divided by 2 pi. Confidence starts at one half; the sign of the pressure gradient
    adds 0.15 if it agrees and takes 0.25 if not, a known safety factor adds 0.2.
    """
    bp = _sign(psi_edge - psi_axis) * _sign(current)
    exponent = F.when(F.greatest(F.abs(psi_axis), F.abs(psi_edge)) > 0.5, 1).otherwise(0)
    rtp = F.coalesce(_sign(q) * _sign(current) * _sign(field), F.lit(1))
    rpz = 1 if right_handed else -1
    of = {(v[0], v[1], v[3]): k for k, v in CONVENTIONS.items() if v[2] == rpz}
    known = F.create_map(*[F.lit(x) for k, v in of.items() for x in ("/".join(map(str, k)), v)])
    agrees = _sign(dp) == -_sign(current) * bp
    confidence = 0.5 + F.when(agrees.isNull(), 0.0).when(agrees, 0.15).otherwise(-0.25) + F.when(_sign(q).isNull(), 0.0).otherwise(0.2)
    return F.struct(known[F.concat_ws("/", bp, exponent, rtp)].alias("convention"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)).alias("confidence"))


def inconsistencies(convention: Column, psi_axis: Column, psi_edge: Column, current: Column, field: Column, q: Column, dp: Column) -> Column:
    """Array of what contradicts a declared convention: invalid, psi, dp, q; empty if nothing does."""
    p = _parameters(convention)
    checks = [
        F.when(_sign(current) * p["bp"] != _sign(psi_edge - psi_axis), "psi"),
        F.when(_sign(dp) != -_sign(current) * p["bp"], "dp"),
        F.when(_sign(q) != _sign(current) * _sign(field) * p["rtp"], "q"),
    ]
    return F.when(p.isNull(), F.array(F.lit("invalid"))).otherwise(F.array_compact(F.array(*checks)))


def change_factors(labelled: DataFrame, a: int, b: int) -> DataFrame:
    """``labelled`` (with ``label``) and the factor from convention ``a`` to ``b``, and whether to multiply by it."""
    both = labelled.withColumns({"a": _parameters(F.lit(a)), "b": _parameters(F.lit(b))})
    out = both.withColumn("factor", factor(F.col("label"), "a", "b")).drop("a", "b")
    return out.withColumn("action", F.when(F.col("factor") == 1, "none").otherwise("multiply"))
