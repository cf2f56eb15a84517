"""What a search query is after: a path, a concept, or both."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Last segments that only give access to a quantity.
ACCESSORS = (
    "data", "value", "time", "r", "z", "phi", "coefficients", "label", "grid_index", "measured", "reconstructed", "parallel", "toroidal", "perpendicular",
)
# Abbreviations and the terms they stand for.
ABBREVIATIONS = {
    "ip": ("plasma current", "ip"),
    "vloop": ("loop voltage", "v_loop", "vloop"),
    "te": ("electron temperature", "te"),
    "ti": ("ion temperature", "ti"),
    "te0": ("central electron temperature", "te", "te0"),
    "ti0": ("central ion temperature", "ti", "ti0"),
    "ne": ("electron density", "ne"),
    "ni": ("ion density", "ni"),
    "ne0": ("central electron density", "ne", "ne0"),
    "n_e_line": ("line-integrated density", "nel", "n_e_line"),
    "bt": ("toroidal magnetic field", "b_field_tor", "bt", "b0"),
    "bp": ("poloidal magnetic field", "b_field_pol", "bp"),
    "bpol": ("poloidal magnetic field", "b_field_pol", "bpol"),
    "btor": ("toroidal magnetic field", "b_field_tor", "btor"),
    "b0": ("vacuum toroidal field", "toroidal magnetic field", "b0", "bt"),
    "q": ("safety factor", "q"),
    "psi": ("poloidal flux", "psi"),
    "beta": ("plasma beta", "beta_pol", "beta_tor", "beta_normal", "beta"),
    "li": ("internal inductance", "li"),
    "wmhd": ("stored energy", "w_mhd", "wmhd"),
    "zeff": ("effective charge", "z_eff", "zeff"),
    "r0": ("reference major radius", "magnetic axis radius", "r0"),
    "a": ("minor radius", "plasma minor radius", "a"),
    "kappa": ("elongation", "plasma elongation", "kappa"),
    "delta": ("triangularity", "plasma triangularity", "delta"),
    "rho": ("normalized radius", "rho_tor_norm", "rho"),
    "phi": ("toroidal flux", "toroidal angle", "phi"),
    "theta": ("poloidal angle", "geometric angle", "theta"),
    "j_tor": ("toroidal current density", "j_tor"),
    "j_parallel": ("parallel current density", "j_parallel"),
    "nbi": ("neutral beam injection", "beam heating", "nbi"),
    "ecrh": ("electron cyclotron heating", "ech", "ecrh"),
    "icrh": ("ion cyclotron heating", "icrf", "icrh"),
    "lh": ("lower hybrid", "lower hybrid heating", "lh"),
    "ece": ("electron cyclotron emission", "ece"),
    "mse": ("motional stark effect", "mse"),
    "bol": ("bolometry", "radiated power", "bol"),
    "sxr": ("soft x-ray", "sxr"),
    "p_ohm": ("ohmic power", "p_ohmic", "p_ohm"),
    "tau_e": ("energy confinement time", "tau_e"),
}


def query_intent(query: Column) -> Column:
    """Struct (kind, accessor, stripped, grp, terms, abbreviated) of a query.

    A text with a slash and no space is a path, partial if it has wildcards; a last segment that gives access is taken
    off. An abbreviation alone is a concept with the terms it stands for; among other words it makes the query hybrid, with
    its terms, the other words and the whole query. Everything else is a concept; null is like an empty query.
    """
    q = F.trim(F.coalesce(query, F.lit("")))
    known = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    parts, words = F.split(q, "/"), F.filter(F.split(F.lower(q), r"\s+"), lambda w: w != "")
    is_path = F.contains(q, F.lit("/")) & ~F.contains(q, F.lit(" "))
    short = F.get(F.filter(words, lambda w: w.isin(*ABBREVIATIONS)), F.lit(0))
    alone = F.size(words) == 1
    last = F.lower(F.element_at(parts, -1))
    opens = is_path & last.isin(*ACCESSORS)
    kind = F.when(is_path, F.when(F.regexp_like(q, F.lit(r"[*?]")), "path_partial").otherwise("path_exact"))
    kind = kind.when(short.isNotNull() & ~alone, "hybrid").otherwise("concept")
    terms = F.try_element_at(known, short)
    every = F.concat(terms, F.filter(words, lambda w: w != short), F.array(q))
    none = F.array().cast("array<string>")
    own = F.when(is_path | (q == ""), none).when(short.isNull(), F.array(q)).when(alone, terms).otherwise(every)
    first = F.get(parts, F.lit(0))
    return F.struct(
        kind.alias("kind"),
        F.when(opens, last).alias("accessor"),
        F.when(opens, F.regexp_replace(q, "/[^/]*$", "")).alias("stripped"),
        F.when(is_path & ~F.startswith(first, F.lit("_")), first).alias("grp"),
        own.alias("terms"),
        (~is_path & short.isNotNull()).alias("abbreviated"),
    )
