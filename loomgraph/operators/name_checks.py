"""Checks on the form of names: a registry of column rules with severities, and names parsed to segments.

A name is a row with id, description, documentation, unit, source_path and label (of its convention); columns that are missing are
null. A check gives a detail or null; ``checked`` runs all of a registry in one pass over the columns. Nulls fail no check.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words and endings that the checks look for, each list in its usual order.
HEADS = ("position", "component", "coordinate", "angle", "distance", "radius", "height", "width", "length")
GENERIC = (
    "geometry", "data", "value", "quantity", "parameter", "coefficient", "coefficients", "element", "elements", "object", "objects", "node", "nodes", "index", "measure", "type", "name",
    "label", "status", "flag", "mode", "state", "version", "identifier", "metadata",
)
GENERIC_QUALIFIERS = ("raw", "input", "output", "generic", "basic")
SPECTRAL_ENDINGS = ("_fourier_coefficients", "_fourier_coefficient", "_fourier_modes", "_fourier_mode", "_harmonics", "_harmonic_coefficients")
SPECTRAL_TEXTS = ("fourier coefficient", "fourier mode", "spectral coefficient", "spectral mode", "harmonic amplitude", "harmonic coefficient")
SPECTRAL_MARKS = ("mode_", "_mode_", "_amplitude", "fourier", "harmonic", "spectral")
ABBREVIATIONS = {
    "norm": "normalized", "perp": "perpendicular", "par": "parallel", "temp": "temperature", "pos": "position", "max": "maximum", "min": "minimum", "avg": "average", "sep": "separatrix",
    "ec": "electron_cyclotron", "ic": "ion_cyclotron", "nbi": "neutral_beam_injector", "lh": "lower_hybrid",
}
REPRESENTATION = (
    "_(?:coefficients|ggd|basis|spline|fourier_modes|harmonics_coefficients)", "_ggd_coefficients", "_coefficient_on_ggd", "_interpolation_coefficients?(?:_on_ggd)?",
    "_finite_element(?:_interpolation)?_coefficients?", "_finite_element_coefficients_(?:real|imaginary)_part",
)
TEMPORAL = ("disruption", "breakdown", "ramp_up", "ramp_down", "flat_top", "shutdown", "startup")
ADJECTIVES = {
    "ohmic": "ohmic_dissipation or ohmic_heating", "neutral_beam": "neutral_beam_injection", "wave": "wave_heating", "halo": "halo_currents", "runaway": "runaway_electrons", "fast_ion": "fast_ions",
    "alpha": "alpha_particle_heating", "turbulent": "turbulent_transport", "neoclassical": "neoclassical_transport", "anomalous": "anomalous_transport", "thermal": "thermal_fusion",
}
FIELD_QUALIFIERS = ("magnetic", "electric", "radiation", "displacement", "velocity", "temperature", "pressure", "density", "flow", "vector")
FIELD_NAMES = ("vacuum_toroidal_field_function", "vacuum_toroidal_field_flux_function", "resistance_of_poloidal_field_coil")
DENSITY_ENDINGS = ("_constraint_measurement_time", "_constraint_weight", "_constraint_reconstructed", "_constraint_measured", "_constraint_time_measurement", "_constraint_position", "_constraint")
META_PREFIXES = ("measurement_time_of_", "time_of_", "position_of_", "weight_of_", "exact_flag_of_")
META_PARTS = ("_exact_flag", "_iteration_count", "_convergence_count", "_constraint_weight")
AXES = ("radial", "vertical", "toroidal")
VECTOR_FIELDS = ("surface_normal", "magnetic_field_vector", "electric_field_vector", "velocity_vector", "current_density_vector", "poynting_vector")
AGGREGATORS = ("volume_averaged", "flux_surface_averaged", "surface_averaged", "line_averaged", "density_averaged", "time_averaged")
FEATURES = ("magnetic_axis", "plasma_boundary", "last_closed_flux_surface", "separatrix", "x_point", "o_point", "strike_point", "inner_strike_point", "outer_strike_point", "stagnation_point")
PARTS_OF = ("amplitude_of_", "phase_of_", "magnitude_of_", "real_part_of_", "imaginary_part_of_", "modulus_of_")
MODE_ENDINGS = ("_per_toroidal_mode_number", "_per_poloidal_mode_number")
CUMULATIVE = ("cumulative", "integrated", "running")
SHAPES = ("peakedness_profile", "half_width_profile", "aspect_ratio_profile")
PAIRS = ("deuterium_deuterium", "deuterium_tritium", "tritium_tritium", "beam_beam")
CONNECTIVES = ("of", "at", "per", "due", "to", "in", "by", "for", "along", "from")
INSTRUMENTS = ("polarimeter", "interferometer", "radiometer", "spectrometer")
OBSERVABLES = ("stokes_vector", "stokes_parameter", "degree_of_polarization")
MOST_LETTERS = 70
RATE_TEXTS = ("instantaneous change", "instantaneous signed change", "rate of change", "time derivative", "time rate of change", "signed change in", "temporal derivative", "per unit time")
WEAK_RATE_TEXTS = ("signed change in", "per unit time")
RATE_NAMES = ("tendency_of_", "change_in_", "rate_of_change_of_", "time_derivative_of_")
INSTANT = ("instant_change_", "instantaneous_change_")
SHAPED = (
    "poloidal", "toroidal", "equilibrium", "magnetic", "plasma", "field", "geometry", "space", "grid", "mesh", "domain", "cross[- ]section", "plane", "surface", "volume", "configuration",
)
PROVENANCE = ("measured", "reconstructed", "fitted", "computed", "calculated")
BRITISH = {
    "normalised": "normalized", "polarised": "polarized", "ionised": "ionized", "centre": "center", "fibre": "fiber", "metre": "meter", "colour": "color", "behaviour": "behavior", "modelled": "modeled",
    "catalogue": "catalog",
}
DEFINING = ("is", "are", "denotes", "represents", "where", "defined", "being", "given by", "expressed as", "known as")
UNITS_IN_BRACKETS = ("eV", "m", "A", "T", "Pa", "Wb", "K", "rad", "s", "W", "V")
CONSTANTS = (
    r"\\pi", r"\\alpha", r"\\beta", r"\\gamma", r"\\delta", r"\\epsilon", r"\\mu", r"\\lambda", r"\\sigma", r"\\tau", r"\\omega", r"\\Omega", r"\\mu_0", r"\\mu_\{0\}", r"\\epsilon_0", r"\\epsilon_\{0\}",
    r"\\hbar", "k_B", r"k_\{B\}",
)
PLACED_BY = ("at", "in", "on", "for")
#: Numbers, powers and products of them, signs of operations, and constants with a factor or a divisor need no definition.
PLAIN_SYMBOL = r"[^A-Za-z]?|(?:[\d.+-]+\s*\\times\s*)?[\d.+-]*(?:\s*\^\s*\{?-?\d+\}?)?|\\times|\\cdot|(?:\d+(?:\.\d+)?\s*)?(?:" + "|".join(CONSTANTS) + r")(?:\s*/\s*\d+)?"


class Name(NamedTuple):
    """The columns a check may use: the name in lower case, its tokens, and the other texts, empty where null."""

    id: Column
    tokens: Column
    description: Column
    documentation: Column
    unit: Column
    source: Column
    label: Column


class Check(NamedTuple):
    critical: bool
    find: Callable[[Name], Column]


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """What a group of the first match holds; null without a match."""
    return F.when(matches(text, pattern), F.regexp_extract(text, pattern, group))


def either(words: Sequence[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def found(condition: Column, detail: str | Column) -> Column:
    return F.when(condition, F.lit(detail) if isinstance(detail, str) else detail)


def content_tokens(n: Name) -> Column:
    """Tokens in order, compounds of two equal or kindred species and the connectives taken out."""
    plain = F.regexp_replace(n.id, either(PAIRS), "_")
    return F.filter(F.split(plain, "_"), lambda t: (t != "") & ~t.isin(*CONNECTIVES))


def repeated(tokens: Column) -> Column:
    """The first token that was there before, null if none was."""
    again = F.filter(tokens, lambda t, k: F.array_contains(F.slice(tokens, F.lit(1), k), t))
    return F.get(again, F.lit(0))


def bare_field(n: Name) -> Column:
    exempt = n.id.isin(*FIELD_NAMES) | F.contains(n.id, F.lit("_field_coil")) | F.startswith(n.id, F.lit("use_exact_"))
    bare = F.filter(F.transform(n.tokens, lambda t, k: F.when(t == "field", F.coalesce(F.get(n.tokens, k - 1), F.lit("")))), lambda t: t.isNotNull() & ~t.isin(*FIELD_QUALIFIERS))
    return F.when(~exempt, F.get(bare, F.lit(0)))


def density_unit(n: Name) -> Column:
    exempt = matches(n.id, either(DENSITY_ENDINGS) + "$") | matches(n.id, "^" + either(META_PREFIXES)) | matches(n.id, "_spectrum|_spectral")
    return found(F.contains(n.id, F.lit("_density")) & ~exempt & ~n.unit.isin("", "1") & ~matches(n.unit, r"m\^-|m\*\*-"), n.unit)


def duplicate_neighbours(n: Name) -> Column:
    tokens = F.split(F.regexp_replace(n.id, either(PAIRS), "_compound_"), "_")
    twice = F.filter(tokens, lambda t, k: (t == F.get(tokens, k - 1)) & (t != "") & ~t.isin(*CONNECTIVES) & (t != "compound"))
    return F.get(twice, F.lit(0))


def tautology(n: Name) -> Column:
    """Heads of the parts between ``_of_``: the first one that two neighbours share."""
    heads = F.transform(F.split(n.id, "_of_"), lambda p: F.substring_index(p, "_", -1))
    same = F.filter(heads, lambda h, k: h.isin(*HEADS) & (h == F.get(heads, k + 1)))
    return F.get(same, F.lit(0))


def rate_drift(n: Name) -> Column:
    """A description of a rate under a name without its mark; a flux is one per unit time by itself."""
    text = F.lower(n.description)
    strong = matches(text, either([t for t in RATE_TEXTS if t not in WEAK_RATE_TEXTS]))
    rate = strong | (matches(text, either(WEAK_RATE_TEXTS)) & ~F.contains(n.id, F.lit("_flux")))
    instant = F.when(text != "", first_group(n.id, "^(" + "|".join(INSTANT) + ")"))
    return F.coalesce(instant, found(rate & ~matches(n.id, either(RATE_NAMES)), "the name has no mark of a rate"))


def storage_shape(n: Name) -> Column:
    exempt = matches(n.description, r"(?i)\b[0-3]d\s+" + either(SHAPED))
    return F.when(~exempt, first_group(n.description, r"\b([0-3][dD])\b"))


def provenance(n: Name) -> Column:
    """A verb of how the value came about that the source's path doesn't have."""
    of_source = F.split(F.replace(n.source, F.lit("/"), F.lit("_")), "_")
    return F.get(F.filter(F.array(*map(F.lit, PROVENANCE)), lambda v: F.array_contains(n.tokens, v) & ~F.array_contains(of_source, v)), F.lit(0))


def undefined_symbol(n: Name) -> Column:
    """The first symbol between dollars without a defining word or a unit in its sentence, the one before or the two behind."""
    text = n.documentation
    symbols = F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, r"\$\$[^$]+\$\$", " "), F.lit(r"\$([^$]+)\$"), F.lit(1)))
    sentences = F.split(text, r"(?<=[.!?])\s+")
    words, units = r"\b" + either(DEFINING) + r"\b", r"\([^)]*" + either(UNITS_IN_BRACKETS) + r"[^)]*\)"
    defines = F.transform(sentences, lambda s: matches(F.lower(s), words) | matches(s, units))

    def undefined(symbol: Column) -> Column:
        at = F.array_position(F.transform(sentences, lambda s: F.contains(s, F.concat(F.lit("$"), symbol, F.lit("$")))), True).cast("int")
        start = F.greatest(at - 1, F.lit(1))
        return ~matches(F.trim(symbol), "^(?:" + PLAIN_SYMBOL + ")$") & (at > 0) & ~F.exists(F.slice(defines, start, at + 3 - start), lambda x: x)

    return F.get(F.filter(symbols, undefined), F.lit(0))


#: By name; those that are critical keep a name out.
CHECKS: Mapping[str, Check] = {
    "generic_noun": Check(True, lambda n: found(((F.size(n.tokens) == 1) & n.id.isin(*GENERIC)) | ((F.size(n.tokens) == 2) & F.element_at(n.tokens, -1).isin(*GENERIC) & n.tokens[0].isin(*GENERIC_QUALIFIERS)), n.id)),
    "tautology": Check(True, tautology),
    "spectral_suffix": Check(True, lambda n: first_group(n.id, "(" + "|".join(SPECTRAL_ENDINGS) + ")$")),
    "abbreviation": Check(True, lambda n: F.get(F.filter(F.array(*map(F.lit, ABBREVIATIONS)), lambda a: F.array_contains(n.tokens, a)), F.lit(0))),
    "spectral_description": Check(True, lambda n: found(matches(F.lower(n.description), either(SPECTRAL_TEXTS)) & ~matches(n.id, either(SPECTRAL_MARKS)), "the name has no mark of a decomposition")),
    "representation": Check(True, lambda n: F.coalesce(first_group(n.id, "(" + "|".join(REPRESENTATION) + ")(?:_|$)"), found(F.endswith(n.id, F.lit("_on_ggd")) & matches(n.source, "/ggd/|/grids_ggd/"), "_on_ggd"))),
    "due_to_event": Check(True, lambda n: first_group(n.id, "^.*?_due_to_(" + "|".join(TEMPORAL) + ")(?:_|$)")),
    "due_to_adjective": Check(True, lambda n: first_group(n.id, "^.*?_due_to_(" + "|".join(ADJECTIVES) + ")_?$")),
    "bare_field": Check(True, bare_field),
    "density_unit": Check(True, density_unit),
    "coordinate_of_vector": Check(True, lambda n: first_group(n.id, "(" + either(AXES) + "_coordinate_of_" + either(VECTOR_FIELDS) + ")(?:_|$)")),
    "aggregator_order": Check(True, lambda n: first_group(n.id, "._(" + "|".join(AGGREGATORS) + ")$")),
    "named_feature": Check(True, lambda n: first_group(n.id, "_at_(" + "|".join(FEATURES) + ")(?:_|$)")),
    "diamagnetic_component": Check(True, lambda n: first_group(n.id, "diamagnetic_component_of_(.*)$")),
    "part_prefix": Check(True, lambda n: first_group(n.id, "^(" + "|".join(PARTS_OF) + ")")),
    "mode_number": Check(True, lambda n: first_group(n.id, "(" + "|".join(MODE_ENDINGS) + ")$")),
    "cumulative": Check(True, lambda n: F.when(~matches(n.id, "^" + either(META_PREFIXES)) & ~matches(n.id, either(META_PARTS)), F.get(F.filter(F.array(*map(F.lit, CUMULATIVE)), lambda c: F.array_contains(n.tokens, c)), F.lit(0)))),
    "ratio_form": Check(True, lambda n: found(matches(n.id, "^.+_to_.+_ratio$") & ~matches(n.id, "^ratio_of_.*_to_"), F.regexp_replace(n.id, "^(.+?)_to_(.+?)_ratio$", "ratio_of_$1_to_$2"))),
    "profile_suffix": Check(False, lambda n: found(F.endswith(n.id, F.lit("_profile")) & ~matches(n.id, either(SHAPES) + "$"), F.regexp_replace(n.id, "_profile$", ""))),
    "adjacent_duplicate": Check(True, duplicate_neighbours),
    "repeated_token": Check(False, lambda n: repeated(content_tokens(n))),
    "length": Check(False, lambda n: found(F.length(n.id) > MOST_LETTERS, F.length(n.id).cast("string"))),
    "instrument_observable": Check(False, lambda n: found(matches(n.id, either(INSTRUMENTS)) & matches(n.id, either(OBSERVABLES)), n.id)),
    "position_redundancy": Check(False, lambda n: found(matches(n.id, "(?:^|_)(?:at|on)_wall_surface"), F.regexp_replace(n.id, "wall_surface", "wall"))),
    "convention_mention": Check(False, lambda n: found((n.label != "") & ~matches(F.concat_ws(" ", n.documentation, n.description), r"(?i)COCOS\s*\d"), n.label)),
    "rate_description": Check(False, rate_drift),
    "storage_shape": Check(False, storage_shape),
    "provenance_verb": Check(False, provenance),
    "british_spelling": Check(False, lambda n: first_group(F.lower(F.concat_ws("\n", F.replace(n.id, F.lit("_"), F.lit(" ")), n.description, n.documentation)), r"\b(" + "|".join(BRITISH) + r")\b")),
    "undefined_symbol": Check(True, undefined_symbol),
    "reference_suffix": Check(True, lambda n: first_group(n.id, "_(reference|reference_waveform)$")),
    "placed_process": Check(False, lambda n: first_group(n.id, "^.*?_due_to_.*?_(" + "|".join(PLACED_BY) + ")_")),
}


def name_columns(names: DataFrame) -> Name:
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in names.columns else F.lit("")
    id_ = F.lower(F.trim(F.col("id")))
    return Name(id_, F.split(id_, "_"), text("description"), text("documentation"), F.trim(text("unit")), text("source_path"), text("label"))


def checked(names: DataFrame, checks: Mapping[str, Check] = CHECKS) -> DataFrame:
    """The names with ``issues`` (check, critical, detail), in the registry's order, and ``critical``, whether any of them is."""
    n = name_columns(names)
    each = [F.struct(F.lit(name).alias("check"), F.lit(c.critical).alias("critical"), c.find(n).alias("detail")) for name, c in checks.items()]
    out = names.withColumn("issues", F.filter(F.array(*each), lambda x: x["detail"].isNotNull()))
    return out.withColumn("critical", F.exists("issues", lambda x: x["critical"]))


def issue_counts(checked_names: DataFrame) -> DataFrame:
    """(check, critical, n, first, last): how many names fail each check, and the first and the last of them by id."""
    each = checked_names.select("id", F.explode("issues").alias("x")).select("id", "x.check", "x.critical")
    return each.groupBy("check", "critical").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def parsed(names: DataFrame, grammar: Mapping[str, Sequence[str]]) -> DataFrame:
    """The names with ``segments`` (kind, text): from left to right the longest word of the grammar, or one unknown token.

    ``grammar`` has the words of each kind of segment, of one or more tokens; a word in several kinds is of the first.
    """
    kinds: dict[str, str] = {}
    for kind, words in grammar.items():
        for w in words:
            kinds.setdefault(w, kind)
    longest = sorted(kinds, key=lambda w: (-w.count("_"), -len(w), w))
    pattern = "(?:^|_)(" + "|".join([*longest, "[^_]+"]) + ")(?=_|$)"
    table = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    words = F.regexp_extract_all(F.lower(F.trim(F.col("id"))), F.lit(pattern), F.lit(1))
    return names.withColumn("segments", F.transform(words, lambda w: F.struct(F.coalesce(F.try_element_at(table, w), F.lit("unknown")).alias("kind"), w.alias("text"))))


def out_of_order(segments: Column, order: Sequence[str]) -> Column:
    """The first segment whose kind comes before the one it follows, in ``order``; kinds that aren't listed count for nothing."""
    place = lambda s: F.array_position(F.array(*map(F.lit, order)), s["kind"])
    ranked = F.filter(segments, lambda s: place(s) > 0)
    wrong = F.filter(ranked, lambda s, k: place(s) < F.coalesce(place(F.get(ranked, k - 1)), F.lit(0)))
    return F.get(F.transform(wrong, lambda s: s["text"]), F.lit(0))
