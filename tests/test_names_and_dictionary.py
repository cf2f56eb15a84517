"""Names that pass and fail each check, parsed names, and dictionary files with nested and inherited attributes."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import name_checks
from loomgraph.sources import dictionary

NAMES = "id string, description string, documentation string, unit string, source_path string, label string"
# Of each check: names that fail it, and names close to them that don't.
CASES = {
    "generic_noun": (["data", "raw_value"], ["ion_data", "data_raw"]),
    "tautology": (["position_of_x_position", "major_radius_of_minor_radius"], ["position_of_x", "width_of_radius"]),
    "spectral_suffix": (["b_fourier_modes", "current_harmonics"], ["fourier_modes_of_b", "harmonics_b"]),
    "abbreviation": (["max_density", "ec_power", "flux_norm"], ["maximum_density", "maxima", "electron"]),
    "spectral_description": (["flux"], ["flux_amplitude"]),
    "representation": (["b_coefficients", "b_spline_x", "b_coefficient_on_ggd"], ["basis_b", "b_ggdx"]),
    "due_to_event": (["flux_due_to_disruption", "flux_due_to_flat_top_end"], ["flux_due_to_diffusion", "disruption"]),
    "due_to_adjective": (["heat_due_to_ohmic"], ["heat_due_to_ohmic_dissipation"]),
    "bare_field": (["toroidal_field", "field"], ["magnetic_field", "current_of_field_coil_field_coil", "use_exact_field", "vacuum_toroidal_field_function"]),
    "coordinate_of_vector": (["vertical_coordinate_of_surface_normal"], ["vertical_component_of_surface_normal", "vertical_coordinate_of_wall"]),
    "aggregator_order": (["temperature_volume_averaged"], ["volume_averaged_temperature", "_line_averaged"[1:]]),
    "named_feature": (["flux_at_magnetic_axis", "flux_at_separatrix_low"], ["flux_of_magnetic_axis", "flux_at_separatrices"]),
    "diamagnetic_component": (["diamagnetic_component_of_velocity"], ["diamagnetic_drift_velocity"]),
    "part_prefix": (["phase_of_wave", "modulus_of_b"], ["wave_phase", "phases_of_b"]),
    "mode_number": (["power_per_toroidal_mode_number"], ["power_per_toroidal_mode"]),
    "cumulative": (["integrated_power", "running_mean"], ["line_averaged_power", "time_of_integrated_power", "integrated_power_exact_flag"]),
    "ratio_form": (["ion_to_electron_ratio"], ["ratio_of_ion_to_electron", "aspect_ratio"]),
    "profile_suffix": (["pressure_profile"], ["peakedness_profile", "profile_pressure"]),
    "adjacent_duplicate": (["magnetic_magnetic_field"], ["deuterium_deuterium_rate", "magnetic_field_at_magnetic_axis"]),
    "repeated_token": (["flux_x_flux"], ["beam_beam_rate", "width_of_width_b"[:8]]),
    "length": (["x" * 71], ["x" * 70]),
    "instrument_observable": (["stokes_vector_of_polarimeter"], ["stokes_vector", "angle_of_polarimeter"]),
    "provenance_verb": (["measured_flux", "flux_fitted"], ["measurement", "fit_of_flux"]),
    "british_spelling": (["normalised_flux", "fibre"], ["normalized_flux", "fibres"]),
    "reference_suffix": (["flux_reference", "flux_reference_waveform"], ["reference_flux", "reference"]),
    "placed_process": (["heat_due_to_waves_at_edge", "heat_due_to_waves_for_ions"], ["heat_at_edge_due_to_waves", "heat_due_to_waves"]),
    "position_redundancy": (["flux_at_wall_surface", "on_wall_surface"], ["flux_at_wall"]),
}


def issues(spark, rows, **columns):
    frame = spark.createDataFrame([(r, columns.get("description"), columns.get("documentation"), columns.get("unit"), columns.get("source_path"), columns.get("label")) for r in rows], NAMES)
    return {r["id"]: {x["check"] for x in r["issues"]} for r in name_checks.checked(frame).collect()}


def test_every_check_has_names_that_pass_and_fail(spark):
    bad, good = [n for b, _ in CASES.values() for n in b], [n for _, g in CASES.values() for n in g]
    found = issues(spark, [*bad, *good], description="Fourier mode of it")
    for check, (fail, passed) in CASES.items():
        assert all(check in found[n] for n in fail), check
        assert not any(check in found[n] for n in passed), check
    assert set(CASES) | {"density_unit", "convention_mention", "rate_description", "storage_shape", "undefined_symbol"} == set(name_checks.CHECKS)


@pytest.mark.parametrize(
    "check, column, cases",
    [
        ("rate_description", "description", [("flux", "Rate of Change of it", True), ("heat_flux", "heat per unit time", False), ("heat", "heat per unit time", True), ("heat_flux", "its time derivative", True),
            ("tendency_of_heat", "rate of change", False), ("instant_change_of_heat", "heat", True), ("instant_change_of_heat", None, False), ("heat", "signed", False)]),
        ("storage_shape", "description", [("a", "a 2D array", True), ("a", "3d", True), ("a", "2D poloidal plane", False), ("a", "4D", False), ("a", "x2D", False), ("a", None, False)]),
        ("undefined_symbol", "documentation", [("a", "$q$ grows.", True), ("a", "$q$ is large.", False), ("a", "Here $q$. It grows. This is it.", False), ("a", "Here $q$. It. Grows. This is it.", True),
            ("a", "It is. $q$ grows.", False), ("a", "$q$ (in eV).", False), ("a", "$2\\pi$ and $10^{21}$ and $2.5\\times10^{19}$ and $\\mu_0/2$ and $+$.", False), ("a", "$$q$$ grows.", False), ("a", "$ q $ grows!", True),
            ("a", "This grows.", False), ("a", "cost: $", False), ("a", "$q$ isolates.", True), ("a", "", False), ("a", None, False), ("a", "$p$ is set. One. Two. Three. $q$ grows.", True)]),
    ],
)
def test_checks_of_prose(spark, check, column, cases):
    for name, text, fails in cases:
        assert (check in issues(spark, [name], **{column: text})[name]) == fails, (name, text)


def test_checks_on_other_columns(spark):
    assert "provenance_verb" not in issues(spark, ["measured_flux"], source_path="a/flux_measured/b")["measured_flux"]
    assert "british_spelling" in issues(spark, ["flux"], description="Centre of it")["flux"]
    assert "density_unit" in issues(spark, ["ion_density"], unit="kg")["ion_density"]
    for unit in ("m^-3", "1", None):
        assert "density_unit" not in issues(spark, ["ion_density"], unit=unit)["ion_density"]
    assert issues(spark, ["flux_on_ggd"], source_path="a/grids_ggd/x")["flux_on_ggd"] == {"representation"}
    assert issues(spark, ["flux"], label="psi_like", documentation="cocos 11") == {"flux": set()}
    assert issues(spark, ["flux", None], label="psi_like")["flux"] == {"convention_mention"}
    counts = name_checks.issue_counts(name_checks.checked(spark.createDataFrame([("max_b",), ("max_a",), ("c",)], "id string"))).collect()
    assert [tuple(r) for r in counts] == [("abbreviation", True, 2, "max_a", "max_b")]


def test_parsed_names(spark):
    grammar = {"axis": ["radial", "major_radius"], "base": ["radius", "magnetic_field", "field"], "place": ["at_magnetic_axis"]}
    rows = spark.createDataFrame([("radial_magnetic_field_at_magnetic_axis",), ("Major_radius_x_field",), ("radially",), ("field_radial",), (None,)], "id string")
    found = {r["id"]: r for r in name_checks.parsed(rows, grammar).withColumn("wrong", name_checks.out_of_order(F.col("segments"), ["axis", "base", "place"])).collect()}
    assert [tuple(s) for s in found["radial_magnetic_field_at_magnetic_axis"]["segments"]] == [("axis", "radial"), ("base", "magnetic_field"), ("place", "at_magnetic_axis")]
    assert [tuple(s) for s in found["Major_radius_x_field"]["segments"]] == [("axis", "major_radius"), ("unknown", "x"), ("base", "field")]
    assert [tuple(s) for s in found["radially"]["segments"]] == [("unknown", "radially")]
    assert found["field_radial"]["wrong"] == "radial" and found["radial_magnetic_field_at_magnetic_axis"]["wrong"] is None and found[None]["segments"] is None


XML = """<root><IDS name="eq" documentation="Equilibria">
  <field name="slice" documentation="One time." lifecycle_status="alpha" units="s"><group><field name="psi" units="Wb" documentation="Flux?" coordinate1="time" coordinate2="1...N" doc_identifier="a.xml"/>
    <field name="r" units="m^dimension" coordinate1="time" min="0" max="9"/><field name="psi_error_upper" units="Wb"/></group>
    <field name="odd" units="units given by coordinate_system(:)/coordinate(theta)/units" introduced_after="3.1"/><field name="gone" units="units given by process(x)"/></field>
  <field name="code"><field name="name"/></field><coordinate name="rho" documentation="Norm" units="1"/></IDS><IDS name="empty"/></root>"""


def test_extractors(spark):
    texts = spark.createDataFrame([("f", XML), ("none", None), ("bad", "<a><b></a>"), ("other", "<x/>")], "file string, value string")
    found = dictionary.elements(texts)
    rows = {r["path"]: r for r in dictionary.extracted(found).collect()}
    assert set(rows) == {"eq/slice", "eq/slice/psi", "eq/slice/r", "eq/slice/odd", "eq/slice/gone", "eq/rho"}
    psi, r, odd, gone = (rows[f"eq/slice/{n}"] for n in ("psi", "r", "odd", "gone"))
    assert psi["documentation"] == "Flux? Within eq IDS: Equilibria. Within slice container: One time." and psi["coordinates"] == ["time", "1...N"] and psi["identifier_schema"] == "a.xml" and psi["units"] == "Wb"
    assert r["documentation"] == "One time. Within eq IDS: Equilibria." and r["units"] == "m" and (r["min_value"], r["max_value"]) == ("0", "9") and r["level"] == 3
    assert odd["units"] == "rad" and odd["introduced_after_version"] == "3.1" and odd["inherited_status"] == "alpha" and gone["units"] == "" and gone["units_required"]
    assert rows["eq/rho"]["units_required"] is False and rows["eq/slice"]["is_leaf"] is False
    info = {r["grp"]: r for r in dictionary.group_info(found).collect()}
    assert info["eq"]["max_depth"] == 3 and info["eq"]["leaf_count"] == 7 and info["eq"]["coverage"] == pytest.approx(4 / 10) and info["empty"]["leaf_count"] == 1
    assert [tuple(r) for r in dictionary.coordinate_systems(found).collect()] == [("f", "eq", "rho", "Norm", "1")]
    own = dictionary.extractors() | {"mine": {"units": F.lit("x"), "n": F.size("above")}}
    mine = dictionary.extracted(found, own, errors=True).where("name = 'psi_error_upper'").first()
    assert (mine["units"], mine["n"]) == ("x", 2)
    assert dictionary.dictionary_jsons(found).where("path = 'eq/slice/r'").first()["value"].startswith('{"path":"eq/slice/r"')


def test_semantic_groups(spark):
    fields = spark.createDataFrame([("g", "g/a/x", "T.m", []), ("g", "g/b", "T.m", ["t"]), ("g", "g/c", "1", ["t", "u"]), ("g", "g/d", None, ["t", "u"]), ("g", "g/e/f", "", []), ("g", "g/e/h", "mixed", []), ("g", "g/k", "", []), ("h", "h/k", "m", [])], "grp string, path string, units string, coordinates array<string>")
    found = {r["key"]: (r["n"], r["paths"]) for r in dictionary.semantic_groups(fields, 1).collect()}
    assert found == {"units_T_m": (2, ["g/a/x"]), "coordinates_t_u": (2, ["g/c"]), "structure_e": (2, ["g/e/f"])}


def test_semantic_groups_list_all_paths(spark):
    fields = spark.range(2500).select(F.lit("g").alias("grp"), F.format_string("g/f%05d", "id").alias("path"), F.lit("T").alias("units"), F.array().cast("array<string>").alias("coordinates"))
    found = dictionary.semantic_groups(fields).first()
    assert found["n"] == 2500 and found["paths"] == [f"g/f{k:05d}" for k in range(2500)]


def test_files_in_pieces(spark):
    cut = [XML[k : k + 7] for k in range(0, len(XML), 7)]
    pieces = [("f", k, x) for k, x in enumerate(cut)] + [("bad", 0, "<root><IDS name='g'/>"), ("bad", 1, "<b></root>"), ("bad", 2, "<c/>"), ("none", 0, None), ("g", 0, "<root>"), ("g", 1, None), ("g", 2, "<IDS name='é'/></root>")]
    found = dictionary.elements(spark.createDataFrame(pieces[::-1], "file string, place int, value string"))
    whole = dictionary.elements(spark.createDataFrame([("f", XML), ("g", "<root><IDS name='é'/></root>")], "file string, value string"))
    rows = [sorted(map(str, df.collect())) for df in (found, whole)]
    assert rows[0] == rows[1] and len(rows[0]) == 12


def test_large_files_in_bounded_batches():
    text = "<root><IDS name='g'>" + "".join(f"<field name='f{k}' units='m'/>" for k in range(20_000)) + "</IDS></root>"
    rows = dictionary.named_elements("f", iter([text]), "IDS")
    first = next(rows)
    assert first[:5] == ("f", "g", "field", "g/f0", "f0") and first[7:] == ([("name", "f0"), ("units", "m")], [{"name": "g", "attributes": [("name", "g")]}])
    assert sum(1 for _ in rows) == 20_000  # the group itself comes last
