"""Landed files, extraction and units on small examples."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import extraction, units
from loomgraph.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_dictionary_files_flatten(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<root><IDS name="eq"><field name="time" data_type="FLT" units="s"/><field name="slice"><field name="psi" units="Wb" documentation="flux"/></field></IDS></root>')
    rows = {r["path"]: r for r in files.dictionary_paths(files.whole_files(spark, str(tmp_path))).collect()}
    assert set(rows) == {"eq", "eq/time", "eq/slice", "eq/slice/psi"}
    assert rows["eq/slice/psi"]["parent_path"] == "eq/slice" and rows["eq/slice/psi"]["is_leaf"] and not rows["eq/slice"]["is_leaf"]


def test_notebooks_and_equilibria(spark, tmp_path):
    (tmp_path / "nb").mkdir()
    (tmp_path / "nb" / "x.ipynb").write_text(json.dumps({"cells": [{"cell_type": "markdown", "source": ["# a\n", "b"]}, {"cell_type": "code", "source": ["x = 1"]}]}))
    cells = files.notebook_cells(files.whole_files(spark, str(tmp_path / "nb"))).orderBy("cell").collect()
    assert [(r["kind"], r["text"]) for r in cells] == [("markdown", "# a\nb"), ("code", "x = 1")]
    (tmp_path / "eq").mkdir()
    number = lambda *v: "".join(f"{x:16.9E}" for x in v)
    (tmp_path / "eq" / "g1").write_text("\n".join(["EFIT 0 65 65", number(1, 2, 3, 4, 5), number(1, 0, -0.25, 0.5, -2.5), number(1.5e6, -0.25, 0, 1, 0)]))
    r = files.equilibria(files.whole_files(spark, str(tmp_path / "eq"))).first()
    assert (r["psi_axis"], r["psi_edge"], r["field"], r["current"]) == (-0.25, 0.5, -2.5, 1.5e6)


def test_file_kinds(spark):
    assert one(spark, files.language(F.lit("a/b.F90"))) == "fortran" and one(spark, files.file_kind(F.lit("x.ipynb"))) == "notebook"
    assert one(spark, files.file_kind(F.lit("README"))) == "other"
    assert one(spark, files.markup_to_html(F.lit("---+ Title\nsome *bold* [[a][b]]"))) == '<h1>Title</h1>\nsome <b>bold</b> <a href="a">b</a>'


def test_extraction(spark):
    text = F.lit(r"See \\tree::ip:x and \TREE::IP:X; EFIT/Q95 and NOT/THIS; 5 keV, 2 T. COCOS 11 with positive clockwise current; use numpy, import foo")
    assert one(spark, extraction.tree_paths(text)) == [r"\TREE::IP:X"]
    assert one(spark, extraction.pair_paths(text, ["efit"])) == ["EFIT/Q95"]
    assert one(spark, extraction.units(text)) == ["T", "keV"]
    found = one(spark, extraction.with_context(text, extraction.CONVENTION, 5))
    assert [(r["name"], r["context"]) for r in found] == [("COCOS 11", "2 T. COCOS 11 with")]
    assert one(spark, extraction.tool_mentions(text, ["NumPy", "num"], ["import foo"])) == ["NumPy", "import foo"]


def test_units(spark):
    norm = lambda u: one(spark, units.normalise(F.lit(u)))
    assert [norm(u) for u in ("Ohm", "A/m^2", "m.s^-1", "m/s", "mixed", "florp")] == ["ohm", "A.m^-2", "m.s^-1", "m.s^-1", None, None]
    kind = lambda a, b: one(spark, units.change_kind(F.lit(a), F.lit(b)))
    assert [kind("m/s", "m.s^-1"), kind("as_parent", "m"), kind("J.m^-3", "Pa"), kind("W", "Wb")] == ["cosmetic", "sentinel_resolved", "dim_equivalent", "dim_incompatible"]
    assert one(spark, units.converted(F.lit(2.0), F.lit("keV"), F.lit("eV"))) == pytest.approx(2000)
    assert one(spark, units.converted(F.lit(2.0), F.lit("keV"), F.lit("m"))) is None
