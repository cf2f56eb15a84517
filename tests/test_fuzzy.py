"""Nearest names against plain versions that compare all."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.operators import fuzzy

WORD = st.text("abc _é", max_size=12)


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(WORD, WORD)
def test_common_subsequence(a, b):
    assert fuzzy.common(a, b) == plain_common(a, b)


@settings(max_examples=200, deadline=None)
@given(WORD, WORD)
def test_ratios_are_symmetric_shares(a, b):
    for r in (fuzzy.ratio, fuzzy.part_ratio, fuzzy.token_ratio, fuzzy.weighted_ratio):
        assert r(a, b) == pytest.approx(r(b, a)) and 0 <= r(a, b) <= 100


def test_known_ratios():
    assert fuzzy.ratio("kitten", "sitting") == pytest.approx(200 * 4 / 13)
    assert fuzzy.part_ratio("core", "the core of it") == 100
    assert fuzzy.token_ratio("profiles core", "core profiles") == 100
    assert fuzzy.token_ratio("core", "core profiles") == 100
    assert fuzzy.weighted_ratio("abcd", "xxabcdxxx") == pytest.approx(90)
    assert fuzzy.weighted_ratio("abcd", "x" * 40 + "abcd") == pytest.approx(60)
    assert fuzzy.weighted_ratio("", "a") == 0


def plain_nearest(asked, known, k, least):
    out = set()
    for name, same in set(asked):
        if name is None or same is None:
            continue
        own = {i for i, s in known if s == same and i is not None}
        best = sorted((-x, i) for i in own if (x := round(fuzzy.weighted_ratio(name, i), 6)) >= least)[:k]
        out |= {(name, same, i, -x, n + 1) for n, (x, i) in enumerate(best)}
    return out


def test_nearest_equals_all_against_all(spark):
    rng = random.Random(3)
    parts = ["core", "profiles", "electron", "temperature", "grid", "psi", "rho", "tor", "norm", "time", "slice", "x"]
    path = lambda n: "/".join("_".join(rng.choices(parts, k=rng.randint(1, 2))) for _ in range(n))
    known = [(path(rng.randint(1, 6)), f"g{rng.randint(0, 2)}") for _ in range(250)] + [("two words", "g0"), ("", "g0"), ("a", "g1"), (None, "g1"), ("z", None)]
    asked = []
    for i, s in rng.sample(known[:250], 40):
        cut = rng.randint(0, len(i) - 1)
        asked += [(i[:cut] + rng.choice("_/qx") + i[cut + rng.randint(0, 2) :], s), (i, s), (i[: len(i) // 2], s)]
    asked += [("words two", "g0"), ("", "g0"), ("b", "g1"), (None, "g0"), ("core", None), ("core/psi", "none"), ("core profiles psi", "g2"), ("qqqqqqqq", "g0")]
    found = fuzzy.nearest(spark.createDataFrame(asked, "name string, same string"), spark.createDataFrame(known, "id string, same string"), 3, 50)
    assert {tuple(r) for r in found.select("name", "same", "id", "score", "place").collect()} == plain_nearest(asked, known, 3, 50)


def test_only_names_without_a_bound_meet_their_group(spark, monkeypatch):
    known = spark.createDataFrame([(f"equilibrium/slice/field_{k}_{k * 37 % 101}", "g") for k in range(400)], "id string, same string")
    asked = spark.createDataFrame([(f"equilibrium/slice/field_{k}_{k * 37 % 101}x", "g") for k in range(20)], "name string, same string")
    met = []
    original = fuzzy.scored
    monkeypatch.setattr(fuzzy, "scored", lambda pairs, least: (met.append(pairs.count()), original(pairs, least))[1])
    assert fuzzy.nearest(asked, known, 1, 50).count() == 20
    assert met[1] < 20 * 400 / 4


def test_fewest_edits_equals_all_against_all(spark):
    rng = random.Random(4)
    known = ["".join(rng.choices("abcde ", k=rng.randint(0, 9))) for _ in range(120)] + ["hot bolt", "hot nut", None]
    asked = ["".join(rng.choices("abcde ", k=rng.randint(0, 9))) for _ in range(40)] + ["hot bolts", "hot", "", None, "zzzzzzzzzzzz"]
    edits = spark.createDataFrame([(a, b) for a in asked if a is not None for b in set(known) if b is not None], "q string, id string").withColumn("d", F.levenshtein("q", "id"))
    base = lambda x: x.split(" ")[0]
    want = {}
    for r in edits.collect():
        want[r["q"]] = min(want.get(r["q"], (99, True, "")), (r["d"], base(r["q"]) != base(r["id"]), r["id"]))
    tie = F.substring_index("q", " ", 1) != F.substring_index("id", " ", 1)
    found = fuzzy.fewest_edits(spark.createDataFrame([(a,) for a in asked], "q string"), spark.createDataFrame([(i,) for i in known], "id string"), tie, "q")
    assert {r["q"]: (r["edits"], r["id"]) for r in found.collect()} == {q: (d, i) for q, (d, _, i) in want.items()}


def test_containing_equals_all_against_all(spark):
    rng = random.Random(5)
    known = ["".join(rng.choices("abc", k=rng.randint(0, 8))) for _ in range(80)] + [None]
    asked = ["".join(rng.choices("abcz", k=rng.randint(0, 4))) for _ in range(60)] + ["", None]
    found = fuzzy.containing(spark.createDataFrame([(a,) for a in asked], "name string"), spark.createDataFrame([(i,) for i in known], "id string"))
    want = {(a, i) for a in asked if a is not None for i in known if i is not None and a in i}
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)
