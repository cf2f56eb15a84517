"""Searches of a tree of ids against comparisons of all pairs."""

import random

import numpy as np
import pytest

from loomgraph.operators import fuzzy, subsequences


@pytest.mark.parametrize("longest", [12, 150])
def test_search_equals_all_pairs(longest, monkeypatch):
    monkeypatch.setattr(subsequences, "OPEN", 3000)  # batches are split
    rng = random.Random(longest)
    text = lambda: "".join(rng.choices("abé/_", k=rng.randint(1, longest)))
    ids = sorted({text() for _ in range(150)} | {"a", "ab", "abab"})
    names = [text() for _ in range(30)] + [x + "b" for x in ids[:20]]
    tree = subsequences.Tree(ids)
    for bounds in (np.full(len(names), 0.0), np.full(len(names), 70.0)):
        found = {(names[a], ids[b]) for x, y in subsequences.search(tree, names, bounds, 3, fuzzy.PARTS_FROM, fuzzy.PART_WEIGHT) for a, b in zip(x, y)}
        for name in names:
            scored = sorted((-round(fuzzy.weighted_ratio(name, i), 6), i) for i in ids)[:3]
            assert {i for x, i in scored if -x >= bounds[0]} <= {i for n, i in found if n == name}


def test_few_pairs_are_scored(spark, monkeypatch):
    ids = [f"small/brand_{k % 25}/{('hot', 'cold', 'blue')[k % 3]}_{('bolt', 'ring')[k % 2]}_{k}" for k in range(3000)]
    known = spark.createDataFrame([(i, "g") for i in ids], "id string, same string")
    asked = spark.createDataFrame([(i + "/none", "g") for i in ids[::50]] + [(i.replace("_", "-"), "g") for i in ids[1::50]], "name string, same string")
    met = []
    original = fuzzy.scored
    monkeypatch.setattr(fuzzy, "scored", lambda pairs, least: (met.append(pairs.count()), original(pairs, least))[1])
    assert fuzzy.nearest(asked, known, 3, 50).count() == 3 * 120
    assert sum(met) < 120 * 40  # of 360,000
