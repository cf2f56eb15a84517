"""Classes and pairs of close vectors against a loop over all pairs."""

import numpy as np
import pytest

from loomgraph.operators import duplicates

ROWS = "id string, v array<double>, domain string, unit string, key long, node string, class string"


@pytest.mark.parametrize("block", [512, 5])
def test_close_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(duplicates, "BLOCK", block)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 5))
    rows = [(f"n{i:03d}", (centres[i % 6] + rng.normal(size=5) * 0.25).tolist(), f"d{i % 2}", "m" if i % 3 else None) for i in range(90)]
    rows += [(f"c{i:03d}", rows[1][1], "d1", "m") for i in range(12)] + [("z", [0.0] * 5, "d1", "m"), ("y", None, "d1", "m"), (None, [1.0] * 5, "d1", "m")]
    frame = spark.createDataFrame([(*r, 0, "x", "y") for r in rows], ROWS)
    fine = [(i, np.array(v) / np.linalg.norm(v), d) for i, v, d, u in rows if i and v and any(v) and u]
    links = {(a, b) for a, v, d in fine for b, w, e in fine if a != b and d == e and v @ w > 0.9}
    pairs = duplicates.close_pairs(frame, "id", "v", ("domain", "unit"), 0.9).collect()
    assert {(r["a"], r["b"]) for r in pairs} == {(a, b) for a, b in links if a < b} and len(pairs) == len(links) // 2
    label = {i: i for i, _, _ in fine}
    while True:
        lower = {i: min([label[i]] + [label[b] for a, b in links if a == i]) for i in label}
        if lower == label:
            break
        label = lower
    found = duplicates.close_classes(frame, "id", "v", ("domain", "unit"), 0.9).collect()
    assert {r["id"]: r["class"] for r in found} == label and len(found) == len(label)
    assert {r["id"]: r["n_links"] for r in found} == {i: sum(a == i for a, _ in links) for i in label}
    assert duplicates.close_classes(frame.where("false"), "id", "v", ("domain", "unit"), 0.9).collect() == []
