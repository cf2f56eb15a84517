"""Lookup, migration, retrieval, review, audit and budget operators: null rows, ties, empty tables, plain versions in Python."""

import builtins
import importlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomgraph.operators import audits, components, fulltext, fusion, lookup, migration, ranking, retrieval, reviews, vectors
from loomgraph.sources.html import PageText
from loomgraph.streaming import budgets


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


NODES = "id string, grp string, parent string, name string, dtype string, unit string, introduced string, deprecated string"


def nodes(spark, data=()):
    full = [(i, i and i.split("/")[0], i and i.rsplit("/", 1)[0], i and i.rsplit("/", 1)[-1], "FLT_1D", "m", came, gone) for i, came, gone in data]
    return spark.createDataFrame(full, NODES)


def test_rank_of_null_values_and_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0), (None, 3.0)], "g string, v double")
    assert rows(ranking.percentile_rank(df, "v", ["g"]), "g", "v", "percentile") == sorted([("a", 1.0, 0.5), ("a", None, None), (None, 2.0, 0.0), (None, 3.0, 1.0)], key=str)
    assert ranking.percentile_rank(df.limit(0), "v", ["g"]).count() == 0


def test_epochs_of_null_fingerprints(spark):
    df = spark.createDataFrame([("g", i, f) for i, f in enumerate(["x", None, None, "x"])], "g string, i long, f string")
    out = ranking.epochs(df, ["g"], [F.col("i")], F.col("f"), "i")
    assert rows(out, "epoch", "fingerprint", "first_place", "last_place") == sorted([(1, "x", 0, 0), (2, None, 1, 2), (3, "x", 3, 3)], key=str)


@pytest.mark.parametrize("at_once", [4096, 7])
def test_nearest_rows_match_loops(spark, monkeypatch, at_once):
    monkeypatch.setattr(vectors, "QUERIES_AT_ONCE", at_once)
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)] + [(None, [1.0] * 4), (500, None), (501, [1.0, 2.0]), (502, [3.0, 6.0]), (503, [0.0] * 4)]
    df = spark.createDataFrame(data, "id long, v array<double>").repartition(5)
    asked = df.where("id % 10 = 0 or id > 500")
    got = {}
    for r in vectors.top_k(df, asked, "id", "v", 3).collect():
        got.setdefault(r["query"], []).append((r["place"], r["id"], round(r["similarity"], 9)))
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    good = [(i, v) for i, v in data if i is not None and v is not None]
    for q, v in good:
        if q % 10 == 0 or q > 500:
            best = sorted((-round(float(unit(v) @ unit(u)), 9), i) for i, u in good if i != q and len(u) == len(v))[:3]
            assert [(round(s, 6)) for _, _, s in sorted(got.get(q, []))] == [round(-s, 6) for s, _ in best]
            assert {i for _, i, s in got.get(q, []) if round(s, 6) > round(-best[-1][0], 6)} == {i for s, i in best if round(-s, 6) > round(-best[-1][0], 6)}
    assert vectors.top_k(df, asked.limit(0), "id", "v", 3).count() == 0


def test_places_without_a_cut_are_those_of_a_sort(spark):
    stream = spark.createDataFrame([(i, float(i * 7 % 50)) for i in range(300)], "id long, score double").repartition(6)
    got = {r["id"]: r["place"] for r in fusion.ranked(stream, "id").collect()}
    want = sorted(((i, float(i * 7 % 50)) for i in range(300)), key=lambda x: (-x[1], x[0]))
    assert [got[i] for i, _ in want] == list(range(300))


def test_themes_count_documents_once_and_prune(spark):
    docs = spark.createDataFrame([("a b a b c",), ("a b c",), (None,), ("",), ("x y",), ("x y",)], "t string")
    out = fulltext.themes(docs, "t")
    assert rows(out, "theme", "n", "n_docs") == sorted([("a b", 3, 2), ("b c", 2, 2), ("a b c", 2, 2), ("x y", 2, 2)], key=str)
    top = fulltext.different_themes(out, 2).orderBy("place").collect()
    assert [r["theme"] for r in top] == ["a b", "b c"]  # the triple repeats two of three words
    assert fulltext.themes(docs.limit(0), "t").count() == 0


def test_pages_with_omitted_end_tags():
    def text(page):
        parser = PageText()
        parser.feed(page)
        parser.close()
        return parser.result()

    assert text("<html><head><title>x</title><body><p>Hello")[0] == "Hello"
    assert text("<body><noscript>no<article><h1>A</h1>yes</article>") == ("A\nyes", {"A": "yes"})
    assert text("<script>var x</script><template>t</template><p>kept</p>")[0] == "kept"


def test_a_missing_library_leaves_the_other_queries(monkeypatch):
    real = importlib.import_module

    def broken(name, *rest):
        if name == "loomgraph.llm.queries":
            raise ModuleNotFoundError("No module named 'xxhash'")
        return real(name, *rest)

    monkeypatch.setattr(importlib, "import_module", broken)
    monkeypatch.setattr(builtins, "__import__", builtins.__import__)
    assert "migration_guide" in __spark_entry__.queries() and not any(n.startswith("op1_") for n in __spark_entry__.queries())


def test_paths_are_checked_once_with_hints(spark):
    known = nodes(spark, [("eq/a/psi", None, None), ("eq/a/old", None, "4.0.0"), ("eq/a/new", "4.0.0", None), ("mag/b", None, None), (None, None, None)])
    edges = spark.createDataFrame([("eq/a/old", "eq/a/new"), (None, "x")], "src string, dst string")
    asked = spark.createDataFrame([("eq/a/psi",), ("eq/a/psi",), ("eq/a/old",), ("eq/a/pso",), ("eqq/a/psi",), ("zzzzzz",), (None,)], "path string")
    out = {r["path"]: r for r in lookup.check_paths(asked, known, edges, "4.1.0").collect()}
    assert len(out) == 5 and out["eq/a/psi"]["found"] and not out["eq/a/old"]["found"]
    assert (out["eq/a/old"]["renamed_to"], out["eq/a/old"]["rename_version"]) == ("eq/a/new", "4.0.0")
    assert out["eq/a/pso"]["suggestions"][0] == "eq/a/psi" and out["eqq/a/psi"]["suggestions"][0] == "eq/a/psi" and out["zzzzzz"]["suggestions"] == []
    assert lookup.check_paths(asked, known, edges).where("found").count() == 2
    assert lookup.check_paths(asked.limit(0), known, edges).count() == 0


def test_prefixes_and_references_join_by_keys(spark):
    known = nodes(spark, [("eq/a", None, None), ("eq/a/psi", None, None), ("eq/ab", None, None), ("mag/PSI", None, None)])
    listed = lookup.list_paths(known, spark.createDataFrame([("eq/a",), ("no",)], "prefix string"), 1)
    assert rows(listed) == [("eq/a", 2, ["eq/a"]), ("no", 0, [])]
    refs = spark.createDataFrame([("eq/a",), ("a/psi",), ("x/psi",), ("nothing",), (None,)], "ref string")
    assert rows(lookup.resolve_references(refs, known)) == sorted([("eq/a", "eq/a", "exact"), ("a/psi", "eq/a/psi", "suffix"), ("x/psi", "eq/a/psi", "last_segment")], key=str)


def test_lineages_between_versions_end_in_cycles(spark):
    known = nodes(spark, [("a", "3.0.0", "4.0.0"), ("b", "3.1.0", "4.0.0"), ("c", "4.0.0", None), ("d", "9.0.0", None)])
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "a")], "src string, dst string")
    out = migration.lineages_between(edges, known, "3.5.0", "4.1.0")
    assert ("a", "c", 2) in rows(out, "src", "dst", "hops") and not [r for r in rows(out, "dst") if r[0] in ("a", "b", "d")]
    assert migration.lineages_between(edges.limit(0), known, "3.5.0", "4.1.0").count() == 0


def test_guide_of_empty_tables(spark):
    changes = spark.createDataFrame([], "id long, node_id string, version string, change_type string, level string, semantic_type string, old_value string, new_value string")
    empty = nodes(spark).withColumns({c: F.lit(None).cast("string") for c in ("category", "label", "expression", "label_source")})
    assert migration.guide(changes, empty, spark.createDataFrame([], "src string, dst string"), "1.0", "2.0", ("quantity",)).count() == 0
    assert migration.history(changes, empty).count() == 0


def test_reservations_match_a_loop(spark):
    rng = random.Random(3)
    data = [(str(rng.randint(0, 5)), i, rng.choice(["a", "b", None]), rng.choice([None, *[float(rng.randint(0, 30)) for _ in range(5)]])) for i in range(400)]
    got = {r["at"]: r["granted"] for r in budgets.reserved(spark.createDataFrame(data, "run string, at long, phase string, amount double").repartition(7), 300.0, {"a": 60.0}).collect()}
    left, used = {}, {}
    for run, at, phase, amount in data:
        spent = used.get((run, phase), 0.0)
        ok = amount is not None and (phase != "a" or spent + amount <= 90) and left.get(run, 300.0) >= amount
        if ok:
            left[run], used[run, phase] = left.get(run, 300.0) - amount, spent + amount
        assert got[at] == ok
    assert budgets.reserved(spark.createDataFrame([], "run string, at long, phase string, amount double"), 1.0, {}).count() == 0


def test_batches_are_halved_until_they_fit(spark):
    rng = random.Random(8)
    items = [(b, i, rng.randint(1, 400)) for b in ("x", "y", "z") for i in range(rng.randint(1, 40))] + [("big", 0, 5000)]
    got = {}
    for r in reviews.token_batches(spark.createDataFrame(items, "batch string, at long, tokens long"), 700).collect():
        got.setdefault((r["batch"], r["part"]), []).append(r["at"])

    def halve(ats, sizes):
        if len(ats) == 1 or sum(sizes[a] for a in ats) <= 700:
            return [ats]
        h = len(ats) // 2
        return halve(ats[:h], sizes) + halve(ats[h:], sizes)

    for batch in ("x", "y", "z", "big"):
        sizes = {i: n for b, i, n in items if b == batch}
        assert sorted(sorted(v) for (b, _), v in got.items() if b == batch) == sorted(halve(sorted(sizes), sizes))


def test_segments_are_whole_and_small(spark):
    texts = ["", "a\n" * 30, "x" * 95 + "\nshort\n", "line one\nline two\n\nend", "é" * 21, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", budgets.segments(F.col("t"), 10).alias("s"))
    for r in df.collect():
        if r["t"] is not None:
            assert "".join(r["s"]) == r["t"] and all(0 < len(x) <= 10 for x in r["s"])


def test_vectors_of_segments_are_averaged(spark):
    rows = spark.createDataFrame([(1, "aa\nbbbb\n"), (2, "x"), (3, None), (4, "")], "id long, text string")
    vector = lambda t: F.array(F.length(t).cast("double"), F.lit(1.0))
    plain = {r["id"]: (r["n_segments"], r["embedding"]) for r in budgets.embedded(rows, "id", "text", vector, 5).collect()}
    assert plain == {1: (2, [4.0, 1.0]), 2: (1, [1.0, 1.0]), 3: (0, None), 4: (0, None)}
    long = {r["id"]: r["embedding"] for r in budgets.embedded(rows, "id", "text", vector, 5, by_length=True).collect()}
    assert long[1] == [(3 * 3 + 5 * 5) / 8, 1.0]


def test_watermark_of_nothing_takes_all(spark):
    new, last = budgets.after_watermark(spark.range(5), "id", spark.createDataFrame([], "watermark long"))
    assert new.count() == 5 and last.first()[0] == 4
    new, last = budgets.after_watermark(spark.range(5), "id", spark.createDataFrame([(3,)], "watermark long"))
    assert [r[0] for r in new.collect()] == [4] and last.first()[0] == 4


def test_admission_by_share(spark):
    admit = lambda data: dict(tuple(r) for r in budgets.admitted(spark.createDataFrame(data, "pool string, weight double, spent double, active boolean")).collect())
    assert admit([("a", 1.0, 9.0, True), ("b", 1.0, 1.0, True), ("c", None, 0.0, True)]) == {"a": False, "b": True, "c": False}
    assert admit([("a", 1.0, 9.0, False), ("b", 1.0, 1.0, False)]) == {"a": True, "b": True}
    assert admit([("a", 1.0, 9.0, True), ("b", 1.0, 1.0, False)]) == {"a": True, "b": False}
    assert admit([("a", 1.0, None, True), ("b", 1.0, None, True)]) == {"a": True, "b": True}


def test_canonical_review_of_the_latest_group(spark):
    data = [
        ("q", 1, 1, 0, "quorum_consensus", 4.0), ("q", 1, 2, 1, "single_review", 6.0), ("e", 1, 1, 0, "quorum_consensus", 1.0), ("e", 1, 2, 2, "authoritative_escalation", 9.0),
        ("s", 1, 1, 0, "retry_item", 3.0), ("s", 1, 2, 1, "quorum_consensus", 5.0), ("n", 1, 1, 0, None, 7.0), ("n", 2, 2, 1, "single_review", 8.0), ("m", 1, 1, 0, None, None), ("m", 1, 2, 1, "quorum_consensus", 8.0),
    ]
    out = reviews.canonical_reviews(spark.createDataFrame(data, "id string, grp long, at long, cycle int, method string, score double"))
    assert rows(out) == sorted([("q", 5.0, "quorum_mean"), ("e", 9.0, "escalator"), ("s", 3.0, "single"), ("m", 8.0, "quorum_mean")], key=str)


def test_audits_and_families_of_odd_rows(spark):
    issues = lambda name, doc, unit: spark.range(1).select(audits.audit(F.lit(name), F.lit(doc).cast("string"), F.lit(unit).cast("string"), ["m"]).alias("x")).first()["x"]
    assert issues("flux", None, None) == [] and issues("flux_flux", "flux flux", "q") == ["repeated_token: flux", "unit: q", "tautology: description repeats the name"]
    items = spark.createDataFrame([("a/v/r", "m"), ("a/v/z", "s"), ("a/w/dp_dpsi", None), ("a/w/dv_dpsi", None), ("lone", "m"), ("a/x/r", "m"), (None, None)], "path string, unit string")
    assert rows(audits.families(items)) == sorted([("a/v", "physical_vector", 2, False), ("a/w", "derivative", 2, True)], key=str)
    pairs = audits.synonyms(spark.createDataFrame([(1, "d", "m", [1.0, 0.0]), (2, "d", "m", [1.0, 0.1]), (3, "d", None, [1.0, 0.0]), (4, "d", "m", None)], "id long, domain string, unit string, v array<double>"), "v")
    assert rows(pairs, "a", "b") == [(1, 2)]


def test_components_ignore_null_ends(spark):
    assert components.connected_components(spark.createDataFrame([(1, None), (None, 2)], "src long, dst long")).count() == 0


def test_coverage_counts(spark):
    """Repeated marks count once, null buckets are 'none', totals of empty tables are 0."""
    data = [("a", "g", "q", "FLT", "x", "d", None), ("b", "g", "q", "FLT", "x", None, "s"), ("c", "g", "q", "STRUCTURE", "x", "d", "s"), ("d", "g", "q", None, "x", "d", "s"), ("e", "g", "q", "FLT", "", "d", "s"),
        ("f", "out", "q", "FLT", "x", "d", "s"), ("h", None, "q", "FLT", "x", "d", "s"), ("i", "g", None, "FLT", "x", "d", "s"), ("j", "g", "q", "FLT", None, "d", "s")]
    leaves = reviews.eligible_leaves(spark.createDataFrame(data, "id string, grp string, category string, dtype string, doc string, domain string, kind string"), ("q",), ("out",))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    names = spark.createDataFrame([("new", None, "rule"), ("new", "valid", None)], "status string, validation string, model string")
    got = {(m, b): n for m, b, n in rows(reviews.coverage_counts(leaves, ids("b", "b", "a", None), ids("a", "a", "zz", None), names, "rule"), "measure", "bucket", "n")}
    assert got == {
        ("eligible", ""): 2, ("eligible_with_errors", ""): 2, ("to_compose", ""): 1, ("to_compose_with_errors", ""): 1, ("expected_siblings", ""): 3, ("names", ""): 2, ("error_siblings", ""): 1, ("covered", ""): 2,
        ("eligible_by_category", "q"): 2, ("eligible_by_domain", "d"): 1, ("eligible_by_domain", "none"): 1, ("eligible_by_kind", "s"): 1, ("eligible_by_kind", "none"): 1,
        ("names_by_status", "new"): 2, ("names_by_validation", "none"): 1, ("names_by_validation", "valid"): 1,
    }
    none = reviews.coverage_counts(leaves.where("false"), ids(), ids(), names.where("false"), "rule")
    assert {n for _, b, n in rows(none, "measure", "bucket", "n")} == {0} and none.count() == 8


def test_search_of_empty_streams(spark):
    none = spark.createDataFrame([], "id string, score double")
    some = spark.createDataFrame([("a/value", 0.5), ("a/red", 0.5), (None, 0.9)], "id string, score double").where("id is not null")
    assert retrieval.path_search(none, none, "id", ["x"], 5).count() == 0
    assert rows(retrieval.path_search(some, none, "id", ["red"], 5)) == [("a/red", 0.3045), ("a/value", 0.285)]
    assert retrieval.by_rank(none, "id", 5).count() == 0
    assert rows(retrieval.semantic_and_lexical(some, none, "id", 1)) == [("a/red", 0.6)]


@pytest.mark.parametrize("block", [512, 5])
def test_token_classes_match_all_pairs(spark, monkeypatch, block):
    """Small vocabulary, so tokens are hot; repeated sets, ties, and rows without tokens."""
    from loomgraph.operators import duplicates

    monkeypatch.setattr(duplicates, "BLOCK", block)
    rng = random.Random(11)
    data = [(i, rng.sample("abcdefgh", rng.randint(1, 6))) for i in range(120)] + [(500, []), (501, None), (502, ["zz", None, "zz"])]
    got = {r["id"]: (r["class"], r["n_links"]) for r in duplicates.token_classes(spark.createDataFrame(data, "id long, t array<string>"), "id", F.col("t"), 0.6).collect()}
    sets = {i: {x for x in t or [] if x} for i, t in data}
    sets = {i: s for i, s in sets.items() if s}
    near = {i: {j for j in sets if j != i and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])} for i in sets}
    label = {i: i for i in sets}
    for _ in sets:
        label = {i: min([label[i], *(label[j] for j in near[i])]) for i in sets}
    assert got == {i: (label[i], len(near[i])) for i in sets}
