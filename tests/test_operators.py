"""Operators on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import chunks, conventions, paths, scores
from loomgraph.operators import aggregates, components, duplicates, filters, fusion, ranking, upsert, vectors, versions
from loomgraph.sources.html import PageText


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_predicates_reject_unknown_names(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id long, name string")
    assert values(filters.where(df, {"name__contains": "b"}), "id") == [(1,)]
    assert values(filters.where(df, {"name__is_null": True}), "id") == [(2,)]
    for key in ("nme", "name__like"):
        with pytest.raises(ValueError):
            filters.where(df, {key: "x"})


def test_filter_reaches_the_scan(spark, sf_dir):
    df = filters.where(spark.read.parquet(f"{sf_dir}/part.parquet"), {"p_size__gt": 5}).select("p_partkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_size,5)" in plan and "p_name" not in plan


def test_optional_branches_do_not_multiply(spark):
    left = spark.createDataFrame([(1,), (2,)], "k long")
    right = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 3)], "k long, s string, n long")
    out = {r["k"]: (r["s"], r["n"]) for r in aggregates.optional_collect(left, right, "k", {"s": "s", "n": "n"}, most=2).collect()}
    assert out == {1: (["a", "b"], [1, 2]), 2: (None, None)}


def test_percentile_rank_of_ties_and_single_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 9.0), ("b", 5.0)], "g string, v double")
    assert values(ranking.percentile_rank(df, "v", ["g"]), "g", "v", "percentile") == [("a", 1.0, 0.0), ("a", 2.0, 0.5), ("a", 2.0, 0.5), ("a", 9.0, 1.0), ("b", 5.0, 0.5)]


def test_semantic_versions(spark):
    order = lambda a, b: one(spark, versions.semver(F.lit(a)) < versions.semver(F.lit(b)))
    assert order("3.9.0", "3.42.0") and order("not a version", "0.0.1") and not order("4.0", "3.99.99")
    assert one(spark, versions.in_range(F.lit("3.42.0"), F.lit("3.9.0"), F.lit("4.0.0")))


def test_diff_tells_null_from_empty(spark):
    old = spark.createDataFrame([("a", None), ("b", "x"), ("c", "x")], "k string, f string")
    new = spark.createDataFrame([("a", ""), ("b", "x"), ("d", "x")], "k string, f string")
    assert sorted((r["k"], r["change"]) for r in versions.diff(old, new, "k", ["f"]).collect()) == [("a", "changed"), ("c", "removed"), ("d", "added")]


def test_lineage_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    out = {(r["src"], r["dst"]): r["hops"] for r in versions.lineage(edges).collect()}
    assert out[("a", "c")] == 2 and out[("a", "a")] == 3 and out[("x", "y")] == 1 and len(out) == 10


def test_components_of_a_long_chain_and_no_edges(spark):
    edges = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    out = components.connected_components(edges)
    assert out.count() == 201 and out.select("component").distinct().collect()[0][0] == 0
    assert components.connected_components(edges.limit(0)).count() == 0


def test_top_k_ties_by_key(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0] if i < 5 else [0.0, 1.0]) for i in range(10)], "id long, v array<double>")
    out = values(vectors.top_k(rows, rows.where("id = 0"), "id", "v", 3), "place", "id")
    assert out == [(1, 1), (2, 2), (3, 3)]


def test_mean_similarity_of_one(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("b", [0.0, 2.0])], "g string, v array<double>")
    assert values(vectors.mean_similarity(rows, "g", "v"), "g", "n", "similarity") == [("a", 1, 1.0), ("b", 2, 0.0)]


def test_reciprocal_ranks(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "id string, place int")
    b = spark.createDataFrame([("y", 0)], "id string, place int")
    out = dict(values(fusion.reciprocal_ranks([a, b], "id"), "id", "mass"))
    assert out["y"] == pytest.approx(1 / 62 + 1 / 61) and out["x"] == pytest.approx(1 / 61)


def test_upsert_keeps_what_the_new_row_lacks(spark):
    table = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k long, s string, n long")
    new = spark.createDataFrame([(2, None, 7, 1), (2, None, 8, 2), (3, "c", 9, 1)], "k long, s string, n long, t long")
    assert values(upsert.upsert(table, new, ["k"], [F.col("t")]), "k", "s", "n") == [(1, "a", 5), (2, "b", 8), (3, "c", 9)]


def test_three_way_conflict_keeps_ours(spark):
    make = lambda v: spark.createDataFrame([("k", v)], "k string, v long")
    assert values(upsert.three_way(make(1), make(2), make(3), "k", "v"), "v", "origin") == [(2, "conflict")]


def test_conflicts_count_null_only_where_strict(spark):
    df = spark.createDataFrame([("a", "m", None), ("a", None, "x"), ("b", "m", "x")], "k string, unit string, kind string")
    assert values(duplicates.conflicts(df, "k", ["unit"], ["kind"]), "k", "conflict") == [("a", "unit")]


def test_paths(spark):
    norm = lambda t: one(spark, paths.normalise_path(F.lit(t)))
    assert norm("flux_loop(i1)/flux/data(:)") == "flux_loop/flux/data"
    assert norm("equilibrium.time_slice/profiles_1d") == "equilibrium/time_slice/profiles_1d"
    assert norm("electron temperature e.g. in eV") == "electron temperature e.g. in eV"
    assert norm("3.39.0") == "3.39.0"
    assert one(spark, paths.name_key(F.lit("__Plasma___Current_"))) == "plasma_current"
    assert [one(spark, c) for c in paths.remote_url(F.lit("git@host.org:team/code.git")).values()] == ["host.org", "team", "code"]


def test_conventions_are_inverse(spark):
    p = conventions.parameters(spark).select(F.struct("*").alias("p"))
    pairs = p.select(F.col("p").alias("a")).crossJoin(p.select(F.col("p").alias("b")))
    for label in conventions.LABELS:
        there, back = conventions.factor(F.lit(label), "a", "b"), conventions.factor(F.lit(label), "b", "a")
        assert pairs.where(F.abs(there * back - 1) > 1e-9).count() == 0
    assert one(spark, conventions.from_version(F.lit("3.42.0"))) == 11 and one(spark, conventions.from_version(F.lit("4.1.0"))) == 17


def test_doc_changes(spark):
    kind = lambda a, b: one(spark, scores.doc_change(F.lit(a), F.lit(b)))
    assert kind("flux", "flux, positive when clockwise") == "sign_convention"
    assert kind("a positive flux", "positive") == "none"
    assert kind("short", "a much longer text about it") == "definition_clarification"


def test_chunks_overlap():
    lines = [f"line {i:02d}" for i in range(20)]
    out = list(chunks.chunks("\n".join(lines), size=40, overlap=16))
    assert all(len(t) <= 40 for _, _, t in out) and out[0][0] == 0 and out[-1][1] == 19
    assert all(b[0] == a[1] - 1 for a, b in zip(out, out[1:]))
    assert list(chunks.chunks("", 10, 2)) == [(0, 0, "")]


def test_html_sections():
    parser = PageText()
    parser.feed("<head><title>t</title></head><h1>One</h1><p>a &amp; b</p><script>x</script><table><tr><td>1</td><td>2</td></tr></table>")
    text, sections = parser.result()
    assert text == "One\na & b\n1 | 2" and sections == {"One": "a & b12"}


def test_chains_are_followed_to_their_end(spark):
    edges = [(k, k + 1) for k in range(14)] + [(100, 101), (201, 202), (202, 203), (203, 202)]
    out = versions.chains(spark.createDataFrame(edges, "src long, dst long"))
    assert sorted((r["root"], r["path"], r["hops"]) for r in out.collect()) == [(0, list(range(15)), 14), (100, [100, 101], 1), (201, [201, 202, 203], 2)]


def test_join_dealt(spark):
    from loomgraph.plans.shared import join_dealt

    left = spark.createDataFrame([("hot", k) for k in range(300)] + [("cold", 1), ("lone", 2), (None, 3)], "g string, a long")
    right = spark.createDataFrame([("hot", k) for k in range(70)] + [("hot", 0), ("cold", 1), ("cold", 2), (None, 3)], "g string, b long")
    out = join_dealt(left, right, "g", pairs=1000)
    assert sorted(map(tuple, out.select("g", "a", "b").collect())) == sorted(map(tuple, left.join(right, "g").select("g", "a", "b").collect()))
    held = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) > 5 and max(held) < 300 * 71 / 2  # the key's pairs don't meet in one task
    assert join_dealt(left.limit(0), right, "g").count() == 0


def test_mentions_below_each_other(spark):
    from loomgraph.operators import lookup

    nodes = spark.createDataFrame([("g/a/x",), ("g/a",), ("g/b",), ("g/b",), (None,)], "id string")
    mentions = spark.createDataFrame([(1, "g"), (1, "g/a"), (1, "g/a"), (None, "g/a/x"), (None, "g/a"), (2, "none"), (2, None)], "key int, path string")
    found = lookup.mention_links(mentions, nodes)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [(1, "g/a/x"), (1, "g/a"), (1, "g/b"), (None, "g/a/x"), (None, "g/a")]))
    assert found._jdf.queryExecution().analyzed().toString().startswith("Project")  # links are many more than rows; no distinct() deals them out again


def test_pairs_of_one_source_are_dealt_out(spark, monkeypatch, tmp_path):
    from loomgraph.plans import shared
    from loomgraph.queries.lookup import find_chunks

    spark.range(40).selectExpr("20 * id as page_id", "concat('http://x/EN/', id) as url").write.parquet(str(tmp_path / "pages.parquet"))
    spark.range(50).selectExpr("id as doc_id", "'The end' as text", "'src0' as source").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(shared, "PAIRS_IN_TASK", 100)
    out = find_chunks(spark, str(tmp_path))
    held = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 2000 and max(held) < 1000
    assert out.distinct().count() == 2000
