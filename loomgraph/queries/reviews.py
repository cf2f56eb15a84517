"""Reviews, coverage, samples and mining over the dictionary graph and the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.operators import reviews
from loomgraph.plans.shared import table
from loomgraph.queries.graph import GRAPH, changes, edges, nodes
from loomgraph.queries.registry import query

#: Reviews: events as reviews of a user, three cycles to a group.
METHOD = "CASE event_type WHEN 'click' THEN 'quorum_consensus' WHEN 'view' THEN 'authoritative_escalation' WHEN 'error' THEN 'retry_item' WHEN 'purchase' THEN 'single_review' END"
REVIEWS = f"(SELECT user_id AS id, event_id // 300 AS grp, event_id AS seen, (event_id % 4)::INT AS cycle, {METHOD} AS method, CASE WHEN event_id % 9 > 0 THEN round(value, 2) END AS score FROM events)"


def review_rows(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.floor(e / 300).alias("grp"), e.alias("at"), (e % 4).cast("int").alias("cycle"), F.expr(METHOD).alias("method"), F.when(e % 9 > 0, F.round("value", 2)).alias("score")
    )


@query(f"""WITH r AS {REVIEWS}, n AS (SELECT DISTINCT o_custkey AS id FROM orders UNION SELECT -1)
  SELECT n.id, count(r.seen)::BIGINT AS n, round(avg(r.score), 6) AS mean, coalesce(count(r.seen) > 1 AND max(r.score) - min(r.score) >= 20, false) AS disagree FROM n LEFT JOIN r ON r.id = n.id GROUP BY 1""")
def review_aggregates(spark, sf_dir):
    names = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).union(spark.range(1).select(F.lit(-1))).distinct()
    return reviews.review_aggregates(names, review_rows(spark, sf_dir), 20).withColumn("mean", F.round("mean", 6))


@query(f"""WITH r AS {REVIEWS}, l AS (SELECT id, arg_max(grp, (seen, grp)) AS grp FROM r GROUP BY 1), w AS (SELECT r.id, cycle, max(seen) AS seen FROM r JOIN l ON l.id = r.id AND l.grp = r.grp GROUP BY 1, 2),
  c AS (SELECT w.id, w.cycle, r.method, r.score FROM w JOIN r ON r.id = w.id AND r.seen = w.seen), n AS (SELECT DISTINCT id FROM r)
  SELECT * FROM (SELECT n.id, CASE WHEN c2.method = 'authoritative_escalation' THEN c2.score WHEN q THEN coalesce((c0.score + c1.score) / 2, c0.score, c1.score) ELSE c0.score END AS score,
    CASE WHEN c2.method = 'authoritative_escalation' THEN 'escalator' WHEN q THEN 'quorum_mean' WHEN c0.id IS NOT NULL THEN 'single' END AS source
    FROM n LEFT JOIN c c0 ON c0.id = n.id AND c0.cycle = 0 LEFT JOIN c c1 ON c1.id = n.id AND c1.cycle = 1 LEFT JOIN c c2 ON c2.id = n.id AND c2.cycle = 2,
    LATERAL (SELECT c0.id IS NOT NULL AND c1.id IS NOT NULL AND coalesce(c0.method, '') NOT IN ('retry_item', 'max_cycles_reached') AND coalesce(c1.method, '') NOT IN ('retry_item', 'max_cycles_reached') AND 'quorum_consensus' IN (coalesce(c0.method, ''), coalesce(c1.method, '')) AS q)) WHERE source IS NOT NULL""")
def canonical_reviews(spark, sf_dir):
    return reviews.canonical_reviews(review_rows(spark, sf_dir))


@query(f"""{GRAPH} SELECT parent, count(*)::BIGINT AS n, coalesce(string_agg(DISTINCT unit, ' ' ORDER BY unit), '') AS unit, coalesce(string_agg(DISTINCT nullif(label, ''), ' ' ORDER BY nullif(label, '')), '') AS label FROM nodes GROUP BY 1""")
def family_overview(spark, sf_dir):
    out = reviews.distinct_values(nodes(spark, sf_dir), "parent", ["unit", "label"])
    return out.withColumns({c: F.array_join(c, " ") for c in ("unit", "label")})


@query(f"""{GRAPH} SELECT name AS token, count(DISTINCT id)::BIGINT AS uses, min((k % 100) / 100.0)::DOUBLE AS min_score, string_agg(DISTINCT coalesce(domain, 'unknown'), ' ' ORDER BY coalesce(domain, 'unknown')) AS domains
  FROM nodes WHERE (k % 100) / 100.0 >= 0.25 AND NOT starts_with(name, 'red') GROUP BY 1 HAVING count(DISTINCT id) >= 2""")
def saturated_tokens(spark, sf_dir):
    own = nodes(spark, sf_dir).withColumn("score", (F.col("k") % 100) / 100)
    known = own.where(F.startswith("name", F.lit("red"))).select(F.col("name").alias("token"))
    return reviews.saturated_tokens(own, "name", "score", "domain", 2, 0.25, known).withColumn("domains", F.array_join("domains", " "))


@query("""WITH l AS (SELECT 'gap' || (event_id % 17) AS gap, CASE WHEN value > 20 THEN 'r' || (event_id % 23) WHEN value > 10 THEN '' END AS reason FROM events), d AS (SELECT DISTINCT gap, reason FROM l WHERE reason <> ''),
  r AS (SELECT *, row_number() OVER (PARTITION BY gap ORDER BY reason) AS place FROM d) SELECT 'gap' || g AS gap, (SELECT count(*) FROM l WHERE l.gap = 'gap' || g)::BIGINT AS occurrences,
  coalesce((SELECT string_agg(reason, ' ' ORDER BY reason) FROM r WHERE r.gap = 'gap' || g AND place <= 5), '') AS reasons FROM range(20) t(g)""")
def gap_examples(spark, sf_dir):
    e = F.col("event_id")
    links = table(spark, sf_dir, "events").select(F.concat(F.lit("gap"), e % 17).alias("gap"), F.when(F.col("value") > 20, F.concat(F.lit("r"), e % 23)).when(F.col("value") > 10, "").alias("reason"))
    gaps = spark.range(20).select(F.concat(F.lit("gap"), F.col("id")).alias("gap"))
    return reviews.gap_examples(gaps, links).withColumn("reasons", F.array_join("reasons", " "))


@query(f"""{GRAPH}, c AS (SELECT DISTINCT src FROM edges), e AS (SELECT n.*, c.src IS NOT NULL AS has FROM nodes n LEFT JOIN c ON c.src = n.id WHERE category IN ('quantity', 'coordinate')), r AS (SELECT sum(o_totalprice) AS cost, sum(o_orderkey % 10) AS names FROM orders)
  SELECT count(*)::BIGINT AS eligible, count_if(has)::BIGINT AS covered, count_if(NOT has)::BIGINT AS to_compose, count_if(NOT has AND k % 11 = 0)::BIGINT AS to_compose_with_errors, count(DISTINCT domain)::BIGINT AS n_domains,
    (3 * count_if(NOT has AND k % 11 = 0))::BIGINT AS expected_siblings, round((SELECT cost / names FROM r), 4) AS cost_per_name, round(count_if(NOT has) * (SELECT cost / names FROM r), 2) AS estimated_cost FROM e""")
def coverage_report(spark, sf_dir):
    own = nodes(spark, sf_dir).withColumn("with_errors", F.col("k") % 11 == 0)
    runs = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("cost"), (F.col("o_orderkey") % 10).alias("names"))
    out = reviews.coverage_report(own, edges(spark, sf_dir).select(F.col("src").alias("id")), ("quantity", "coordinate"), runs)
    return out.withColumns({"cost_per_name": F.round("cost_per_name", 4), "estimated_cost": F.round("estimated_cost", 2)})


KIND = "CASE k % 4 WHEN 0 THEN 'dynamic' WHEN 1 THEN 'static' WHEN 2 THEN 'constant' END"
OF_NAMES = {"status": "CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'drafted' END", "validation": "CASE WHEN o_orderkey % 5 < 3 THEN 'valid' WHEN o_orderkey % 5 = 3 THEN 'quarantined' END", "model": "CASE WHEN o_orderkey % 7 = 0 THEN 'rule' ELSE 'm' || (o_orderkey % 3) END"}
BUCKETS = {"eligible_by_category": ("category", "e"), "eligible_by_domain": ("domain", "e"), "eligible_by_kind": ("kind", "e"), "names_by_status": ("status", "m"), "names_by_validation": ("validation", "m")}
TOTALS = {
    "eligible": "count(*) FROM e", "eligible_with_errors": "count_if(errors) FROM e", "to_compose": "count_if(NOT has) FROM e", "to_compose_with_errors": "count_if(errors AND NOT has) FROM e",
    "expected_siblings": "3 * count_if(errors AND NOT has) FROM e", "names": "count(*) FROM m", "error_siblings": "count_if(model = 'rule') FROM m", "covered": "count(DISTINCT src) FROM edges",
}


@query(f"""{GRAPH}, e AS (SELECT category, domain, {KIND} AS kind, EXISTS (SELECT 1 FROM edges WHERE src = n.id) AS has, EXISTS (SELECT 1 FROM changes c WHERE c.node_id = n.id AND c.level = 'breaking') AS errors FROM nodes n
    WHERE category IN ('quantity', 'coordinate') AND dtype NOT IN ('STRUCTURE', 'STRUCT_ARRAY') AND doc <> '' AND grp <> 'promo'), m AS (SELECT {', '.join(f'{v} AS {c}' for c, v in OF_NAMES.items())} FROM orders)
  {' UNION ALL '.join([f"SELECT '{t}' AS measure, '' AS bucket, ({v.split(' FROM ')[0]})::BIGINT AS n FROM {v.split(' FROM ')[1]}" for t, v in TOTALS.items()] + [f"SELECT '{b}', coalesce({c}, 'none'), count(*)::BIGINT FROM {t} GROUP BY ALL" for b, (c, t) in BUCKETS.items()])}""")
def coverage_counts(spark, sf_dir):
    """Every count of the coverage of leaves by names, in all and by bucket."""
    leaves = reviews.eligible_leaves(nodes(spark, sf_dir), ("quantity", "coordinate"), ("promo",)).withColumn("kind", F.expr(KIND))
    errors = changes(spark, sf_dir).where("level = 'breaking'").select(F.col("node_id").alias("id"))
    names = table(spark, sf_dir, "orders").select(*[F.expr(v).alias(c) for c, v in OF_NAMES.items()])
    return reviews.coverage_counts(leaves, errors, edges(spark, sf_dir).select(F.col("src").alias("id")), names, "rule")


COVERED = """(SELECT c.c_mktsegment, count(DISTINCT c.c_custkey) AS n, count(DISTINCT CASE WHEN t > 0 THEN c.c_custkey END) AS mapped, count(DISTINCT CASE WHEN t > 1 THEN c.c_custkey END) AS multi
  FROM customer c LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) AS t FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) m ON m.o_custkey = c.c_custkey GROUP BY 1)"""


def covered(spark, sf_dir):
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), "c_mktsegment")
    mappings = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("target"))
    return reviews.source_coverage(sources, mappings, "c_mktsegment")


@query(f"SELECT c_mktsegment, n::BIGINT AS n, mapped::BIGINT AS mapped, multi::BIGINT AS multi, round(100.0 * mapped / n, 2)::DOUBLE AS percentage FROM {COVERED}")
def source_coverage(spark, sf_dir):
    return covered(spark, sf_dir)


@query(f"SELECT c_mktsegment, CASE WHEN p < 40 THEN 'error' WHEN p < 99 THEN 'warning' END AS severity FROM (SELECT c_mktsegment, round(100.0 * mapped / n, 2) AS p FROM {COVERED})")
def coverage_thresholds(spark, sf_dir):
    return covered(spark, sf_dir).select("c_mktsegment", reviews.graded(F.col("percentage"), 99, 40).alias("severity"))


@query(f"""{GRAPH} SELECT grp, count(*)::BIGINT AS n, count_if(dtype <> 'STRUCTURE')::BIGINT AS leaves, count_if(dtype = 'STRUCTURE')::BIGINT AS structures, max(len(string_split(id, '/')))::INT AS deepest, count(DISTINCT unit)::BIGINT AS units, count_if(unit IS NULL)::BIGINT AS without_unit,
  round(avg(len(string_split(id, '/'))), 4) AS mean_depth FROM nodes GROUP BY 1""")
def structure_summary(spark, sf_dir):
    return reviews.structure_summary(nodes(spark, sf_dir))


@query(f"""{GRAPH}, s AS (SELECT grp, count(*) AS n, count(DISTINCT parent) AS parents, count_if(dtype = 'FLT_1D') AS arrays FROM nodes GROUP BY 1)
  SELECT grp, round(0.4 * least(n / 1000.0, 1) + 0.3 * least(3 / 10.0, 1) + 0.3 * least(n / parents::DOUBLE / 10, 1), 3)::DOUBLE AS complexity, round(0.3 * n + 10 * 3 + 5 * (n / parents::DOUBLE) + 2 * arrays + 20 * (1 - 0.25), 4)::DOUBLE AS pattern FROM s""")
def complexity_scores(spark, sf_dir):
    s = nodes(spark, sf_dir).groupBy("grp").agg(F.count("*").alias("n"), F.count_distinct("parent").alias("parents"), F.count_if(F.col("dtype") == "FLT_1D").alias("arrays"))
    branching = F.col("n") / F.col("parents")
    pattern = reviews.tree_pattern(F.col("n"), F.lit(3), branching, F.col("arrays"), F.lit(0.25))
    return s.select("grp", reviews.complexity(F.col("n"), F.lit(3), branching).alias("complexity"), F.round(pattern, 4).alias("pattern"))


@query("""WITH c AS (SELECT DISTINCT p_brand AS b, p_name AS name FROM part WHERE p_partkey % 3 > 0), r AS (SELECT DISTINCT p_brand AS b, p_name AS name FROM part WHERE p_partkey % 3 < 2), j AS (SELECT coalesce(c.b, r.b) AS p_brand, c.name AS c, r.name AS r FROM c FULL JOIN r ON c.b = r.b AND c.name = r.name)
  SELECT p_brand, count(c)::BIGINT AS n_candidates, count(r)::BIGINT AS n_reference, count_if(c IS NOT NULL AND r IS NOT NULL)::BIGINT AS overlap, round(CASE WHEN count(c) > 0 THEN count_if(c IS NOT NULL AND r IS NOT NULL) / count(c)::DOUBLE ELSE 0 END, 6) AS precision,
  round(CASE WHEN count(r) > 0 THEN count_if(c IS NOT NULL AND r IS NOT NULL) / count(r)::DOUBLE ELSE 0 END, 6) AS recall FROM j GROUP BY 1""")
def reference_benchmark(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnRenamed("p_name", "name")
    return reviews.benchmark(part.where("p_partkey % 3 > 0"), part.where("p_partkey % 3 < 2"), "p_brand").withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query("SELECT o_orderpriority, round(avg(o_totalprice / (o_orderkey % 7)), 4) AS cpi FROM orders WHERE o_orderkey % 7 > 0 AND o_totalprice > 0 GROUP BY 1")
def cost_per_item(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").alias("cost"), (F.col("o_orderkey") % 7).alias("n"))
    return reviews.cost_per_item(runs, "o_orderpriority").withColumn("cpi", F.round("cpi", 4))


@query("SELECT o_orderpriority AS phase, round(sum(o_totalprice), 2) AS cost FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 UNION ALL SELECT 'total', round(coalesce(sum(o_totalprice), 0), 2) FROM orders WHERE o_orderstatus = 'P'")
def spend_per_phase(spark, sf_dir):
    """Costs of a run by phase and in all, from one pass."""
    run = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    phase = F.when(F.grouping("o_orderpriority") == 1, "total").otherwise(F.col("o_orderpriority"))
    return run.rollup("o_orderpriority").agg(phase.alias("phase"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("cost")).select("phase", "cost")


@query("""SELECT count_if(event_type = 'click')::BIGINT AS generate, count_if(event_type = 'view' AND value < 65)::BIGINT AS refine, count_if(event_type = 'view' AND value >= 65)::BIGINT AS review, count_if(value IS NULL)::BIGINT AS unscored, count_if(event_type = 'error' AND event_id % 5 < 3)::BIGINT AS retry, count_if(event_type = 'error' AND event_id % 5 >= 3)::BIGINT AS exhausted FROM events""")
def pipeline_buckets(spark, sf_dir):
    """Six counts of pending work in one pass."""
    kind, value, tried = F.col("event_type"), F.col("value"), F.col("event_id") % 5
    pools = {
        "generate": kind == "click", "refine": (kind == "view") & (value < 65), "review": (kind == "view") & (value >= 65),
        "unscored": value.isNull(), "retry": (kind == "error") & (tried < 3), "exhausted": (kind == "error") & (tried >= 3),
    }
    return table(spark, sf_dir, "events").agg(*[F.count_if(c).alias(n) for n, c in pools.items()])


@query("SELECT v AS source FROM (SELECT 'src' || i AS v FROM range(30) t(i)) WHERE v NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)")
def expected_gaps(spark, sf_dir):
    """Expected sources without any document."""
    counts = table(spark, sf_dir, "documents").groupBy("source").count()
    return reviews.expected_gaps(counts, spark.range(30).select(F.concat(F.lit("src"), F.col("id")).alias("source")), "source")


@query("""SELECT quartile, event_id FROM (SELECT event_id, least(floor(value / 100 * 4), 3)::INT AS quartile, row_number() OVER (PARTITION BY least(floor(value / 100 * 4), 3) ORDER BY md5('7|' || event_id), event_id) AS place FROM events WHERE value BETWEEN 0 AND 100) WHERE place <= 15""")
def quartile_samples(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("score", F.col("value") / 100)
    return reviews.quartile_samples(events, "score", "event_id", 15, seed=7).select("quartile", "event_id")


DIMENSIONS = {"balance": "c_acctbal / 10000", "parity": "(c_custkey % 10) / 10"}


@query(f"""WITH d AS ({' UNION ALL '.join(f"SELECT c_custkey, '{n}' AS dimension, ({e.replace(' / 10)', ' / 10.0)').replace('% 10) / 10', '% 10) / 10.0')})::DOUBLE AS score, c_mktsegment = 'BUILDING' AS own FROM customer" for n, e in DIMENSIONS.items())}),
  b AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY score DESC, c_custkey) AS p FROM d WHERE score >= 0.6), t AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY own DESC, score DESC, c_custkey) AS place FROM b WHERE p <= 20)
  SELECT dimension, place::INT AS place, c_custkey, score FROM t WHERE place <= 10""")
def top_per_dimension(spark, sf_dir):
    scored = table(spark, sf_dir, "customer").withColumns({n: F.expr(e) for n, e in DIMENSIONS.items()})
    return reviews.top_per_dimension(scored, list(DIMENSIONS), "c_custkey", 10, F.col("c_mktsegment") == "BUILDING")


@query("""SELECT c_mktsegment, place::INT AS place, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 5""")
def top_by_purpose(spark, sf_dir):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("place", F.row_number().over(w)).where("place <= 5").select("c_mktsegment", "place", "c_custkey")


@query(f"""{GRAPH} SELECT id, len(string_split(id, '/'))::INT AS depth FROM nodes ORDER BY depth, id LIMIT 40""")
def frontier(spark, sf_dir):
    """A report: the next nodes by depth and then path."""
    return nodes(spark, sf_dir).select("id", F.size(F.split("id", "/")).alias("depth")).orderBy("depth", "id").limit(40)


AXES = "CASE k % 5 WHEN 0 THEN 'radial' WHEN 1 THEN 'toroidal' WHEN 2 THEN 'vertical' WHEN 3 THEN 'other' END"


@query(f"""{GRAPH} SELECT parent, string_agg(id, ' ' ORDER BY CASE {AXES} WHEN 'radial' THEN 0 WHEN 'toroidal' THEN 1 WHEN 'vertical' THEN 2 ELSE 99 END, id) AS ids FROM nodes GROUP BY 1""")
def axis_order(spark, sf_dir):
    """Members in the usual order of their axes, others last by id."""
    order = F.create_map(*[F.lit(x) for pair in (("radial", 0), ("toroidal", 1), ("vertical", 2)) for x in pair])
    own = nodes(spark, sf_dir).withColumn("place", F.coalesce(order[F.expr(AXES)], F.lit(99)))
    return own.groupBy("parent").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]), " ").alias("ids"))


@query()
def token_batches(spark, sf_dir):
    """Documents in batches by source, halved until each part is within 5,000 tokens or one document."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("batch"), F.col("doc_id").alias("at"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("tokens"))
    return reviews.token_batches(docs, 5000)


@query(f"""{GRAPH} SELECT 'rings' AS label, id FROM nodes WHERE regexp_matches(name, 'ring') UNION ALL SELECT 'colours', id FROM nodes WHERE regexp_matches(name, '^(red|blue|green)_')""")
def regex_clusters(spark, sf_dir):
    return reviews.by_label(nodes(spark, sf_dir), {"rings": "ring", "colours": "^(red|blue|green)_"}, F.col("name"), "id")


@query(f"""{GRAPH} SELECT substr(sha256(string_agg(DISTINCT name, '|' ORDER BY name)), 1, 16) AS id, parent AS label, count(DISTINCT name)::INT AS n FROM nodes GROUP BY parent""")
def content_clusters(spark, sf_dir):
    return reviews.content_clusters(nodes(spark, sf_dir).select(F.col("parent").alias("label"), F.col("name").alias("member")))


@query(f"""{GRAPH}, c AS (SELECT substr(sha256(string_agg(DISTINCT name, '|' ORDER BY name)), 1, 16) AS id, parent AS label FROM nodes GROUP BY parent), d AS (SELECT substr(sha256(string_agg(DISTINCT name, '|' ORDER BY name)), 1, 16) AS id FROM nodes WHERE k % 5 > 0 GROUP BY parent)
  SELECT id, label FROM c WHERE id NOT IN (SELECT id FROM d)""")
def stale_clusters(spark, sf_dir):
    """Clusters of an earlier import that the next one no longer has."""
    own = nodes(spark, sf_dir).select("k", F.col("parent").alias("label"), F.col("name").alias("member"))
    return reviews.stale(reviews.content_clusters(own), reviews.content_clusters(own.where("k % 5 > 0")), "id").select("id", "label")


@query(f"""{GRAPH}, p AS (SELECT k, label, 1 AS source FROM nodes WHERE label <> '' UNION ALL SELECT k, 'cluster_' || domain, 2 FROM nodes WHERE domain IS NOT NULL)
  SELECT k, arg_min(label, source) AS label, min(source)::INT AS source FROM p GROUP BY 1""")
def first_source_wins(spark, sf_dir):
    """A property where there is one, else the cluster's."""
    own = nodes(spark, sf_dir)
    given = own.where("label <> ''").select("k", "label", F.lit(1).alias("source"))
    told = own.where("domain is not null").select("k", F.concat(F.lit("cluster_"), "domain").alias("label"), F.lit(2).alias("source"))
    return given.unionByName(told).groupBy("k").agg(F.min_by("label", "source").alias("label"), F.min("source").alias("source"))


@query("""SELECT doc_id, max(score)::DOUBLE AS score, arg_max(stream, (score, stream)) AS stream FROM (SELECT doc_id, 0.9 AS score, 'text' AS stream FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 0.5 + 0.5 * quality, 'vector' FROM labels) GROUP BY 1""")
def merged_keeping_best(spark, sf_dir):
    text = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.lit(0.9).alias("score"), F.lit("text").alias("stream"))
    vector = table(spark, sf_dir, "labels").select("doc_id", (0.5 + 0.5 * F.col("quality")).alias("score"), F.lit("vector").alias("stream"))
    return text.unionByName(vector).groupBy("doc_id").agg(F.max("score").alias("score"), F.max_by("stream", F.struct("score", "stream")).alias("stream"))


@query(f"{GRAPH} SELECT id FROM nodes WHERE domain IN ('domain_1', 'domain_3') UNION SELECT id FROM nodes WHERE grp = 'large' UNION SELECT DISTINCT node_id FROM changes WHERE level = 'breaking'")
def filter_set_union(spark, sf_dir):
    """Ids that any of three filters picks."""
    own = nodes(spark, sf_dir)
    return own.where("domain in ('domain_1', 'domain_3') or grp = 'large'").select("id").union(changes(spark, sf_dir).where("level = 'breaking'").select("node_id")).distinct()


@query("SELECT p_brand, p_name FROM part WHERE p_partkey % 3 > 0 INTERSECT SELECT p_brand, p_name FROM part WHERE p_partkey % 3 < 2")
def set_overlap(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where("p_partkey % 3 > 0").select("p_brand", "p_name").intersect(part.where("p_partkey % 3 < 2").select("p_brand", "p_name"))


@query("""WITH p AS (SELECT '/d' || (s_suppkey % 9) || CASE WHEN s_suppkey % 2 = 0 THEN '/sub' ELSE '' END || '/f' || s_suppkey AS path, s_suppkey // 3 AS inode FROM supplier)
  SELECT inode, arg_min(path, (len(string_split(path, '/')), path)) AS path, count(*)::BIGINT AS n FROM p GROUP BY 1""")
def paths_by_inode(spark, sf_dir):
    """Of the paths of one file the shallowest."""
    k = F.col("s_suppkey")
    paths = table(spark, sf_dir, "supplier").select(F.concat(F.lit("/d"), k % 9, F.when(k % 2 == 0, "/sub").otherwise(""), F.lit("/f"), k).alias("path"), F.floor(k / 3).alias("inode"))
    return paths.groupBy("inode").agg(F.min_by("path", F.struct(F.size(F.split("path", "/")), F.col("path"))).alias("path"), F.count("*").alias("n"))


@query(f"""{GRAPH} SELECT cross_grp, count(*)::BIGINT AS n, sum(size)::BIGINT AS members, round(avg(size), 4) AS mean_size FROM (SELECT name, count(DISTINCT grp) > 1 AS cross_grp, count(*) AS size FROM nodes GROUP BY 1) GROUP BY 1""")
def cluster_statistics(spark, sf_dir):
    sizes = nodes(spark, sf_dir).groupBy("name").agg((F.count_distinct("grp") > 1).alias("cross_grp"), F.count("*").alias("size"))
    return sizes.groupBy("cross_grp").agg(F.count("*").alias("n"), F.sum("size").alias("members"), F.round(F.avg("size"), 4).alias("mean_size"))


@query(f"""{GRAPH} SELECT grp, count(*)::BIGINT AS n, count_if(introduced IS NOT NULL)::BIGINT AS dated, count_if(deprecated IS NOT NULL)::BIGINT AS gone, count_if(label <> '')::BIGINT AS labelled, count_if(EXISTS (SELECT 1 FROM edges e WHERE e.src = nodes.id))::BIGINT AS renamed FROM nodes GROUP BY 1""")
def progress_by_group(spark, sf_dir):
    renamed = edges(spark, sf_dir).select(F.col("src").alias("id")).distinct().withColumn("r", F.lit(True))
    own = nodes(spark, sf_dir).join(renamed, "id", "left")
    return own.groupBy("grp").agg(F.count("*").alias("n"), F.count("introduced").alias("dated"), F.count("deprecated").alias("gone"), F.count_if(F.col("label") != "").alias("labelled"), F.count("r").alias("renamed"))


@query(f"""{GRAPH}, a AS (SELECT id, parent, grp FROM nodes) SELECT grp, count(DISTINCT id) + count(DISTINCT parent) + 1 AS n_nodes, count(DISTINCT id)::BIGINT AS n_leaves, 3::INT AS depth FROM a GROUP BY 1""")
def tree_metrics(spark, sf_dir):
    """Nodes, leaves and depth of each group's tree, from exploded ancestors."""
    from loomgraph.operators.versions import ancestors

    every = nodes(spark, sf_dir).select("grp", "id", F.explode(F.array_append(ancestors(F.col("id")), F.col("id"))).alias("node"))
    return every.groupBy("grp").agg(F.count_distinct("node").alias("n_nodes"), F.count_distinct("id").alias("n_leaves"), F.max(F.size(F.split("node", "/"))).alias("depth"))


@query(f"""{GRAPH} SELECT id, CASE WHEN regexp_matches(name, '_error_') THEN 'error' ELSE category END AS category FROM nodes WHERE id NOT IN (SELECT src FROM edges WHERE src IS NOT NULL)
  UNION ALL SELECT id, 'renamed' FROM nodes WHERE id IN (SELECT src FROM edges)""")
def reclassified(spark, sf_dir):
    """Categories revised by what edges show."""
    own = nodes(spark, sf_dir).join(edges(spark, sf_dir).select(F.col("src").alias("id")).distinct().withColumn("r", F.lit(True)), "id", "left")
    return own.select("id", F.when(F.col("r"), "renamed").when(F.contains("name", F.lit("_error_")), "error").otherwise(F.col("category")).alias("category"))


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT source)::BIGINT AS sources, count(DISTINCT lang)::BIGINT AS languages, sum(n_chars)::BIGINT AS chars, max(n_chars)::BIGINT AS longest, count_if(text IS NULL OR text = '')::BIGINT AS empty FROM documents")
def store_statistics(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(
        F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("languages"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty")
    )


@query(f"""{GRAPH}, o AS (SELECT domain, grp, parent, count(*) AS options FROM nodes GROUP BY 1, 2, 3) SELECT domain, grp, count(*)::BIGINT AS n, round(avg(options), 4) AS mean_options, max(options)::BIGINT AS most_options, count_if(options > 5)::BIGINT AS significant FROM o GROUP BY ROLLUP (domain, grp) HAVING grouping(domain) = 0""")
def branching_summary(spark, sf_dir):
    """Options of each enumeration by group, and of each domain in all."""
    options = nodes(spark, sf_dir).groupBy("domain", "grp", "parent").agg(F.count("*").alias("options"))
    out = options.rollup("domain", "grp").agg(F.grouping("domain").alias("all"), F.count("*").alias("n"), F.round(F.avg("options"), 4).alias("mean_options"), F.max("options").alias("most_options"), F.count_if(F.col("options") > 5).alias("significant"))
    return out.where(F.col("all") == 0).drop("all")
