"""Filters, traversals, aggregates and windows over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import conventions, scores
from loomgraph.operators import aggregates, duplicates, filters, ranking, upsert
from loomgraph.plans.shared import table
from loomgraph.queries.registry import query

MONEY = "decimal(18,2)"
EDGES = {
    "IN_REGION": ("Nation", "n_regionkey", "Region", "r_regionkey"),
    "LIVES_IN": ("Customer", "c_nationkey", "Nation", "n_nationkey"),
    "PLACED_BY": ("Order", "o_custkey", "Customer", "c_custkey"),
    "SUPPLIES_FROM": ("Supplier", "s_nationkey", "Nation", "n_nationkey"),
}
LABELS = {"Nation": "nation", "Region": "region", "Customer": "customer", "Order": "orders", "Supplier": "supplier", "Part": "part"}


def graph(spark, sf_dir):
    return filters.Graph({label: table(spark, sf_dir, name) for label, name in LABELS.items()}, EDGES)


@query("""SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE contains(p_name, 'ring') AND starts_with(p_brand, 'Brand#1')
  AND p_size > 5 AND p_size <= 40 AND p_type IN ('ECONOMY', 'PROMO', 'LARGE') AND p_brand <> 'Brand#12'""")
def where_ops(spark, sf_dir):
    conditions = {"p_name__contains": "ring", "p_brand__starts_with": "Brand#1", "p_size__gt": 5, "p_size__lte": 40, "p_type__in": ["ECONOMY", "PROMO", "LARGE"], "p_brand__ne": "Brand#12"}
    return graph(spark, sf_dir).search("Part", conditions, returns=["p_partkey", "p_name", "p_brand", "p_size"])


@query("""SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY'""")
def traverse_one_hop(spark, sf_dir):
    return graph(spark, sf_dir).search("Customer", {"c_mktsegment": "MACHINERY"}, ["LIVES_IN>Nation"], ["c_custkey", "c_name", "n_name"])


@query("""SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice >= 300000""")
def traverse_three_hops(spark, sf_dir):
    return graph(spark, sf_dir).search("Order", {"o_totalprice__gte": 300000.0}, ["PLACED_BY>Customer", "LIVES_IN>Nation", "IN_REGION>Region"], ["o_orderkey", "c_name", "n_name", "r_name"])


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def ordered_top(spark, sf_dir):
    return graph(spark, sf_dir).search("Order", order_by=["-o_totalprice", "o_orderkey"], returns=["o_orderkey", "o_totalprice"], limit=25)


@query("""WITH l AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) f, list_sort(list(DISTINCT l_suppkey))[1:5] s FROM lineitem GROUP BY 1)
  SELECT o_orderkey, o_orderstatus, array_to_string(f, ',') AS flags, array_to_string(s, ',') AS suppliers FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def optional_enrich_collect(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_returnflag", "l_suppkey")
    flags = aggregates.optional_collect(orders, lines, "key", {"f": "l_returnflag", "s": "l_suppkey"}, most=5)
    return flags.select(F.col("key").alias("o_orderkey"), "o_orderstatus", F.array_join("f", ",").alias("flags"), F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("suppliers"))


@query("""SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def semi_exists(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(done, "c_custkey", "left_semi")


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)""")
def anti_not_exists(spark, sf_dir):
    large = table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(large, "c_custkey", "left_anti")


@query("""SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL""")
def dynamic_group_counts(spark, sf_dir):
    return aggregates.group_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("""SELECT CASE WHEN l.ok IS NULL THEN 'unchecked' WHEN l.ok THEN 'passed' ELSE 'failed' END AS status, o_orderpriority, count(DISTINCT o_orderkey)::BIGINT AS n
  FROM orders LEFT JOIN (SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS ok FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey GROUP BY ALL""")
def check_status_counts(spark, sf_dir):
    checks = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(F.col("l_returnflag") != "R").alias("ok"))
    status = F.when(F.col("ok").isNull(), "unchecked").when(F.col("ok"), "passed").otherwise("failed").alias("status")
    return aggregates.group_counts(table(spark, sf_dir, "orders").join(checks, "o_orderkey", "left"), [status, "o_orderpriority"])


@query("""SELECT user_id, count_if(event_type = 'error') AS errors, count_if(event_type = 'purchase') AS purchases, count_if(value > 50) AS large,
  count_if(value IS NULL) AS missing FROM events GROUP BY 1""")
def conditional_counters(spark, sf_dir):
    kind, value = F.col("event_type"), F.col("value")
    conditions = {"errors": kind == "error", "purchases": kind == "purchase", "large": value > 50, "missing": value.isNull()}
    return aggregates.counters(table(spark, sf_dir, "events"), conditions, ["user_id"])


@query("""SELECT (SELECT count(*) FROM nation)::BIGINT AS nations, (SELECT count(*) FROM supplier)::BIGINT AS suppliers, (SELECT count(*) FROM customer)::BIGINT AS customers,
  (SELECT count(*) FROM orders)::BIGINT AS orders""")
def independent_counts_row(spark, sf_dir):
    return aggregates.counts_row({"nations": table(spark, sf_dir, "nation"), "suppliers": table(spark, sf_dir, "supplier"), "customers": table(spark, sf_dir, "customer"), "orders": table(spark, sf_dir, "orders")})


@query("""WITH a AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)
  SELECT l_suppkey AS supplier, round(sum(o_totalprice / n), 2) AS share FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) l
  JOIN a USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def apportioned_cost(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("ids"))
    priced = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(ids, "o_orderkey")
    return aggregates.apportioned(priced, "ids", "o_totalprice").select(F.col("id").alias("supplier"), F.round("share", 2).alias("share"))


@query("""SELECT l_partkey, count(DISTINCT l_suppkey)::BIGINT AS n_suppliers FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 20""")
def having_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n_suppliers")).where("n_suppliers > 20")


@query("""SELECT a.p_partkey AS query, count(*)::BIGINT AS n_related, min(b.p_partkey) AS first_related FROM part a JOIN part b
  ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey WHERE a.p_partkey % 20 = 0 GROUP BY 1""")
def hub_self_join(spark, sf_dir):
    """Parts that share brand, type and size with a part of the query set; related parts are counted by hub, not listed."""
    hub = ["p_brand", "p_type", "p_size"]
    part = table(spark, sf_dir, "part").select("p_partkey", *hub)
    two = part.groupBy(*hub).agg(F.count("*").alias("n"), F.min("p_partkey").alias("a"), F.min_by(F.lit(0), "p_partkey").alias("z"))
    second = part.join(two.select(*hub, "a"), hub).where("p_partkey <> a").groupBy(*hub).agg(F.min("p_partkey").alias("b"))
    asked = part.where("p_partkey % 20 = 0").join(two, hub).join(second, hub, "left").where("n > 1")
    return asked.select(F.col("p_partkey").alias("query"), (F.col("n") - 1).alias("n_related"), F.when(F.col("p_partkey") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("first_related"))


@query("""SELECT l_partkey, array_to_string(list_sort(list(DISTINCT n_regionkey)), ',') AS regions FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 HAVING count(DISTINCT n_regionkey) > 1""")
def shared_across_groups(spark, sf_dir):
    where_from = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_regionkey")
    found = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(where_from, "l_suppkey").groupBy("l_partkey").agg(F.sort_array(F.collect_set("n_regionkey")).alias("r"))
    return found.where(F.size("r") > 1).select("l_partkey", F.array_join(F.transform("r", lambda x: x.cast("string")), ",").alias("regions"))


@query("""SELECT n_name, count(c_custkey)::BIGINT AS total, count(o.k)::BIGINT AS mapped, round(100.0::DOUBLE * count(o.k) / count(c_custkey), 1) AS percent FROM customer
  JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') o ON o.k = c_custkey GROUP BY 1""")
def mapping_coverage(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    mapped = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return aggregates.coverage(customers, mapped, "c_custkey", ["n_name"])


@query("""SELECT CASE WHEN v >= 0.8 THEN 'high' WHEN v >= 0.5 THEN 'medium' WHEN v >= 0.25 THEN 'low' ELSE 'weak' END AS bucket, count(*)::BIGINT AS n, round(avg(v), 4) AS mean
  FROM (SELECT l_discount * 10 AS v FROM lineitem) GROUP BY 1""")
def confidence_buckets(spark, sf_dir):
    values = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("v"))
    return aggregates.buckets(values, F.col("v"), [0.0, 0.25, 0.5, 0.8], ["weak", "low", "medium", "high"])


@query("""SELECT c_custkey, c_mktsegment, round(CASE WHEN n > 1 THEN (r - 1 + (t - 1) / 2.0::DOUBLE) / (n - 1) ELSE 0.5 END, 4)::DOUBLE AS percentile FROM (SELECT *, rank() OVER
  (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS r, count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) AS t, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)""")
def percentile_avg_rank(spark, sf_dir):
    return ranking.percentile_rank(table(spark, sf_dir, "customer"), "c_acctbal", ["c_mktsegment"]).select("c_custkey", "c_mktsegment", "percentile")


LEVELS = {"lowest": (0.0, 1000.0), "low": (500.0, 3000.0), "middle": (4000.0, 6000.0), "high": (7000.0, 9999.0)}


@query("""WITH v(level, a, b) AS (VALUES ('lowest', 0.0::DOUBLE, 1000.0::DOUBLE), ('low', 500.0, 3000.0), ('middle', 4000.0, 6000.0), ('high', 7000.0, 9999.0))
  SELECT level, c_custkey, place::INT AS place FROM (SELECT level, c_custkey, row_number() OVER (PARTITION BY level ORDER BY abs(c_acctbal - (a + b) / 2), c_custkey) AS place
  FROM customer JOIN v ON c_acctbal BETWEEN a AND b) WHERE place <= 5""")
def top_k_per_bucket(spark, sf_dir):
    return ranking.calibration_samples(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", LEVELS, 5, "c_custkey").select("level", "c_custkey", "place")


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next, coalesce(year(o_orderdate) <> lag(year(o_orderdate)) OVER w, false) AS is_boundary
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def lag_lead_chain(spark, sf_dir):
    out = ranking.chain(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderkey", F.year("o_orderdate"))
    return out.select("o_orderkey", "previous", "next", "is_boundary")


@query("""WITH s AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR lag(event_id) OVER w IS NULL THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  e AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS epoch FROM s)
  SELECT user_id, epoch, event_type AS fingerprint, min(event_id) AS first_place, max(event_id) AS last_place, count(*)::BIGINT AS n FROM e GROUP BY ALL""")
def epochs(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return ranking.epochs(events, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type"), "event_id")


@query("""WITH s AS (SELECT c_mktsegment, avg(c_acctbal) m, stddev_samp(c_acctbal) d, count(*) n FROM customer GROUP BY 1)
  SELECT c_custkey, round((c_acctbal - m) / d, 4) AS z, CASE WHEN (c_acctbal - m) / d < -2 THEN 'regenerate' WHEN (c_acctbal - m) / d < -1.5 THEN 'review' ELSE 'investigate' END AS action
  FROM customer JOIN s USING (c_mktsegment) WHERE n >= 3 AND d > 0 AND (c_acctbal - m) / d < -1""")
def outliers_z(spark, sf_dir):
    return ranking.outliers(table(spark, sf_dir, "customer"), "c_acctbal", ["c_mktsegment"]).select("c_custkey", "z", "action")


@query("""SELECT s_nationkey, count(s_acctbal)::BIGINT AS n, round(stddev_samp(s_acctbal) / abs(avg(s_acctbal)), 4) AS cv, coalesce(stddev_samp(s_acctbal) / abs(avg(s_acctbal)) > 1, false) AS drifts
  FROM supplier GROUP BY 1 HAVING count(s_acctbal) >= 3""")
def cv_drift(spark, sf_dir):
    return ranking.drift(table(spark, sf_dir, "supplier"), "s_acctbal", ["s_nationkey"])


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def upsert_latest_wins(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return upsert.latest(events, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("""WITH n AS (SELECT o_custkey AS c_custkey, max(o_orderpriority) AS p FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
  SELECT c_custkey, coalesce(p, c_mktsegment) AS c_mktsegment, c_name FROM customer FULL JOIN n USING (c_custkey)""")
def upsert_properties(spark, sf_dir):
    new = table(spark, sf_dir, "orders").where("o_orderdate >= '1998-01-01'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_mktsegment"))
    return upsert.upsert(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name"), new, ["c_custkey"])


@query("""SELECT DISTINCT l_orderkey AS src, l_suppkey AS dst, l_returnflag FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey""")
def edge_table(spark, sf_dir):
    found = upsert.edges(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", ["l_returnflag"])
    orders, suppliers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("dst"))
    return found.join(orders, "src", "left_semi").join(suppliers, "dst", "left_semi")


@query("""WITH c AS (SELECT p_brand, p_type, count(DISTINCT p_name) + 0 AS names, count(DISTINCT p_size) AS sizes FROM part GROUP BY 1, 2)
  SELECT p_brand || '/' || p_type AS key, 'p_name' AS conflict FROM c WHERE names > 1 UNION ALL SELECT p_brand || '/' || p_type, 'p_size' FROM c WHERE sizes > 1""")
def conflict_flags(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("key", F.concat_ws("/", "p_brand", "p_type"))
    return duplicates.conflicts(part, "key", ["p_name"], ["p_size"])


@query("""SELECT p_brand, p_type, max({'n': length(p_name), 't': p_name}).t AS p_name, array_to_string(list_sort(list(DISTINCT p_partkey)), ',') AS sources, count(*)::BIGINT AS n_merged FROM part GROUP BY 1, 2""")
def merge_duplicates(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_name", F.array("p_partkey").alias("sources"))
    out = duplicates.merged(part, ["p_brand", "p_type"], "p_name", "sources")
    return out.withColumn("sources", F.array_join(F.transform("sources", lambda x: x.cast("string")), ","))


CLASSES_SQL = """WITH RECURSIVE t AS (SELECT p_partkey, list_sort(list_distinct(string_split(lower(p_name || ' ' || p_type || ' size' || (p_size % 4)), ' '))) AS s FROM part),
  n AS (SELECT s, min(p_partkey) AS node, count(*) AS copies FROM t GROUP BY s),
  l AS (SELECT a.node AS src, b.node AS dst, b.copies FROM n a JOIN n b ON a.node <> b.node AND len(list_intersect(a.s, b.s)) >= 0.6 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))),
  r AS (SELECT node AS id, node AS class FROM n UNION SELECT l.dst, r.class FROM r JOIN l ON l.src = r.id WHERE r.class < l.dst),
  c AS (SELECT id, min(class) AS class FROM r GROUP BY 1),
  k AS (SELECT src, sum(copies) AS others FROM l GROUP BY 1)
  SELECT p_partkey, class, (copies - 1 + coalesce(others, 0))::BIGINT AS n_links FROM t JOIN n USING (s) JOIN c ON c.id = n.node LEFT JOIN k ON k.src = n.node"""


@query(CLASSES_SQL)
def blocked_jaccard_classes(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", F.concat(F.lit("size"), F.col("p_size") % 4))), " ").alias("tokens"))
    return duplicates.token_classes(part, "p_partkey", F.col("tokens"), 0.6)


CONVENTION_TABLE = """(VALUES (1,1,0,1,1),(2,1,0,-1,1),(3,-1,0,1,-1),(4,-1,0,-1,-1),(5,1,0,1,-1),(6,1,0,-1,-1),(7,-1,0,1,1),(8,-1,0,-1,1),(11,1,1,1,1),(12,1,1,-1,1),(13,-1,1,1,-1),(14,-1,1,-1,-1),(15,1,1,1,-1),(16,1,1,-1,-1),(17,-1,1,1,1),(18,-1,1,-1,1))"""


@query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS value, ['one_like','ip_like','b0_like','tor_angle_like','pol_angle_like','q_like','psi_like','dodpsi_like'][l_partkey % 8 + 1] AS label,
    l_linenumber + CASE WHEN l_suppkey % 2 = 0 THEN 10 ELSE 0 END AS from_convention, l_quantity::INT % 8 + 11 AS to_convention FROM lineitem)
  SELECT l_orderkey, l_linenumber, label, r.from_convention::INT AS from_convention, r.to_convention::INT AS to_convention, round(value * CASE label WHEN 'ip_like' THEN a.rpz * a.bp * b.rpz * b.bp WHEN 'b0_like' THEN a.rpz * b.rpz WHEN 'tor_angle_like' THEN a.rpz * b.rpz
    WHEN 'pol_angle_like' THEN a.rtp * b.rtp WHEN 'q_like' THEN a.rtp * a.rpz * b.rtp * b.rpz WHEN 'psi_like' THEN a.bp * b.bp * pow(2 * pi(), a.e - b.e) WHEN 'dodpsi_like' THEN 1 / (a.bp * b.bp * pow(2 * pi(), a.e - b.e)) ELSE 1 END::DOUBLE, 4) AS value
  FROM r JOIN {CONVENTION_TABLE} a(convention, bp, e, rpz, rtp) ON a.convention = r.from_convention JOIN {CONVENTION_TABLE} b(convention, bp, e, rpz, rtp) ON b.convention = r.to_convention""")
def convention_factors(spark, sf_dir):
    """Labelled quantities of every line, changed from the line's convention to another."""
    label = F.get(F.array(*[F.lit(x) for x in conventions.LABELS]), (F.col("l_partkey") % 8).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", label.alias("label"), F.col("l_extendedprice").alias("value"),
        (F.col("l_linenumber") + F.when(F.col("l_suppkey") % 2 == 0, 10).otherwise(0)).cast("int").alias("from_convention"), (F.col("l_quantity").cast("int") % 8 + 11).cast("int").alias("to_convention"),
    )
    p = conventions.parameters(spark)  # 16 rows
    both = rows.join(F.broadcast(p.select(F.col("convention").alias("from_convention"), F.struct("*").alias("a"))), "from_convention")
    both = both.join(F.broadcast(p.select(F.col("convention").alias("to_convention"), F.struct("*").alias("b"))), "to_convention")
    changed = F.col("value") * conventions.factor(F.col("label"), "a", "b")
    return both.select("l_orderkey", "l_linenumber", "label", "from_convention", "to_convention", F.round(changed, 4).alias("value"))


@query("""SELECT p_partkey, round(least(1.0, greatest(p_size / 40.0::DOUBLE, p_retailprice / 2000)), 6) AS max_score,
  round(greatest(0, least(1, greatest(p_size / 40.0::DOUBLE, p_retailprice / 2000) * CASE WHEN p_type = 'ECONOMY' THEN 1.0::DOUBLE WHEN p_type = 'PROMO' THEN 0.8 ELSE 0.3 END)), 6)::DOUBLE AS purpose_score,
  round(least(1.0, 0.5 * p_size / 50.0::DOUBLE + CASE WHEN p_size > 30 THEN 0.25 WHEN p_size > 15 THEN 0.15 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 0.1 ELSE 0 END + 0.05 + 0.05 * p_retailprice / 2000), 9)::DOUBLE AS relevance FROM part""")
def composite_scores(spark, sf_dir):
    a, b = F.col("p_size") / 40.0, F.col("p_retailprice") / 2000
    purpose = F.when(F.col("p_type") == "ECONOMY", "code").when(F.col("p_type") == "PROMO", "tutorial").otherwise("other")
    mapping = F.when(F.col("p_size") > 30, "high").when(F.col("p_size") > 15, "medium").otherwise("low")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(scores.max_composite([a, b]), 6).alias("max_score"),
        F.round(scores.purpose_weighted([a, b], purpose), 6).alias("purpose_score"),
        F.round(scores.relevance(F.col("p_size") / 50.0, mapping, F.col("p_partkey") % 2 == 0, F.lit("domain"), b), 9).alias("relevance"),
    )
