"""Diffs between snapshots, change logs, rename lineage, hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import scores
from loomgraph.functions.paths import common_prefix, normalise_path, parent_path
from loomgraph.operators import aggregates, components, upsert, versions
from loomgraph.plans.shared import table
from loomgraph.queries.registry import query

CUT = "1998-06-30"
SNAPSHOT = """SELECT l_partkey AS part, max(l_returnflag) AS flag, count(*) AS n, CAST(max(l_quantity) AS BIGINT) AS most FROM lineitem WHERE l_shipdate {0} TIMESTAMP '1998-06-30' GROUP BY 1"""


def snapshot(spark, sf_dir, later: bool):
    lines = table(spark, sf_dir, "lineitem").where(f"l_shipdate {'>' if later else '<='} '{CUT}'")
    return lines.groupBy(F.col("l_partkey").alias("part")).agg(F.max("l_returnflag").alias("flag"), F.count("*").alias("n"), F.max("l_quantity").cast("long").alias("most"))


@query(f"""WITH o AS ({SNAPSHOT.format('<=')}), n AS ({SNAPSHOT.format('>')}), j AS (SELECT coalesce(o.part, n.part) AS part, o.part AS op, n.part AS np, o.flag f1, n.flag f2, o.n n1, n.n n2, o.most m1, n.most m2 FROM o FULL JOIN n ON o.part = n.part)
  SELECT part, 'added' AS change, NULL AS field, NULL AS old_value, NULL AS new_value FROM j WHERE op IS NULL UNION ALL SELECT part, 'removed', NULL, NULL, NULL FROM j WHERE np IS NULL
  UNION ALL SELECT part, 'changed', 'flag', f1, f2 FROM j WHERE op IS NOT NULL AND np IS NOT NULL AND f1 IS DISTINCT FROM f2
  UNION ALL SELECT part, 'changed', 'n', n1::VARCHAR, n2::VARCHAR FROM j WHERE op IS NOT NULL AND np IS NOT NULL AND n1 IS DISTINCT FROM n2
  UNION ALL SELECT part, 'changed', 'most', m1::VARCHAR, m2::VARCHAR FROM j WHERE op IS NOT NULL AND np IS NOT NULL AND m1 IS DISTINCT FROM m2""")
def version_diff(spark, sf_dir):
    return versions.diff(snapshot(spark, sf_dir, False), snapshot(spark, sf_dir, True), "part", ["flag", "n", "most"])


@query("""SELECT user_id, count(*)::BIGINT AS n_changes, count(DISTINCT event_type)::BIGINT AS n_kinds, max(CASE WHEN value > 99 THEN 1 ELSE 0 END)::BIGINT AS renamed,
  (count(*) + 2 * count(DISTINCT event_type) + 3 * max(CASE WHEN value > 99 THEN 1 ELSE 0 END))::BIGINT AS volatility FROM events GROUP BY 1""")
def volatility(spark, sf_dir):
    return aggregates.volatility(table(spark, sf_dir, "events"), "user_id", "event_type", F.col("value") > 99)


@query("""SELECT event_type, coalesce(CASE WHEN value > 90 THEN 'breaking' WHEN value > 50 THEN 'advisory' END, 'unknown') AS level, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def change_summary(spark, sf_dir):
    level = F.coalesce(F.when(F.col("value") > 90, "breaking").when(F.col("value") > 50, "advisory"), F.lit("unknown")).alias("level")
    return aggregates.group_counts(table(spark, sf_dir, "events"), ["event_type", level])


# parts renamed in chains: a part whose number is no multiple of 7 gave way to the next one
CHAIN = "SELECT p_partkey AS src, p_partkey + 1 AS dst FROM part WHERE p_partkey % 7 <> 6"


def chain_edges(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_partkey % 7 <> 6").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"))


@query(f"""WITH RECURSIVE e AS ({CHAIN}), r AS (SELECT src, dst, 1 AS hops FROM e UNION ALL SELECT r.src, e.dst, hops + 1 FROM r JOIN e ON r.dst = e.src WHERE hops < 10)
  SELECT src, dst, min(hops)::INT AS hops FROM r GROUP BY 1, 2""")
def rename_lineage(spark, sf_dir):
    return versions.lineage(chain_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE e AS ({CHAIN}), r AS (SELECT src AS root, dst, [src, dst] AS path FROM e WHERE src NOT IN (SELECT dst FROM e) UNION ALL SELECT root, e.dst, list_append(path, e.dst) FROM r JOIN e ON r.dst = e.src)
  SELECT root, array_to_string(path, '>') AS path, (len(path) - 1)::INT AS hops FROM r WHERE dst NOT IN (SELECT src FROM e)""")
def rename_chains(spark, sf_dir):
    out = versions.chains(chain_edges(spark, sf_dir))
    return out.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query(f"""WITH RECURSIVE e AS ({CHAIN}), r AS (SELECT src, dst, 1 AS hops FROM e UNION ALL SELECT r.src, e.dst, hops + 1 FROM r JOIN e ON r.dst = e.src WHERE hops < 10)
  SELECT src, max(hops)::INT AS depth FROM r GROUP BY 1""")
def max_depth(spark, sf_dir):
    return versions.lineage(chain_edges(spark, sf_dir)).groupBy("src").agg(F.max("hops").alias("depth"))


@query(f"""WITH RECURSIVE e AS ({CHAIN}), b AS (SELECT src a, dst b FROM e UNION ALL SELECT dst, src FROM e), r AS (SELECT a AS id, a AS component FROM b UNION SELECT b.b, r.component FROM r JOIN b ON b.a = r.id WHERE r.component < b.b)
  SELECT id, min(component) AS component FROM r GROUP BY 1""")
def connected_components(spark, sf_dir):
    return components.connected_components(chain_edges(spark, sf_dir))


TREE = "(SELECT DISTINCT lower(p_type) || '/' || lower(p_brand) || '/' || replace(p_name, ' ', '_') AS path FROM part)"


def tree(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat_ws("/", F.lower("p_type"), F.lower("p_brand"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("path")).distinct()


@query(f"""WITH t AS {TREE}, a AS (SELECT path, string_split(path, '/')[1] AS ancestor FROM t UNION ALL SELECT path, string_split(path, '/')[1] || '/' || string_split(path, '/')[2] FROM t)
  SELECT ancestor, count(DISTINCT path)::BIGINT AS n_below, count(DISTINCT path)::BIGINT AS n_leaves FROM a GROUP BY 1""")
def prefix_join_ancestors(spark, sf_dir):
    return versions.subtree_counts(tree(spark, sf_dir), "path")


@query(f"""WITH t AS {TREE} SELECT regexp_replace(path, '/[^/]*$', '') AS parent, count(*)::BIGINT AS n_children, min(path) AS first_child FROM t GROUP BY 1""")
def hierarchy_children(spark, sf_dir):
    paths = tree(spark, sf_dir)
    return paths.groupBy(parent_path(F.col("path")).alias("parent")).agg(F.count("*").alias("n_children"), F.min("path").alias("first_child"))


@query("""SELECT p_partkey, CASE WHEN contains(p_name, ' ') THEN lower(p_type) || '/' || replace(p_name, ' ', '/') ELSE lower(p_type) || '/' || p_name END AS path FROM part""")
def normalised_paths(spark, sf_dir):
    raw = F.concat(F.lit("  /"), F.lower("p_type"), F.lit("(i1)."), F.replace("p_name", F.lit(" "), F.lit("[:].")), F.lit("/ "))
    return table(spark, sf_dir, "part").select("p_partkey", normalise_path(raw).alias("path"))


@query("""SELECT p_brand, CASE WHEN count(DISTINCT p_type) = 1 THEN CASE WHEN count(DISTINCT p_name) = 1 THEN min(p_type || '/' || p_name) ELSE min(p_type) END ELSE '' END AS prefix FROM part GROUP BY 1""")
def common_path_prefix(spark, sf_dir):
    paths = table(spark, sf_dir, "part").select("p_brand", F.concat_ws("/", "p_type", "p_name").alias("path"))
    ends = paths.groupBy("p_brand").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    return ends.select("p_brand", common_prefix(F.col("low"), F.col("high")).alias("prefix"))


VERSION = "('v' || (1 + o_orderkey % 4) || '.' || (o_orderkey % 13) || '.' || (o_orderkey % 3))"
ORDER = "(1 + o_orderkey % 4) * 10000 + (o_orderkey % 13) * 100 + o_orderkey % 3"


@query(f"""SELECT o_orderkey, {VERSION} AS version, ({ORDER} > 20902 AND {ORDER} <= 31100) AS in_range, (({ORDER}) <= 31100 AND NOT ((o_orderkey % 5 = 0) AND 30000 <= 31100)) AS active FROM orders""")
def version_predicates(spark, sf_dir):
    n = F.col("o_orderkey")
    version = F.concat(F.lit("v"), (1 + n % 4), F.lit("."), n % 13, F.lit("."), n % 3)
    deprecated = F.when(n % 5 == 0, "3.0.0")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", version.alias("version"), versions.in_range(version, F.lit("2.9.2"), F.lit("3.11.0")).alias("in_range"), versions.active_in(version, deprecated, F.lit("3.11.0")).alias("active")
    )


@query("""WITH o AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey + 1000000 * (p_partkey % 3 = 1)::BIGINT AS id, p_partkey AS was FROM part WHERE p_partkey % 3 <> 2)
  SELECT id, was AS old_key FROM n WHERE id NOT IN (SELECT id FROM o) AND was IN (SELECT id FROM o) AND was NOT IN (SELECT id FROM n)""")
def rename_detection(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    old = part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"))
    new = part.where("p_partkey % 3 <> 2").select((F.col("p_partkey") + F.when(F.col("p_partkey") % 3 == 1, 1000000).otherwise(0)).alias("id"), F.col("p_partkey").alias("was"))
    return versions.renames(old, new, "id", "was")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'breaking' WHEN event_type IN ('click', 'view') THEN 'advisory' WHEN event_type = 'purchase' THEN CASE WHEN value > 50 THEN 'breaking' ELSE 'advisory' END
  ELSE CASE WHEN value > 50 THEN 'breaking' ELSE 'informational' END END AS level FROM events""")
def breaking_levels(spark, sf_dir):
    kind = F.col("event_type")
    change = F.when(kind == "error", "path_removed").when(kind.isin("click", "view"), "lifecycle_status").when(kind == "purchase", "units").otherwise("documentation")
    unit = F.when(F.col("value") > 50, "dim_incompatible").otherwise("dim_equivalent")
    doc = F.when(F.col("value") > 50, "sign_convention").otherwise("none")
    return table(spark, sf_dir, "events").select("event_id", scores.breaking_level(change, unit, doc).alias("level"))


@query("""WITH b AS (SELECT p_partkey k, p_size v FROM part), o AS (SELECT p_partkey k, p_size + (p_partkey % 5 = 0)::INT v FROM part WHERE p_partkey % 7 <> 0), t AS (SELECT p_partkey k, p_size + (p_partkey % 3 = 0)::INT * 2 v FROM part)
  SELECT b.k AS p_partkey, CASE WHEN o.v IS NOT DISTINCT FROM b.v THEN t.v ELSE o.v END AS p_size, CASE WHEN o.v IS NOT DISTINCT FROM t.v THEN 'same' WHEN o.v IS DISTINCT FROM b.v AND t.v IS DISTINCT FROM b.v THEN 'conflict'
  WHEN t.v IS DISTINCT FROM b.v THEN 'theirs' ELSE 'ours' END AS origin FROM b LEFT JOIN o USING (k) LEFT JOIN t USING (k)""")
def three_way_merge(spark, sf_dir):
    part, k = table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("p_partkey")
    ours = part.where("p_partkey % 7 <> 0").withColumn("p_size", F.col("p_size") + F.when(k % 5 == 0, 1).otherwise(0))
    theirs = part.withColumn("p_size", F.col("p_size") + F.when(k % 3 == 0, 2).otherwise(0))
    return upsert.three_way(part, ours, theirs, "p_partkey", "p_size")


@query("""SELECT conv_id, turn, lag(role) OVER w AS parent_role, lead(role) OVER w AS next_role, count(*) OVER (PARTITION BY conv_id) - 1 AS n_siblings FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)""")
def conversation_context(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.lag("role").over(w).alias("parent_role"), F.lead("role").over(w).alias("next_role"), (F.count("*").over(Window.partitionBy("conv_id")) - 1).alias("n_siblings"))
