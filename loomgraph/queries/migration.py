"""Migration guides between two versions of the dictionary graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import migration, versions
from loomgraph.queries.graph import GRAPH, IN_RANGE, changes, edges, nodes
from loomgraph.queries.registry import query

LOW, HIGH = "3.42.0", "4.1.0"
SEARCHED = ("quantity", "coordinate")
JOINED = "SELECT n.grp, c.node_id, c.{0} FROM changes c JOIN nodes n ON n.id = c.node_id"
LEVEL = "coalesce(c.level, 'informational') AS level"
#: Versions as numbers that sort like them.
SORTABLE = "CASE {0} WHEN '3.9.0' THEN 1 WHEN '3.10.2' THEN 2 WHEN '3.42.0' THEN 3 WHEN '4.0.0' THEN 4 WHEN '4.0.1' THEN 5 WHEN '4.1.0' THEN 6 END"
REMOVED = f"""(SELECT DISTINCT n.grp, c.node_id FROM changes c JOIN nodes n ON n.id = c.node_id WHERE c.change_type = 'path_removed' AND c.version IN {IN_RANGE}
  AND NOT EXISTS (SELECT 1 FROM edges e WHERE c.node_id = e.src OR starts_with(c.node_id, e.src || '/')))"""
RENAMED = f"""(SELECT o.grp, e.src, e.dst FROM edges e JOIN nodes o ON o.id = e.src JOIN nodes n ON n.id = e.dst
  WHERE o.deprecated IN {IN_RANGE} OR n.introduced IN {IN_RANGE} OR (o.deprecated IS NULL AND n.introduced IS NULL))"""
INFERRED = """coalesce(nullif({0}, ''), nullif(regexp_extract(expression, '\\{{(\\w+_like)\\}}', 1), ''), CASE WHEN contains(expression, 'fact_psi') THEN 'psi_like'
  WHEN contains(expression, 'sigma_ip') THEN 'ip_like' WHEN contains(expression, 'sigma_b0') THEN 'b0_like' END)"""
LABELLED = f"(SELECT grp, id, {INFERRED.format('label')} AS label FROM nodes WHERE category IN ('quantity', 'coordinate') AND {INFERRED.format('label')} IS NOT NULL)"


def between(kind, columns, extra=""):
    return f"SELECT n.grp, c.node_id{columns} FROM changes c JOIN nodes n ON n.id = c.node_id WHERE c.change_type = '{kind}' AND c.version IN {IN_RANGE}{extra}"


@query(f"{GRAPH} {between('units', ', c.old_value, c.new_value, ' + LEVEL)}")
def unit_changes_between(spark, sf_dir):
    return migration.changes_between(changes(spark, sf_dir), nodes(spark, sf_dir), LOW, HIGH, "units").select("grp", "node_id", "old_value", "new_value", "level")


@query(f"{GRAPH} {between('data_type', ', c.old_value, c.new_value')}")
def type_changes_between(spark, sf_dir):
    return migration.changes_between(changes(spark, sf_dir), nodes(spark, sf_dir), LOW, HIGH, "data_type").select("grp", "node_id", "old_value", "new_value")


@query(f"{GRAPH} {between('path_added', '')}")
def additions_between(spark, sf_dir):
    return migration.changes_between(changes(spark, sf_dir), nodes(spark, sf_dir), LOW, HIGH, "path_added").select("grp", "node_id")


@query(f"{GRAPH} SELECT * FROM {REMOVED}")
def removals_between(spark, sf_dir):
    return migration.removals_between(changes(spark, sf_dir), nodes(spark, sf_dir), edges(spark, sf_dir), LOW, HIGH)


@query(f"{GRAPH} {between('documentation', ', c.semantic_type, c.version, ' + LEVEL, chr(32) + "AND c.semantic_type IN ('sign_convention', 'coordinate_convention', 'data_format_change')")}")
def semantic_changes_between(spark, sf_dir):
    return migration.semantic_changes(changes(spark, sf_dir), nodes(spark, sf_dir), LOW, HIGH).select("grp", "node_id", "semantic_type", "version", "level")


@query(f"{GRAPH} SELECT * FROM {RENAMED}")
def renames_between(spark, sf_dir):
    return migration.renames_between(edges(spark, sf_dir), nodes(spark, sf_dir), LOW, HIGH)


@query(f"""{GRAPH}, walk AS (SELECT src, dst, [src, dst] AS path FROM edges UNION ALL SELECT w.src, e.dst, list_append(w.path, e.dst) FROM walk w JOIN edges e ON e.src = w.dst WHERE len(w.path) <= 10)
  SELECT w.src, w.dst, (len(path) - 1)::INT AS hops, (SELECT string_agg(n.id || '@' || coalesce(n.introduced, '?'), ' ' ORDER BY u.i) FROM (SELECT unnest(w.path) AS id, unnest(range(len(w.path))) AS i) u JOIN nodes n ON n.id = u.id) AS chain
  FROM walk w JOIN nodes a ON a.id = w.src JOIN nodes z ON z.id = w.dst WHERE len(path) > 2
  AND coalesce(a.introduced IN ('3.9.0', '3.10.2', '3.42.0'), true) AND coalesce(a.deprecated NOT IN ('3.9.0', '3.10.2', '3.42.0'), true) AND z.deprecated IS NULL""")
def lineages_between(spark, sf_dir):
    out = migration.lineages_between(edges(spark, sf_dir), nodes(spark, sf_dir), LOW, HIGH)
    text = F.transform("chain", lambda x: F.concat(x["id"], F.lit("@"), F.coalesce(x["introduced"], F.lit("?"))))
    return out.select("src", "dst", "hops", F.array_join(text, " ").alias("chain"))


@query(f"{GRAPH} SELECT grp, id, label, 'xml' AS source FROM {LABELLED}")
def labelled_nodes(spark, sf_dir):
    return migration.labelled_nodes(nodes(spark, sf_dir), SEARCHED)


@query(f"""{GRAPH}, f AS (SELECT id, CASE k % 4 WHEN 0 THEN 'b0_like' WHEN 1 THEN 'q_like' END AS forward FROM nodes)
  SELECT * FROM (SELECT n.id, coalesce(nullif(n.label, ''), f.forward, {INFERRED.format('NULL')}, CASE WHEN n.k % 10 = 0 THEN 'psi_like' END) AS label,
    CASE WHEN nullif(n.label, '') IS NOT NULL THEN 'xml' WHEN f.forward IS NOT NULL THEN 'forward_ported' WHEN {INFERRED.format('NULL')} IS NOT NULL THEN 'expression' WHEN n.k % 10 = 0 THEN 'sign_flip' END AS source
    FROM nodes n JOIN f ON f.id = n.id) WHERE label IS NOT NULL""")
def label_backfill(spark, sf_dir):
    """Nodes divisible by four had another label in the last version but one, which must not win."""
    own = nodes(spark, sf_dir)
    reference = own.select("id", F.explode(F.expr("""CASE k % 4 WHEN 0 THEN array(struct('3.42.0' AS version, 'b0_like' AS label), struct('3.9.0' AS version, 'ip_like' AS label)) WHEN 1 THEN array(struct('3.42.0' AS version, 'q_like' AS label))
      ELSE array(struct('3.42.0' AS version, CAST(NULL AS STRING) AS label)) END""")).alias("r")).select("id", "r.*")
    return migration.backfilled_labels(own, reference, own.where("k % 10 = 0"))


@query(f"""{GRAPH}, r AS (SELECT node_id, version, change_type, row_number() OVER (PARTITION BY node_id ORDER BY {SORTABLE.format('version')}, id) AS place, count(*) OVER (PARTITION BY node_id) AS n FROM changes)
  SELECT o.id, coalesce(max(r.n), 0)::BIGINT AS n_changes, coalesce(string_agg(r.version || ' ' || r.change_type, '; ' ORDER BY place), '') AS changes FROM nodes o LEFT JOIN (SELECT * FROM r WHERE place <= 20) r ON r.node_id = o.id GROUP BY o.id""")
def change_history(spark, sf_dir):
    out = migration.history(changes(spark, sf_dir), nodes(spark, sf_dir))
    return out.withColumn("changes", F.array_join("changes", "; "))


@query(f"""{GRAPH}, r AS (SELECT node_id, version, change_type, row_number() OVER (PARTITION BY node_id ORDER BY {SORTABLE.format('version')}, id) AS place, count(*) OVER (PARTITION BY node_id) AS n FROM changes)
  SELECT o.id, coalesce(max(r.n), 0)::BIGINT AS n_changes, coalesce(string_agg(r.version || ' ' || r.change_type, '; ' ORDER BY place), '') AS changes FROM nodes o LEFT JOIN (SELECT * FROM r WHERE place <= 5) r ON r.node_id = o.id WHERE o.k < 100 GROUP BY o.id""")
def hit_version_context(spark, sf_dir):
    """Beside a report's hits: five changes and the true count."""
    hits = nodes(spark, sf_dir).where("k < 100")
    out = migration.history(changes(spark, sf_dir), hits, migration.CONTEXT_ROWS)
    return out.withColumn("changes", F.array_join("changes", "; "))


@query(f"""{GRAPH} SELECT node_id, version, id, level FROM ({between('units', ', c.version, c.id, ' + LEVEL)}) ORDER BY {SORTABLE.format('version')}, node_id, id LIMIT 200""")
def bulk_changes(spark, sf_dir):
    return migration.bulk_changes(changes(spark, sf_dir), nodes(spark, sf_dir), LOW, HIGH, "units").select("node_id", "version", "id", "level")


@query(f"""{GRAPH}, walk AS (SELECT src, dst, 1 AS hops FROM edges UNION ALL SELECT w.src, e.dst, hops + 1 FROM walk w JOIN edges e ON e.src = w.dst WHERE hops < 10)
  SELECT src AS id, dst AS final, hops::INT AS hops FROM walk WHERE dst NOT IN (SELECT src FROM edges)""")
def final_names(spark, sf_dir):
    return migration.final_names(edges(spark, sf_dir))


@query(f"""{GRAPH}, a AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY {SORTABLE.format('version')}, id) AS place FROM changes WHERE change_type = 'path_added')
  SELECT id, node_id, change_type, version FROM changes WHERE change_type <> 'path_added' UNION ALL SELECT id, node_id, change_type, version FROM a WHERE place = 1""")
def change_event_sink(spark, sf_dir):
    return migration.first_additions(changes(spark, sf_dir)).select("id", "node_id", "change_type", "version")


@query(f"""{GRAPH} {between('units', ", c.old_value, c.new_value").replace('SELECT n.grp, c.node_id, c.old_value, c.new_value', "SELECT 'units' AS section, n.grp, c.node_id AS id, coalesce(c.old_value, 'none') || ' -> ' || coalesce(c.new_value, 'none') AS detail")}
  UNION ALL {between('data_type', '').replace('SELECT n.grp, c.node_id', "SELECT 'types', n.grp, c.node_id, coalesce(c.old_value, 'none') || ' -> ' || coalesce(c.new_value, 'none')")}
  UNION ALL SELECT 'removed', grp, node_id, '' FROM {REMOVED} UNION ALL {between('path_added', '').replace('SELECT n.grp, c.node_id', "SELECT 'added', n.grp, c.node_id, ''")}
  UNION ALL {between('documentation', '', " AND c.semantic_type IN ('sign_convention', 'coordinate_convention')").replace('SELECT n.grp, c.node_id', "SELECT 'meaning', n.grp, c.node_id, c.semantic_type")}
  UNION ALL SELECT 'renamed', grp, src, dst FROM {RENAMED} UNION ALL SELECT 'labels', grp, id, label FROM {LABELLED}""")
def migration_guide(spark, sf_dir):
    return migration.guide(changes(spark, sf_dir), nodes(spark, sf_dir), edges(spark, sf_dir), LOW, HIGH, SEARCHED)


@query(f"""{GRAPH} SELECT id, array_to_string(list_filter([CASE WHEN k % 2 = 0 THEN 'unit' END, CASE WHEN k % 3 = 0 THEN 'text' END], lambda x: x IS NOT NULL), ',') AS sections FROM nodes""")
def embedding_text_changes(spark, sf_dir):
    """Sections of a text that changed between two builds."""
    own = nodes(spark, sf_dir)
    old = F.concat(F.lit("unit: m\ntext: "), F.col("doc"), F.lit("\n"))
    new = F.concat(F.lit("unit: "), F.when(F.col("k") % 2 == 0, "T").otherwise("m"), F.lit("\ntext: "), F.when(F.col("k") % 3 == 0, "new").otherwise(F.col("doc")), F.lit("\n"))
    changed = migration.changed_sections(old, new, {"unit": r"unit: ([^\n]*)", "text": r"text: ([^\n]*)"})
    return own.select("id", F.array_join(changed, ",").alias("sections"))


@query(f"{GRAPH} SELECT id, introduced FROM nodes WHERE coalesce(introduced IN ('3.9.0', '3.10.2', '3.42.0'), true) AND coalesce(deprecated NOT IN ('3.9.0', '3.10.2', '3.42.0'), true)")
def alive_nodes(spark, sf_dir):
    return migration.alive(nodes(spark, sf_dir), LOW).select("id", "introduced")


@query(f"{GRAPH} SELECT node_id, version FROM changes WHERE change_type = 'path_removed' GROUP BY 1, 2")
def deprecation_edges(spark, sf_dir):
    """A sink: one edge for each path and version it was removed in."""
    return changes(spark, sf_dir).where("change_type = 'path_removed'").select("node_id", "version").distinct()


@query("""SELECT v AS version, row_number() OVER (ORDER BY n)::INT AS place FROM (SELECT DISTINCT CASE event_id % 6 WHEN 0 THEN '3.9.0' WHEN 1 THEN '3.42.0' WHEN 2 THEN '4.0.0' WHEN 3 THEN '4.1.0' WHEN 4 THEN '4.0.1' ELSE '3.10.2' END AS v,
  CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 6 WHEN 4 THEN 5 ELSE 2 END AS n FROM events)""")
def version_catalogue(spark, sf_dir):
    """All versions in their order; there are few of them, so one task ranks them."""
    from pyspark.sql import Window

    found = changes(spark, sf_dir).select("version").distinct()
    return found.select("version", F.row_number().over(Window.orderBy(versions.semver(F.col("version")))).alias("place"))


PRESENT = """p AS (SELECT DISTINCT k, CASE version WHEN '3.9.0' THEN 1 WHEN '3.10.2' THEN 2 WHEN '3.42.0' THEN 3 WHEN '4.0.0' THEN 4 WHEN '4.0.1' THEN 5 ELSE 6 END AS v FROM changes WHERE level = 'breaking')"""


@query(f"""{GRAPH}, {PRESENT} SELECT a.k, a.v::INT AS place, 'added' AS change FROM p a WHERE a.v > 1 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.k = a.k AND b.v = a.v - 1)
  UNION ALL SELECT a.k, (a.v + 1)::INT, 'removed' FROM p a WHERE a.v < 6 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.k = a.k AND b.v = a.v + 1)""")
def presence_changes(spark, sf_dir):
    """Keys that came or went from each version to the next one, of all that have both."""
    c = changes(spark, sf_dir)
    present = c.where("level = 'breaking'").select("k", "version")
    return versions.presence_changes(present, c.select("version"), "k")


FIELDS = ("category", "dtype", "unit", "introduced", "deprecated", "label", "expression", "doc", "domain", "parent", "name")


@query(f"""{GRAPH}, m AS (SELECT k, {', '.join(f"CASE WHEN k % 13 = {i} THEN 'new' ELSE {f} END AS {f}" for i, f in enumerate(FIELDS))} FROM nodes WHERE k % 17 > 0 UNION ALL SELECT -1, {', '.join("'x'" for _ in FIELDS)})
  SELECT k, 'removed' AS change, NULL AS field, NULL AS old_value, NULL AS new_value FROM nodes WHERE k NOT IN (SELECT k FROM m) UNION ALL SELECT k, 'added', NULL, NULL, NULL FROM m WHERE k NOT IN (SELECT k FROM nodes)
  {' '.join(f"UNION ALL SELECT m.k, 'changed', '{f}', n.{f}, m.{f} FROM m JOIN nodes n ON n.k = m.k WHERE n.{f} IS DISTINCT FROM m.{f}" for f in FIELDS)}""")
def full_diff(spark, sf_dir):
    """A diff of two versions over eleven fields."""
    old = nodes(spark, sf_dir).select("k", *FIELDS)
    new = old.where("k % 17 > 0").select("k", *[F.when(F.col("k") % 13 == i, "new").otherwise(F.col(f)).alias(f) for i, f in enumerate(FIELDS)])
    new = new.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("k"), *[F.lit("x").alias(f) for f in FIELDS]))
    return versions.diff(old, new, "k", FIELDS)
