"""A dictionary graph made from the tables: parts are nodes, events are their changes, neighbouring parts are renames.

``nodes()`` and the like build the tables; NODES and the like say the same in SQL, for the queries' oracles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.plans.shared import table

BRAND = "lower(replace(p_brand, '#', '_'))"
#: Of parts: (k, grp, parent, name, id, category, dtype, unit, introduced, deprecated, label, expression, doc, domain).
NODE_COLUMNS = {
    "k": "p_partkey",
    "grp": "lower(p_type)",
    "parent": f"concat(lower(p_type), '/', {BRAND})",
    "name": "concat(replace(p_name, ' ', '_'), CASE WHEN p_partkey % 11 = 0 THEN '_error_upper' ELSE '' END)",
    "id": f"concat(lower(p_type), '/', {BRAND}, '/', replace(p_name, ' ', '_'), '_', p_partkey)",
    "category": "CASE p_size % 5 WHEN 0 THEN 'coordinate' WHEN 1 THEN 'structural' WHEN 2 THEN 'error' ELSE 'quantity' END",
    "dtype": "CASE p_size % 4 WHEN 0 THEN 'FLT_1D' WHEN 1 THEN 'INT_0D' WHEN 2 THEN 'STRUCTURE' ELSE 'STR_0D' END",
    "unit": "CASE p_size % 6 WHEN 0 THEN 'm' WHEN 1 THEN 'eV' WHEN 2 THEN '-' WHEN 3 THEN 'T' WHEN 4 THEN 'Pa' END",
    "introduced": "CASE p_partkey % 5 WHEN 0 THEN '3.9.0' WHEN 1 THEN '3.42.0' WHEN 2 THEN '4.0.0' WHEN 3 THEN '4.1.0' END",
    "deprecated": "CASE p_partkey % 7 WHEN 0 THEN '4.0.0' WHEN 3 THEN '3.10.2' WHEN 5 THEN '4.1.0' END",
    "label": "CASE WHEN p_size % 9 = 0 THEN 'psi_like' WHEN p_size % 9 = 1 THEN '' END",
    "expression": "CASE p_size % 8 WHEN 1 THEN '.{ip_like}' WHEN 2 THEN 'x*fact_psi' WHEN 3 THEN 'sigma_b0' WHEN 4 THEN 'none' END",
    "doc": "concat(p_name, ' of ', lower(p_type), ', in ', CAST(p_size AS {text}))",
    "domain": "CASE WHEN p_partkey % 6 < 5 THEN concat('domain_', CAST(p_partkey % 6 AS {text})) END",
}
NODES = "nodes AS (SELECT " + ", ".join(f"{v.replace('{text}', 'VARCHAR')} AS {k}" for k, v in NODE_COLUMNS.items()) + " FROM part)"
#: Of events: changes of nodes. Over a node's number, events are dealt to parts by their own.
CHANGE_COLUMNS = {
    "id": "event_id",
    "k": "event_id % 97",
    "version": "CASE event_id % 6 WHEN 0 THEN '3.9.0' WHEN 1 THEN '3.42.0' WHEN 2 THEN '4.0.0' WHEN 3 THEN '4.1.0' WHEN 4 THEN '4.0.1' ELSE '3.10.2' END",
    "change_type": "CASE event_type WHEN 'click' THEN 'units' WHEN 'view' THEN 'data_type' WHEN 'error' THEN 'path_removed' WHEN 'purchase' THEN 'documentation' ELSE 'path_added' END",
    "level": "CASE WHEN value > 90 THEN 'breaking' WHEN value > 50 THEN 'advisory' END",
    "semantic_type": "CASE event_id % 4 WHEN 0 THEN 'sign_convention' WHEN 1 THEN 'coordinate_convention' WHEN 2 THEN 'none' END",
    "old_value": "CASE event_id % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'eV' END",
    "new_value": "CASE event_id % 5 WHEN 0 THEN 'T' WHEN 1 THEN 'm' ELSE 'Pa' END",
}
CHANGES = "changes AS (SELECT c.*, n.id AS node_id FROM (SELECT " + ", ".join(f"{v} AS {k}" for k, v in CHANGE_COLUMNS.items()) + " FROM events) c JOIN nodes n ON n.k = c.k)"
#: Renames: a part whose number is no multiple of 7 less one gave way to the next one.
EDGES = "edges AS (SELECT a.id AS src, b.id AS dst FROM nodes a JOIN nodes b ON b.k = a.k + 1 WHERE a.k % 7 <> 6)"
GRAPH = f"WITH RECURSIVE {NODES}, {CHANGES}, {EDGES}"
IN_RANGE = "('4.0.0', '4.0.1', '4.1.0')"


def nodes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(*[F.expr(v.replace("{text}", "STRING")).alias(k) for k, v in NODE_COLUMNS.items()]).withColumn("label_source", F.lit(None).cast("string"))


def changes(spark, sf_dir):
    each = table(spark, sf_dir, "events").select(*[F.expr(v).alias(k) for k, v in CHANGE_COLUMNS.items()])
    return each.join(nodes(spark, sf_dir).select("k", F.col("id").alias("node_id")), "k")


def edges(spark, sf_dir):
    own = nodes(spark, sf_dir).select("k", "id")
    later = own.select((F.col("k") - 1).alias("k"), F.col("id").alias("dst"))
    return own.where("k % 7 <> 6").join(later, "k").select(F.col("id").alias("src"), "dst")
