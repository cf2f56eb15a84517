"""Entities, units and identifiers in the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import extraction, paths, scores, units
from loomgraph.plans.shared import table
from loomgraph.queries.registry import query
from loomgraph.sources import files

UNIT_SQL = extraction.UNIT.replace("'", "''")


@query(f"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g'), '{UNIT_SQL}'))), ',') AS units FROM documents""")
def extract_units(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(extraction.units(F.col("text")), ",").alias("units"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(upper(text), '\\b[A-Z][A-Z0-9]{1,7}/[A-Z][A-Z0-9_]{0,9}\\b'), lambda x: x LIKE 'AN/%' OR x LIKE 'THE/%'))), ',') AS pairs FROM documents""")
def extract_pairs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(extraction.pair_paths(F.upper("text"), ["an", "the"]), ",").alias("pairs"))


@query("""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)\\bpassword\\b') THEN 'password' END, CASE WHEN contains(text, 'token =') THEN 'token =' END) AS tools FROM documents""")
def tool_mentions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(extraction.tool_mentions(F.col("text"), ["password"], ["token ="]), ",").alias("tools"))


@query()
def convention_context(spark, sf_dir):
    """Every mention of a convention or sign with fifty characters on either side."""
    both = F.concat(extraction.with_context(F.col("text"), extraction.CONVENTION), extraction.with_context(F.col("text"), extraction.SIGN))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(both).alias("m")).select("doc_id", "m.name", "m.context")


KIND = "CASE p_size % 4 WHEN 0 THEN 'm/s' WHEN 1 THEN 'J.m^-3' WHEN 2 THEN 'mixed' ELSE 'W' END"
NEW = "CASE p_size % 3 WHEN 0 THEN 'm.s^-1' WHEN 1 THEN 'Pa' ELSE 'Wb' END"


@query(f"""SELECT p_partkey, CASE WHEN a IS NULL THEN 'sentinel_resolved' WHEN a = b THEN 'cosmetic' WHEN a = 'J.m^-3' AND b = 'Pa' THEN 'dim_equivalent' ELSE 'dim_incompatible' END AS kind FROM
  (SELECT p_partkey, CASE {KIND} WHEN 'm/s' THEN 'm.s^-1' WHEN 'mixed' THEN NULL ELSE {KIND} END AS a, {NEW} AS b FROM part)""")
def unit_changes(spark, sf_dir):
    n = F.col("p_size")
    old = F.when(n % 4 == 0, "m/s").when(n % 4 == 1, "J.m^-3").when(n % 4 == 2, "mixed").otherwise("W")
    new = F.when(n % 3 == 0, "m.s^-1").when(n % 3 == 1, "Pa").otherwise("Wb")
    return table(spark, sf_dir, "part").select("p_partkey", units.change_kind(old, new).alias("kind"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, CASE WHEN url LIKE '%?%' THEN true ELSE false END AS has_query FROM pages""")
def page_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.contains("url", F.lit("?")).alias("has_query"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'python' WHEN event_id % 5 = 1 THEN 'fortran' END AS language, CASE event_id % 5 WHEN 0 THEN 'code' WHEN 1 THEN 'code' WHEN 2 THEN 'notebook' WHEN 3 THEN 'document' ELSE 'other' END AS kind FROM events""")
def file_kinds(spark, sf_dir):
    n = F.col("event_id")
    path = F.concat(F.lit("src/x"), n, F.when(n % 5 == 0, ".py").when(n % 5 == 1, ".F90").when(n % 5 == 2, ".ipynb").when(n % 5 == 3, ".pdf").otherwise(".bin"))
    return table(spark, sf_dir, "events").select("event_id", files.language(path).alias("language"), files.file_kind(path).alias("kind"))


@query("""SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS key, CASE WHEN p_size > 10 THEN 'high' WHEN p_size > 5 THEN 'medium' ELSE 'low' END AS significance FROM part""")
def name_keys(spark, sf_dir):
    raw = F.concat(F.lit("__"), F.upper(F.replace("p_name", F.lit(" "), F.lit("___"))), F.lit("_"))
    return table(spark, sf_dir, "part").select("p_partkey", paths.name_key(raw).alias("key"), scores.significance(F.col("p_size")).alias("significance"))


@query("""SELECT min(a.doc_id) AS doc_id, a.lang, count(*)::BIGINT AS copies FROM documents a GROUP BY a.lang, sha256(a.text)""")
def content_identity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", paths.content_hash(F.col("text"), 64).alias("hash"))
    return docs.groupBy("lang", "hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("hash")


@query("""SELECT lang, source, count(*)::BIGINT AS documents, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest, count(l.doc_id)::BIGINT AS labelled, coalesce(sum(quality), 0)::BIGINT AS good FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL""")
def catalog_counts(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").drop("text"), table(spark, sf_dir, "labels").withColumn("has", F.lit(1))
    joined = docs.join(labels, "doc_id", "left")
    return joined.groupBy("lang", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"), F.count("has").alias("labelled"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"))


@query("""SELECT lang, avg(n_chars) IS NOT NULL AS any, round(quantile_cont(n_chars, 0.5), 4)::DOUBLE AS median FROM documents GROUP BY 1""")
def length_medians(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.avg("n_chars").isNotNull().alias("any"), F.round(F.percentile("n_chars", 0.5), 4).alias("median"))


@query("""SELECT c_custkey, n_orders::BIGINT AS n_orders, place::INT AS place FROM (SELECT c_custkey, n_orders, row_number() OVER (ORDER BY n_orders DESC, c_custkey) AS place FROM (SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)) WHERE place <= 20""")
def most_connected(spark, sf_dir):
    """The twenty customers with most orders: a top-k report."""
    from pyspark.sql import Window

    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(counts, "c_custkey", "left").fillna(0, ["n_orders"])
    top = joined.orderBy(F.desc("n_orders"), "c_custkey").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_orders"), "c_custkey")))
