"""Path batches, resolvers, links and neighbours over the dictionary graph and the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions.paths import normalise_path
from loomgraph.operators import lookup
from loomgraph.plans.shared import cut, join_dealt, table
from loomgraph.queries.graph import GRAPH, changes, edges, nodes
from loomgraph.queries.registry import query

#: Paths asked for: every seventh node's, some of them misspelt or of a misspelt group.
ASKED = "CASE k % 4 WHEN 0 THEN id WHEN 1 THEN replace(id, '_', '-') WHEN 2 THEN concat('x', id) ELSE concat(id, '/none') END"
# The plain ratio by the longest common subsequence, whose table's rows are the bits of one number; ids here have no words, and parts never win.
BITS = "list_reduce(list_prepend((1::HUGEINT << length({0})) - 1, list_transform(string_split({1}, ''), lambda c: coalesce({2}[c], 0::HUGEINT))), lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::HUGEINT << length({0})) - 1))"
RATIO = "round(200.0::DOUBLE * (length({0}) - bit_count(" + BITS + ")) / (length({0}) + length({1})), 6)"
PLACES = "map_from_entries([(c, list_sum([1::HUGEINT << (i - 1) FOR i IN range(1, length({0}) + 1) IF {0}[i] = c])::HUGEINT) FOR c IN list_distinct(string_split({0}, ''))])"
SUGGESTED = f"""asked AS (SELECT DISTINCT {ASKED} AS path FROM nodes WHERE k % 7 = 3), f AS (SELECT path, string_split(path, '/')[1] AS grp FROM asked WHERE path NOT IN (SELECT id FROM nodes)),
  g AS (SELECT DISTINCT grp FROM nodes), u AS (SELECT grp AS was, {PLACES.format('grp')} AS m FROM (SELECT DISTINCT grp FROM f WHERE grp NOT IN (SELECT grp FROM g))),
  x AS (SELECT was, arg_min(grp, (-r, grp)) AS grp FROM (SELECT was, grp, {RATIO.format('was', 'grp', 'm')} AS r FROM u, g) WHERE r >= 60 GROUP BY 1),
  c AS (SELECT path, w, grp, {PLACES.format('w')} AS m FROM (SELECT f.path, coalesce(x.grp, f.grp) AS grp, coalesce(x.grp, f.grp) || substr(f.path, length(f.grp) + 1) AS w FROM f LEFT JOIN x ON x.was = f.grp)),
  s AS (SELECT path, id, row_number() OVER (PARTITION BY path ORDER BY r DESC, id) AS place FROM (SELECT c.path, n.id, {RATIO.format('w', 'n.id', 'm')} AS r FROM c JOIN nodes n ON n.grp = c.grp) WHERE r >= 50)"""


def asked(spark, sf_dir):
    return nodes(spark, sf_dir).where("k % 7 = 3").select(F.expr(ASKED).alias("path")).distinct()


@query(f"{GRAPH}, {SUGGESTED} SELECT path, string_agg(id, ' ' ORDER BY place) AS suggestions FROM s WHERE place <= 3 GROUP BY 1")
def suggest_paths(spark, sf_dir):
    """Nearest ids by weighted ratio in the same group, after a misspelt group is corrected."""
    own = nodes(spark, sf_dir)
    missing = asked(spark, sf_dir).join(own.select(F.col("id").alias("path")), "path", "left_anti")
    return lookup.suggest_paths(missing, own).withColumn("suggestions", F.array_join("suggestions", " "))


@query(f"""{GRAPH}, {SUGGESTED}, a AS (SELECT path FROM asked UNION SELECT src FROM edges),
  t AS (SELECT * FROM nodes WHERE coalesce(introduced <> '4.1.0', true) AND coalesce(deprecated NOT IN ('3.10.2', '4.0.0'), true)),
  r AS (SELECT src, min(dst) AS dst FROM edges GROUP BY 1)
  SELECT a.path, coalesce((SELECT string_agg(s.id, ' ' ORDER BY place) FROM s WHERE s.path = a.path AND place <= 3 AND t.id IS NULL AND r.dst IS NULL), '') AS suggestions, t.id IS NOT NULL AS found, t.grp, t.dtype, t.unit, CASE WHEN t.id IS NULL THEN r.dst END AS renamed_to, CASE WHEN t.id IS NULL THEN (SELECT introduced FROM nodes n WHERE n.id = r.dst) END AS rename_version
  FROM a LEFT JOIN t ON t.id = a.path LEFT JOIN r ON r.src = a.path""")
def check_paths(spark, sf_dir):
    """Existence in a version, renames, and for the rest suggestions (see suggest_paths)."""
    own, renames = nodes(spark, sf_dir), edges(spark, sf_dir)
    paths = asked(spark, sf_dir).union(renames.select("src")).distinct()
    return lookup.check_paths(paths, own, renames, F.lit("4.0.1")).withColumn("suggestions", F.array_join("suggestions", " "))


@query(f"""{GRAPH}, p AS (SELECT DISTINCT parent AS prefix FROM nodes UNION SELECT DISTINCT grp FROM nodes UNION SELECT 'none'),
  u AS (SELECT p.prefix, n.id, row_number() OVER (PARTITION BY p.prefix ORDER BY n.id) AS place FROM p JOIN nodes n ON (n.id = p.prefix OR starts_with(n.id, p.prefix || '/')) AND n.dtype NOT IN ('STRUCTURE', 'STRUCT_ARRAY'))
  SELECT p.prefix, count(u.id)::BIGINT AS n, coalesce(string_agg(u.id, ' ' ORDER BY place) FILTER (place <= 10), '') AS paths FROM p LEFT JOIN u ON u.prefix = p.prefix GROUP BY 1""")
def list_paths(spark, sf_dir):
    own = nodes(spark, sf_dir)
    prefixes = own.select(F.col("parent").alias("prefix")).union(own.select("grp")).union(spark.range(1).select(F.lit("none")))
    return lookup.list_paths(own, prefixes, 10, leaf_only=True).withColumn("paths", F.array_join("paths", " "))


@query(f"""{GRAPH} SELECT n.id, n.doc, coalesce((SELECT string_agg(DISTINCT c.version, ' ' ORDER BY c.version) FROM changes c WHERE c.node_id = n.id), '') AS versions,
  coalesce((SELECT string_agg(DISTINCT e.dst, ' ' ORDER BY e.dst) FROM edges e WHERE e.src = n.id), '') AS successors, coalesce((SELECT string_agg(DISTINCT e.src, ' ' ORDER BY e.src) FROM edges e WHERE e.dst = n.id), '') AS predecessors,
  coalesce((SELECT string_agg(DISTINCT c.change_type, ' ' ORDER BY c.change_type) FROM changes c WHERE c.node_id = n.id AND c.level = 'breaking'), '') AS breaking,
  coalesce((SELECT string_agg(DISTINCT s.name, ' ' ORDER BY s.name) FROM nodes s WHERE s.parent = n.parent), '') AS siblings FROM nodes n WHERE n.k % 3 = 0""")
def fetch_paths(spark, sf_dir):
    """Point lookups of a batch with five optional lists."""
    own, events, renames = nodes(spark, sf_dir), changes(spark, sf_dir).withColumnRenamed("id", "event").withColumnRenamed("node_id", "id"), edges(spark, sf_dir)
    asked_for = own.where("k % 3 = 0").select("id", "doc", "parent")
    siblings = asked_for.select("id", "parent").join(own.select("parent", "name").distinct(), "parent")
    out = lookup.gathered(asked_for, "id", {
        "versions": (events, F.col("version")),
        "successors": (renames.withColumnRenamed("src", "id"), F.col("dst")),
        "predecessors": (renames.withColumnRenamed("dst", "id"), F.col("src")),
        "breaking": (events.where("level = 'breaking'"), F.col("change_type")),
        "siblings": (siblings, F.col("name")),
    })
    return out.select("id", "doc", *[F.array_join(c, " ").alias(c) for c in ("versions", "successors", "predecessors", "breaking", "siblings")])


@query(f"""{GRAPH} SELECT b.id AS base, e.id, regexp_extract(e.name, '_error_(\\w+)$', 1) AS error_type FROM nodes e JOIN nodes b ON b.parent = e.parent AND e.name = b.name || '_error_upper'""")
def error_fields(spark, sf_dir):
    """Error fields with the field of the same parent they belong to."""
    return lookup.error_edges(nodes(spark, sf_dir))


@query(f"{GRAPH} SELECT id, CASE WHEN k % 13 = 0 THEN 'metadata' WHEN k % 17 = 0 THEN 'ggd' WHEN k % 11 = 0 THEN 'error_field' END AS reason FROM nodes")
def exclusion_reasons(spark, sf_dir):
    path = F.expr("concat(grp, CASE WHEN k % 13 = 0 THEN '/code' ELSE '' END, CASE WHEN k % 17 = 0 THEN '/GGD' ELSE '' END, '/', name)")
    return nodes(spark, sf_dir).select("id", lookup.exclusion_reason(path).alias("reason"))


@query(f"""{GRAPH}, q AS (SELECT DISTINCT v AS q FROM (SELECT unnest([domain, grp, 'main_' || (k % 3), 'mo', 'zzz']) AS v FROM nodes) WHERE v IS NOT NULL)
  SELECT q, CASE WHEN q IN (SELECT domain FROM nodes) THEN 'exact' WHEN q IN (SELECT grp FROM nodes) THEN 'group' WHEN EXISTS (SELECT 1 FROM nodes WHERE contains(domain, q)) THEN 'substring' ELSE 'no_match' END AS method,
    coalesce(CASE WHEN q IN (SELECT domain FROM nodes) THEN q WHEN q IN (SELECT grp FROM nodes) THEN (SELECT string_agg(DISTINCT domain, ' ' ORDER BY domain) FROM nodes n WHERE n.grp = q.q) ELSE (SELECT string_agg(DISTINCT domain, ' ' ORDER BY domain) FROM nodes n WHERE contains(domain, q.q)) END, '') AS matches FROM q""")
def resolve_domains(spark, sf_dir):
    """A domain by its name, else by a group's name, else by a part of it."""
    own = nodes(spark, sf_dir)
    names = own.select(F.explode(F.array("domain", "grp", F.concat(F.lit("main_"), F.col("k") % 3), F.lit("mo"), F.lit("zzz"))).alias("q")).where("q is not null").distinct()
    domains = own.select(F.col("domain").alias("key"), F.col("domain").alias("value")).distinct()
    groups = own.select(F.col("grp").alias("key"), F.col("domain").alias("value")).distinct()
    out = lookup.resolve(names, "q", [("exact", domains, "equal"), ("group", groups, "equal"), ("substring", domains, "within")])
    return out.withColumn("matches", F.array_join("matches", " "))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a/b c/' || p_partkey WHEN 1 THEN 'a/b c/' || p_partkey ELSE 'a/b x' END AS paths FROM part""")
def path_lists(spark, sf_dir):
    """Requests as JSON, with commas, and with white space; dots become slashes."""
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit('["a.b(i1)", "", " c/'), k, F.lit('"]'))).when(k % 3 == 1, F.concat(F.lit(" a/b,,c/"), k)).otherwise(F.lit("a/b   x "))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(lookup.path_list(text, normalise_path), " ").alias("paths"))


RULES = [("skip_rings", "*ring*", None), ("blue_unit", "*/blue_*", "K"), ("one_char", "small/brand_?/*", "s")]


@query(f"""{GRAPH} SELECT id, CASE WHEN contains(id, 'ring') THEN 'skip_rings' WHEN contains(id, '/blue_') THEN 'blue_unit' WHEN regexp_matches(id, '^small/brand_./') THEN 'one_char' END AS rule,
  CASE WHEN contains(id, 'ring') THEN unit WHEN contains(id, '/blue_') THEN 'K' WHEN regexp_matches(id, '^small/brand_./') THEN 's' ELSE unit END AS unit FROM nodes""")
def unit_overrides(spark, sf_dir):
    """The first rule whose pattern an id matches gives another unit, or says to skip the node."""
    return lookup.ruled(nodes(spark, sf_dir), F.col("id"), RULES).select("id", "rule", F.coalesce("given", "unit").alias("unit"))


@query(f"""{GRAPH} SELECT id, CASE WHEN unit = '-' THEN 'mixed_unit' WHEN contains(id, 'ring') THEN 'denied' END AS reason FROM nodes WHERE unit = '-' OR contains(id, 'ring')""")
def rejected_candidates(spark, sf_dir):
    """The side output: what a deny rule or a unit keeps out, and why."""
    hit = lookup.ruled(nodes(spark, sf_dir), F.col("id"), RULES[:1])
    reason = F.when(F.col("unit") == "-", "mixed_unit").when(F.col("rule").isNotNull(), "denied")
    return lookup.split_rejected(hit, reason)[1].select("id", "reason")


@query(f"""{GRAPH}, m AS (SELECT n.*, row_number() OVER (PARTITION BY grp, unit ORDER BY id) AS place FROM nodes n WHERE category = 'quantity' AND coalesce(unit <> '-', true) AND id NOT IN (SELECT src FROM edges WHERE src IS NOT NULL))
  SELECT grp, unit, count(*)::BIGINT AS n, string_agg(id, ' ' ORDER BY id) FILTER (place <= 20) AS ids FROM m GROUP BY 1, 2""")
def candidate_batches(spark, sf_dir):
    """Quantities not renamed away, in batches by group and unit: size and first ids."""
    from pyspark.sql import Window

    own = nodes(spark, sf_dir).where("category = 'quantity' and coalesce(unit <> '-', true)").join(edges(spark, sf_dir).select(F.col("src").alias("id")), "id", "left_anti")
    placed = own.withColumn("place", F.row_number().over(Window.partitionBy("grp", "unit").orderBy("id")))
    return placed.groupBy("grp", "unit").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("place") <= 20, F.col("id")))), " ").alias("ids"))


@query(f"""{GRAPH} SELECT id, doc, domain FROM nodes WHERE starts_with(id, 'small/') AND domain = 'domain_2' AND contains(lower(doc), 'ring') ORDER BY id LIMIT 50""")
def find_nodes(spark, sf_dir):
    """A report by prefix, domain and text; each condition may be left out."""
    own = nodes(spark, sf_dir)
    return own.where(F.startswith("id", F.lit("small/")) & (F.col("domain") == "domain_2") & F.contains(F.lower("doc"), F.lit("ring"))).select("id", "doc", "domain").orderBy("id").limit(50)


@query("""SELECT c.c_custkey, c.c_name, count(o.o_orderkey)::BIGINT AS n_orders, coalesce(string_agg(DISTINCT o.o_orderstatus, ' ' ORDER BY o.o_orderstatus), '') AS states FROM
  (SELECT * FROM customer WHERE contains(lower(c_name), '1') AND c_mktsegment = 'MACHINERY' ORDER BY c_name LIMIT 50) c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1, 2""")
def find_signals(spark, sf_dir):
    """A report of fifty rows with an optional join, which comes after the cut."""
    few = table(spark, sf_dir, "customer").where(F.contains(F.lower("c_name"), F.lit("1")) & (F.col("c_mktsegment") == "MACHINERY")).orderBy("c_name").limit(50)
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    out = few.select("c_custkey", "c_name").join(orders, "c_custkey", "left").groupBy("c_custkey", "c_name")
    return out.agg(F.count("o_orderkey").alias("n_orders"), F.array_join(F.sort_array(F.collect_set("o_orderstatus")), " ").alias("states"))


@query("""SELECT p.page_id, p.url, d.doc_id FROM (SELECT page_id, url, page_id % 20 AS s FROM pages WHERE contains(lower(url), '/en/')) p
  JOIN documents d ON d.source = 'src' || p.s WHERE contains(lower(d.text), 'the ')""")
def find_chunks(spark, sf_dir):
    """Chunks of the pages whose address holds a text, if they hold another, in any case."""
    pages = table(spark, sf_dir, "pages").where(F.contains(F.lower("url"), F.lit("/en/"))).select("page_id", "url", F.concat(F.lit("src"), F.col("page_id") % 20).alias("source"))
    chunks = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("the "))).select("doc_id", "source")
    # a source has many of both, so its pairs are dealt to many tasks; a page meets the same chunks in the same order as the page before
    return join_dealt(cut(pages), cut(chunks), "source").select("page_id", "url", "doc_id")


@query(f"""{GRAPH}, q AS (SELECT DISTINCT v AS q FROM (SELECT unnest([id, name, 'zzz']) AS v FROM nodes WHERE k % 50 = 1)), x AS (SELECT q.q, min(CASE WHEN n.id = q.q THEN 0 ELSE 1 END) AS r FROM q JOIN nodes n ON n.id = q.q OR n.name = q.q GROUP BY 1)
  SELECT q.q, CASE x.r WHEN 0 THEN 'id' WHEN 1 THEN 'name' ELSE 'no_match' END AS method, coalesce((SELECT string_agg(n.id, ' ' ORDER BY n.id) FROM nodes n WHERE CASE x.r WHEN 0 THEN n.id = q.q WHEN 1 THEN n.name = q.q END), '') AS matches FROM q LEFT JOIN x ON x.q = q.q""")
def fetch_resource(spark, sf_dir):
    """A resource by its id, else by its name."""
    own = nodes(spark, sf_dir)
    wanted = own.where("k % 50 = 1").select(F.explode(F.array("id", "name", F.lit("zzz"))).alias("q")).distinct()
    steps = [("id", own.select(F.col("id").alias("key"), F.col("id").alias("value")), "equal"), ("name", own.select(F.col("name").alias("key"), F.col("id").alias("value")), "equal")]
    return lookup.resolve(wanted, "q", steps).withColumn("matches", F.array_join("matches", " "))


REFS = "CASE k % 5 WHEN 0 THEN id WHEN 1 THEN concat(split_part(id, '/', 2), '/', split_part(id, '/', 3)) WHEN 2 THEN concat('other/', upper(split_part(id, '/', 3))) WHEN 3 THEN split_part(id, '/', 3) ELSE concat(id, 'x') END"


@query(f"""{GRAPH}, r AS (SELECT DISTINCT {REFS} AS ref FROM nodes WHERE k % 3 = 0), e AS (SELECT ref, ref AS id FROM r WHERE ref IN (SELECT id FROM nodes)),
  s AS (SELECT r.ref, min(n.id) AS id FROM r JOIN nodes n ON ends_with(n.id, '/' || r.ref) OR n.id = r.ref WHERE r.ref NOT IN (SELECT ref FROM e) GROUP BY 1),
  l AS (SELECT r.ref, min(n.id) AS id FROM r JOIN nodes n ON lower(string_split(n.id, '/')[-1]) = lower(string_split(r.ref, '/')[-1]) WHERE r.ref NOT IN (SELECT ref FROM e) AND r.ref NOT IN (SELECT ref FROM s) GROUP BY 1)
  SELECT *, 'exact' AS method FROM e UNION ALL SELECT *, 'suffix' FROM s UNION ALL SELECT *, 'last_segment' FROM l""")
def resolve_references(spark, sf_dir):
    own = nodes(spark, sf_dir)
    return lookup.resolve_references(own.where("k % 3 = 0").select(F.expr(REFS).alias("ref")), own)


MENTION = "CASE WHEN doc_id % 3 = 0 THEN 'small' WHEN doc_id % 3 = 1 THEN concat('large/brand_', CAST(1 + doc_id % 25 AS {0})) ELSE 'none/at_all' END"


@query(f"""{GRAPH}, m AS (SELECT DISTINCT doc_id AS key, {MENTION.format('VARCHAR')} AS path FROM documents) SELECT m.key, n.id FROM m JOIN nodes n ON n.id = m.path OR starts_with(n.id, m.path || '/')""")
def mention_links(spark, sf_dir):
    """All links, as a cut without an order would keep any of them."""
    mentions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.expr(MENTION.format("STRING")).alias("path"))
    return lookup.mention_links(mentions, nodes(spark, sf_dir))


ALIKE = {"Subject": "name", "Unit": "unit", "Label": "label", "Domain": "domain"}


@query(f"""{GRAPH}, a AS (SELECT * FROM nodes WHERE k % 20 = 0), b AS ({' UNION ALL '.join(f"SELECT a.id AS anchor, '{b}' AS bucket, n.id AS name FROM a JOIN nodes n ON n.{c} = a.{c} AND n.id <> a.id" for b, c in ALIKE.items())}
  UNION ALL SELECT a.id, 'Successors', e.dst FROM a JOIN edges e ON e.src = a.id UNION ALL SELECT a.id, 'Predecessors', e.src FROM a JOIN edges e ON e.dst = a.id)
  SELECT anchor, bucket, place::INT AS place, name FROM (SELECT *, row_number() OVER (PARTITION BY anchor, bucket ORDER BY name) AS place FROM b) WHERE place <= 5""")
def related_buckets(spark, sf_dir):
    """Neighbours of the anchors asked for, every twentieth node, five in each bucket."""
    own, renames = nodes(spark, sf_dir), edges(spark, sf_dir)
    back = renames.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return lookup.related_buckets(own.where("k % 20 = 0").select(F.col("id").alias("anchor")), own, ALIKE, {"Successors": renames, "Predecessors": back}, 5)


@query("""WITH r AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'root:' ELSE 'repo:' END || s_suppkey AS id, CASE WHEN s_suppkey % 7 < 6 THEN 'c' || (s_suppkey // 4) END AS root_commit, 1 + s_suppkey % 3 AS clone_count FROM supplier)
  SELECT root_commit, arg_min(id, (starts_with(id, 'root:'), id)) AS canonical, (count(*) - 1)::INT AS n_clones, (sum(clone_count) - count(*) + 1)::BIGINT AS n FROM r WHERE root_commit IS NOT NULL GROUP BY 1""")
def merged_clones(spark, sf_dir):
    k = F.col("s_suppkey")
    repos = table(spark, sf_dir, "supplier").select(F.concat(F.when(k % 3 == 0, "root:").otherwise("repo:"), k).alias("id"), F.when(k % 7 < 6, F.concat(F.lit("c"), F.floor(k / 4))).alias("root_commit"), (1 + k % 3).alias("clone_count"))
    return lookup.merged_clones(repos).select("root_commit", "canonical", F.size("clones").alias("n_clones"), "n")


@query(f"""{GRAPH} SELECT name AS pattern, count(DISTINCT parent)::BIGINT AS n, min(id) AS first_member FROM nodes GROUP BY 1 HAVING count(DISTINCT parent) >= 3""")
def leaf_pattern_groups(spark, sf_dir):
    """Names that at least three parents have a leaf of."""
    return lookup.pattern_groups(nodes(spark, sf_dir), F.col("name"), "parent", 3)


@query(f"""{GRAPH} SELECT nullif(regexp_extract(name, '_([a-z]+)$', 1), '') AS pattern, count(DISTINCT grp)::BIGINT AS n, min(id) AS first_member FROM nodes WHERE regexp_matches(name, '_([a-z]+)$') GROUP BY 1 HAVING count(DISTINCT grp) >= 2""")
def member_suffix_groups(spark, sf_dir):
    suffix = F.nullif(F.regexp_extract("name", "_([a-z]+)$", 1), F.lit(""))
    return lookup.pattern_groups(nodes(spark, sf_dir), suffix, "grp", 2)


BOUND = "(SELECT CASE k % 10 WHEN 0 THEN name ELSE grp || '_' || (k % 3) END AS source, parent AS target, domain FROM nodes)"


@query(f"""{GRAPH}, c AS (SELECT target, count(DISTINCT source) AS n, count(DISTINCT string_split(source, '_')[1]) AS p, count(DISTINCT domain) AS d FROM {BOUND} GROUP BY 1 HAVING count(DISTINCT source) > 1)
  SELECT target, n::BIGINT AS n, CASE WHEN p = 1 THEN 'same_family' WHEN d <= 1 THEN 'same_domain' ELSE 'mixed' END AS kind FROM c""")
def many_to_one_targets(spark, sf_dir):
    source = F.when(F.col("k") % 10 == 0, F.col("name")).otherwise(F.concat_ws("_", "grp", F.col("k") % 3))
    return lookup.many_to_one(nodes(spark, sf_dir).select(source.alias("source"), F.col("parent").alias("target"), "domain"))


@query(f"""{GRAPH}, w AS (SELECT id, unnest(string_split(name, '_')) AS w FROM nodes) SELECT n.parent, string_agg(DISTINCT w.w, ' ' ORDER BY w.w) AS keywords FROM w JOIN nodes n ON n.id = w.id GROUP BY 1""")
def inherited_keywords(spark, sf_dir):
    own = nodes(spark, sf_dir)
    out = lookup.inherited_keywords(own, own.select("id", F.split("name", "_").alias("keywords")))
    return out.select("parent", F.array_join("keywords", " ").alias("keywords"))


@query(f"""{GRAPH} SELECT n.id, coalesce((SELECT string_agg(DISTINCT c.change_type || ':' || coalesce(c.level, '-'), ' ' ORDER BY c.change_type || ':' || coalesce(c.level, '-')) FROM changes c WHERE c.node_id = n.id), '') AS access,
  CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.src = n.id) THEN (SELECT string_agg(e.dst, ' ' ORDER BY e.dst) FROM edges e WHERE e.src = n.id) ELSE coalesce(n.domain, '') END AS linked FROM nodes n""")
def enriched_nodes(spark, sf_dir):
    """Nested values from one branch; linked ids from another, or what is stored where nothing is linked."""
    own, events, renames = nodes(spark, sf_dir), changes(spark, sf_dir).drop("id").withColumnRenamed("node_id", "id"), edges(spark, sf_dir)
    kinds = F.struct("change_type", F.coalesce("level", F.lit("-")).alias("level"))
    out = lookup.gathered(own.select("id", "domain"), "id", {"access": (events, kinds), "links": (renames.withColumnRenamed("src", "id"), F.col("dst"))})
    stored = F.when(F.col("domain").isNotNull(), F.array("domain"))
    return out.select("id", F.array_join(F.transform("access", lambda x: F.concat_ws(":", x["change_type"], x["level"])), " ").alias("access"), F.array_join(lookup.either(F.col("links"), stored), " ").alias("linked"))


@query(f"""{GRAPH} SELECT n.id, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce((SELECT list(e.dst) FROM edges e WHERE e.src = n.id), []), CASE WHEN n.k % 2 = 0 THEN [n.grp] ELSE [] END))), ' '), '') AS refs FROM nodes n""")
def cross_references(spark, sf_dir):
    """Ids linked by edges together with the one a property names."""
    own, renames = nodes(spark, sf_dir), edges(spark, sf_dir)
    out = lookup.gathered(own.select("id", "k", "grp"), "id", {"links": (renames.withColumnRenamed("src", "id"), F.col("dst"))})
    named = F.when(F.col("k") % 2 == 0, F.array("grp")).otherwise(F.array().cast("array<string>"))
    return out.select("id", F.array_join(F.sort_array(F.array_union("links", named)), " ").alias("refs"))


@query(f"""{GRAPH}, r AS (SELECT k, CASE WHEN k % 2 = 0 THEN upper(id) ELSE id END AS ref FROM nodes) SELECT n.id, count(DISTINCT r.k)::BIGINT AS n FROM r JOIN nodes n ON upper(n.id) = upper(r.ref) GROUP BY 1""")
def evidence_links(spark, sf_dir):
    """References equal to an id in any case, counted by node."""
    own = nodes(spark, sf_dir)
    refs = own.select("k", F.upper(F.when(F.col("k") % 2 == 0, F.upper("id")).otherwise(F.col("id"))).alias("ref"))
    return refs.join(own.select("id", F.upper("id").alias("ref")), "ref").groupBy("id").agg(F.count_distinct("k").alias("n"))


@query("""SELECT doc_id, r AS order_key, o.o_orderstatus FROM (SELECT doc_id, unnest([doc_id, doc_id + 1, doc_id * 7]) AS r FROM documents) JOIN orders o ON o.o_orderkey = r""")
def exploded_ids_join(spark, sf_dir):
    """Rows that list ids, joined with what the ids name."""
    k = F.col("doc_id")
    listed = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(k, k + 1, k * 7)).alias("order_key"))
    return listed.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), "o_orderstatus"), "order_key")


@query("""SELECT n.n_name AS facility, c.c_mktsegment AS label, count(*)::BIGINT AS n FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE n.n_nationkey IN (1, 3, 5, 7) GROUP BY 1, 2""")
def compare_groups(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where(F.col("n_nationkey").isin(1, 3, 5, 7)).select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("facility"))
    return table(spark, sf_dir, "customer").join(nations, "c_nationkey").groupBy("facility", F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("n"))


@query("""SELECT t AS target, sum(n)::BIGINT AS n FROM (SELECT s_nationkey % 5 AS d, count(*) AS n FROM supplier GROUP BY 1) JOIN (SELECT unnest([r_regionkey, (r_regionkey + 1) % 5]) AS d, r_name AS t FROM region) USING (d) GROUP BY 1""")
def mappable_targets(spark, sf_dir):
    """Sources counted for each target by any of its domains."""
    k = F.col("r_regionkey")
    domains = table(spark, sf_dir, "region").select(F.col("r_name").alias("target"), F.explode(F.array(k, (k + 1) % 5)).alias("d"))
    sources = table(spark, sf_dir, "supplier").groupBy((F.col("s_nationkey") % 5).alias("d")).agg(F.count("*").alias("n"))
    return domains.join(sources, "d").groupBy("target").agg(F.sum("n").alias("n"))


@query("""SELECT c.c_custkey, CASE WHEN c.c_acctbal > 5000 THEN 'direct' WHEN c.c_mktsegment = 'BUILDING' THEN 'proxy' END AS method, n.n_name FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE c.c_acctbal > 5000 OR c.c_mktsegment = 'BUILDING'""")
def access_methods(spark, sf_dir):
    """The method whose condition a row meets first; rows that meet none have no link."""
    method = F.when(F.col("c_acctbal") > 5000, "direct").when(F.col("c_mktsegment") == "BUILDING", "proxy")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", method.alias("method")).where("method is not null").join(nations, "c_nationkey").drop("c_nationkey")


@query(f"""{GRAPH} SELECT n.id, n.parent, coalesce((SELECT string_agg(e.dst, ' ' ORDER BY e.dst) FROM edges e WHERE e.src = n.id), '') AS outgoing, coalesce((SELECT string_agg(e.src, ' ' ORDER BY e.src) FROM edges e WHERE e.dst = n.id), '') AS incoming FROM nodes n WHERE starts_with(n.id, 'small/brand_1')""")
def neighbours(spark, sf_dir):
    """A subtree with its neighbours in three relations: parent, outgoing and incoming renames."""
    own, renames = nodes(spark, sf_dir).where(F.startswith("id", F.lit("small/brand_1"))), edges(spark, sf_dir)
    out = lookup.gathered(own.select("id", "parent"), "id", {"outgoing": (renames.withColumnRenamed("src", "id"), F.col("dst")), "incoming": (renames.withColumnRenamed("dst", "id"), F.col("src"))})
    return out.select("id", "parent", F.array_join("outgoing", " ").alias("outgoing"), F.array_join("incoming", " ").alias("incoming"))


@query("""WITH q AS (SELECT DISTINCT p_name || 'x' AS q, split_part(p_name, ' ', 1) AS base FROM part WHERE p_partkey < 300), c AS (SELECT DISTINCT p_name AS name FROM part)
  SELECT q, arg_min(name, (levenshtein(q, name), split_part(name, ' ', 1) <> base, name)) AS suggestion, min(levenshtein(q, name))::INT AS edits FROM q, c GROUP BY 1""")
def edit_suggestions(spark, sf_dir):
    """The nearest name by edits; ties go to one with the same base, then by name."""
    part = table(spark, sf_dir, "part")
    catalogue = part.select(F.col("p_name").alias("id")).distinct()
    asked_for = part.where("p_partkey < 300").select(F.concat("p_name", F.lit("x")).alias("q")).distinct()
    return lookup.edit_suggestions(asked_for, "q", catalogue, F.substring_index("q", " ", 1) == F.substring_index("id", " ", 1))


@query("""SELECT c_custkey, n_name, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING' AND n_regionkey = 2 AND c_acctbal > 0""")
def nodes_across_groups(spark, sf_dir):
    """Nodes of any group that fit some equalities and bounds."""
    from loomgraph.operators import filters

    groups = filters.where(table(spark, sf_dir, "nation"), {"n_regionkey": 2}).select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    own = filters.where(table(spark, sf_dir, "customer"), {"c_mktsegment": "BUILDING", "c_acctbal__gt": 0})
    return own.join(groups, "c_nationkey").select("c_custkey", "n_name", "c_mktsegment")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false ELSE true END AS compatible, CASE p_partkey % 5 WHEN 0 THEN 1000.0 WHEN 1 THEN 1.0 WHEN 4 THEN 0.001 END::DOUBLE AS factor FROM part""")
def unit_compatibility(spark, sf_dir):
    """Whether one unit can be converted to another, and by which factor."""
    from loomgraph.functions import units

    pick = lambda *v: F.get(F.array(*[F.lit(x).cast("string") for x in v]), (F.col("p_partkey") % 5).cast("int"))
    a, b = pick("keV", "J.m^-3", "m", "T", "mm"), pick("eV", "Pa", "s", "mixed", "m")
    factor = units.converted(F.lit(1.0), a, b)
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(factor.isNotNull(), F.lit(False)).alias("compatible"), F.round(factor, 6).alias("factor"))


@query(f"""{GRAPH} SELECT 'field:' || grp || ':' || v AS section, id, k AS sort_key FROM nodes JOIN (SELECT unnest(['3.42.0', '4.0.0']) AS v) ON introduced = v WHERE domain = 'domain_1'
  UNION ALL SELECT 'gone:' || grp, id, k FROM nodes WHERE deprecated = '4.1.0' AND domain = 'domain_2' UNION ALL SELECT 'via:' || src, dst, (SELECT k FROM nodes WHERE id = dst) FROM edges""")
def section_nodes(spark, sf_dir):
    """Nodes of structural sections, by system, source and epoch, or by what an epoch points to."""
    own = nodes(spark, sf_dir).select("id", F.col("k").alias("sort_key"), F.lit("f").alias("facility"), F.col("grp").alias("system"), F.col("domain").alias("source"), "introduced", "deprecated")
    groups = own.select("system").distinct()
    null = F.lit(None).cast("string")
    row = lambda df, section, epoch, system, source, field, via: df.select(section.alias("section"), epoch.alias("epoch"), F.lit("f").alias("facility"), system.alias("system"), source.alias("source"), field.alias("epoch_field"), via.alias("via"))
    g = F.col("system")
    sections = row(groups, F.concat(F.lit("gone:"), g), F.lit("4.1.0"), g, F.lit("domain_2"), F.lit("deprecated"), null)
    for v in ("3.42.0", "4.0.0"):
        sections = sections.unionByName(row(groups, F.concat(F.lit("field:"), g, F.lit(":" + v)), F.lit(v), g, F.lit("domain_1"), F.lit("introduced"), null))
    renames = edges(spark, sf_dir).select("src", F.lit("renamed_to").alias("relation"), "dst")
    sections = sections.unionByName(row(renames.select("src").distinct(), F.concat(F.lit("via:"), "src"), F.col("src"), null, null, null, F.lit("renamed_to")))
    return lookup.section_nodes(sections, own, renames, ("introduced", "deprecated"))
