"""Audits, gates, names and conventions over the dictionary graph and the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import conventions, names
from loomgraph.operators import audits, name_checks
from loomgraph.plans.shared import table
from loomgraph.queries.graph import GRAPH, nodes
from loomgraph.queries.registry import query

UNITS = ("m", "eV", "T")
DOC = "CASE k % 6 WHEN 0 THEN replace(name, '_', ' ') WHEN 1 THEN concat('the {value} of ', name) WHEN 2 THEN 'its colour and centre' WHEN 3 THEN NULL ELSE doc END"
NAME = "CASE k % 5 WHEN 0 THEN concat(name, '_measured') WHEN 1 THEN concat(name, '_', split_part(name, '_', -1)) ELSE name END"
AUDITED = f"""(SELECT id, list_filter([CASE WHEN k % 6 = 1 THEN 'placeholder: description' END, CASE WHEN len(rep) > 0 THEN 'repeated_token: ' || array_to_string(rep, ',') END,
    CASE WHEN unit NOT IN {UNITS} THEN 'unit: ' || unit END, CASE WHEN array_to_string(list_filter(regexp_split_to_array(lower(coalesce(d, '')), '[^a-z]+'), lambda w: w <> ''), '_') = lower(nm) THEN 'tautology: description repeats the name' END,
    CASE WHEN k % 6 = 2 THEN 'spelling: centre,colour' END, CASE WHEN k % 5 = 0 THEN 'processing: name ends with a way of processing' END, CASE WHEN length(nm) > 60 THEN 'length: name is long' END], lambda x: x IS NOT NULL) AS issues
  FROM (SELECT *, list_filter([CASE WHEN t[i] = t[i + 1] THEN t[i] END FOR i IN range(1, len(t))], lambda x: x IS NOT NULL) AS rep FROM (SELECT *, string_split(nm, '_') AS t FROM (SELECT *, {NAME} AS nm, {DOC} AS d FROM nodes))))"""


@query(f"{GRAPH} SELECT id, array_to_string(issues, '; ') AS issues, len(list_filter(issues, lambda x: string_split(x, ':')[1] IN ('placeholder', 'repeated_token', 'unit'))) > 0 AS critical FROM {AUDITED}")
def name_audits(spark, sf_dir):
    own = nodes(spark, sf_dir).withColumns({"nm": F.expr(NAME), "d": F.expr(DOC)})
    out = own.select("id", audits.audit(F.col("nm"), F.col("d"), F.col("unit"), UNITS).alias("issues"))
    return out.select("id", F.array_join("issues", "; ").alias("issues"), audits.is_critical(F.col("issues")).alias("critical"))


COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
VECTORS = "(SELECT vec_id AS id, embedding, label % 7 AS domain, CASE vec_id % 4 WHEN 0 THEN 'm' WHEN 1 THEN 's' WHEN 2 THEN 'm' END AS unit FROM embeddings)"


@query(f"SELECT a.id AS a, b.id AS b, round({COSINE}, 5) AS similarity FROM {VECTORS} a JOIN {VECTORS} b ON a.domain = b.domain AND a.unit = b.unit AND a.id < b.id WHERE {COSINE} > 0.3")
def synonym_pairs(spark, sf_dir):
    """Names of one domain and unit that are closer than a threshold."""
    return audits.synonyms(named_vectors(spark, sf_dir), "embedding", 0.3).withColumn("similarity", F.round("similarity", 5))


def named_vectors(spark, sf_dir):
    k = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(k.alias("id"), "embedding", (F.col("label") % 7).alias("domain"), F.when(k % 2 == 0, "m").when(k % 4 == 1, "s").alias("unit"))


@query(f"""WITH RECURSIVE v AS {VECTORS}, l AS (SELECT a.id AS src, b.id AS dst FROM v a JOIN v b ON a.domain = b.domain AND a.unit = b.unit AND a.id <> b.id WHERE {COSINE} > 0.2),
  r AS (SELECT id, id AS class FROM v WHERE unit IS NOT NULL UNION SELECT l.dst, r.class FROM r JOIN l ON l.src = r.id WHERE r.class < l.dst), c AS (SELECT id, min(class) AS class FROM r GROUP BY 1)
  SELECT c.id, c.class, (SELECT count(*) FROM l WHERE l.src = c.id)::BIGINT AS n_links FROM c""")
def synonym_classes(spark, sf_dir):
    """Classes of names of one domain and unit that are linked by their vectors, with the number of links of each."""
    return audits.synonym_classes(named_vectors(spark, sf_dir), "embedding", 0.2)


POSITION = "CASE k % 4 WHEN 0 THEN 'on_axis' WHEN 1 THEN CASE WHEN k % 10 < 5 THEN 'at_magnetic_axis' ELSE 'on_axis' END WHEN 2 THEN 'at_boundary' END"


@query(f"{GRAPH} SELECT domain, 'axis' AS form, string_agg(DISTINCT p, ' ' ORDER BY p) AS found FROM (SELECT domain, {POSITION} AS p FROM nodes WHERE domain IS NOT NULL) WHERE p IN ('on_axis', 'at_magnetic_axis') GROUP BY 1 HAVING count(DISTINCT p) > 1")
def mixed_positions(spark, sf_dir):
    own = nodes(spark, sf_dir).withColumn("position", F.expr(POSITION))
    return audits.mixed_positions(own).withColumn("found", F.array_join("found", " "))


LINKED = "(SELECT id, k, CASE WHEN k % 3 = 0 THEN [id, 'name:none_' || k] WHEN k % 3 = 1 THEN ['dd:' || id] ELSE NULL END AS links, CASE WHEN k % 5 > 0 THEN 11 + (k % 10 = 9)::INT END AS convention FROM nodes)"


def linked(spark, sf_dir):
    k = F.col("k")
    links = F.when(k % 3 == 0, F.array("id", F.concat(F.lit("name:none_"), k))).when(k % 3 == 1, F.array(F.concat(F.lit("dd:"), "id")))
    return nodes(spark, sf_dir).select("id", "k", links.alias("links"), F.when(k % 5 > 0, 11 + (k % 10 == 9).cast("int")).alias("convention"))


@query(f"""{GRAPH} SELECT id, 'convention' AS issue, convention::VARCHAR AS detail FROM {LINKED} WHERE convention <> 11 UNION ALL SELECT id, 'parse', id FROM nodes WHERE NOT regexp_matches(id, '^[a-z0-9_/]*_[0-9]*[02468]$')
  UNION ALL SELECT id, 'dangling_link', 'none_' || k FROM {LINKED} WHERE k % 3 = 0""")
def export_gate_issues(spark, sf_dir):
    return audits.gate_issues(linked(spark, sf_dir), 11, r"^[a-z0-9_/]*_[0-9]*[02468]$")


@query("SELECT event_id, CASE WHEN value IS NULL OR event_id % 7 = 0 THEN 'unreviewed' WHEN value < 40 THEN 'below_score' WHEN event_id % 11 < 3 AND event_id % 100 < 50 THEN 'below_description_score' END AS reason FROM events")
def export_gate_reasons(spark, sf_dir):
    e = F.col("event_id")
    score, told = F.when(e % 7 > 0, F.col("value")), F.when(e % 11 < 3, e % 100)
    return table(spark, sf_dir, "events").select("event_id", audits.gate_reason(score, told, 40, 50).alias("reason"))


@query(f"{GRAPH} SELECT domain, count(*)::BIGINT AS n, string_agg(id, ' ' ORDER BY id) AS entries FROM nodes WHERE category = 'quantity' AND domain IS NOT NULL GROUP BY 1")
def catalogue_by_domain(spark, sf_dir):
    """What a gated export writes: one row, and so one file, for each domain."""
    kept = nodes(spark, sf_dir).where("category = 'quantity' and domain is not null")
    return kept.groupBy("domain").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), " ").alias("entries"))


@query(f"{GRAPH} SELECT id FROM nodes WHERE k % 4 = 1")
def diverged_entries(spark, sf_dir):
    """Imported entries whose protected columns changed since; those never imported have no hash."""
    own = nodes(spark, sf_dir)
    stored = F.when(F.col("k") % 4 < 2, audits.fingerprint("doc", "unit"))
    changed = own.withColumn("stored", stored).withColumn("doc", F.when(F.col("k") % 4 == 1, F.concat("doc", F.lit("!"))).otherwise(F.col("doc")))
    return audits.diverged(changed, ["doc", "unit"], "stored")


@query(f"""{GRAPH} SELECT CASE e WHEN 'u' THEN 'upper_uncertainty_of_' ELSE 'lower_uncertainty_of_' END || id AS id, id || CASE e WHEN 'u' THEN '_error_upper' ELSE '_error_lower' END AS source, unit FROM nodes, (SELECT unnest(['u', 'l']) AS e) WHERE k % 2 = 0""")
def error_siblings(spark, sf_dir):
    endings = F.array(*map(F.lit, ("_error_upper", "_error_lower", "_error_index", "_other")))
    own = nodes(spark, sf_dir).where("k % 2 = 0").withColumn("errors", F.transform(endings, lambda e: F.concat("id", e)))
    return audits.error_siblings(own)


LEAF = "CASE k % 8 WHEN 0 THEN 'j_tor' WHEN 1 THEN 'r' WHEN 2 THEN 'radial' WHEN 3 THEN concat('darea_dpsi', CAST(k % 2 AS {0})) WHEN 4 THEN 'dv_dpsi' WHEN 5 THEN 'dp_dpsi' ELSE 'value' END"
HOLDER = "CASE WHEN k % 8 < 3 THEN CASE WHEN k % 5 = 0 THEN concat(grp, '/outline') ELSE concat(grp, '/vector') END ELSE parent END"


@query(f"""{GRAPH}, r AS (SELECT {HOLDER} AS parent, {LEAF.format('VARCHAR')} AS leaf, coalesce(unit, '') AS unit FROM nodes), x AS (SELECT *, leaf IN ('j_tor', 'r', 'radial') AS axis, nullif(regexp_extract(leaf, '^d(\\w+?)_d(\\w+)$', 2), '') AS by_ FROM r),
  a AS (SELECT parent, count(*) AS n, count(DISTINCT unit) = 1 AS u FROM x WHERE axis GROUP BY 1 HAVING count(*) >= 2)
  SELECT parent, CASE WHEN ends_with(parent, '/outline') THEN 'geometric_coordinate' ELSE 'physical_vector' END AS kind, n::BIGINT AS n, u AS unit_uniform FROM a
  UNION ALL SELECT parent, 'derivative', count(*), count(DISTINCT unit) = 1 FROM x WHERE by_ IS NOT NULL AND parent NOT IN (SELECT parent FROM a) GROUP BY parent, by_ HAVING count(*) >= 2""")
def name_families(spark, sf_dir):
    own = nodes(spark, sf_dir)
    return audits.families(own.select(F.concat_ws("/", F.expr(HOLDER), F.expr(LEAF.format("STRING"))).alias("path"), "unit"))


BINDINGS = """(SELECT k, 's' || (k % 40) AS source, CASE WHEN k % 9 = 0 THEN 'gone' ELSE parent END AS target, CASE k % 7 WHEN 0 THEN 'value * 2' WHEN 1 THEN 'exec()' ELSE 'value' END AS transform,
  CASE k % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'eV' END AS source_unit, CASE WHEN k % 4 = 0 THEN 'm' WHEN k % 4 = 1 THEN 'mm' END AS target_unit, CASE WHEN k % 5 = 0 THEN 'psi_like' END AS label FROM nodes)"""


def bindings(spark, sf_dir):
    k = F.col("k")
    return nodes(spark, sf_dir).select(
        "k",
        F.concat(F.lit("s"), k % 40).alias("source"),
        F.when(k % 9 == 0, "gone").otherwise(F.col("parent")).alias("target"),
        F.when(k % 7 == 0, "value * 2").when(k % 7 == 1, "exec()").otherwise("value").alias("transform"),
        F.when(k % 3 == 0, "m").when(k % 3 == 1, "eV").alias("source_unit"),
        F.when(k % 4 == 0, "m").when(k % 4 == 1, "mm").alias("target_unit"),
        F.when(k % 5 == 0, "psi_like").alias("label"),
    )


@query(f"""{GRAPH} SELECT k, source, target, array_to_string(list_filter([CASE WHEN k % 40 >= 30 THEN 'no_source' END, CASE WHEN target = 'gone' THEN 'no_target' END, CASE WHEN transform = 'exec()' THEN 'bad_transform' END,
    CASE WHEN (source_unit IS NOT NULL OR target_unit IS NOT NULL) AND NOT coalesce(source_unit = 'm', false) THEN 'units_incompatible' WHEN (source_unit IS NOT NULL OR target_unit IS NOT NULL) AND target_unit IS NULL THEN 'units_incompatible'
      WHEN transform = 'value' AND source_unit <> target_unit THEN 'units_not_converted' END,
    CASE WHEN starts_with(target, 'small/') AND transform = 'value' AND label IS NULL THEN 'sign_not_handled' END], lambda x: x IS NOT NULL), ' ') AS issues FROM {BINDINGS}""")
def mapping_validation(spark, sf_dir):
    own = nodes(spark, sf_dir)
    sources = spark.range(30).select(F.concat(F.lit("s"), F.col("id")).alias("source"))
    targets = own.select(F.col("parent").alias("target"))
    flips = targets.where(F.startswith("target", F.lit("small/")))
    alike = F.col("source_unit").isin("m", "mm") & F.col("target_unit").isin("m", "mm")
    out = audits.checked_bindings(bindings(spark, sf_dir), sources, targets, flips, alike, ("value", "value * 2"))
    return out.select("k", "source", "target", F.array_join("issues", " ").alias("issues"))


@query(f"{GRAPH} SELECT target, CASE WHEN count(DISTINCT source) > 1 THEN 'several_sources' ELSE 'conflicting_transforms' END AS kind FROM {BINDINGS} GROUP BY 1 HAVING count(DISTINCT source) > 1 OR count(DISTINCT transform) > 1")
def conflicting_targets(spark, sf_dir):
    return audits.conflicting_targets(bindings(spark, sf_dir))


@query(f"{GRAPH} SELECT 'gradient_of_' || id AS src, id AS dst, 'gradient' AS relation FROM nodes WHERE k % 3 = 0 UNION ALL SELECT 'flux_of_' || id, id, 'flux' FROM nodes WHERE k % 3 = 1")
def structural_edges(spark, sf_dir):
    own = nodes(spark, sf_dir)
    made = own.select(F.concat(F.when(F.col("k") % 3 == 0, "gradient_of_").when(F.col("k") % 3 == 1, "flux_of_").otherwise("odd_"), "id").alias("id"))
    return audits.structural_edges(made, ("gradient", "flux"))


@query("SELECT doc_id, used FROM (SELECT doc_id, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents) WHERE used <= 4000")
def token_capped_results(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("tokens", F.greatest(F.lit(1), F.floor(F.length("text") / 4)))
    return audits.by_tokens(docs, "tokens", [F.col("doc_id")], ["source"], 4000).select("doc_id", "used")


@query(f"""{GRAPH} SELECT id, CASE k % 4 WHEN 0 THEN 'toroidal' WHEN 1 THEN 'radial' WHEN 2 THEN 'poloidal' END AS axis, CASE WHEN k % 3 < 2 THEN CASE WHEN k % 3 = 1 THEN 'unresolved' ELSE 'resolved' END END AS status,
  'fac:' || coalesce(domain, 'none') || '/' || name AS signal, substr(sha256('model:' || doc), 1, 16) AS hash FROM nodes""")
def name_functions(spark, sf_dir):
    """Axis of a leaf, status of links, signal ids, hashes of texts."""
    k = F.col("k")
    leaf = F.when(k % 4 == 0, "j_tor").when(k % 4 == 1, "radial").when(k % 4 == 2, "b_field_pol").otherwise("value")
    return linked(spark, sf_dir).drop("k").join(nodes(spark, sf_dir), "id").select(
        "id",
        names.axis(leaf).alias("axis"),
        names.link_status(F.col("links")).alias("status"),
        names.signal_id(F.lit("fac"), F.coalesce("domain", F.lit("none")), F.initcap(F.replace("name", F.lit("_"), F.lit(" ")))).alias("signal"),
        names.embedding_hash(F.col("doc"), "model").alias("hash"),
    )


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'name:' || replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 1 THEN ' dd:core/a_b' ELSE '' END END AS links,
  CASE p_partkey % 4 WHEN 0 THEN 'ann smith' WHEN 1 THEN 'bo li' WHEN 2 THEN NULL ELSE 'x y z' END AS person,
  p_name || CASE WHEN p_partkey % 2 = 0 THEN '. ' || lower(p_type) ELSE '' END || '. a, b' AS text, CASE WHEN p_partkey % 2 = 0 THEN 'core/a/b eq/t' ELSE 'core/a/b' END AS paths FROM part""")
def text_functions(spark, sf_dir):
    """Links, persons' keys, embedding texts and dictionary paths."""
    k = F.col("p_partkey")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    doc = F.when(k % 3 == 0, F.concat(F.lit("see [x](name:"), name, F.lit(") and name:"), name)).when(k % 3 == 1, F.concat(F.lit("dd:core/a_b or name:"), name)).otherwise(F.lit("none"))
    given = F.when(k % 4 == 0, " Ann").when(k % 4 == 1, "Bo").when(k % 4 == 2, "").otherwise("x  y")
    family = F.when(k % 4 == 0, "Smith Jr").when(k % 4 == 1, "Li-PhD ").otherwise("Z")
    text = names.embedding_text(F.concat(F.lit(" "), "p_name"), F.when(k % 2 == 0, F.lower("p_type")), F.array(F.lit("a"), F.lit("b")), 512)
    paths = names.dictionary_paths(F.concat(F.lit("in core/a(i1)/b[2], "), F.when(k % 2 == 0, "eq/t").otherwise("other/t"), F.lit(" or core/a/b")), ("core", "eq"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names.doc_links(doc), " ").alias("links"), names.person_key(given, family).alias("person"), text.alias("text"), F.array_join(paths, " ").alias("paths"))


# Signs of an equilibrium made from an event: flux at axis and edge, current, field, safety factor, pressure gradient.
SIGNALS = {
    "psi_axis": "CASE WHEN event_id % 3 = 0 THEN 0.2 ELSE value / 100 END", "psi_edge": "CASE WHEN event_id % 2 = 0 THEN -0.1 ELSE 0.4 END", "ip": "CASE WHEN event_id % 5 < 2 THEN -1.0 ELSE 1.0 END",
    "b0": "CASE WHEN event_id % 7 < 3 THEN -5.0 ELSE 5.0 END", "q": "CASE event_id % 4 WHEN 0 THEN -3.0 WHEN 1 THEN 3.0 WHEN 2 THEN 1.0 END", "dp": "CASE event_id % 6 WHEN 0 THEN -1.0 WHEN 1 THEN 1.0 END",
}
TABLE = ", ".join(f"({k}, {', '.join(map(str, v))})" for k, v in conventions.CONVENTIONS.items())
SIGNS = f"""WITH c(cocos, bp, e, rpz, rtp) AS (VALUES {TABLE}), s AS (SELECT event_id, (1 + event_id % 20)::INT AS declared, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in SIGNALS.items())} FROM events),
  g AS (SELECT *, CASE WHEN ip >= 0 THEN 1 ELSE -1 END AS si, CASE WHEN b0 >= 0 THEN 1 ELSE -1 END AS sb, CASE WHEN psi_edge - psi_axis >= 0 THEN 1 ELSE -1 END AS sp, CASE WHEN q >= 0 THEN 1 WHEN q < 0 THEN -1 END AS sq, CASE WHEN dp >= 0 THEN 1 WHEN dp < 0 THEN -1 END AS sd FROM s)"""


def signals(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (1 + F.col("event_id") % 20).cast("int").alias("declared"), *[F.expr(f"CAST({v} AS DOUBLE)").alias(k) for k, v in SIGNALS.items()])


@query(f"""{SIGNS} SELECT event_id, c.cocos::INT AS convention, round(least(1, greatest(0, 0.5 + CASE WHEN sd IS NULL THEN 0 WHEN sd = -si * (sp * si) THEN 0.15 ELSE -0.25 END + CASE WHEN sq IS NULL THEN 0 ELSE 0.2 END)), 4)::DOUBLE AS confidence
  FROM g JOIN c ON c.bp = sp * si AND c.e = CASE WHEN greatest(abs(psi_axis), abs(psi_edge)) > 0.5 THEN 1 ELSE 0 END AND c.rpz = 1 AND c.rtp = coalesce(sq * si * sb, 1)""")
def inferred_conventions(spark, sf_dir):
    c = F.col
    out = conventions.inferred_convention(c("psi_axis"), c("psi_edge"), c("ip"), c("b0"), c("q"), c("dp"))
    return signals(spark, sf_dir).select("event_id", out.alias("x")).select("event_id", "x.convention", F.round("x.confidence", 4).alias("confidence"))


@query(f"""{SIGNS} SELECT event_id, declared, array_to_string(CASE WHEN c.cocos IS NULL THEN ['invalid'] ELSE list_filter([CASE WHEN si * bp <> sp THEN 'psi' END, CASE WHEN sd <> -si * bp THEN 'dp' END, CASE WHEN sq <> si * sb * rtp THEN 'q' END], lambda x: x IS NOT NULL) END, ' ') AS issues
  FROM g LEFT JOIN c ON c.cocos = declared""")
def convention_checks(spark, sf_dir):
    c = F.col
    issues = conventions.inconsistencies(c("declared"), c("psi_axis"), c("psi_edge"), c("ip"), c("b0"), c("q"), c("dp"))
    return signals(spark, sf_dir).select("event_id", "declared", F.array_join(issues, " ").alias("issues"))


@query(f"""{GRAPH} SELECT id, label, CASE label WHEN 'psi_like' THEN round(-2 * pi(), 6) WHEN 'ip_like' THEN -1.0 ELSE 1.0 END AS factor, CASE label WHEN 'psi_like' THEN 'multiply' WHEN 'ip_like' THEN 'multiply' ELSE 'none' END AS action FROM
  (SELECT id, CASE k % 3 WHEN 0 THEN 'psi_like' WHEN 1 THEN 'ip_like' ELSE 'b0_like' END AS label FROM nodes)""")
def convention_changes(spark, sf_dir):
    """What to do with labelled paths from one convention to another."""
    label = F.when(F.col("k") % 3 == 0, "psi_like").when(F.col("k") % 3 == 1, "ip_like").otherwise("b0_like")
    own = nodes(spark, sf_dir).select("id", label.alias("label"))
    out = conventions.change_factors(own, 17, 1)
    return out.withColumn("factor", F.round("factor", 6))


# Names made of the parts' own words: what stands before and behind them decides which checks they fail.
BEFORE = ("", "amplitude_of_", "max_", "cumulative_", "radial_coordinate_of_surface_normal_", "stokes_vector_", "position_of_", "diamagnetic_component_of_", "measurement_time_of_")
BEHIND = ("", "_harmonics", "_ggd", "_due_to_ohmic", "_due_to_startup_phase", "_field", "_density", "_time_averaged", "_at_separatrix", "_per_toroidal_mode_number", "_profile", "_of_x_position", "_polarimeter", "_at_wall_surface", "_magnetic_field", "_on_ggd", "_to_b_ratio")
COMPOSED = f"""(SELECT p_partkey AS k, [{', '.join(repr(b) for b in BEFORE)}][k % {len(BEFORE)} + 1] || replace(p_name, ' ', '_') || CASE WHEN k % 19 = 0 THEN '_' || string_split(p_name, ' ')[2] ELSE '' END || [{', '.join(repr(b) for b in BEHIND)}][k % {len(BEHIND)} + 1] AS id,
  CASE WHEN k % 5 = 0 THEN 'The Fourier Mode of it' WHEN k % 5 = 1 THEN 'In COCOS 11' END AS description, CASE WHEN k % 4 = 0 THEN 'm^-3' WHEN k % 4 = 1 THEN 'Pa' WHEN k % 4 = 2 THEN '1' END AS unit, CASE WHEN k % 2 = 0 THEN 'a/ggd/b' END AS source_path, CASE WHEN k % 3 = 0 THEN 'psi_like' END AS label FROM part)"""
# The same in SQL's own words: conditions on the whole name.
CONDITIONS = {
    "tautology": "regexp_matches(id, '(^|_)position_of_([a-z0-9_]*_)?position$') AND len(string_split(id, '_of_')) > 1 AND list_contains(list_transform(range(1, len(string_split(id, '_of_'))), lambda i: string_split(string_split(id, '_of_')[i], '_')[-1] = 'position' AND string_split(string_split(id, '_of_')[i + 1], '_')[-1] = 'position'), true)",
    "spectral_suffix": "suffix(id, '_harmonics')",
    "abbreviation": "contains('_' || id || '_', '_max_')",
    "spectral_description": "contains(lower(description), 'fourier mode') AND NOT regexp_matches(id, 'mode_|_amplitude|fourier|harmonic|spectral')",
    "representation": "regexp_matches(id, '_ggd(_|$)')",
    "due_to_event": "contains(id, '_due_to_startup')",
    "due_to_adjective": "suffix(id, '_due_to_ohmic')",
    "bare_field": "suffix(id, '_field') AND NOT suffix(id, 'magnetic_field')",
    "density_unit": "contains(id, '_density') AND unit = 'Pa' AND NOT regexp_matches(id, '^(measurement_time_of_|position_of_)')",
    "coordinate_of_vector": "contains(id, 'radial_coordinate_of_surface_normal_')",
    "aggregator_order": "suffix(id, '_time_averaged')",
    "named_feature": "suffix(id, '_at_separatrix')",
    "diamagnetic_component": "contains(id, 'diamagnetic_component_of_')",
    "part_prefix": "starts_with(id, 'amplitude_of_')",
    "mode_number": "suffix(id, '_per_toroidal_mode_number')",
    "cumulative": "starts_with(id, 'cumulative_')",
    "ratio_form": "suffix(id, '_to_b_ratio')",
    "profile_suffix": "suffix(id, '_profile')",
    "adjacent_duplicate": "list_contains(list_transform(range(1, len(t)), lambda i: t[i] = t[i + 1]), true)",
    "repeated_token": "len(list_filter(t, lambda x: x NOT IN ('of', 'at', 'per', 'due', 'to'))) > len(list_distinct(list_filter(t, lambda x: x NOT IN ('of', 'at', 'per', 'due', 'to'))))",
    "length": "length(id) > 70",
    "instrument_observable": "contains(id, 'polarimeter') AND contains(id, 'stokes_vector')",
    "position_redundancy": "contains(id, '_at_wall_surface')",
    "convention_mention": "label IS NOT NULL AND NOT coalesce(contains(description, 'COCOS 11'), false)",
}
NOT_CRITICAL = ("profile_suffix", "repeated_token", "length", "instrument_observable", "position_redundancy", "convention_mention")
FOUND = f"(SELECT id, list_filter([{', '.join(f'CASE WHEN {c} THEN {n!r} END' for n, c in CONDITIONS.items())}], lambda x: x IS NOT NULL) AS checks FROM (SELECT *, string_split(id, '_') AS t FROM {COMPOSED}))"


def composed_names(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    again = F.when(k % 19 == 0, F.concat(F.lit("_"), F.split("p_name", " ")[1])).otherwise("")
    return table(spark, sf_dir, "part").select(
        F.concat(pick(BEFORE), F.replace("p_name", F.lit(" "), F.lit("_")), again, pick(BEHIND)).alias("id"),
        F.when(k % 5 == 0, "The Fourier Mode of it").when(k % 5 == 1, "In COCOS 11").alias("description"),
        F.when(k % 4 == 0, "m^-3").when(k % 4 == 1, "Pa").when(k % 4 == 2, "1").alias("unit"),
        F.when(k % 2 == 0, "a/ggd/b").alias("source_path"), F.when(k % 3 == 0, "psi_like").alias("label"),
    )


@query(f"SELECT id, array_to_string(checks, ',') AS checks, len(list_filter(checks, lambda x: x NOT IN {NOT_CRITICAL})) > 0 AS critical FROM {FOUND}")
def name_checks_found(spark, sf_dir):
    """The checks that each composed name fails, and whether any is critical."""
    out = name_checks.checked(composed_names(spark, sf_dir))
    return out.select("id", F.array_join(F.transform("issues", lambda x: x["check"]), ",").alias("checks"), "critical")


@query(f'SELECT "check", "check" NOT IN {NOT_CRITICAL} AS critical, count(*)::BIGINT AS n, min(id) AS first, max(id) AS last FROM (SELECT id, unnest(checks) AS "check" FROM {FOUND}) GROUP BY 1')
def name_issue_counts(spark, sf_dir):
    return name_checks.issue_counts(name_checks.checked(composed_names(spark, sf_dir)))


GRAMMAR = {"size": ("small", "large", "tiny"), "thing": ("bolt", "nut", "widget"), "place": ("at_separatrix", "at_wall_surface"), "average": ("time_averaged", "time")}


@query(f"""WITH s AS (SELECT id, k, string_split(CASE WHEN regexp_matches(id, '_(at_separatrix|at_wall_surface|time_averaged)$') THEN replace(regexp_replace(id, '_(at_separatrix|at_wall_surface|time_averaged)$', ''), '_', ' ') || ' ' || regexp_extract(id, '_(at_separatrix|at_wall_surface|time_averaged)$', 1) ELSE replace(id, '_', ' ') END, ' ') AS w FROM {COMPOSED})
  SELECT id, array_to_string(list_transform(w, lambda x: CASE WHEN x IN ('small', 'large', 'tiny') THEN 'size' WHEN x IN ('bolt', 'nut', 'widget') THEN 'thing' WHEN x IN ('at_separatrix', 'at_wall_surface') THEN 'place' WHEN x IN ('time_averaged', 'time') THEN 'average' ELSE 'unknown' END || ':' || x), ' ') AS segments FROM s""")
def name_segments(spark, sf_dir):
    """Composed names parsed to segments by the longest match."""
    out = name_checks.parsed(composed_names(spark, sf_dir), GRAMMAR)
    return out.select("id", F.array_join(F.transform("segments", lambda s: F.concat_ws(":", s["kind"], s["text"])), " ").alias("segments"))


# Names with prose about them, in which the parts' own words are the symbols.
PROSE_ENDS = ("", "_reference", "_measured", "_due_to_waves_at_wall", "_flux", "_normalised", "_fitted", "_reference_waveform", "_due_to_waves")
ABOUT = ("Rate of change of {}", "{} per unit time", "Array in 2D of {}", "2D plasma with {}", "Colour of {}", "Plainly {}", "Temporal derivative of {}")
DOCUMENTED = ("${}$ is a size.", "One. ${}$ grows. Two.", "No symbol for {}.", "It has $2$ and {}.", "${}$ grows. Then. Then. It is late.", "It are two. ${}$ grows.", "As ${}$ (in keV) grows. $x$ falls.", "$x$ falls. ${}$ (in keV) grows.")
FIRST_WORD, SECOND_WORD = "string_split(p_name, ' ')[1]", "string_split(p_name, ' ')[2]"
PROSE = f"""(SELECT replace(p_name, ' ', '_') || [{', '.join(map(repr, PROSE_ENDS))}][p_partkey % {len(PROSE_ENDS)} + 1] AS id, replace([{', '.join(map(repr, ABOUT))}][p_partkey % {len(ABOUT)} + 1], '{{}}', {FIRST_WORD}) AS description,
  replace([{', '.join(map(repr, DOCUMENTED))}][p_partkey % {len(DOCUMENTED)} + 1], '{{}}', {SECOND_WORD}) AS documentation, CASE WHEN p_partkey % 4 = 0 THEN 'a/fitted/b' WHEN p_partkey % 4 = 1 THEN 'a/b_measured' ELSE '' END AS source FROM part)"""
DEFINED = "list_contains(list_transform(list_slice(sentences, greatest(list_position(list_transform(sentences, lambda y: contains(y, x)), true) - 1, 1), list_position(list_transform(sentences, lambda y: contains(y, x)), true) + 2), lambda z: regexp_matches(lower(z), '(^|[^a-z])(is|are)([^a-z]|$)') OR contains(z, '(in keV)')), true)"
PROSE_CONDITIONS = {
    "rate_description": "regexp_matches(lower(description), 'rate of change|temporal derivative') OR (contains(description, 'per unit time') AND NOT contains(id, '_flux'))",
    "storage_shape": "contains(description, '2D') AND NOT contains(description, '2D plasma')",
    "provenance_verb": "(list_contains(string_split(id, '_'), 'measured') AND NOT contains(source, 'measured')) OR (list_contains(string_split(id, '_'), 'fitted') AND NOT contains(source, 'fitted'))",
    "british_spelling": "suffix(id, '_normalised') OR starts_with(description, 'Colour ')",
    "undefined_symbol": f"len(list_filter(regexp_extract_all(documentation, '[$][a-z]+[$]'), lambda x: NOT {DEFINED})) > 0",
    "reference_suffix": "suffix(id, '_reference') OR suffix(id, '_reference_waveform')",
    "placed_process": "contains(id, '_due_to_waves_at_')",
}


@query(f"""SELECT id, description, documentation, array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {n!r} END' for n, c in PROSE_CONDITIONS.items())}], lambda w: w IS NOT NULL), ',') AS checks
  FROM (SELECT *, string_split(documentation, '. ') AS sentences FROM {PROSE})""")
def prose_checks(spark, sf_dir):
    """The checks of names against what is written about them."""
    k, words = F.col("p_partkey"), F.split("p_name", " ")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    names = table(spark, sf_dir, "part").select(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), pick(PROSE_ENDS)).alias("id"), F.replace(pick(ABOUT), F.lit("{}"), words[0]).alias("description"),
        F.replace(pick(DOCUMENTED), F.lit("{}"), words[1]).alias("documentation"), F.when(k % 4 == 0, "a/fitted/b").when(k % 4 == 1, "a/b_measured").alias("source_path"),
    )
    out = name_checks.checked(names, {c: name_checks.CHECKS[c] for c in PROSE_CONDITIONS})
    return out.select("id", "description", "documentation", F.array_join(F.transform("issues", lambda x: x["check"]), ",").alias("checks"))
