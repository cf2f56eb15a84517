"""Sources and sinks: landed texts made from the tables and read back, node categories, functions on names and units."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import categories, chunks, conventions, extraction, intents, paths, scores, units
from loomgraph.operators import fulltext, lookup, upsert, vectors
from loomgraph.plans.shared import ensure_checkpoint_dir, table
from loomgraph.queries.graph import GRAPH, edges, nodes
from loomgraph.queries.queues import NOW, now, queue
from loomgraph.queries.registry import query
from loomgraph.sources import dictionary, files
from loomgraph.streaming import leases


def dictionary_texts(spark, sf_dir):
    """One dictionary file for each group: brands as structures, parts as fields."""
    part = table(spark, sf_dir, "part").select(F.lower("p_type").alias("grp"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("brand"), "p_partkey", "p_name", "p_size")
    label = F.when(F.col("p_size") % 9 == 0, ' cocos_label_transformation="psi_like"').otherwise("")
    field = F.concat(F.lit('<field name="f'), "p_partkey", F.lit('" data_type="FLT_1D" units="m" documentation="'), "p_name", F.lit('"'), label, F.lit("/>"))
    brands = part.groupBy("grp", "brand").agg(F.concat(F.lit('<field name="'), "brand", F.lit('" data_type="STRUCTURE">'), F.array_join(F.sort_array(F.collect_list(field)), ""), F.lit("</field>")).alias("x"))
    body = F.concat(F.lit("<root><cocos>"), F.when(F.startswith("grp", F.lit("s")), 17).otherwise(11), F.lit('</cocos><IDS name="'), "grp", F.lit('">'), F.array_join(F.sort_array(F.collect_list("x")), ""), F.lit("</IDS></root>"))
    return brands.groupBy("grp").agg(body.alias("value")).select(F.col("grp").alias("file"), "value")


OWN = "(SELECT lower(p_type) AS grp, lower(replace(p_brand, '#', '_')) AS brand, p_partkey AS k, p_name, p_size FROM part)"


@query(f"""SELECT grp || '/' || brand || '/f' || k AS path, grp || '/' || brand AS parent_path, 'FLT_1D' AS data_type, p_name AS documentation, CASE WHEN p_size % 9 = 0 THEN 'psi_like' END AS label, 2::INT AS depth, true AS is_leaf FROM {OWN}
  UNION ALL SELECT DISTINCT grp || '/' || brand, grp, 'STRUCTURE', NULL, NULL, 1, false FROM {OWN} UNION ALL SELECT DISTINCT grp, NULL, NULL, NULL, NULL, 0, false FROM {OWN}""")
def dictionary_fields(spark, sf_dir):
    """Dictionary files flattened to paths with their parents and labels."""
    return files.dictionary_paths(dictionary_texts(spark, sf_dir)).select("path", "parent_path", "data_type", "documentation", "label", "depth", "is_leaf")


@query(f"SELECT grp AS file, CASE WHEN starts_with(grp, 's') THEN 17 ELSE 11 END::INT AS convention, count_if(p_size % 9 = 0)::INT AS n_labelled FROM {OWN} GROUP BY 1")
def dictionary_conventions(spark, sf_dir):
    return files.dictionary_conventions(dictionary_texts(spark, sf_dir))


@query(f"SELECT grp, string_agg(brand || '/f' || k, ' ' ORDER BY brand || '/f' || k) AS fields FROM {OWN} WHERE p_size % 9 = 0 GROUP BY 1")
def labelled_fields(spark, sf_dir):
    """Paths with a label, by dictionary file."""
    found = files.dictionary_paths(dictionary_texts(spark, sf_dir)).where("label is not null")
    inner = F.expr("substring(path, length(file) + 2)")
    return found.groupBy(F.col("file").alias("grp")).agg(F.array_join(F.sort_array(F.collect_list(inner)), " ").alias("fields"))


@query(f"""{GRAPH} SELECT grp, count(*)::BIGINT AS n, sha256(string_agg(id || ':' || coalesce(unit, ''), '|' ORDER BY id)) AS digest FROM nodes WHERE NOT contains(name, '_error_') GROUP BY 1""")
def dictionary_documents(spark, sf_dir):
    """What a dictionary is transformed to: one document for each group, without error fields."""
    own = nodes(spark, sf_dir)
    kept = own.where(lookup.exclusion_reason(F.concat_ws("/", "parent", "name")).isNull())
    listed = F.sort_array(F.collect_list(F.struct("id", F.coalesce("unit", F.lit("")).alias("unit"))))
    written = F.transform(listed, lambda x: F.concat(x["id"], F.lit(":"), x["unit"]))
    return kept.groupBy("grp").agg(F.count("*").alias("n"), F.sha2(F.array_join(written, "|"), 256).alias("digest"))


def nested_texts(spark, sf_dir):
    """Dictionary files in pieces, with nested structures: some documented, with units that refer elsewhere, coordinates, bounds and states."""
    k, size = F.col("p_partkey"), F.col("p_size")
    part = table(spark, sf_dir, "part").select(F.lower("p_type").alias("grp"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))).alias("brand"), k, "p_name", size)
    attribute = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"'))).otherwise("")
    unit = F.when(size % 7 == 0, "m^dimension").when(size % 7 == 1, "units given by coordinate_system(:)/coordinate(phi)/units").when(size % 7 == 2, "units given by process").when(size % 7 == 3, "T.m").when(size % 7 == 4, "1")
    field = F.concat(
        F.when(size % 10 == 0, "<coordinate").otherwise("<field"), F.lit(' name="f'), k, F.when(k % 13 == 0, "_error_upper").otherwise(""), F.lit('" data_type="FLT_1D"'), attribute("units", unit), attribute("documentation", F.when(k % 3 > 0, F.col("p_name"))),
        attribute("coordinate1", F.when(k % 2 == 0, "time")), attribute("coordinate2", F.when(k % 4 == 0, "1...N")), attribute("min", F.when(k % 5 == 0, k)), attribute("lifecycle_status", F.when(k % 9 == 0, "obsolescent")),
        attribute("introduced_after", F.when(k % 6 == 0, "3.2.0")), attribute("doc_identifier", F.when(k % 8 == 0, "x/y_identifier.xml")), F.lit("/>"),
    )
    # pieces of a file, as no task should hold one whole: of place 1 are structures, each with its fields of kind 1
    piece = lambda df, place, brand, kind, at, value: df.select(F.col("grp").alias("file"), F.struct(F.lit(place).alias("place"), brand.alias("brand"), F.lit(kind).alias("kind"), at.alias("at")).alias("place"), value.alias("value"))
    none, nowhere, brand = F.lit(""), F.lit(0).cast("long"), F.col("brand")
    brands = part.where("brand is not null").select("grp", "brand").distinct()
    groups = part.select("grp").distinct()
    pieces = [
        piece(groups, 0, none, 0, nowhere, F.concat(F.lit('<root><IDS name="'), "grp", F.lit('" documentation="All of '), "grp", F.lit('">'))),
        piece(brands, 1, brand, 0, nowhere, F.concat(F.lit('<field name="'), "brand", F.lit('" data_type="STRUCTURE" units="Pa" documentation="About '), "brand", F.lit('!" lifecycle_status="alpha"><part>'))),
        piece(part.where("brand is not null"), 1, brand, 1, k, field),
        piece(brands, 1, brand, 2, nowhere, F.lit("</part></field>")),
        piece(groups, 2, none, 0, nowhere, F.lit("</IDS></root>")),
    ]
    return reduce(DataFrame.unionByName, pieces).where("file is not null and value is not null")


UNITS_OF = "CASE p_size % 7 WHEN 0 THEN CASE WHEN k % 4 = 0 THEN 'm^2' WHEN k % 2 = 0 THEN 'm' ELSE 'm^3' END WHEN 1 THEN 'rad' WHEN 3 THEN 'T.m' WHEN 4 THEN '1' ELSE '' END"
GIVEN_UNITS = "CASE p_size % 7 WHEN 0 THEN 'm^dimension' WHEN 1 THEN 'units given by coordinate_system(:)/coordinate(phi)/units' WHEN 2 THEN 'units given by process' WHEN 3 THEN 'T.m' WHEN 4 THEN '1' END"
NESTED = f"""(SELECT grp, grp || '/' || brand || '/f' || k AS path, CASE WHEN k % 3 > 0 THEN p_name || '. Within ' || grp || ' IDS: All of ' || grp || '. Within ' || brand || ' container: About ' || brand || '!' ELSE 'About ' || brand || '! Within ' || grp || ' IDS: All of ' || grp || '.' END AS documentation,
  {UNITS_OF} AS units, concat_ws(',', CASE WHEN k % 2 = 0 THEN 'time' END, CASE WHEN k % 4 = 0 THEN '1...N' END) AS coordinates, CASE WHEN k % 5 = 0 THEN k::VARCHAR END AS min_value, p_size % 7 IN (0, 1, 2, 3) AS units_required,
  CASE WHEN k % 9 = 0 THEN 'obsolescent' ELSE 'alpha' END AS inherited_status, coalesce({GIVEN_UNITS}, 'Pa') AS inherited_units, CASE WHEN k % 6 = 0 THEN '3.2.0' END AS introduced_after_version, CASE WHEN k % 8 = 0 THEN 'x/y_identifier.xml' END AS identifier_schema FROM {OWN} WHERE k % 13 > 0
  UNION ALL SELECT DISTINCT grp, grp || '/' || brand, 'About ' || brand || '! Within ' || grp || ' IDS: All of ' || grp || '.', 'Pa', '', NULL, true, 'alpha', 'Pa', NULL, NULL FROM {OWN})"""


@query(f"SELECT * FROM {NESTED}")
def dictionary_extracts(spark, sf_dir):
    """What the extractors find for each field, with what it inherits from the elements above; error fields are left out."""
    out = dictionary.extracted(dictionary.elements(nested_texts(spark, sf_dir)))
    return out.select("grp", "path", "documentation", "units", F.array_join("coordinates", ",").alias("coordinates"), "min_value", "units_required", "inherited_status", "inherited_units", "introduced_after_version", "identifier_schema")


@query(f"""SELECT grp, 'All of ' || grp AS description, 3::INT AS max_depth, count(*)::BIGINT AS leaf_count, round((1 + count(DISTINCT brand) + count_if(k % 3 > 0)) / (1 + count(DISTINCT brand) + count(*))::DOUBLE, 6) AS coverage FROM {OWN} GROUP BY 1""")
def dictionary_groups(spark, sf_dir):
    out = dictionary.group_info(dictionary.elements(nested_texts(spark, sf_dir)))
    return out.select("grp", "description", "max_depth", "leaf_count", F.round("coverage", 6).alias("coverage"))


@query(f"SELECT grp, 'f' || k || CASE WHEN k % 13 = 0 THEN '_error_upper' ELSE '' END AS name, CASE WHEN k % 3 > 0 THEN p_name ELSE '' END AS description, coalesce({GIVEN_UNITS}, '') AS units FROM {OWN} WHERE p_size % 10 = 0")
def coordinate_systems(spark, sf_dir):
    return dictionary.coordinate_systems(dictionary.elements(nested_texts(spark, sf_dir))).drop("file")


@query(f"""SELECT grp, key, count(*)::BIGINT AS n, string_agg(path, ' ' ORDER BY path) AS paths FROM (SELECT grp, path, CASE WHEN units NOT IN ('', '1', 'mixed') THEN 'units_' || replace(replace(units, '/', '_'), '.', '_') WHEN coordinates <> '' THEN 'coordinates_' || replace(coordinates, ',', '_')
  WHEN len(string_split(path, '/')) >= 3 THEN 'structure_' || string_split(path, '/')[2] ELSE 'misc' END AS key FROM {NESTED}) GROUP BY 1, 2 HAVING count(*) > 1""")
def semantic_groups(spark, sf_dir):
    """Fields of a group that belong together by units, coordinates or place."""
    fields = dictionary.extracted(dictionary.elements(nested_texts(spark, sf_dir)))
    return dictionary.semantic_groups(fields).withColumn("paths", F.array_join("paths", " "))


@query("""SELECT 's' || (p_size % 5) AS schema, count(DISTINCT p_name)::BIGINT AS n, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS names FROM part GROUP BY 1""")
def identifier_catalogue(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    option = F.to_json(F.array(F.struct(F.col("p_name").alias("name"), F.lit(1).alias("index"), F.lit("d").alias("description"))))
    out = files.identifier_catalogue(part.select(F.concat(F.lit("s"), F.col("p_size") % 5).alias("schema"), option.alias("options")))
    return out.select("schema", "n", F.array_join(F.sort_array(F.transform("options", lambda o: o["name"])), ",").alias("names"))


@query("""SELECT conv_id::VARCHAR AS file, turn::INT AS cell, CASE WHEN role = 'user' THEN 'markdown' ELSE 'code' END AS kind, text FROM conversations WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) = 1""")
def notebook_cells(spark, sf_dir):
    """Conversations as notebooks: a cell for each turn, its lines in a list."""
    turns = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("t"))
    cell = F.struct("turn", F.when(F.col("t.role") == "user", "markdown").otherwise("code").alias("cell_type"), F.array("t.text").alias("source"))
    books = turns.groupBy(F.col("conv_id").cast("string").alias("file")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(cell)).alias("cells"))).alias("value"))
    return files.notebook_cells(books)


@query("SELECT doc_id::VARCHAR AS file, lang AS ids, n_chars FROM documents WHERE lang IN ('en', 'de')")
def json_documents(spark, sf_dir):
    """JSON documents read back, those of two groups."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.to_json(F.struct(F.col("lang").alias("ids"), "n_chars", "text")).alias("value"))
    return files.json_rows(d, "ids string, n_chars long").where(F.col("ids").isin("en", "de"))


@query("SELECT event_id::VARCHAR AS file, floor(value) / 1000 AS psi_axis, -0.5::DOUBLE AS psi_edge, 2.5::DOUBLE AS field, (CASE WHEN event_id % 2 = 0 THEN -1e6 ELSE 1e6 END)::DOUBLE AS current FROM events")
def equilibria(spark, sf_dir):
    """Numbers of fixed width read from equilibrium files."""
    number = lambda c: F.lpad(F.format_string("%.9E", c.cast("double")), 16, " ")
    zero = F.lit(0.0)
    rows = [[zero] * 5, [zero, zero, F.floor("value") / 1000, F.lit(-0.5), F.lit(2.5)], [F.when(F.col("event_id") % 2 == 0, -1e6).otherwise(1e6), zero, zero, zero, zero]]
    body = F.concat_ws("\n", F.lit("EFIT 0 65 65"), *[F.concat(*[number(c) for c in r]) for r in rows])
    return files.equilibria(table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("file"), body.alias("value")))


def equilibrium_texts(spark, sf_dir):
    """Files of 3 x 2 points; every seventh ends early, every eleventh has no sizes. Numbers stand without spaces between them."""
    number = lambda c: F.lpad(F.format_string("%.9E", c.cast("double")), 16, " ")
    k = F.col("event_id")
    values = F.concat(
        F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: (k % 50 + i) / 4), F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: -(k % 9) - i),
        F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: (k % 7) * i / 8), F.array(*[F.lit(x).cast("double") for x in (1, 1.5, 2)]),
    )
    lines = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda r: F.array_join(F.transform(F.slice(values, r * 5 + 1, F.lit(5)), number), ""))
    points = F.concat(F.lit("\n    2    1\n"), F.array_join(F.transform(F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4)]), number), ""), F.lit("\n"), F.array_join(F.transform(F.array(F.lit(9.0), F.lit(-8.0)), number), ""))
    head = F.when(k % 11 == 0, "EFIT").otherwise("EFIT   01/02  #1   0   3   2")
    body = F.when(k % 7 == 0, F.array_join(F.slice(lines, 1, 8), "\n")).otherwise(F.concat(F.array_join(lines, "\n"), points))
    return table(spark, sf_dir, "events").select(k.cast("string").alias("file"), F.concat(head, F.lit("\n"), body).alias("value"))


EQ = "(SELECT event_id AS k, CASE WHEN event_id % 11 = 0 THEN 'header' WHEN event_id % 7 = 0 THEN 'short: 40 of 41' END AS error FROM events)"


@query(f"""SELECT k::VARCHAR AS file, error, CASE WHEN error IS NULL THEN (k % 50 + 7) / 4 END AS psi_axis, CASE WHEN error IS NULL THEN (k % 50 + 10) / 4 END AS current, CASE WHEN error IS NULL THEN -(k % 9) - 3 END::DOUBLE AS first_pressure,
  CASE WHEN error IS NULL THEN 5 * (k % 7) / 8 END AS last_flux, CASE WHEN error IS NULL THEN 2 END::DOUBLE AS last_safety, CASE WHEN error IS NULL THEN 3.0 END::DOUBLE AS boundary_r, CASE WHEN error IS NULL THEN -8.0 END::DOUBLE AS limiter_z FROM {EQ}""")
def whole_equilibria(spark, sf_dir):
    """Whole equilibrium files: scalars, profiles, flux, boundary and limiter, and what is wrong with bad ones."""
    out = files.whole_equilibria(equilibrium_texts(spark, sf_dir))
    return out.select("file", "error", "psi_axis", "current", F.get("pressure", F.lit(0)).alias("first_pressure"), F.element_at("flux", -1).alias("last_flux"), F.element_at("safety_factor", -1).alias("last_safety"), F.get("boundary", F.lit(1))["r"].alias("boundary_r"), F.get("limiter", F.lit(0))["z"].alias("limiter_z"))


@query(f"""SELECT k::VARCHAR AS file, i::INT AS i, j::INT AS j, (k % 50 + 3) / 4 + (k % 50) / 8 * i AS r, (k % 50 + 4) / 4 - (k % 50 + 1) / 8 + (k % 50 + 1) / 4 * j AS z, (k % 7) * (j * 3 + i) / 8 AS psi FROM {EQ}, range(3) a(i), range(2) b(j) WHERE error IS NULL""")
def flux_grid(spark, sf_dir):
    """The flux of each file as rows of its grid."""
    return files.flux_grid(files.whole_equilibria(equilibrium_texts(spark, sf_dir)))


@query("""SELECT p_partkey, '<h2>' || p_name || '</h2>' || chr(10) || '<li>a <b>' || lower(p_type) || '</b></li>' || chr(10) || '<a href="T' || p_size || '">see</a> <code>x</code>' AS html FROM part""")
def markup_to_html(spark, sf_dir):
    text = F.concat(F.lit("---++ "), "p_name", F.lit("\n   * a *"), F.lower("p_type"), F.lit("*\n[[T"), "p_size", F.lit("][see]] =x="))
    return table(spark, sf_dir, "part").select("p_partkey", files.markup_to_html(text).alias("html"))


@query("SELECT user_id, min(event_id)::BIGINT AS first, max(event_id)::BIGINT AS last, count(*)::BIGINT AS n FROM events GROUP BY 1")
def merged_versions(spark, sf_dir):
    return files.merged_versions(table(spark, sf_dir, "events"), "user_id", F.col("event_id"))


# Paths with data type, unit, parent's data type, and the category that they must get.
CATEGORY_EXAMPLES = [
    ("eq/slice/psi_error_upper", "FLT_1D", "Wb", None, "error"), ("eq/code/parameters", "STR_0D", None, None, "metadata"), ("temporary/constant", "FLT_0D", "m", None, "metadata"),
    ("summary/a/temporary_storage_value", "INT_0D", None, None, "metadata"), ("eq/slice/name", "FLT_0D", None, None, "metadata"), ("eq/machine", "STR_0D", None, None, "metadata"),
    ("eq/time", "FLT_1D", "s", None, "coordinate"), ("eq/a/validity", "INT_0D", None, None, "structural"), ("eq/a/data", "FLT_1D", "m", "STRUCTURE", "structural"),
    ("eq/a/grid_type", "INT_0D", None, None, "structural"), ("eq/a/chi_squared", "FLT_0D", None, None, "fit_artifact"), ("cp/n_e_fit/measured", "FLT_1D", "m^-3", None, "fit_artifact"),
    ("transport_solver_numerics/convergence/x", "FLT_0D", "m", None, "fit_artifact"), ("eq/grids_ggd/x", "FLT_1D", "m", None, "representation"), ("eq/a/spline_b", "FLT_1D", None, None, "representation"),
    ("pulse_schedule/a/b/reference", "FLT_1D", "A", None, "representation"), ("x/j_tot/diamagnetic", "FLT_1D", "A.m^-2", None, "representation"), ("det/adc/bias", "FLT_0D", "V", None, "metadata"),
    ("pf/a/current_limit_max", "FLT_1D", "A", None, "metadata"), ("a/data_entry/run", "INT_0D", None, None, "metadata"), ("summary/a/occurrence", "STRUCTURE", "Hz", None, "metadata"),
    ("pf_active/coil/r", "FLT_1D", "m", None, "geometry"), ("eq/boundary/outline/r", "FLT_1D", "m", None, "quantity"), ("eq/a/psi", "FLT_1D", None, None, "coordinate"),
    ("eq/a/q", "FLT_1D", None, None, "quantity"), ("eq/a/b", "STRUCTURE", "T", None, "quantity"), ("eq/a/b", "STRUCTURE", None, None, "structural"), ("eq/a/value", "INT_0D", None, None, "structural"),
    ("eq/a/z_n", "INT_0D", None, None, "quantity"), ("eq/a/thing", "INT_0D", None, None, "structural"), ("eq/a/turn_area", "INT_1D", "m", None, "quantity"), ("eq/a/odd", None, None, None, "structural"),
    ("x/pulse_time_begin_epoch/seconds", "INT_0D", "s", None, "metadata"), ("x/equilibrium_id/occurrence", "INT_0D", None, None, "metadata"), ("a/b/sound_3db", "FLT_0D", "dB", None, "metadata"),
]
LITERAL = ", ".join(f"({k}, {', '.join('NULL' if x is None else repr(x) for x in e)})" for k, e in enumerate(CATEGORY_EXAMPLES))


@query(f"WITH e(k, path, dtype, unit, up, category) AS (VALUES {LITERAL}) SELECT p.p_partkey, e.path, e.category FROM part p JOIN e ON e.k = p.p_partkey % {len(CATEGORY_EXAMPLES)}")
def node_categories(spark, sf_dir):
    """Categories by path and type; the SQL lists what each example must get."""
    examples = F.array(*[F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(("path", "dtype", "unit", "up"), e)]) for e in CATEGORY_EXAMPLES])
    e = table(spark, sf_dir, "part").select("p_partkey", F.get(examples, (F.col("p_partkey") % len(CATEGORY_EXAMPLES)).cast("int")).alias("e"))
    return e.select("p_partkey", "e.path", categories.category(F.col("e.path"), F.col("e.dtype"), F.col("e.unit"), F.col("e.up")).alias("category"))


@query(f"""{GRAPH} SELECT id, CASE WHEN k % 6 = 0 THEN 'identifier' WHEN k % 5 = 0 AND category <> 'error' AND coalesce(unit, '') NOT IN ('', '-', 'mixed') THEN category WHEN k % 5 = 0 AND category <> 'error' THEN 'coordinate'
  WHEN category = 'quantity' AND dtype = 'STRUCTURE' AND coalesce(unit, '') NOT IN ('', '-', 'mixed') THEN 'structural' ELSE category END AS category FROM nodes
  UNION ALL SELECT parent, CASE WHEN count_if(category IN ('quantity', 'coordinate', 'structural')) > 0 THEN 'quantity' ELSE 'structural' END FROM nodes GROUP BY 1
  UNION ALL SELECT DISTINCT parent || '/bare', 'structural' FROM nodes UNION ALL SELECT DISTINCT parent || '_fit/x', 'fit_artifact' FROM nodes UNION ALL SELECT DISTINCT parent || '_fit', 'quantity' FROM nodes""")
def revised_categories(spark, sf_dir):
    """Categories after a look at identifier schemas, coordinate targets and children.

    Beside the nodes there are their parents, structures that hold data or none, and what stands inside of fits.
    """
    own = nodes(spark, sf_dir)
    columns = ["id", "parent", "name", "category", "dtype", "unit"]
    up = own.select("parent").distinct()
    made = lambda id_, parent, name, dtype: up.select(id_.alias("id"), parent.alias("parent"), F.lit(name).alias("name"), F.lit("quantity").alias("category"), F.lit(dtype).alias("dtype"), F.lit("Pa").alias("unit"))
    p, none = F.col("parent"), F.lit(None).cast("string")
    fit = F.concat(p, F.lit("_fit"))
    every = [made(p, none, "brand", "STRUCTURE"), made(F.concat(p, F.lit("/bare")), none, "bare", "STRUCTURE"), made(F.concat(fit, F.lit("/x")), fit, "x", "FLT_1D"), made(fit, none, "fit", "STRUCTURE")]
    whole = own.select(columns)
    for part in every:
        whole = whole.unionByName(part)
    return categories.reclassified(whole, own.where("k % 6 = 0"), own.where("k % 5 = 0"))


@query(f"""{GRAPH} SELECT id AS src, parent AS dst, 'in_parent' AS type FROM nodes UNION ALL SELECT id, grp, 'in_group' FROM nodes UNION ALL SELECT id, unit, 'has_unit' FROM nodes WHERE unit IS NOT NULL UNION ALL SELECT id, introduced, 'introduced_in' FROM nodes WHERE introduced IS NOT NULL
  UNION ALL SELECT id, deprecated, 'deprecated_in' FROM nodes WHERE deprecated IS NOT NULL UNION ALL SELECT id, domain, 'in_domain' FROM nodes WHERE domain IS NOT NULL UNION ALL SELECT src, dst, 'renamed_to' FROM edges""")
def bulk_edges(spark, sf_dir):
    """The edge tables that a bulk write of nodes fans out to, from one pass over the nodes."""
    types = {"in_parent": "parent", "in_group": "grp", "has_unit": "unit", "introduced_in": "introduced", "deprecated_in": "deprecated", "in_domain": "domain"}
    own = upsert.fanned_out(nodes(spark, sf_dir), "id", types)
    return own.unionByName(edges(spark, sf_dir).withColumn("type", F.lit("renamed_to")))


@query("SELECT p_partkey AS id, p_size AS n FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, p_size + 1 FROM part WHERE p_partkey % 6 = 0")
def conditional_delete(spark, sf_dir):
    """Of the rows that changed some are deleted and the others replaced."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("n"))
    changed = part.where("id % 3 = 0").withColumn("n", F.col("n") + 1)
    return upsert.replaced_or_deleted(part, changed, "id", F.col("id") % 6 != 0)


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'new' || l.quality ELSE d.lang END AS lang FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id")
def write_back(spark, sf_dir):
    """Values computed elsewhere written back by id: only that column changes, missing ids keep theirs."""
    new = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.concat(F.lit("new"), F.max("quality")).alias("lang"))
    return upsert.upsert(table(spark, sf_dir, "documents").select("doc_id", "lang"), new, ["doc_id"]).where("doc_id is not null")


def reread(spark, df, how):
    folder = f"{ensure_checkpoint_dir(spark)}/sink-{uuid.uuid4().hex}"
    df.write.format(how).save(folder)
    return spark.read.schema(df.schema).format(how).load(folder)


@query(f"{GRAPH} SELECT parent AS label, count(*)::BIGINT AS n, string_agg(id, '|' ORDER BY id) AS members FROM nodes GROUP BY 1")
def clusters_to_json(spark, sf_dir):
    """A sink of JSON lines, read back."""
    own = nodes(spark, sf_dir).groupBy(F.col("parent").alias("label")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), "|").alias("members"))
    return reread(spark, own, "json")


@query("SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def vectors_to_files(spark, sf_dir):
    """A sink of vectors, read back."""
    out = reread(spark, table(spark, sf_dir, "embeddings"), "parquet")
    return out.select("vec_id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


@query("SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AND text IS NOT NULL")
def comments_to_json(spark, sf_dir):
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct()
    return reread(spark, table(spark, sf_dir, "documents").where("text is not null").join(bad, "doc_id", "left_semi").select("doc_id", "text"), "json")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a/b' WHEN 1 THEN 'a/time_b' WHEN 2 THEN 'b' ELSE 'x/validity/y' END AS path, CASE p_partkey % 4 WHEN 0 THEN '\\(a\\+b\\)' WHEN 1 THEN 'a\\-b' WHEN 2 THEN '\\"x\\"' ELSE 'c\\:d' END AS term,
  CASE p_partkey % 3 WHEN 0 THEN 'github.com' ELSE 'git.iter.org' END AS host, CASE p_partkey % 3 WHEN 0 THEN 'o' WHEN 1 THEN 'a/b' ELSE 'scm' END AS owner, CASE p_partkey % 3 WHEN 0 THEN 'repo' WHEN 1 THEN 'c' ELSE 'x.y' END AS repository FROM part""")
def path_functions(spark, sf_dir):
    """Accessors stripped, query signs escaped, git remotes read."""
    k = F.col("p_partkey")
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), (k % len(v)).cast("int"))
    remote = paths.remote_url(pick("git@github.com:o/repo.git", "https://git.iter.org/a/b/c", "ssh://git@git.iter.org:2222/scm/x.y.git"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", paths.strip_accessor(pick("a/b/data", "a/time_b", "b/value", "x/validity/y")).alias("path"), paths.escape_query(pick("(a+b)", "a-b", '"x"', "c:d")).alias("term"), *[c.alias(n) for n, c in remote.items()]
    )


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'sign_convention' WHEN 1 THEN 'coordinate_convention' WHEN 2 THEN 'data_format_change' WHEN 3 THEN 'definition_clarification' ELSE 'none' END AS class,
  CASE WHEN event_id % 2 = 0 THEN 17 ELSE 11 END::INT AS convention, round(value * 1000, 4)::DOUBLE AS in_ev, CASE event_id % 2 WHEN 0 THEN '\\A::B:C,\\T::X' ELSE '\\T::X' END AS tree_paths FROM events""")
def value_functions(spark, sf_dir):
    """Classes of documentation changes, conventions of versions, converted units, tree paths in text."""
    e = F.col("event_id")
    new = F.get(F.array(*map(F.lit, ("now positive upwards", "in a right-handed frame", "each column", "short text that grew much", "same"))), (e % 5).cast("int"))
    old = F.get(F.array(*map(F.lit, ("now", "in a frame", "each", "short", "same"))), (e % 5).cast("int"))
    text = F.when(e % 2 == 0, r"see \\t::x and \a::b:c").otherwise(r"\T::x, \\t::X")
    return table(spark, sf_dir, "events").select(
        "event_id", scores.doc_change(old, new).alias("class"), conventions.from_version(F.when(e % 2 == 0, "4.0.0").otherwise("3.42.2")).alias("convention"),
        F.round(units.converted(F.col("value"), F.lit("keV"), F.lit("eV")), 4).alias("in_ev"), F.array_join(extraction.tree_paths(text), ",").alias("tree_paths"),
    )


@query("""SELECT event_id AS id, CASE WHEN event_type = 'purchase' AND event_id % 3 <> 0 THEN 'old' END AS token FROM events""")
def released_claims(spark, sf_dir):
    """Claims given back, one or many; others keep theirs."""
    work = queue(spark, sf_dir)
    return leases.release(work, work.where("id % 3 = 0"), "old").select("id", "token")


@query(f"""WITH q AS (SELECT event_id AS id, user_id, event_type <> 'error' AND (event_type <> 'purchase' OR ts < TIMESTAMP '{NOW}' - INTERVAL 300 SECOND) AS free FROM events)
  SELECT count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS n_users FROM (SELECT * FROM q WHERE free AND user_id = (SELECT user_id FROM q WHERE free AND id = (SELECT min(id) FROM q WHERE free AND user_id = 5)) ORDER BY id LIMIT 8)""")
def group_claim(spark, sf_dir):
    """Rows of one user claimed together."""
    work = queue(spark, sf_dir).where("user = 5")
    claimed = leases.claim_group(work, "mine", now(), 8, 300, ["user"]).where("token = 'mine'")
    return claimed.agg(F.count("*").alias("n"), F.count_distinct("user").alias("n_users"))


@query(f"""{GRAPH}, s AS (SELECT id, (CASE WHEN contains(lower(name), 'red_ring') THEN 6 ELSE 0 END) + (CASE WHEN contains(lower(coalesce(doc, '')), 'red_ring') THEN 4 ELSE 0 END) + (CASE WHEN contains(name, 'red') THEN 3 ELSE 0 END) + (CASE WHEN contains(name, 'ring') THEN 3 ELSE 0 END)
    + (CASE WHEN contains(doc, 'red') THEN 1 ELSE 0 END) + (CASE WHEN contains(doc, 'ring') THEN 1 ELSE 0 END) + (CASE WHEN k % 10 = 0 THEN 10 ELSE 0 END) AS score FROM nodes)
  SELECT id, score::INT AS score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 30""")
def identifier_search(spark, sf_dir):
    """Keyword tiers, and ten more for a vector hit."""
    own = nodes(spark, sf_dir)
    none = F.array().cast("array<string>")
    score = fulltext.keyword_score("red_ring", F.col("name"), F.col("doc"), none, none) + F.when(F.col("k") % 10 == 0, 10).otherwise(0)
    return own.select("id", score.cast("int").alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(30)


CENTRES = """c AS (SELECT label, list(m / n ORDER BY pos) AS v FROM (SELECT label, pos, m, sqrt(sum(m * m) OVER (PARTITION BY label)) AS n FROM (SELECT label, pos, avg(x) AS m FROM
  (SELECT label, unnest(list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY 1, 2)) GROUP BY 1)"""


@query(f"""WITH {CENTRES} SELECT a.label AS cluster, b.label AS other, round(list_cosine_similarity(a.v, b.v), 5) AS similarity, row_number() OVER (PARTITION BY a.label ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.label)::INT AS place FROM c a JOIN c b ON a.label <> b.label
  QUALIFY row_number() OVER (PARTITION BY a.label ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.label) <= 2""")
def similar_clusters(spark, sf_dir):
    """The two clusters whose centres are nearest to each cluster's."""
    centres = vectors.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", "centroid")
    out = vectors.top_k(centres, centres, "label", "centroid", 2)
    return out.select(F.col("query").alias("cluster"), F.col("label").alias("other"), F.round("similarity", 5).alias("similarity"), "place")


@query(f"""WITH {CENTRES} SELECT c.label AS cluster, round(0.5 * s + 0.25 + 0.1 + 0.05 * 0.5, 5)::DOUBLE AS relevance FROM (SELECT c.label, list_cosine_similarity(c.v, e.embedding::DOUBLE[]) AS s FROM c, (SELECT embedding FROM embeddings WHERE vec_id = 0) e) c WHERE s > 0.05""")
def cluster_relevance(spark, sf_dir):
    """Clusters over a threshold of similarity with a query vector, and their relevance."""
    rows = table(spark, sf_dir, "embeddings")
    centres = vectors.centroids(rows, "label", "embedding")
    asked = rows.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    near = centres.crossJoin(F.broadcast(asked)).withColumn("s", vectors.cosine(F.col("centroid"), F.col("q"))).where("s > 0.05")  # one row
    relevance = scores.relevance(F.col("s"), F.lit("high"), F.lit(False), F.lit("global"), F.lit(0.5))
    return near.select(F.col("label").alias("cluster"), F.round(relevance, 5).alias("relevance"))


@query("""SELECT c.c_custkey, count(o.o_orderkey)::BIGINT AS n, coalesce(string_agg(DISTINCT o.o_orderpriority, ' ' ORDER BY o.o_orderpriority), '') AS targets, max(o.o_totalprice)::DOUBLE AS best FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' WHERE c.c_nationkey < 3 GROUP BY 1""")
def mapping_state(spark, sf_dir):
    """What is mapped so far for the sources of some groups: number, targets, best score; none give zeros."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("o_orderpriority")).alias("t"), F.max("o_totalprice").alias("best"))
    own = table(spark, sf_dir, "customer").where("c_nationkey < 3").select("c_custkey").join(orders, "c_custkey", "left")
    return own.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.array_join("t", " "), F.lit("")).alias("targets"), "best")


# Queries, and the kind, accessor, group and terms that each must get.
INTENT_EXAMPLES = [
    ("eq/time_slice/psi", "path_exact", None, "eq", ""), ("core/te/data", "path_exact", "data", "core", ""), ("core/*/te", "path_partial", None, "core", ""), ("_x/value", "path_exact", "value", None, ""),
    (" Te ", "concept", None, None, "electron temperature|te"), ("te profile", "hybrid", None, None, "electron temperature|te|profile|te profile"), ("plasma shape", "concept", None, None, "plasma shape"), ("", "concept", None, None, ""),
]
INTENTS = ", ".join(f"({k}, {', '.join('NULL' if x is None else repr(x) for x in e)})" for k, e in enumerate(INTENT_EXAMPLES))


@query(f"WITH e(k, q, kind, accessor, grp, terms) AS (VALUES {INTENTS}) SELECT p.p_partkey, e.kind, e.accessor, e.grp, e.terms FROM part p JOIN e ON e.k = p.p_partkey % {len(INTENT_EXAMPLES)}")
def query_intents(spark, sf_dir):
    """What a query is after; the SQL lists what each example must get."""
    texts = F.array(*[F.lit(e[0]) for e in INTENT_EXAMPLES])
    q = table(spark, sf_dir, "part").select("p_partkey", intents.query_intent(F.get(texts, (F.col("p_partkey") % len(INTENT_EXAMPLES)).cast("int"))).alias("i"))
    return q.select("p_partkey", "i.kind", "i.accessor", "i.grp", F.array_join("i.terms", "|").alias("terms"))


@query("""SELECT p_partkey, c.chunk::INT AS chunk, c.text FROM part, (SELECT unnest([0, 1, 2]) AS chunk) n, LATERAL (SELECT n.chunk, CASE n.chunk WHEN 0 THEN 'import ' || lower(p_type) || chr(10) WHEN 1 THEN '@cached' || chr(10) || 'def f_' || p_partkey || '(x):' || chr(10) || '    return x' || chr(10)
  ELSE 'class C:' || chr(10) || '    n = ' || p_size END AS text) c""")
def code_chunks(spark, sf_dir):
    """Source texts cut between their units."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("import "), F.lower("p_type"), F.lit("\n\n@cached\ndef f_"), k, F.lit("(x):\n    return x\n\nclass C:\n    n = "), "p_size")
    out = chunks.chunk_rows(table(spark, sf_dir, "part").select(k, text.alias("text")), "p_partkey", "text", 45, 0, code=True)
    return out.select("p_partkey", "chunk", "text")


# Two units in each language; strings and comments hold what would begin or end one.
SOURCES = {
    "python": ["# of {k}\n@kept(\n    1)\ndef f_{k}(a):\n    \"\"\"x\ndef no():\n\"\"\"\n    return [a,\na]\n", "class C_{k}:\n    t = '#('\n\n    def g(self):  # it does nothing at all, and says so\n        pass"],
    "c": ["/* } of\n   {k} */\nint f_{k}(int a,\n  int b)\n{{\n  if (a) {{ puts(\"}}\"); }}\n  return '{{';\n}}\n", "// next, and last of all that is here\nstatic int n_{k} = 1; /* never {{ changed */"],
    "fortran": ["! of {k}\nsubroutine f_{k}(a)\n  if (a > 0) then ! end\n    print *, 'end if'\n  end if\n  do i = 1, &\n   end_of\n  enddo\nEND SUBROUTINE\n", "real function g_{k}(x)\n  g = x\nend"],
}
PIECES = [(n, x, k, t) for n, (x, parts) in enumerate(SOURCES.items()) for k, t in enumerate(parts)]
def source_text(parts: list[str]):
    return F.replace(F.lit("\n".join(parts).replace("{{", "{").replace("}}", "}")), F.lit("{k}"), F.col("p_partkey").cast("string"))


def quoted(text: str) -> str:
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in text.replace("{{", "{").replace("}}", "}").split("\n"))


@query("SELECT p_partkey, e.chunk::INT AS chunk, replace(e.text, '{k}', p_partkey::VARCHAR) AS text FROM part p JOIN (VALUES " + ", ".join(f"({n}, {k}, {quoted(t)})" for n, _, k, t in PIECES) + ") e(n, chunk, text) ON e.n = p.p_partkey % 3")
def code_chunks_by_language(spark, sf_dir):
    """Source texts of three languages cut between their units, which brackets, strings and comments don't mislead."""
    texts, names = [source_text(parts) for parts in SOURCES.values()], list(SOURCES)
    pick = lambda values: F.when(F.col("p_partkey") % 3 == 0, values[0]).when(F.col("p_partkey") % 3 == 1, values[1]).otherwise(values[2])
    rows = table(spark, sf_dir, "part").select("p_partkey", pick(texts).alias("text"), pick([F.lit(x) for x in names]).alias("language"))
    return chunks.chunk_rows(rows, "p_partkey", "text", 140, 0, code=True, language="language").select("p_partkey", "chunk", "text")
