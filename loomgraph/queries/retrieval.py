"""Ranked retrieval over documents, labels and the dictionary graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import fulltext, retrieval
from loomgraph.plans.shared import table
from loomgraph.queries.graph import GRAPH, nodes
from loomgraph.queries.registry import query

#: Streams over the nodes: a vector-like score, and a text score of those whose text holds a word.
VECTOR = "v AS (SELECT id, round(((k * 37) % 1000) / 1000.0, 3)::DOUBLE AS score FROM nodes WHERE k % 3 <> 0)"
TEXT = "t AS (SELECT id, round(((k * 53) % 500) / 500.0, 3)::DOUBLE AS score FROM nodes WHERE contains(doc, 'red'))"
STREAMS = f"{GRAPH}, {VECTOR}, {TEXT}"


def vector_stream(spark, sf_dir):
    return nodes(spark, sf_dir).where("k % 3 <> 0").select("id", F.round((F.col("k") * 37 % 1000) / 1000, 3).alias("score"))


def text_stream(spark, sf_dir):
    return nodes(spark, sf_dir).where(F.contains("doc", F.lit("red"))).select("id", F.round((F.col("k") * 53 % 500) / 500, 3).alias("score"))


def rounded(df, digits=6):
    return df.withColumn("score", F.round("score", digits))


@query(f"{STREAMS} SELECT v.id, round(v.score * CASE WHEN t.id IS NULL THEN 1 ELSE 1.1 END, 6) AS score FROM v LEFT JOIN t ON t.id = v.id WHERE v.score >= 0.3 ORDER BY v.score * CASE WHEN t.id IS NULL THEN 1 ELSE 1.1 END DESC, v.id LIMIT 50")
def semantic_text_boost(spark, sf_dir):
    return rounded(retrieval.boosted_by_text(vector_stream(spark, sf_dir), text_stream(spark, sf_dir), "id", 50, 0.3))


@query(f"{STREAMS}, c AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS place FROM t ORDER BY score DESC, id LIMIT 40) SELECT id, round(1 - place / (SELECT count(*) FROM c)::DOUBLE, 6) AS score FROM c")
def lexical_rank_scores(spark, sf_dir):
    return rounded(retrieval.by_rank(text_stream(spark, sf_dir), "id", 40))


@query(f"""{STREAMS}, b AS (SELECT coalesce(v.id, t.id) AS id, CASE WHEN v.id IS NOT NULL AND t.id IS NOT NULL THEN 0.7 * (1.2 * v.score) + 0.3 * t.score + 0.1 ELSE coalesce(1.2 * v.score, t.score) END AS score FROM v FULL JOIN t ON t.id = v.id)
  SELECT id, round(score, 6)::DOUBLE AS score FROM b ORDER BY score DESC, id LIMIT 60""")
def semantic_and_lexical(spark, sf_dir):
    return rounded(retrieval.semantic_and_lexical(vector_stream(spark, sf_dir), text_stream(spark, sf_dir), "id", 60))


@query(f"""{STREAMS} SELECT coalesce(v.id, t.id) AS id, CASE WHEN v.id IS NOT NULL AND t.id IS NOT NULL THEN round(0.7 * v.score + 0.3 * t.score + 0.1, 3) ELSE round(coalesce(v.score, t.score), 3) END::DOUBLE AS score FROM v FULL JOIN t ON t.id = v.id""")
def signal_search(spark, sf_dir):
    return retrieval.signal_blend(vector_stream(spark, sf_dir), text_stream(spark, sf_dir), "id")


@query(f"""{STREAMS}, b AS (SELECT coalesce(v.id, t.id) AS id, CASE WHEN v.id IS NOT NULL AND t.id IS NOT NULL THEN round(0.7 * v.score + 0.3 * t.score + 0.1, 3) ELSE round(coalesce(v.score, t.score), 3) END AS score FROM v FULL JOIN t ON t.id = v.id),
  e AS (SELECT id, round((k % 10) / 10.0, 3) AS score FROM nodes WHERE k % 8 = 0) SELECT coalesce(b.id, e.id) AS id, (CASE WHEN b.id IS NOT NULL AND e.id IS NOT NULL THEN round(greatest(b.score, e.score) + 0.05, 3) ELSE coalesce(b.score, e.score) END)::DOUBLE AS score
  FROM b FULL JOIN e ON e.id = b.id ORDER BY score DESC, id LIMIT 60""")
def code_search(spark, sf_dir):
    examples = nodes(spark, sf_dir).where("k % 8 = 0").select("id", ((F.col("k") % 10) / 10).alias("score"))
    return retrieval.with_examples(retrieval.signal_blend(vector_stream(spark, sf_dir), text_stream(spark, sf_dir), "id"), examples, "id", 60)


@query(f"""{STREAMS}, b AS (SELECT id, score FROM v ORDER BY score DESC, id LIMIT 30), n AS (SELECT b.id, b.score, (contains('_' || n.name || '_', '_red_'))::INT + (contains('_' || n.name || '_', '_ring_'))::INT AS hits FROM b JOIN nodes n ON n.id = b.id)
  SELECT id, round(CASE WHEN hits > 0 THEN least(1.0, score + 0.1 * hits) ELSE score END, 6)::DOUBLE AS score FROM n""")
def docs_search(spark, sf_dir):
    """The cut comes first: the boost changes what is shown, not which rows."""
    best = retrieval.top(vector_stream(spark, sf_dir), "id", 30).join(nodes(spark, sf_dir).select("id", "name"), "id")
    return rounded(best.select("id", retrieval.title_boost(F.col("score"), F.col("name"), ["Red", "ring"]).alias("score")))


SEG = "string_split(lower(id), '/')"


@query(f"""{STREAMS}, b AS (SELECT coalesce(v.id, t.id) AS id, round((0.6 * coalesce(v.score, 0) + 0.4 * coalesce(t.score, 0))::DOUBLE, 4) AS s FROM v FULL JOIN t ON t.id = v.id),
  n AS (SELECT id, s, (len(list_filter({SEG}, lambda x: x = 'small')) > 0 OR len(list_filter({SEG}, lambda x: contains(x, 'small'))) > 0)::INT + (len(list_filter({SEG}, lambda x: x = 'red')) > 0)::INT + (len(list_filter({SEG}, lambda x: contains(x, 'ring'))) > 0)::INT AS hits FROM b),
  a AS (SELECT id, CASE WHEN hits > 0 THEN round(s * (1 + 0.015::DOUBLE * hits), 4) ELSE s END AS s FROM n), c AS (SELECT id, CASE WHEN starts_with(id, 'large/') THEN round(s * 1.03::DOUBLE, 4) ELSE s END AS score FROM a) SELECT id, score FROM c ORDER BY score DESC, id LIMIT 80""")
def path_search(spark, sf_dir):
    """The blend with its tie-breakers, each rounded to four places."""
    return retrieval.path_search(vector_stream(spark, sf_dir), text_stream(spark, sf_dir), "id", ["small", "red", "ring"], 80, preferred=["large"])


@query(f"{STREAMS} SELECT id, round(score, 4)::DOUBLE AS score FROM t ORDER BY score DESC, id LIMIT 25")
def path_search_text_only(spark, sf_dir):
    return retrieval.path_search(vector_stream(spark, sf_dir), text_stream(spark, sf_dir), "id", [], 25, text_only=True)


SEGMENTS = {"grp": 1, "domain": 2, "unit": 3}
TOKENS = ("small", "domain_1", "m", "T")
GRAMMAR = f"""h AS ({' UNION ALL '.join(f"SELECT id, {t} AS tier, {retrieval.TIER_WEIGHTS[t]}::DOUBLE AS w, row_number() OVER (ORDER BY id) - 1 AS place FROM nodes WHERE {s} IN {TOKENS}" for s, t in SEGMENTS.items())}),
  g AS (SELECT id, sum(w / (60 + place + 1)) AS score FROM h GROUP BY 1 HAVING bool_or(tier = 1) AND (bool_or(tier = 3) OR id IN (SELECT id FROM v)))"""


def grammar(spark, sf_dir):
    return retrieval.grammar_stream(nodes(spark, sf_dir), SEGMENTS, TOKENS, vector_stream(spark, sf_dir).select("id"))


@query(f"{STREAMS}, {GRAMMAR} SELECT id, round(score, 8)::DOUBLE AS score FROM g")
def grammar_stream(spark, sf_dir):
    return rounded(grammar(spark, sf_dir), 8)


@query(f"""{STREAMS}, {GRAMMAR}, r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS p FROM (SELECT * FROM v ORDER BY score DESC, id LIMIT 100) UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 FROM (SELECT * FROM t ORDER BY score DESC, id LIMIT 100)
  UNION ALL SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 FROM (SELECT * FROM g ORDER BY score DESC, id LIMIT 100)) SELECT id, round(sum(1.0::DOUBLE / (60 + p + 1)), 8) AS score FROM r GROUP BY 1 ORDER BY sum(1.0::DOUBLE / (60 + p + 1)) DESC, id LIMIT 20""")
def three_stream_search(spark, sf_dir):
    return rounded(retrieval.three_streams(vector_stream(spark, sf_dir), text_stream(spark, sf_dir), grammar(spark, sf_dir), "id", 20, 100), 8)


@query(f"""{GRAPH}, m AS (SELECT parent AS cluster, id, row_number() OVER (PARTITION BY parent ORDER BY id) AS place FROM nodes), c AS (SELECT parent AS cluster, round(max((k % 100) / 100.0), 4)::DOUBLE AS score FROM nodes GROUP BY 1 HAVING max((k % 100) / 100.0) > 0.35)
  SELECT c.cluster, c.score, count(m.id)::BIGINT AS n, string_agg(m.id, ' ' ORDER BY m.id) FILTER (place <= 50) AS members FROM c JOIN m ON m.cluster = c.cluster GROUP BY 1, 2""")
def cluster_search(spark, sf_dir):
    """Clusters over a threshold with their first members."""
    own = nodes(spark, sf_dir)
    clusters = own.groupBy(F.col("parent").alias("cluster")).agg(F.round(F.max((F.col("k") % 100) / 100), 4).alias("score")).where("score > 0.35")
    out = retrieval.with_members(clusters, own.select(F.col("parent").alias("cluster"), F.col("id").alias("member")))
    return out.withColumn("members", F.array_join("members", " "))




@query("""SELECT source, target, place::INT AS place, score FROM (SELECT a.vec_id AS source, CASE WHEN b.label % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, b.vec_id AS target, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS score,
  row_number() OVER (PARTITION BY a.vec_id, b.label % 2 = 0 ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS place FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE place <= 3""")
def match_matrix(spark, sf_dir):
    """For each source the best targets of each kind, all in one job."""
    from loomgraph.operators import vectors

    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 20 = 0")
    parts = [vectors.top_k(rows.where(f"label % 2 = {k}"), asked, "vec_id", "embedding", 3) for k in (0, 1)]
    return parts[0].union(parts[1]).select(F.col("query").alias("source"), F.col("vec_id").alias("target"), "place", F.round("similarity", 5).alias("score"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'lexical' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'lexical' WHEN 3 THEN 'semantic' ELSE 'hybrid' END AS mode,
  CASE doc_id % 5 WHEN 0 THEN '"a AND" OR "AND b" OR a OR AND OR b' WHEN 1 THEN '"what is" OR "is core/x" OR what OR is OR core/x' WHEN 2 THEN 'b_tor' WHEN 3 THEN '"why q" OR why OR q' ELSE '"plain words" OR plain OR words' END AS phrases FROM documents""")
def query_modes(spark, sf_dir):
    texts = F.array(*map(F.lit, ("a AND b", "what is core/x", "b_tor", "why  q", " plain words")))
    q = F.get(texts, (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.search_mode(q).alias("mode"), retrieval.phrase_query(q).alias("phrases"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'plasma NOT wall' WHEN 1 THEN 'a b "x -y"' WHEN 2 THEN 'NOT core edge' ELSE 'q f:-x' END AS q FROM documents""")
def full_text_queries(spark, sf_dir):
    texts = F.array(*map(F.lit, ("plasma -wall", 'a  - b "x -y"', "-core edge -", " q f:-x")))
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.full_text_query(F.get(texts, (F.col("doc_id") % 4).cast("int"))).alias("q"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents)
  SELECT term, doc_id, count(*)::BIGINT AS tf, any_value(n)::INT AS length FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM w) GROUP BY 1, 2""")
def postings(spark, sf_dir):
    """The full-text index of all documents, as a table."""
    return fulltext.postings(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""SELECT query, vec_id FROM (SELECT a.vec_id AS query, b.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS place
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE place <= 20 AND label % 3 = 0""")
def filtered_after_search(spark, sf_dir):
    """A filter that comes after the cut, so a query can get fewer rows."""
    from loomgraph.operators import vectors

    rows = table(spark, sf_dir, "embeddings")
    best = vectors.top_k(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 20)
    return best.join(rows.where("label % 3 = 0").select("vec_id"), "vec_id", "left_semi").select("query", "vec_id")


@query(f"""{STREAMS}, b AS (SELECT id, score FROM v ORDER BY score DESC, id LIMIT 40) SELECT n.grp, n.dtype, count(*)::BIGINT AS n, round(avg(b.score), 6) AS mean_score FROM b JOIN nodes n ON n.id = b.id WHERE n.unit = 'm' OR n.unit IS NULL GROUP BY 1, 2""")
def hit_facets(spark, sf_dir):
    """Hits of a search by group and type, after filters."""
    best = retrieval.top(vector_stream(spark, sf_dir), "id", 40)
    own = nodes(spark, sf_dir).where("unit = 'm' or unit is null").select("id", "grp", "dtype")
    return best.join(own, "id").groupBy("grp", "dtype").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


CHUNKS = "(SELECT vec_id, embedding, 'f' || (vec_id % 3) AS facility, ['g' || (label % 4), 'g' || (label % 3)] AS groups, 'fun' || (vec_id % 9) AS function, CASE WHEN vec_id % 7 > 0 THEN vec_id % 50 END AS example, repeat('x', (vec_id % 900)::INT) AS text FROM embeddings)"
NEAR = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def code_chunk_vectors(spark, sf_dir):
    v, label = F.col("vec_id"), F.col("label")
    own = table(spark, sf_dir, "embeddings")
    return own.select(
        "vec_id", "embedding", F.concat(F.lit("f"), v % 3).alias("facility"), F.array(F.concat(F.lit("g"), label % 4), F.concat(F.lit("g"), label % 3)).alias("groups"),
        F.concat(F.lit("fun"), v % 9).alias("function"), F.when(v % 7 > 0, v % 50).alias("example"), F.repeat(F.lit("x"), (v % 900).cast("int")).alias("text"),
    )


@query(f"""SELECT query, vec_id, round(s, 5) AS similarity, function, groups FROM (SELECT a.vec_id AS query, b.vec_id, b.function, array_to_string(b.groups, ' ') AS groups, {NEAR} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {NEAR} DESC, b.vec_id) AS place
  FROM embeddings a JOIN {CHUNKS} b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND b.facility = 'f1' AND list_has_any(b.groups, ['g1', 'g3'])) WHERE place <= 10 AND s >= 0.1""")
def code_chunk_search(spark, sf_dir):
    """Chunks near each query, of one facility and related to one of two groups."""
    chunks = code_chunk_vectors(spark, sf_dir)
    out = retrieval.chunk_search(chunks, chunks.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, "f1", ["g1", "g3"], 0.1)
    return out.select("query", "vec_id", F.round("similarity", 5).alias("similarity"), "function", F.array_join("groups", " ").alias("groups"))


@query(f"""WITH e AS (SELECT k AS example, 'file' || (k % 20) AS source_file FROM range(40) r(k)), n AS (SELECT a.vec_id AS query, b.vec_id, b.example, b.function, b.text, {NEAR} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {NEAR} DESC, b.vec_id) AS place FROM embeddings a JOIN {CHUNKS} b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
  SELECT query, vec_id, round(s, 5) AS similarity, length(substr(text, 1, 500)) AS letters, function, source_file FROM n JOIN e USING (example) WHERE place <= 10 AND substr(source_file, 5)::INT % 2 = 0""")
def code_by_files(spark, sf_dir):
    """Chunks near each query, and of these the ones whose example's file is of one facility."""
    chunks = code_chunk_vectors(spark, sf_dir)
    k = F.col("vec_id") % 50
    examples = chunks.select(k.alias("example"), F.concat(F.lit("file"), k % 20).alias("source_file")).where("example < 40").distinct()
    files = examples.select(F.col("source_file").alias("file"), F.when(F.substring("source_file", 5, 9).cast("int") % 2 == 0, "even").otherwise("odd").alias("facility")).distinct()
    out = retrieval.code_by_files(chunks, chunks.where("vec_id % 20 = 0"), examples, files, "vec_id", "embedding", 10, "even")
    return out.select("query", "vec_id", F.round("similarity", 5).alias("similarity"), F.length("text").cast("long").alias("letters"), "function", "source_file")


@query(f"""WITH d AS (SELECT vec_id, embedding, 'g' || (label % 2) AS grp, CASE vec_id % 4 WHEN 0 THEN 'quantity' WHEN 1 THEN 'coordinate' WHEN 2 THEN 'error' END AS category, CASE WHEN vec_id % 5 = 0 THEN '4.0.0' END AS deprecated FROM embeddings),
  n AS (SELECT a.vec_id AS query, b.vec_id, b.category, {NEAR} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {NEAR} DESC, b.vec_id) AS place FROM embeddings a JOIN d b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND category IN ('quantity', 'coordinate') AND grp = 'g1' AND deprecated IS NULL)
  SELECT query, vec_id, round(s, 5) AS similarity, category, concat_ws(' ', CASE WHEN vec_id % 2 = 0 THEN 'even' END, CASE WHEN vec_id % 3 = 0 THEN 'third' END) AS clusters FROM n WHERE place <= 8""")
def node_search(spark, sf_dir):
    """Dictionary nodes near each query that are searchable, of one group and not deprecated, with their clusters."""
    v = F.col("vec_id")
    category = F.when(v % 4 == 0, "quantity").when(v % 4 == 1, "coordinate").when(v % 4 == 2, "error")
    own = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.concat(F.lit("g"), F.col("label") % 2).alias("grp"), category.alias("category"), F.when(v % 5 == 0, "4.0.0").alias("deprecated"))
    clusters = own.where("vec_id % 2 = 0").select("vec_id", F.lit("even").alias("label")).union(own.where("vec_id % 3 = 0").select("vec_id", F.lit("third")))
    out = retrieval.node_search(own, own.where("vec_id % 20 = 0"), clusters, "vec_id", "embedding", 8, ("quantity", "coordinate"), "g1")
    return out.select("query", "vec_id", F.round("similarity", 5).alias("similarity"), "category", F.array_join("clusters", " ").alias("clusters"))
