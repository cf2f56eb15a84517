"""Full text, extraction and fusion over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.functions.chunks import chunk_rows
from loomgraph.operators import fulltext, fusion
from loomgraph.plans.shared import cut, table
from loomgraph.queries.registry import query
from loomgraph.sources.html import page_text

TERMS = ("the", "que", "verwh", "ring")
TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
BM25 = f"""w AS (SELECT doc_id, {TOKENS} AS w FROM documents), c AS (SELECT doc_id, len(w) AS l, {', '.join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(TERMS))} FROM w),
  s AS (SELECT count(*) AS n, avg(l) AS m, {', '.join(f'count_if(tf{i} > 0) AS df{i}' for i in range(len(TERMS)))} FROM c),
  b AS (SELECT doc_id, {' + '.join(f'ln(1 + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m))' for i in range(len(TERMS)))} AS score FROM c, s
        WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(TERMS)))})"""


def scored(spark, sf_dir):
    return fulltext.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", TERMS)


@query(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM b")
def bm25_search(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))


@query("""SELECT doc_id, CASE WHEN contains(lower(source), 'src1') THEN 0.98 WHEN contains(lower(lang), 'src1') THEN 0.95 WHEN contains(lower(text), 'src1') THEN 0.9 END::DOUBLE AS score FROM documents
  WHERE contains(lower(source), 'src1') OR contains(lower(lang), 'src1') OR contains(lower(text), 'src1')""")
def contains_tiered(spark, sf_dir):
    return fulltext.tiered_contains(table(spark, sf_dir, "documents"), "doc_id", "SRC1", [(F.col("source"), 0.98), (F.col("lang"), 0.95), (F.col("text"), 0.9)])


VECTOR = "SELECT doc_id, quality * 0.5 + toxic * 0.25 + 0.1::DOUBLE AS score FROM labels"


def label_stream(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 0.5 + F.col("toxic") * 0.25 + 0.1).alias("score"))


@query(f"""WITH {BM25}, v AS ({VECTOR}), t AS (SELECT doc_id, score / max(score) OVER () AS score FROM b)
  SELECT doc_id, round(0.6 * coalesce(v.score, 0) + 0.4 * coalesce(t.score, 0) + CASE WHEN v.score IS NOT NULL AND t.score IS NOT NULL THEN 0.1 ELSE 0 END, 4)::DOUBLE AS score FROM v FULL JOIN t USING (doc_id)""")
def hybrid_blend(spark, sf_dir):
    text = cut(scored(spark, sf_dir))
    top = text.agg(F.max("score").alias("top"))
    relative = text.crossJoin(F.broadcast(top)).select("doc_id", (F.col("score") / F.col("top")).alias("score"))  # one row
    return fusion.blend(label_stream(spark, sf_dir), relative, "doc_id", bonus=0.1).select("doc_id", "score")


@query(f"""WITH {BM25}, v AS ({VECTOR}), r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS place FROM (SELECT * FROM v ORDER BY score DESC, doc_id LIMIT 100)
  UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 FROM (SELECT * FROM b ORDER BY score DESC, doc_id LIMIT 100))
  SELECT doc_id, round(sum(1.0::DOUBLE / (60 + place + 1)), 8) AS mass FROM r GROUP BY 1""")
def rrf_fuse(spark, sf_dir):
    """Reciprocal ranks of two top-100 reports."""
    streams = [fusion.ranked(s, "doc_id", 100) for s in (label_stream(spark, sf_dir), scored(spark, sf_dir))]
    return fusion.reciprocal_ranks(streams, "doc_id").select("doc_id", F.round("mass", 8).alias("mass"))


@query(f"""WITH {BM25}, t AS (SELECT doc_id, quality AS q, toxic AS x FROM labels) SELECT doc_id FROM t WHERE q = 1 AND (x = 1 OR doc_id IN (SELECT doc_id FROM b WHERE score > 1)) GROUP BY 1""")
def tier_gate(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    tiers = labels.where("quality = 1").select("doc_id", F.lit(1).alias("tier")).union(labels.where("toxic = 1").select("doc_id", F.lit(3)))
    return fusion.tier_gate(tiers, "doc_id", scored(spark, sf_dir).where("score > 1"))


@query("""SELECT p_partkey, (CASE WHEN contains(lower(p_name), 'red ring') THEN 6 ELSE 0 END + CASE WHEN contains(lower(p_brand), 'red ring') THEN 5 ELSE 0 END + CASE WHEN contains(lower(p_type), 'red ring') THEN 4 ELSE 0 END
  + CASE WHEN contains(lower(p_name), 'red') THEN 3 ELSE 0 END + CASE WHEN contains(lower(p_name), 'ring') THEN 3 ELSE 0 END + CASE WHEN contains(lower(p_type), 'red') THEN 1 ELSE 0 END + CASE WHEN contains(lower(p_type), 'ring') THEN 1 ELSE 0 END
  + CASE WHEN contains(lower(p_brand), 'red') THEN 4 ELSE 0 END + CASE WHEN contains(lower(p_brand), 'ring') THEN 4 ELSE 0 END)::INT AS score FROM part""")
def keyword_score(spark, sf_dir):
    brands = F.array("p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", fulltext.keyword_score("red ring", F.col("p_name"), F.col("p_type"), brands, brands).alias("score"))


@query(f"""WITH w AS (SELECT doc_id, {TOKENS} AS w FROM documents), p AS (SELECT doc_id, w[i] || ' ' || w[i + 1] AS theme, 2 AS k FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)
  UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], 3 FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w))
  SELECT theme, k::INT AS size, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_docs, round(count(*) * (ln((SELECT count(*) FROM documents) / count(DISTINCT doc_id)::DOUBLE) + 1) * CASE WHEN k = 3 THEN 1.2::DOUBLE ELSE 1 END, 4)::DOUBLE AS weight
  FROM p GROUP BY theme, k HAVING count(*) >= 2""")
def ngram_themes(spark, sf_dir):
    return fulltext.themes(table(spark, sf_dir, "documents"), "text").withColumn("weight", F.round("weight", 4))


THEMES = f"""w AS (SELECT doc_id, {TOKENS} AS w FROM documents), p AS (SELECT doc_id, w[i] || ' ' || w[i + 1] AS theme, 2 AS k FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)
  UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], 3 FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
  themes AS (SELECT theme, round(count(*) * (ln((SELECT count(*) FROM documents) / count(DISTINCT doc_id)::DOUBLE) + 1) * CASE WHEN k = 3 THEN 1.2::DOUBLE ELSE 1 END, 4)::DOUBLE AS weight FROM p GROUP BY theme, k HAVING count(*) >= 2)"""


@query(f"""WITH RECURSIVE {THEMES}, t AS (SELECT row_number() OVER (ORDER BY weight DESC, theme) AS i, theme, weight, list_distinct(string_split(theme, ' ')) AS words FROM themes QUALIFY i <= 2000),
  r AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS seen, 0 AS n, false AS taken UNION ALL
    SELECT t.i, CASE WHEN ok AND n < 60 THEN list_distinct(list_concat(seen, words)) ELSE seen END, CASE WHEN ok AND n < 60 THEN n + 1 ELSE n END, ok AND n < 60
    FROM (SELECT r.*, len(list_intersect(t.words, r.seen)) < floor(len(t.words) / 2) + 1 AS ok FROM r JOIN t ON t.i = r.i + 1) r JOIN t ON t.i = r.i + 1)
  SELECT (n - 1)::INT AS place, theme, weight FROM r JOIN t USING (i) WHERE taken""")
def theme_report(spark, sf_dir):
    """The sixty heaviest themes without those that mostly repeat words of heavier ones."""
    found = fulltext.themes(table(spark, sf_dir, "documents"), "text").withColumn("weight", F.round("weight", 4))
    return fulltext.different_themes(found, 60)


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+\\.[0-9]+'))), ',') AS numbers, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(text), '[A-Z]{2,}/[A-Z0-9]+'))), ',') AS pairs FROM documents""")
def regex_extract_entities(spark, sf_dir):
    distinct = lambda c, p: F.array_join(F.sort_array(F.array_distinct(F.regexp_extract_all(c, F.lit(p), F.lit(0)))), ",")
    return table(spark, sf_dir, "documents").select("doc_id", distinct(F.col("text"), r"[0-9]+\.[0-9]+").alias("numbers"), distinct(F.upper("text"), "[A-Z]{2,}/[A-Z0-9]+").alias("pairs"))


@query("""SELECT DISTINCT p_name, levenshtein(p_name, 'rde rign')::INT AS distance FROM part""")
def levenshtein_suggest(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", F.levenshtein("p_name", F.lit("rde rign")).alias("distance"))


@query("""SELECT doc_id, substr(sha256(text), 1, 16) AS hash, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents""")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", paths.content_hash(F.col("text")).alias("hash"), paths.token_estimate(F.col("text")).alias("tokens"))


@query()
def chunk_text(spark, sf_dir):
    return chunk_rows(table(spark, sf_dir, "documents"), "doc_id", "text", size=2000, overlap=200)


@query()
def html_to_text(spark, sf_dir):
    return page_text(table(spark, sf_dir, "pages"), "page_id", "html")
