"""Budgets, backlogs and watermarks over events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.plans.shared import table
from loomgraph.queries.registry import query
from loomgraph.streaming import budgets


@query()
def reservations(spark, sf_dir):
    """Requests of each user in order of their events, granted while the user's pool and the phase's cap last."""
    e = table(spark, sf_dir, "events")
    requests = e.select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("at"), F.col("event_type").alias("phase"), F.col("value").alias("amount"))
    return budgets.reserved(requests, 400.0, {"click": 60.0, "view": 40.0}).select("run", "at", "granted")


@query("""WITH p AS (SELECT event_type AS pool, CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 3.0 WHEN 'error' THEN 0.5 WHEN 'purchase' THEN 2.0 END AS weight, sum(value) AS spent, event_type <> 'purchase' AS active FROM events GROUP BY 1)
  SELECT pool, CASE WHEN weight IS NULL THEN false WHEN NOT active THEN false ELSE spent / (SELECT sum(spent) FROM p) < weight / (SELECT sum(weight) FROM p WHERE active) END AS admit FROM p""")
def fair_admission(spark, sf_dir):
    kind = F.col("event_type")
    weight = F.when(kind == "click", 1.0).when(kind == "view", 3.0).when(kind == "error", 0.5).when(kind == "purchase", 2.0)
    pools = table(spark, sf_dir, "events").groupBy(kind.alias("pool")).agg(F.first(weight).alias("weight"), F.sum("value").alias("spent"), F.first(kind != "purchase").alias("active"))
    return budgets.admitted(pools)


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) AND coalesce(text, '') <> '' AND n_chars >= 200 ORDER BY n_chars DESC, doc_id LIMIT 50")
def embedding_backlog(spark, sf_dir):
    """A batch of the texts without a result yet, longest first."""
    done = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = table(spark, sf_dir, "documents").join(done, "doc_id", "left")
    return budgets.backlog(rows, "quality", "text", F.col("n_chars"), 200, 50, "doc_id").select("doc_id", "n_chars")


@query("SELECT event_id AS id, CASE WHEN event_type = 'error' AND event_id % 4 < 3 THEN 'discovered' WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status, CASE WHEN event_type = 'error' AND event_id % 4 = 3 THEN 'x' END AS error FROM events")
def recovered_items(spark, sf_dir):
    failed = F.col("event_type") == "error"
    items = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(failed, "failed").otherwise("done").alias("status"), F.when(failed, "x").alias("error"), (F.col("event_id") % 4).alias("attempts"))
    return budgets.recovered(items, 3).select("id", "status", "error")


@query("SELECT event_id, (SELECT max(event_id) FROM events) AS watermark FROM events WHERE event_id > 700")
def after_watermark(spark, sf_dir):
    """Rows since the last import, and the mark to store for the next."""
    seen = spark.range(1).select(F.lit(700).cast("long").alias("watermark"))
    new, last = budgets.after_watermark(table(spark, sf_dir, "events"), "event_id", seen)
    return new.select("event_id").crossJoin(F.broadcast(last))


@query("SELECT event_type, bool_or(value > 300) AS waits FROM events GROUP BY 1")
def pending_work(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.bool_or(F.col("value") > 300).alias("waits"))


# Lines with their ends, cut hard where they are over 1,000 characters, and then added to a segment one after the other while they fit.
SEGMENTS = """lines AS (SELECT doc_id, unnest(range(len(l))) AS line, l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> '')),
  whole AS (SELECT doc_id, line, l[line + 1] || CASE WHEN line + 1 < len(l) THEN chr(10) ELSE '' END AS t FROM lines),
  cut AS (SELECT doc_id, line, part, substr(t, part * 1000 + 1, 1000) AS t FROM (SELECT *, unnest(range(0, (length(t) + 999) // 1000)) AS part FROM whole WHERE t <> '')),
  pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, part) AS i, t FROM cut),
  added AS (SELECT doc_id, i, 0 AS place, length(t) AS filled FROM pieces WHERE i = 1 UNION ALL
    SELECT p.doc_id, p.i, CASE WHEN a.filled + length(p.t) <= 1000 THEN place ELSE place + 1 END, CASE WHEN a.filled + length(p.t) <= 1000 THEN a.filled + length(p.t) ELSE length(p.t) END FROM added a JOIN pieces p ON p.doc_id = a.doc_id AND p.i = a.i + 1),
  segments AS (SELECT a.doc_id, a.place, string_agg(p.t, '' ORDER BY p.i) AS segment FROM added a JOIN pieces p ON p.doc_id = a.doc_id AND p.i = a.i GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {SEGMENTS} SELECT doc_id, place::INT AS place, segment FROM segments")
def text_segments(spark, sf_dir):
    """Texts cut at line ends into segments of at most 1,000 characters."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(budgets.segments(F.col("text"), 1000)).alias("place", "segment"))


LETTERS = "etaoinsr"
SHARES = ", ".join(f"(length(segment) - length(replace(segment, '{c}', '')))::DOUBLE / length(segment) AS x{k}" for k, c in enumerate(LETTERS))


@query(f"""WITH RECURSIVE {SEGMENTS}, v AS (SELECT doc_id, {SHARES} FROM segments), m AS (SELECT doc_id, count(*) AS n, {', '.join(f'avg(x{k}) AS x{k}' for k in range(len(LETTERS)))} FROM v GROUP BY 1)
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_segments, round({' + '.join(f'{k + 1} * x{k}' for k in range(len(LETTERS)))}, 6)::DOUBLE AS weighted FROM documents d LEFT JOIN m USING (doc_id)""")
def segment_embeddings(spark, sf_dir):
    """Vectors of long texts as means of their segments' vectors, here shares of some letters."""
    share = lambda t, c: (F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))) / F.length(t)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = budgets.embedded(docs, "doc_id", "text", lambda t: F.array(*[share(t, c) for c in LETTERS]), 1000)
    weighted = F.aggregate(F.transform("embedding", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("doc_id", "n_segments", F.round(weighted, 6).alias("weighted"))
