"""The numbered queries over the whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import chat, divergence, graph_search, importance, media, mixing, near_dup, packing, pii, quality_knn, secret_scan, token_links, toxicity
from loomgraph.plans.shared import table


def op1_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_rows(table(spark, sf_dir, "documents"))
    clip = lambda c: F.format_string("%d-%d@%.2f-%.2f:%.3f", c["first_frame"], c["last_frame"], c["start_s"], c["end_s"], c["level"])
    return out.select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.array_join(F.transform("clips", clip), ";").alias("feature"),
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in secret_scan.KINDS])
    is_base = lambda s: s["kind"] < 3
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    return out.select(
        "doc_id",
        *[F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(secret_scan.KINDS)],
        F.sha2(written(F.filter("spans", is_base)).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def op3_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op4_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_knn.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.sanitise(table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.PATTERNS)],
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = divergence.judge(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("class_distance", "common_distance")})


def op7_sql() -> str:
    """The rules with histograms as rows (document, histogram, place, count)."""
    words = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
    left, classes = "t", []
    for _, pattern in divergence.CHARACTER_CLASSES:
        less = f"regexp_replace({left}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g')"
        classes.append(f"length({left}) - length({less})")
        left = less
    classes.append(f"length({left})")
    listed = ", ".join(f"'{w}'" for w in divergence.VOCABULARY)
    known = ", ".join(f"'{x}'" for x in divergence.LANGUAGES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {words} AS w, [{", ".join(classes)}] AS classes FROM d),
g AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
s AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
v AS (SELECT r, sum(least(3, coalesce(after - i, 3)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM s) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM d),
m AS (SELECT w.r, doc_id, lang, len(w)::BIGINT AS n_words, (length(t) - classes[2])::BIGINT AS word_chars, classes[4]::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words, classes, w AS w
      FROM w JOIN l USING (r) LEFT JOIN v ON v.r = w.r),
f AS (SELECT *, n_words < {divergence.MIN_WORDS} OR 100 * n_repeat_words > {divergence.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM m),
c AS (SELECT r, k, count(*) AS c FROM (SELECT r, coalesce(list_position([{listed}], lower(x)), {len(divergence.VOCABULARY) + 1}) AS k FROM (SELECT r, unnest(w) AS x FROM f)) GROUP BY 1, 2),
h AS (SELECT r, 'classes' AS h, unnest(range(1, {len(classes) + 1})) AS k, unnest(classes)::DOUBLE AS c FROM f
      UNION ALL SELECT f.r, 'commons', q.k, coalesce(c.c, 0)::DOUBLE FROM f CROSS JOIN (SELECT unnest(range(1, {len(divergence.VOCABULARY) + 2})) AS k) q LEFT JOIN c ON c.r = f.r AND c.k = q.k),
p AS (SELECT r, h, k, CASE WHEN sum(c) OVER (PARTITION BY r, h) > 0 THEN c / sum(c) OVER (PARTITION BY r, h) ELSE 0 END AS p, sum(c) OVER (PARTITION BY r, h) AS n FROM h),
u AS (SELECT p.*, CASE WHEN lang IN ({known}) THEN lang END AS known FROM p JOIN f USING (r) WHERE NOT base_failed AND n_words >= {divergence.MIN_WORDS_FOR_COMMON}),
q AS (SELECT known, h, k, avg(p) AS q FROM u WHERE known IS NOT NULL GROUP BY 1, 2, 3 UNION ALL SELECT NULL, h, k, avg(p) FROM u GROUP BY 2, 3),
o AS (SELECT r, lang AS known FROM f WHERE lang IN (SELECT known FROM q) UNION ALL SELECT r, NULL FROM f WHERE lang IS NULL OR lang NOT IN (SELECT known FROM q WHERE known IS NOT NULL)),
j AS (SELECT p.r, p.h, max(n) AS n, round(sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)), 6)::DOUBLE AS x
      FROM p JOIN o USING (r) JOIN q ON q.known IS NOT DISTINCT FROM o.known AND q.h = p.h AND q.k = p.k GROUP BY 1, 2),
e AS (SELECT f.*, CASE WHEN a.n >= {divergence.MIN_CHARS_FOR_CLASSES} THEN a.x END AS class_distance, CASE WHEN n_words >= {divergence.MIN_WORDS_FOR_COMMON} THEN b.x END AS common_distance
      FROM f LEFT JOIN j a ON a.r = f.r AND a.h = 'classes' LEFT JOIN j b ON b.r = f.r AND b.h = 'commons')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, common_distance,
       NOT base_failed AND coalesce(class_distance, 0) <= {divergence.MAX_CLASS_DISTANCE} AND coalesce(common_distance, 0) <= {divergence.MAX_COMMON_DISTANCE} AS kept FROM e
"""


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|mix-1'), 1, 15))::BIGINT AS key,
         md5(coalesce(text, '')) AS tie
  FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
w AS (SELECT *, CAST(list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS INT)) AS DOUBLE) AS weight,
             (source_size * 3)::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS level_at_cap,
        ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER b, 0.0))
          / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0.0)) AS level
      FROM w WINDOW b AS (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT src, source_size,
        coalesce(least(weight * (SELECT arg_min(level, (level_at_cap, src)) FROM l WHERE level <= level_at_cap), cap), cap) AS target FROM l),
p AS (SELECT d.*, t.source_size, t.target, least(round(t.target)::BIGINT, t.source_size * 3) AS whole,
        coalesce(sum(size) OVER (PARTITION BY d.src ORDER BY key, doc_id, tie, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.src = t.src),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE whole // source_size END AS epochs FROM p),
r AS (SELECT *, greatest(0, least(size, whole - epochs * source_size - start)) AS partial FROM e)
SELECT doc_id, size::BIGINT AS size, source_size, target, epochs::BIGINT AS epochs, partial::BIGINT AS partial,
       (epochs * size + partial)::BIGINT AS taken FROM r
"""

def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


ODD_TURN = r"\### Assistant: </turn> ok"


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(1).select(
        F.explode(
            F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(ODD_TURN).alias("text")) for i, role in enumerate(("user", "assistant"))])
        ).alias("t")
    )
    windows = chat.chat_windows(turns.unionByName(odd.select("t.*")))
    own = F.filter(
        F.transform(chat.read_turns(F.col("formatted")), lambda t, i: F.struct(i.alias("i"), t["role"].alias("role"), t["text"].alias("text"))),
        lambda t: t["i"] >= F.col("n_repeated"),
    )
    read = windows.select(
        "conv_id",
        "window",
        F.struct(
            "window",
            F.size(own).alias("n"),
            F.array_join(F.transform(own, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
            F.length("formatted").cast("long").alias("chars"),
        ).alias("w"),
    )
    whole = read.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    joined = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    total = lambda name: F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + x[name])
    return whole.select(
        "conv_id",
        total("n").alias("n_turns"),
        F.sha2(joined("turns").cast("binary"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"),
        F.sha2(joined("loss").cast("binary"), 256).alias("loss_sha256"),
        total("chars").alias("formatted_chars"),
    )


#: The windows in SQL: a turn is written once as its own window's, and again in each window that repeats it.
OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
             len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM c),
s AS (SELECT conv_id, greatest(1, (512 - coalesce(max(n) FILTER (role = 'system'), 0)) // 2) AS stride FROM o GROUP BY conv_id),
p AS (SELECT o.*, s.stride, coalesce(sum(n) OVER before_it, 0) AS start, coalesce(sum(CASE WHEN n > stride THEN 1 ELSE 0 END) OVER before_it, 0) AS longs
      FROM o JOIN s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
      WINDOW before_it AS (PARTITION BY o.conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY 2 * longs + CASE WHEN n > stride THEN 1 ELSE 0 END, start // stride) - 1 AS win FROM p),
w AS (SELECT conv_id, win, min(place) AS first_place, min(start) AS first_start, sum(n) AS own FROM v GROUP BY 1, 2),
f AS (SELECT w.*, (SELECT max(place) FROM v WHERE v.conv_id IS NOT DISTINCT FROM w.conv_id AND v.role = 'system' AND v.place < w.first_place) AS system_place FROM w),
h AS (SELECT f.*, coalesce(v.n, 0) AS system_n FROM f LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM f.conv_id AND v.place = f.system_place),
again AS (SELECT h.conv_id, v.place FROM h JOIN v ON v.conv_id IS NOT DISTINCT FROM h.conv_id
          AND (v.place = h.system_place
               OR v.role <> 'system' AND v.place BETWEEN h.first_place - 2 AND h.first_place - 1 AND h.first_start - v.start + h.system_n + h.own <= 512)),
r AS (SELECT v.*, (SELECT count(*) FROM again a WHERE a.conv_id IS NOT DISTINCT FROM v.conv_id AND a.place = v.place) AS again,
             length(role) + length(text) + 15 + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) AS chars FROM v)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars * (1 + again))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""


def op11_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("text"))
    return out.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


#: crc32 of each different word by a table that is made bit by bit.
OP12_SQL = r"""
WITH RECURSIVE bits AS (SELECT i, i AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS c FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
x AS (SELECT r, unnest(w) AS w FROM d),
words AS (SELECT DISTINCT w FROM (SELECT w FROM x UNION ALL SELECT w FROM b)),
hex AS (SELECT w, hex(encode(w)) AS h FROM words),
h AS (SELECT w, xor(4294967295, list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
        lambda a, y: xor(c[(xor(a, y) & 255) + 1], a >> 8), 4294967295::BIGINT)) % 10000 AS k FROM hex, crc),
s AS (SELECT k, count(*) AS n FROM x JOIN h USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM b JOIN h USING (w) GROUP BY k),
g AS (SELECT i AS k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
        / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM range(10000) r(i) LEFT JOIN s ON s.k = i LEFT JOIN t ON t.k = i),
e AS (SELECT r, sum(gain)::BIGINT AS weight FROM x JOIN h USING (w) JOIN g USING (k) GROUP BY r),
f AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
        + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN e USING (r)),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM f WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM f LEFT JOIN o USING (r)
"""


def op13_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return graph_search.nearest(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


#: The exact nearest; on small tables the walks find all of them.
OP13_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id, list_distance(q.v, v.v) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.v) = len(q.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def queries() -> dict:
    return {
        "op1_avi_media": op1_avi_media,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_minhash_near_dup": op3_minhash_near_dup,
        "op4_quality_neighbours": op4_quality_neighbours,
        "op5_personal_data": op5_personal_data,
        "op6_secret_scan": op6_secret_scan,
        "op7_quality_rules": op7_quality_rules,
        "op8_mix_sources": op8_mix_sources,
        "op9_chat_windows": op9_chat_windows,
        "op10_toxicity": op10_toxicity,
        "op11_token_links": op11_token_links,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_graph_search": op13_graph_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": op7_sql(), "op8_mix_sources": OP8_SQL, "op9_chat_windows": OP9_SQL, "op12_importance_resampling": OP12_SQL, "op13_graph_search": OP13_SQL}
