"""Ranked retrieval on top of vector, full-text and fusion operators.

Streams are tables (key, score). Ties go by key. A key that is null in a stream joins with nothing. Empty streams
give what the other streams give.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import fusion, vectors

# Last segments that only give access to a quantity.
ACCESSORS = ("value", "data", "time", "validity", "fit", "coefficients")
ACCESSOR_FACTOR, PREFERRED_FACTOR, BOTH_BONUS = 0.95, 1.03, 0.1
# Weights of the tiers of grammar segments.
TIER_WEIGHTS = {1: 1.0, 2: 0.5, 3: 0.25}
TEXT_BOOST, SEMANTIC_WEIGHT = 1.1, 1.2
# What makes a query technical, conceptual, or a search expression.
OPERATORS = r"\bAND\b|\bOR\b|\bNOT\b|[\"*~:]"
TECHNICAL = r"[a-z0-9]_[a-z0-9]|/"
CONCEPTUAL = r"(?i)\b(what|how|why|explain|describe|relation|physics|concept|meaning)\b"


def top(stream: DataFrame, key: str, k: int) -> DataFrame:
    """The best ``k`` rows; each task cuts its own first."""
    return stream.orderBy(F.desc("score"), F.asc(key)).limit(k)


def boosted_by_text(semantic: DataFrame, text: DataFrame, key: str, k: int, least: float, boost: float = TEXT_BOOST) -> DataFrame:
    """Semantic scores times ``boost`` where a text hit agrees; at ``least`` or over, the best ``k``."""
    hits = text.select(key).distinct().withColumn("_hit", F.lit(True))
    score = F.col("score") * F.when(F.col("_hit"), boost).otherwise(1.0)
    out = semantic.where(F.col("score") >= least).join(hits, key, "left").select(key, score.alias("score"))
    return top(out, key, k)


def by_rank(stream: DataFrame, key: str, k: int) -> DataFrame:
    """(key, score): the best ``k`` rows with 1 - place / their number as score."""
    placed = fusion.ranked(stream, key, k)
    n = F.count("*").over(Window.partitionBy())  # of at most k rows
    return placed.select(key, (1 - F.col("place") / n).alias("score"))


def semantic_and_lexical(semantic: DataFrame, lexical: DataFrame, key: str, k: int) -> DataFrame:
    """Semantic scores times 1.2; where both agree 0.7 of that, 0.3 of the lexical one and a bonus; the best ``k``."""
    both = semantic.select(key, (SEMANTIC_WEIGHT * F.col("score")).alias("s")).join(lexical.select(key, F.col("score").alias("l")), key, "full_outer")
    score = F.when(F.col("s").isNotNull() & F.col("l").isNotNull(), 0.7 * F.col("s") + 0.3 * F.col("l") + BOTH_BONUS).otherwise(F.coalesce("s", "l"))
    return top(both.select(key, score.alias("score")), key, k)


def signal_blend(vector: DataFrame, text: DataFrame, key: str) -> DataFrame:
    """0.7 of the vector score, 0.3 of the text score and a bonus where both agree, to three places; else the only one."""
    both = vector.select(key, F.col("score").alias("v")).join(text.select(key, F.col("score").alias("t")), key, "full_outer")
    blended = F.round(0.7 * F.col("v") + 0.3 * F.col("t") + BOTH_BONUS, 3)
    return both.select(key, F.when(F.col("v").isNotNull() & F.col("t").isNotNull(), blended).otherwise(F.round(F.coalesce("v", "t"), 3)).alias("score"))


def with_examples(stream: DataFrame, examples: DataFrame, key: str, k: int) -> DataFrame:
    """Scores raised by example hits: the higher of both and 0.05 more; a key only among the examples keeps its own."""
    both = stream.select(key, F.col("score").alias("s")).join(examples.select(key, F.round("score", 3).alias("e")), key, "full_outer")
    score = F.when(F.col("s").isNotNull() & F.col("e").isNotNull(), F.round(F.greatest("s", "e") + 0.05, 3)).otherwise(F.coalesce("s", "e"))
    return top(both.select(key, score.alias("score")), key, k)


def title_boost(score: Column, title: Column, words: Sequence[str]) -> Column:
    """A tenth more for each query word in a title, 1 at most; for show, after the cut."""
    own = F.array_distinct(F.split(F.replace(F.lower(F.coalesce(title, F.lit(""))), F.lit("_"), F.lit(" ")), r"\s+"))
    n = F.size(F.array_intersect(own, F.array(*[F.lit(w) for w in dict.fromkeys(x.lower() for x in words)])))
    return F.when(n > 0, F.least(F.lit(1.0), score + 0.1 * n)).otherwise(score)


def tie_broken(score: Column, path: Column, words: Sequence[str], preferred: Sequence[str] = (), accessors: Sequence[str] = ACCESSORS) -> Column:
    """Scores raised by query words in the path, lowered for accessors, raised for preferred groups; rounded after each step.

    A word counts if it is a segment or, with more than three letters, part of one.
    """
    segments = F.split(F.lower(path), "/")
    hit = lambda w: F.exists(segments, lambda s: (s == w) | (F.contains(s, F.lit(w)) if len(w) > 3 else F.lit(False)))
    n = sum((hit(w.lower()).cast("int") for w in words), F.lit(0))
    score = F.when(n > 0, F.round(score * (1 + 0.015 * n), 4)).otherwise(score)
    score = F.when(F.element_at(segments, -1).isin(*accessors), F.round(score * ACCESSOR_FACTOR, 4)).otherwise(score)
    if preferred:
        score = F.when(F.get(segments, F.lit(0)).isin(*preferred), F.round(score * PREFERRED_FACTOR, 4)).otherwise(score)
    return score


def path_search(vector: DataFrame, text: DataFrame, key: str, words: Sequence[str], k: int, preferred: Sequence[str] = (), text_only: bool = False) -> DataFrame:
    """The blend of 0.6 and 0.4 to four places, tie-breakers, and the best ``k``; with ``text_only`` text scores alone."""
    if text_only:
        blended = text.select(key, F.round("score", 4).alias("score"))
    else:
        blended = fusion.blend(vector, text, key).select(key, "score")
    return top(blended.withColumn("score", tie_broken(F.col("score"), F.col(key), words, preferred)), key, k)


def grammar_stream(names: DataFrame, segments: Mapping[str, int], tokens: Sequence[str], corroborated: DataFrame) -> DataFrame:
    """(id, score): names whose segments hold query tokens, admitted by the tier gate, by weighted reciprocal ranks.

    ``segments`` maps a column to its tier. In each segment hits are ranked by id.
    """
    each = F.array(*[F.struct(F.lit(s).alias("segment"), F.lit(t).alias("tier"), F.lit(TIER_WEIGHTS[t]).alias("weight"), F.col(s).alias("token")) for s, t in segments.items()])
    hits = names.select("id", F.explode(each).alias("x")).select("id", "x.*").where(F.col("token").isin(*tokens))
    placed = hits.withColumn("place", F.row_number().over(Window.partitionBy("segment").orderBy("id")) - 1)
    admitted = fusion.tier_gate(hits, "id", corroborated)
    return placed.join(admitted, "id", "left_semi").groupBy("id").agg(F.sum(F.col("weight") / (60 + F.col("place") + 1)).alias("score"))


def three_streams(vector: DataFrame, keyword: DataFrame, grammar: DataFrame, key: str, k: int, candidates: int) -> DataFrame:
    """Reciprocal rank fusion of three streams, each cut to its candidates; the best ``k``."""
    streams = [fusion.ranked(s.select(key, "score"), key, candidates) for s in (vector, keyword, grammar)]
    return top(fusion.reciprocal_ranks(streams, key).withColumnRenamed("mass", "score"), key, k)


def with_members(clusters: DataFrame, members: DataFrame, most: int = 50) -> DataFrame:
    """Clusters with their first ``most`` members and how many there are; a task passes on the first of its own only, and sums."""
    counted = members.groupBy("cluster").agg(F.count("*").alias("n"))
    placed = members.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy("member"))).where(F.col("place") <= most)
    listed = placed.groupBy("cluster").agg(F.sort_array(F.collect_list("member")).alias("members"))
    return clusters.join(counted.join(listed, "cluster"), "cluster", "left")


def search_mode(query: Column) -> Column:
    """lexical, semantic or hybrid, by what a query looks like."""
    has = lambda p: F.regexp_like(query, F.lit(p))
    return F.when(has(OPERATORS), "lexical").when(has(TECHNICAL) & has(CONCEPTUAL), "hybrid").when(has(TECHNICAL), "lexical").when(has(CONCEPTUAL), "semantic").otherwise("hybrid")


def phrase_query(query: Column) -> Column:
    """Adjacent pairs as phrases and then the words, joined by OR; a single word stays."""
    words = F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != "")
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat(F.lit('"'), F.get(words, i), F.lit(" "), F.get(words, i + 1), F.lit('"')))
    return F.when(F.size(words) <= 1, F.trim(query)).otherwise(F.array_join(F.concat(pairs, words), " OR "))


def full_text_query(query: Column) -> Column:
    """``-word`` as ``NOT word`` outside quotes, lone dashes and repeated spaces dropped.

    Quoted parts are at odd places after a split at the quotes.
    """
    def plain(x: Column) -> Column:
        for pattern, to in ((r"(^|\s)-([a-zA-Z_][a-zA-Z0-9_]*)(?![:\w])", "$1NOT $2"), (r"(^|\s)-(?=\s|$)", "$1"), (r"\s+", " ")):
            x = F.regexp_replace(x, pattern, to)
        return x

    parts = F.split(query, '"', -1)
    closed = lambda i: (i % 2 == 1) & (i < F.size(parts) - 1)
    return F.trim(F.array_join(F.transform(parts, lambda x, i: F.when(closed(i), x).otherwise(plain(x))), '"'))


def chunk_search(chunks: DataFrame, queries: DataFrame, key: str, vector: str, k: int, facility: str | None = None, groups: Sequence[str] | None = None, least: float = 0.5) -> DataFrame:
    """(query, key, similarity, facility, groups, ...): code chunks near each query's vector, with all columns but the vector.

    Chunks of other facilities, and those related to none of ``groups``, are left out before the search, those below ``least`` after it,
    so a query can get fewer than ``k``. Null facilities and groups fit no filter.
    """
    kept = chunks
    if facility is not None:
        kept = kept.where(F.col("facility") == facility)
    if groups:
        kept = kept.where(F.arrays_overlap("groups", F.array(*map(F.lit, groups))))
    near = vectors.top_k(kept, queries, key, vector, k).where(F.col("similarity") >= least)
    return near.drop("place").join(kept.drop(vector), key)


def code_by_files(chunks: DataFrame, queries: DataFrame, examples: DataFrame, files: DataFrame, key: str, vector: str, k: int, facility: str | None = None, letters: int = 500) -> DataFrame:
    """(query, key, similarity, text, function, source_file): the nearest chunks, then the file of each one's example.

    The search takes all chunks; only after it those are left out whose example's file isn't of ``facility``, if one is given. Texts are
    cut to ``letters``. ``examples`` is (example, source_file), ``files`` (file, facility).
    """
    near = vectors.top_k(chunks, queries, key, vector, k).drop("place")
    told = near.join(chunks.drop(vector), key).join(examples, "example", "left")
    if facility is not None:
        own = files.where(F.col("facility") == facility).select(F.col("file").alias("source_file")).distinct()
        told = told.join(own, "source_file", "left_semi")
    return told.select("query", key, "similarity", F.substring("text", 1, letters).alias("text"), "function", "source_file")


def node_search(nodes: DataFrame, queries: DataFrame, clusters: DataFrame, key: str, vector: str, k: int, searchable: Sequence[str], group: str | None = None, deprecated: bool = False) -> DataFrame:
    """(query, key, similarity, ..., clusters): dictionary nodes near each query's vector, with the labels of their clusters.

    Only nodes of a searchable category take part, of one group if it is given, and of those that are deprecated only if asked for.
    ``clusters`` is (key, label); labels are distinct and sorted, none give an empty array.
    """
    kept = nodes.where(F.col("category").isin(*searchable))
    if group is not None:
        kept = kept.where(F.col("grp") == group)
    if not deprecated:
        kept = kept.where(F.col("deprecated").isNull())
    near = vectors.top_k(kept, queries, key, vector, k).drop("place")
    labels = clusters.join(near.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.sort_array(F.collect_set("label")).alias("clusters"))
    out = near.join(kept.drop(vector), key).join(labels, key, "left")
    return out.withColumn("clusters", F.coalesce("clusters", F.array().cast("array<string>")))
