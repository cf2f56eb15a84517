"""Full text: postings, BM25, tiered matches, keyword scores, n-gram themes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.shared import cut

K1, B = 1.2, 0.75
NOT_WORD = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, length): how often a term stands in a document."""
    split = docs.select(key, tokens(F.col(text)).alias("w"))
    return split.select(key, F.size("w").alias("length"), F.explode("w").alias("term")).groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, key: str, text: str, terms: Sequence[str]) -> DataFrame:
    """(key, score): BM25 of the documents that hold any of the terms.

    The counts of the few query terms are taken in one pass over the texts and written, a few numbers for each document;
    statistics and scores come from them, so no text is read twice and no posting of other terms is shuffled.
    """
    def occurrences(term: str) -> Column:
        return F.size("w") - F.size(F.array_remove("w", F.lit(term)))

    wanted = list(dict.fromkeys(t.lower() for t in terms))
    counted = docs.select(key, tokens(F.col(text)).alias("w"))
    counted = cut(counted.select(key, F.size("w").alias("length"), *[occurrences(t).alias(f"tf{i}") for i, t in enumerate(wanted)]))
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))])
    joined = counted.where(" or ".join(f"tf{i} > 0" for i in range(len(wanted)))).crossJoin(F.broadcast(stats))  # one row

    def part(i: int) -> Column:
        tf = F.col(f"tf{i}")
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))

    return joined.select(key, sum((part(i) for i in range(1, len(wanted))), part(0)).alias("score"))


def tiered_contains(df: DataFrame, key: str, query: str, tiers: Sequence[tuple[Column, float]]) -> DataFrame:
    """(key, score): the score of the first tier whose text contains the query in any case."""
    score = None
    for text, value in tiers:
        hit = F.contains(F.lower(text), F.lit(query.lower()))
        score = F.when(hit, value) if score is None else score.when(hit, value)
    return df.select(key, score.alias("score")).where(F.col("score").isNotNull())


def keyword_score(query: str, name: Column, description: Column, options: Column, keywords: Column) -> Column:
    """Tiers for the whole query (6 name, 5 keyword, 4 description), and for each of its words (3, 2, 2, 1)."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    has = lambda c, w: F.contains(low(c), F.lit(w))
    any_ = lambda a, w: F.exists(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), F.lit(w)))
    whole = query.lower()
    score = F.when(has(name, whole), 6).otherwise(0) + F.when(any_(keywords, whole), 5).otherwise(0) + F.when(has(description, whole), 4).otherwise(0)
    for word in [w for w in query_words(whole) if w]:
        score = score + F.when(has(name, word), 3).otherwise(0) + F.when(any_(keywords, word), 2).otherwise(0) + F.when(any_(options, word), 2).otherwise(0) + F.when(has(description, word), 1).otherwise(0)
    return score


def query_words(text: str) -> list[str]:
    """Words of a query: split at underscores, commas and white space."""
    return re.split(r"[_\s,]+", text)


#: Different n-grams that a task counts before it gives them out.
COUNTED_NGRAMS = 500_000


def ngram_counts(docs: DataFrame, text: str, sizes: Sequence[int]) -> DataFrame:
    """(theme, size, n, n_docs): runs of ``sizes`` words, how often they stand in the texts and in how many of them.

    A task counts its own n-grams before they are shuffled, and gives them out whenever it holds COUNTED_NGRAMS.
    """
    names, kinds = ["theme", "size", "n", "n_docs"], [pa.string(), pa.int32(), pa.int64(), pa.int64()]

    def given(n: Counter, n_docs: Counter) -> pa.RecordBatch:
        columns = list(n), [g.count(" ") + 1 for g in n], list(n.values()), [n_docs[g] for g in n]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, n_docs = Counter(), Counter()
        for batch in batches:
            for words in batch.column(0):
                words = words.as_py().split(" ")
                found = Counter(" ".join(g) for k in sizes for g in zip(*(words[i:] for i in range(k))))
                n.update(found)
                n_docs.update(found.keys())
                if len(n) >= COUNTED_NGRAMS:
                    yield given(n, n_docs)
                    n, n_docs = Counter(), Counter()
        yield given(n, n_docs)

    # tokens hold no space; texts are dealt out evenly, as n-grams are many times their size
    listed = docs.select(F.col(text).alias("words")).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).select(F.array_join(tokens(F.col("words")), " ").alias("words"))
    each = listed.mapInArrow(run, "theme string, size int, n long, n_docs long")
    return each.groupBy("theme", "size").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def themes(docs: DataFrame, text: str, least: int = 2) -> DataFrame:
    """(theme, size, n, n_docs, weight): word pairs and triples that occur at least twice, count * (ln(N / df) + 1), triples * 1.2.

    Null texts count as documents without words.
    """
    n_docs = docs.count()
    kept = ngram_counts(docs, text, (2, 3)).where(F.col("n") >= least)
    factor = F.when(F.col("size") == 3, 1.2).otherwise(1.0)
    return kept.select("theme", "size", "n", "n_docs", (F.col("n") * (F.log(F.lit(float(n_docs)) / F.col("n_docs")) + 1) * factor).alias("weight"))


def different_themes(found: DataFrame, k: int, most: int = 2000) -> DataFrame:
    """(place, theme, weight): the ``k`` heaviest themes, without those that mostly repeat words of heavier ones: a report.

    Of the ``most`` heaviest themes, in order of weight and then theme, one is taken unless more than half of its words
    were in those taken before.
    """
    order = lambda x: F.struct((-x["weight"]).alias("w"), x["theme"].alias("theme"))
    listed = found.orderBy(F.desc("weight"), "theme").limit(most).agg(F.sort_array(F.collect_list(order(F.struct("weight", "theme")))).alias("t"))
    start = F.struct(F.array().cast("array<struct<theme:string,weight:double>>").alias("done"), F.array().cast("array<string>").alias("seen"))

    def step(a: Column, x: Column) -> Column:
        words = F.array_distinct(F.split(x["theme"], " "))
        repeated = F.size(F.array_intersect(words, a["seen"])) >= F.floor(F.size(words) / 2) + 1
        taken = F.struct(F.array_append(a["done"], F.struct(x["theme"].alias("theme"), (-x["w"]).alias("weight"))).alias("done"), F.array_union(a["seen"], words).alias("seen"))
        return F.when(repeated | (F.size(a["done"]) >= k), a).otherwise(taken)

    chosen = listed.select(F.posexplode(F.aggregate("t", start, step, lambda a: a["done"])).alias("place", "x"))
    return chosen.select("place", "x.theme", "x.weight")
