"""Resampling by importance: draw the documents that look most like a target collection.

Features are runs of words, hashed to buckets. A bucket's gain compares its share in the target with its share in the corpus;
a document's weight is the sum of gains over its features. Gumbel noise from a hash of its id turns the highest
scores into a draw without replacement.

A text of over CHUNK_CHARS characters is split at word boundaries. A chunk owns the words that start in it and carries the
``longest - 1`` words after it, so every feature belongs to the chunk of its first word, and each chunk of a long text
can be another task's work. Counts and weights of chunks are summed by document. Only tables of one
row for each bucket are collected, and ranks come from ranges of scores and their sizes.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.shared import cut, join_counted

#: Words in the longest feature.
LONGEST = 1
BUCKETS = 10_000
SEED = "2024"
#: Documents with fewer words are not drawn.
LEAST_WORDS = 20
#: Share of the documents with enough words that is drawn, in percent.
DRAWN_PERCENT = 10
#: Longer texts are split into chunks of about so many characters.
CHUNK_CHARS = 1 << 16
#: Features whose bucket a task remembers.
REMEMBERED = 500_000
#: Buckets of features that a task lists before it counts them.
HELD = 1 << 20
#: Gains and scores are whole numbers of so many parts.
PARTS = 1000
#: Documents in one range of scores, about, if there are more than the shuffle partitions take.
RANGE_ROWS = 1_000_000

#: Letters A-Z and a-z, digits, and everything beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


class FeatureBuckets(dict):
    """Bucket of each feature met, A-Z lower-cased."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[feature] = zlib.crc32(feature.translate(LOWER).encode()) % self.buckets
        return value


def features(text: str, carry: str, longest: int) -> tuple[list[str], int]:
    """Features that start in ``text`` and may end in ``carry``, and the number of words in ``text``."""
    words = WORD.findall(text)
    n = len(words)
    if longest == 1:
        return words, n
    words += WORD.findall(carry)
    return [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(min(n, len(words) - k + 1))], n


def chunks(text: str, longest: int, chars: int) -> Iterator[tuple[str, str]]:
    """(own, carry) parts of a text: cut between words at about every ``chars`` characters, with longest - 1 words carried."""
    at = 0
    while at < len(text):
        end = min(len(text), at + chars)
        if end < len(text) and (m := WORD.match(text, end)) and WORD.match(text, end - 1):
            end = m.end()  # the word in hand is this chunk's
        to = end
        for _ in range(longest - 1):
            m = WORD.search(text, to)
            to = m.end() if m else len(text)
        yield text[at:end], text[end:to]
        at = end


def in_chunks(docs: DataFrame, longest: int = LONGEST, chars: int = CHUNK_CHARS) -> DataFrame:
    """(row_id, doc_id, text, carry): short texts as they are, chunks of long ones dealt out by a hash.

    ``row_id`` tells rows apart that share an id; a null text is empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    schema = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("text", pa.string()), ("carry", pa.string())])

    def split(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row_id, doc_id, text = (batch.column(c)[k].as_py() for c in range(3))
                for n, (own, carry) in enumerate(chunks(text, longest, chars)):
                    yield pa.RecordBatch.from_pydict({"row_id": [row_id], "doc_id": [doc_id], "chunk": [n], "text": [own], "carry": [carry]}, schema=schema)

    is_long = F.length("text") > chars
    long = rows.where(is_long).mapInArrow(split, "row_id long, doc_id long, chunk long, text string, carry string")
    dealt = long.repartition(F.col("row_id"), F.col("chunk")).drop("chunk")
    return rows.where(~is_long).select("row_id", "doc_id", "text", F.lit("").alias("carry")).unionByName(dealt)


def bucket_counts(parts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features in each bucket that has any; a task gives one row for a bucket."""

    def run(batches):
        known, total, held = FeatureBuckets(buckets), np.zeros(buckets, np.int64), array("q")
        for batch in batches:
            for text, carry in zip(batch.column(0), batch.column(1)):
                held.extend(map(known.__getitem__, features(text.as_py(), carry.as_py(), longest)[0]))
                if len(held) > HELD:
                    total += np.bincount(held, minlength=buckets)
                    held = array("q")
        total += np.bincount(np.array(held, np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    return parts.select("text", "carry").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket, from two tables of (bucket, n).

    The gain is floor(PARTS * ln(((t + 1) / (T + buckets)) / ((s + 1) / (S + buckets)))), t and s being the bucket's counts.
    """
    spark = corpus.sparkSession
    sides = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = sides.unionByName(spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    each = cut(every.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    totals = each.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))
    # the totals are one row
    return each.join(F.broadcast(totals)).select("bucket", F.floor(F.lit(float(PARTS)) * F.log(ratio)).cast("long").alias("gain"))


def weights(parts: DataFrame, gain_of: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """(row_id, doc_id, n_words, n_features, weight) summed over each row's chunks."""
    shared = parts.sparkSession.sparkContext.broadcast(gain_of)
    names = ["row_id", "doc_id", "n_words", "n_features", "weight"]
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches):
        gain, known = shared.value, FeatureBuckets(len(shared.value))
        for batch in batches:
            words, counts, sums = [], [], []
            for text, carry in zip(batch.column(2), batch.column(3)):
                found, n = features(text.as_py(), carry.as_py(), longest)
                words.append(n)
                counts.append(len(found))
                sums.append(int(gain[np.fromiter(map(known.__getitem__, found), np.int64, len(found))].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in (words, counts, sums)]], schema=schema)

    each = parts.mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return each.groupBy("row_id", "doc_id").agg(*[F.sum(c).alias(c) for c in names[2:]])


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """floor(PARTS times a Gumbel variate), from the first 32 bits of a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(PARTS)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, order: list[Column], n_rows: int) -> DataFrame:
    """Add ``place`` (from 1) in ``order``: rows are sorted in ranges, and each range starts behind the rows of those before.

    The window without partitions holds one row for each range.
    """
    ranges = max(int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // RANGE_ROWS))
    dealt = scored.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # the lower 33 bits of these ids count the rows of a partition
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = cut(dealt.select("*", F.spark_partition_id().alias("range_id"), own.alias("own")))
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("range_id").agg(F.count("*").alias("n"))
    first = sizes.select("range_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return join_counted(numbered, first, "range_id", "inner").withColumn("place", F.col("own") + F.col("first") + 1).drop("range_id", "own", "first")


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    percent: int = DRAWN_PERCENT,
    least_words: int = LEAST_WORDS,
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """Per document: ``doc_id, n_words, n_features, weight, score, rank``; ``rank`` is null where it isn't drawn.

    ``target`` needs a column text. Of the documents with at least ``least_words`` words, ``percent`` in a hundred are drawn,
    rounded down: the highest scores, ties by smaller doc_id, null ids last, then by number of features and weight. A null or
    empty text has no features, weight 0, and takes part in no draw. Repeated rows are documents of their own;
    other columns are ignored; an empty target gives every bucket its smoothed share; no documents, no rows.
    """
    parts = in_chunks(docs, longest, chunk_chars)
    aims = in_chunks(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, chunk_chars)
    table = gains(bucket_counts(parts, longest, buckets), bucket_counts(aims, longest, buckets), buckets).toArrow()  # one row for each bucket
    gain_of = np.zeros(buckets, np.int64)
    gain_of[table["bucket"].to_numpy()] = table["gain"].to_numpy()
    scored = cut(weights(parts, gain_of, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"))))
    able = scored.where(F.col("n_words") >= least_words)
    n = able.count()
    drawn = n * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("row_id")]
    best = ranked(able.select("row_id", "doc_id", "n_features", "weight", "score"), order, n).where(F.col("place") <= drawn)
    rows = scored.join(best.select("row_id", F.col("place").alias("rank")), "row_id", "left")
    return rows.select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def resampled_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, in their own columns; rows that share an id are drawn together if any of them is."""
    ids = resample(docs, target, **options).where("rank is not null and doc_id is not null").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi").select(*docs.columns)
