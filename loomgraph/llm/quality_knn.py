"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

Terms are trigrams of character classes over a text's UTF-8 bytes, words equal to the one or two before them, and words
hashed to WORD_BUCKETS. Square roots of term shares, weighted by inverse document frequency over a labelled sample, are projected on the
sample's leading singular vectors. The sample's vectors and labels are broadcast; every document's cosine with all
of them is computed in blocks, exactly, and the NEIGHBOURS nearest vote for their label by similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents at most, for each label: those first by hash. This bounds what is collected and broadcast.
SAMPLE_PER_LABEL = 1000
DIMENSIONS = 32
NEIGHBOURS = 15
#: Similarities are raised to this power before they weigh a vote.
SHARPNESS = 8
#: Cosines are rounded to so many places, so that ties don't depend on the order of a sum.
DIGITS = 9
FOLDS, HELD_OUT = 3, 1
#: Documents whose products with the sample are computed at once.
BLOCK_ROWS = 256
N_CLASSES = 8
#: Buckets of words in any case, and how much their shares weigh beside those of the other terms.
WORD_BUCKETS = 1024
WORD_WEIGHT = 0.5
#: Words whose bucket a Python worker remembers.
REMEMBERED = 50_000


def character_classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, space, line end, stop, other sign, beyond ASCII."""
    out = np.full(256, 6, np.int32)
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:!?'\"()-")):
        out[list(chars.encode())] = k
    out[128:] = 7
    return out


CLASSES = character_classes()
N_SHAPES = N_CLASSES**3 + 2
N_TERMS = N_SHAPES + WORD_BUCKETS


class WordPlaces(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        place = self[word] = zlib.crc32(word.encode()) % WORD_BUCKETS
        return place


@lru_cache(maxsize=1)
def word_places() -> WordPlaces:
    return WordPlaces()


def roots(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares; zeros stay."""
    n = counts.sum()
    return np.sqrt(counts / n) if n else counts


def term_shares(text: str | None) -> np.ndarray:
    """Square roots of the terms' shares, of shapes and of words each; zeros where a text has none."""
    text = text or ""
    words = text.lower().split()
    places = np.fromiter(map(word_places().__getitem__, words), np.int64, len(words))
    return np.concatenate([roots(shapes(text)), WORD_WEIGHT * roots(np.bincount(places, minlength=WORD_BUCKETS))]).astype(np.float32)


def shapes(text: str) -> np.ndarray:
    """Counts of the trigrams of character classes, and of words equal to the one or two before."""
    out = np.zeros(N_SHAPES, np.float32)
    c = CLASSES[np.frombuffer(text.encode(), np.uint8)]
    if len(c) > 2:
        out[:-2] = np.bincount(c[:-2] * N_CLASSES**2 + c[1:-1] * N_CLASSES + c[2:], minlength=N_CLASSES**3)
    words = text.split()
    out[-2] = sum(a == b for a, b in zip(words, words[1:]))
    out[-1] = sum(a == b for a, b in zip(words, words[2:]))
    return out


def in_blocks(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def is_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into a fold; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: dict[int, int]) -> DataFrame:
    """(doc_id, text, label) of documents that come first by hash of their id, at most ``per_label`` rows for each label.

    Ids with several labels count with the largest one, and of several rows with an id the one whose text's hash is
    least; null labels are left out.
    """
    each = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    each = each.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    parts = [each.where(F.col("label") == k).orderBy(order, "doc_id").limit(n) for k, n in per_label.items()]
    ids = parts[0]
    for part in parts[1:]:
        ids = ids.union(part)
    # the limits bound this side
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    return one.select("doc_id", "least.text", "label")


@dataclass
class Neighbours:
    """The labelled sample in latent space."""

    weights: np.ndarray  # terms x dimensions: idf and singular vectors
    vectors: np.ndarray  # sample x dimensions, of length 1
    labels: np.ndarray
    prior: float

    def place(self, shares: np.ndarray) -> np.ndarray:
        v = shares @ self.weights
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(n > 0, n, 1)

    def score(self, shares: np.ndarray) -> np.ndarray:
        """Share of label 1 in the votes; the sample's share where no neighbour is similar at all.

        Neighbours whose cosine ties for the last of the NEIGHBOURS places share what is left of them.
        """
        if not len(self.labels):
            return np.full(len(shares), self.prior)
        n = len(self.labels)
        cosines = np.round(self.place(shares) @ self.vectors.T, DIGITS)
        k = min(NEIGHBOURS, n)
        last = np.partition(cosines, n - k, axis=1)[:, n - k, None]
        nearer, tied = cosines > last, cosines == last
        places = nearer + tied * ((k - nearer.sum(axis=1, keepdims=True)) / tied.sum(axis=1, keepdims=True))
        votes = places * np.maximum(cosines, 0) ** SHARPNESS
        total = votes.sum(axis=1)
        return np.where(total > 0, np.minimum(1.0, votes @ self.labels / np.where(total > 0, total, 1)), self.prior)


def fit(sample: DataFrame, dimensions: int = DIMENSIONS) -> Neighbours:
    """Latent space of a bounded labelled sample (text, label)."""
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("shares", pa.list_(pa.float32()))])

    def run(batches):
        for b in in_blocks(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "label": b.column("label"), "shares": [term_shares(t) for t in b.column("text").to_pylist()]}, schema=schema)

    picked = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text").mapInArrow(run, "doc_id long, label int, shares array<float>").toArrow()
    if not picked.num_rows:
        return Neighbours(np.zeros((N_TERMS, 1)), np.zeros((0, 1)), np.zeros(0), 0.5)
    order = np.lexsort((picked["label"].to_numpy(), picked["doc_id"].to_numpy()))  # ids are different
    shares = picked["shares"].combine_chunks().flatten().to_numpy().reshape(-1, N_TERMS)[order].astype(np.float64)
    labels = picked["label"].to_numpy()[order].astype(np.float64)
    idf = np.log((1 + len(shares)) / (1 + (shares > 0).sum(axis=0))) + 0.05
    _, vectors = np.linalg.eigh((shares * idf).T @ (shares * idf))
    space = Neighbours(idf[:, None] * vectors[:, ::-1][:, :dimensions], np.zeros((0, 1)), labels, float(labels.mean()))
    space.vectors = space.place(shares)
    return space


def score_quality(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """Per document: ``row`` (the input row), ``held_out``, ``score``.

    Trains on labels of ids outside the held-out fold only; only the text is scored. A null or empty text has no
    terms and gets the sample's share of label 1, as does every text if there are no labels. Equal texts get equal
    scores; repeated rows stay; input columns can have any names; an empty table gives no rows.
    """
    usable = labels.where(~is_fold(F.col("doc_id"), FOLDS, HELD_OUT))
    space = fit(labelled_sample(docs, usable, "quality", {0: per_label, 1: per_label}))
    shared = docs.sparkSession.sparkContext.broadcast(space)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        parts = [shared.value.score(np.stack([term_shares(t) for t in texts[at : at + BLOCK_ROWS]])) for at in range(0, len(texts), BLOCK_ROWS)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, is_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), score(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("score"))


def accepted_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, in their own columns, that score at least ``threshold``."""
    return score_quality(docs, labels).where(F.col("score") >= threshold).select("row.*")
