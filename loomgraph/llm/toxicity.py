"""Toxicity: bags of subword embeddings, averaged into a linear softmax, trained jointly in numpy.

A word is its own bucket and those of its character n-grams, so a misspelling shares most of the vectors of the word
it stands for. The vectors of a run of SEGMENT words are averaged and go through a linear softmax; a document is
scored by its most toxic run, and is trained through that run, because a few words make a long text toxic.
"""

from __future__ import annotations

import string
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.quality_knn import BLOCK_ROWS, is_fold, labelled_sample

#: Labelled documents at most, by label: those first by hash. All of their text is trained on.
SAMPLE = {1: 1000, 0: 2000}
FOLDS, HELD_OUT = 4, 2
#: Words of a run; of 8, 4 and 2, the one with the best recall on folds outside the held-out one.
SEGMENT = 2
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SHORTEST, LONGEST = 3, 5
#: Bytes of a word at most; longer runs without white space are cut into pieces.
LONGEST_WORD = 62
DIMENSIONS = 8
EPOCHS, WHOLE_EPOCHS = 50, 8
RATE = 0.3
SEED = 10
#: Words whose value a Python worker remembers.
REMEMBERED = 300_000


def normal(word: str) -> str:
    return word.lower().strip(string.punctuation)


def windows(word: str) -> list[str]:
    """Pieces of at most LONGEST_WORD bytes that overlap enough for every n-gram to be whole in one of them."""
    data, out, at = word.encode(), [], 0
    while True:
        end = min(at + LONGEST_WORD, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:  # not inside a character
            end -= 1
        out.append(data[at:end].decode())
        if end == len(data):
            return out
        at = end - (LONGEST - 1)
        while data[at] & 0xC0 == 0x80:
            at -= 1


def pieces_of(word: str) -> list[str]:
    """A word itself; of a run too long for one its parts between punctuation, and the run in windows."""
    plain = normal(word)
    if len(plain.encode()) <= LONGEST_WORD:
        return [word]
    parts = "".join(" " if unicodedata.category(c)[0] in "PSZC" else c for c in plain).split()
    return windows(plain) + ([w for p in parts for w in windows(p)] if len(parts) > 1 else [])


def words_of(text: str | None) -> list[str]:
    words = (text or "").split()
    if max(map(len, words), default=0) <= LONGEST_WORD // 4:
        return words
    return [p for w in words for p in ([w] if len(w) <= LONGEST_WORD // 4 else pieces_of(w))]


def subword_table(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) pairs as two arrays: for each word, itself and its n-grams between edge marks."""
    data = [b"<" + w.encode() + b">" for w in words]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    chars = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))  # characters to the word's end
    whole = np.fromiter((zlib.crc32(d) % BUCKETS for d in data), np.int64, len(data))
    owners, buckets = [np.arange(len(words))], [whole]
    code = np.zeros(len(chars), np.uint64)
    for n in range(1, LONGEST + 1):
        code[: len(chars) - n + 1] = code[: len(chars) - n + 1] * np.uint64(257) + chars[n - 1 :]
        if n >= SHORTEST:
            fits = left >= n
            owners.append(owner[fits])
            mixed = (code[fits] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


@dataclass
class Model:
    """What scoring needs: each bucket's share of the log odds, as the softmax is linear in the mean vector."""

    values: np.ndarray
    bias: float

    def words(self, words: list[str]) -> np.ndarray:
        """The mean value of each normal word's subwords."""
        owner, bucket = subword_table(words)
        return np.bincount(owner, self.values[bucket], len(words)) / np.bincount(owner, minlength=len(words))


class WordValues(dict):
    """Values of words as they are written, with those used before kept until as many new ones are there."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.before = model, {}

    def learn(self, words: set[str]) -> None:
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()
        new = words.difference(self)
        self.update({w: self.before[w] for w in new if w in self.before})
        new = list(new.difference(self))
        if new:
            plain = list(map(normal, new))
            different = list(dict.fromkeys(plain))
            value = dict(zip(different, self.model.words(different).tolist()))
            self.update(zip(new, map(value.__getitem__, plain)))


def probability(odds: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def score_texts(texts: list[str | None], known: WordValues) -> list[float]:
    """Probability that the most toxic run of each text is toxic; runs overlap by half."""
    split = [words_of(t) for t in texts]
    known.learn(set().union(*split))
    out = []
    for words in split:
        best = 0.0
        if words:
            sums = np.concatenate([[0.0], np.cumsum(np.fromiter(map(known.__getitem__, words), np.float64, len(words)))])
            starts = np.arange(0, max(1, len(words) - SEGMENT // 2), SEGMENT // 2)
            best = ((sums[np.minimum(starts + SEGMENT, len(words))] - sums[starts]) / SEGMENT).max()
        out.append(probability(best + known.model.bias))
    return out


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Embeddings and softmax together, by Adagrad over all documents at once.

    The first epochs average over whole documents, to find which subwords matter; then each document learns
    through its highest run. Both labels weigh the same while training; the bias is then set for the sample's shares.
    """
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    runs, run_doc = [], []
    for d, text in enumerate(texts):
        ids = [vocabulary.setdefault(normal(w), len(vocabulary)) for w in words_of(text)] or [vocabulary.setdefault("", len(vocabulary))]
        for at in range(0, len(ids), SEGMENT):
            part = ids[at : at + SEGMENT]
            runs.append(part + [-1] * (SEGMENT - len(part)))
            run_doc.append(d)
    runs, run_doc = np.array(runs, np.int32), np.array(run_doc, np.int32)
    owner, bucket = subword_table(list(vocabulary))
    order = np.argsort(owner, kind="stable")
    owner, bucket = owner[order].astype(np.int32), bucket[order].astype(np.int32)
    n_words, n_docs = len(vocabulary), len(texts)
    sizes = np.bincount(owner, minlength=n_words)
    begin = np.cumsum(sizes) - sizes
    first = np.concatenate([[0], np.flatnonzero(np.diff(run_doc)) + 1])
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    memory = [np.full_like(x, 1e-6) for x in (vectors, out, bias)]
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    target = np.stack([1 - labels, labels], axis=1)

    for epoch in range(epochs):
        if epoch < WHOLE_EPOCHS:
            chosen = np.arange(len(runs))
        else:
            worth = (vectors @ (out[:, 1] - out[:, 0]))[bucket]
            word = np.append(np.bincount(owner, worth, n_words) / sizes, 0.0)
            odds = word[runs].sum(axis=1)
            hit = np.flatnonzero(odds == np.maximum.reduceat(odds, first)[run_doc])
            chosen = hit[np.unique(run_doc[hit], return_index=True)[1]]
        # (document, word) pairs of the chosen runs; a document is the mean over their places
        flat, doc_of = runs[chosen].ravel(), np.repeat(run_doc[chosen], SEGMENT)
        share = 1 / (SEGMENT * np.bincount(run_doc[chosen], minlength=n_docs))
        flat, doc_of = flat[flat >= 0], doc_of[flat >= 0]
        used, local = np.unique(flat, return_inverse=True)
        count = sizes[used]
        places = np.repeat(begin[used] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        subs, sub_word = bucket[places], np.repeat(np.arange(len(used)), count)
        words = np.stack([np.bincount(sub_word, vectors[subs, k], len(used)) for k in range(DIMENSIONS)], axis=1) / count[:, None]
        doc = np.stack([np.bincount(doc_of, words[local, k], n_docs) for k in range(DIMENSIONS)], axis=1) * share[:, None]
        logits = doc @ out + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        wrong = (p / p.sum(axis=1, keepdims=True) - target) * weight[:, None]
        to_doc = (wrong @ out.T) * share[:, None]
        to_word = np.stack([np.bincount(local, to_doc[doc_of, k], len(used)) for k in range(DIMENSIONS)], axis=1) / count[:, None]
        to_vectors = np.stack([np.bincount(subs, to_word[sub_word, k], BUCKETS) for k in range(DIMENSIONS)], axis=1)
        for x, g, m in zip((vectors, out, bias), (to_vectors, doc.T @ wrong, wrong.sum(axis=0)), memory):
            m += (g * g).astype(np.float32)
            x -= (RATE * g / np.sqrt(m)).astype(np.float32)
    share = labels.mean()
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0] + np.log(share / (1 - share))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample of the labelled documents outside the held-out fold."""
    usable = labels.where(~is_fold(F.col("doc_id"), FOLDS, HELD_OUT))
    sample = labelled_sample(docs, usable, "toxic", SAMPLE)
    picked = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "label", F.coalesce("text", F.lit("")).alias("text")).toArrow().to_pylist()
    picked.sort(key=lambda r: (r["doc_id"], r["label"], r["text"]))
    seen = {r["label"] for r in picked}
    if len(seen) < 2:  # nothing to tell apart
        return Model(np.zeros(BUCKETS), 30.0 if seen == {1} else -30.0)
    return train([r["text"] for r in picked], np.array([r["label"] for r in picked], np.float64))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: ``row`` (the input row), ``held_out``, ``score``.

    Only the text is scored, all of it. A null or empty text has no runs and gets the score of the bias alone; without
    labels of both kinds every score is near that of the only label, or 0. Equal texts get equal scores;
    repeated rows stay; input columns can have any names; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    known: list[WordValues] = []

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        if not known:
            known.append(WordValues(shared.value))
        parts = [score_texts(list(texts[at : at + BLOCK_ROWS]), known[0]) for at in range(0, len(texts), BLOCK_ROWS)]
        return pd.Series([x for part in parts for x in part], dtype="float64")

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, is_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), score(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("score"))
