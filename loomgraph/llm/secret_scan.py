"""Secret scans: three patterns, and Markov models of characters for strings without a pattern.

Two models of order 2 give the likelihood of a candidate string: one of random strings, one of ordinary identifiers
and words. A candidate is a secret if the log-likelihood ratio per character exceeds a threshold. Both are trained
on labelled samples: the secrets that the patterns find in a bounded sample of the corpus together with strings
drawn from common alphabets, against the words and identifiers of the same sample outside those spans together
with identifiers joined from ordinary parts.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.shared import cut

# The kinds and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6

#: Candidates for the models: long runs of the characters that keys are written in.
LEAST_CANDIDATE = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_CANDIDATE)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
THRESHOLD = 2.5
#: Weight of the shorter context's probability, in characters seen.
BACK_OFF = 4.0
# Parts of ordinary identifiers, for the model of what is no secret.
IDENTIFIER_PARTS = (
    "get", "set", "user", "name", "value", "count", "index", "list", "file", "path", "data", "item", "key", "type", "node", "config", "default",
    "message", "error", "handler", "request", "response", "service", "manager", "client", "server", "table", "column", "query", "result",
    "version", "number", "start", "end", "update", "create", "delete", "version2", "page1", "v3", "2024", "utf8", "sha256",
)
#: Training samples at most: documents read, strings of either label kept, drawn strings of each alphabet.
SAMPLE_DOCUMENTS = 2000
SAMPLE_STRINGS = 20_000
DRAWN = 2000
SEED = 6

SPAN = "array<struct<kind:int,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches in order of start, then kind."""
    found = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Markov:
    """Order-2 model over ALPHABET; rare contexts fall back on shorter ones."""

    def __init__(self, samples: Iterable[str]):
        n = self.size = len(ALPHABET) + 1  # the last stands for a string's edge
        counts = np.zeros((n, n, n))
        for s in samples:
            c = codes(s)
            if len(c):
                a = np.concatenate([[n - 1, n - 1], c])
                np.add.at(counts, (a[:-2], a[1:-1], a[2:]), 1)
        p = np.full(n, 1 / n)
        for level in (counts.sum(axis=(0, 1)), counts.sum(axis=0), counts):
            p = (level + BACK_OFF * p) / (level.sum(axis=-1, keepdims=True) + BACK_OFF)
        self.log = np.log(p).astype(np.float32)

    def score(self, c: np.ndarray) -> float:
        a = np.concatenate([[self.size - 1, self.size - 1], c])
        return float(self.log[a[:-2], a[1:-1], a[2:]].mean())


CODE = np.full(128, -1, np.int16)
for _i, _c in enumerate(ALPHABET):
    CODE[ord(_c)] = _i


def codes(s: str) -> np.ndarray:
    """Places in ALPHABET of the characters of ``s`` that have one."""
    c = CODE[np.frombuffer(s.encode("ascii", "ignore"), np.uint8)]
    return c[c >= 0]


def drawn_strings() -> list[str]:
    """Random strings over the usual alphabets, always the same."""
    rng = random.Random(SEED)
    alphabets = (ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], "0123456789abcdef")
    return ["".join(rng.choices(a, k=rng.randint(20, 48))) for a in alphabets for _ in range(DRAWN)]


def ordinary_identifiers() -> list[str]:
    """Identifiers joined from ordinary parts in the usual notations, always the same."""
    rng = random.Random(SEED + 1)
    out = []
    for _ in range(DRAWN):
        parts = rng.choices(IDENTIFIER_PARTS, k=rng.randint(2, 5))
        out += ["_".join(parts), "-".join(parts), "/".join(parts), parts[0] + "".join(map(str.capitalize, parts[1:])), "_".join(parts).upper()]
    return out


def ratio(models: tuple[Markov, Markov], s: str) -> float:
    """Log-likelihood ratio for each character: over 0, ``s`` is likelier random."""
    c = codes(s)
    return models[0].score(c) - models[1].score(c) if len(c) else 0.0


def is_candidate(s: str) -> bool:
    return len(s) >= LEAST_CANDIDATE and any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def labelled_strings(text: str) -> tuple[list[str], list[str]]:
    """Secrets by pattern, and the ordinary words and identifiers outside of them; what the models are asked about is neither."""
    spans = base_spans(text)
    secret = []
    for start, kind, end in spans:
        m = ASSIGN.match(text, start) if kind == 0 else None
        secret.append(m[2] if m else text[start:end])
    masked = list(text)
    for start, _, end in spans:
        masked[start:end] = " " * (end - start)
    return secret, [s for s in re.findall(r"[A-Za-z0-9+/_=-]{4,}", "".join(masked)) if not is_candidate(s)]


def train(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, sample_strings: int = SAMPLE_STRINGS) -> tuple[Markov, Markov]:
    """Models of random strings and of ordinary ones.

    Reads the ``sample_documents`` different texts that come first by hash, among those with a hint of a secret and
    among all, and keeps at most ``sample_strings`` different strings of either label, in order of their own hash, so
    the models depend neither on the order of rows nor on how often a text is repeated. Hashes alone are sorted.
    """

    def run(batches):
        for batch in batches:
            for t in batch.column("text").to_pylist():
                secret, plain = labelled_strings(t)
                rows = [(s, 1) for s in dict.fromkeys(secret)] + [(s, 0) for s in dict.fromkeys(plain)]
                yield pa.RecordBatch.from_pydict({"s": [r[0] for r in rows], "label": [r[1] for r in rows]}, schema=pa.schema([("s", pa.string()), ("label", pa.int32())]))

    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).select("text", F.xxhash64("text").alias("h"))
    hint = F.regexp_like("text", F.lit(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"))
    hashes = cut(texts.select("h", hint.alias("hinted")).groupBy("h").agg(F.bool_or("hinted").alias("hinted")))
    first = lambda d: d.select("h").orderBy("h").limit(sample_documents)
    chosen = first(hashes.where("hinted")).union(first(hashes)).distinct()
    # the limits bound this side
    sample = texts.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("text").alias("text"))
    strings = cut(sample.select("text").mapInArrow(run, "s string, label int").distinct())
    kept = [[r["s"] for r in strings.where(F.col("label") == label).orderBy(F.xxhash64("s"), "s").limit(sample_strings).collect()] for label in (1, 0)]
    return Markov(kept[0] + drawn_strings()), Markov(kept[1] + ordinary_identifiers())


def spans_of(text: str, models: tuple[Markov, Markov], threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
    """All spans: the patterns', and candidates outside of them whose ratio exceeds the threshold."""
    found = base_spans(text)
    more = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        s = m[0]
        if any(start < b and a < end for start, _, end in found):
            continue
        if is_candidate(s) and ratio(models, s) > threshold:
            more.append((a, KINDS.index("random"), b))
    return sorted(found + more)


def scan(docs: DataFrame, models: tuple[Markov, Markov] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: ``doc_id, text`` and ``spans`` (kind, start, end), in order of start and then kind.

    Places are code points, ends exclusive. A null text is like an empty one: no spans. Rows are independent:
    repeated rows and null ids stay, equal texts get equal spans, an empty table gives no rows, other columns are
    ignored. The models are broadcast; their size is fixed by the alphabet.
    """
    models = models or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches):
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                found = [[{"kind": k, "start": a, "end": b} for a, k, b in spans_of(t, shared.value, threshold)] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(found, schema.types[2])], schema=schema)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, f"doc_id long, text string, spans {SPAN}")


def redacted(text, spans):
    """``text`` with each span replaced by ``[SECRET]``; spans that overlap become one."""
    step = lambda a, s: F.when(
        s["start"] >= a["at"],
        F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("[SECRET]")).alias("out")),
    ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))
    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))
