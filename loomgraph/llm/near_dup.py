"""Near-duplicates: a multi-index Hamming join of MinHash signatures, confirmed on full shingle sets.

A signature has CHUNKS x CHUNK_BYTES minima of one byte each. Sets whose Jaccard similarity reaches the threshold
differ in more than MOST_ERRORS bytes with a chance under 1 in 10,000. By the pigeonhole principle two
signatures within that distance have a chunk with at most ALLOWED errors; with one allowed error, all keys that leave
out one byte of a chunk are enumerated, and every such pair shares a key. Documents with equal sets are
one node from the start.

Pairs under a key don't become rows. Every node is first compared with a few lead nodes, those it shares most keys
with; confirmed links give components. Where a key holds several components, the nodes outside its largest one meet
each other under the key, and they meet all of the largest component; signatures are compared block by block. So each
pair under a key is in one component or its distance is computed. Pairs within the distance give clusters, in
which the full sets of all nodes outside the largest component are compared with all others, again block by block:
each node is sent once for each block of the other side.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.expr import let
from loomgraph.operators.blocks import among, forest, in_blocks, runs
from loomgraph.operators.components import connected_components
from loomgraph.plans.shared import cut, join_counted

SHINGLE_WORDS = 5
#: Similarity as a whole number of percent.
PERCENT = 80
CHUNKS, CHUNK_BYTES = 22, 6
ALLOWED = 1
#: Two signatures this close must share a key: fewer than CHUNKS * (ALLOWED + 1) errors.
MOST_ERRORS = CHUNKS * (ALLOWED + 1) - 1
HASHES = CHUNKS * CHUNK_BYTES
#: Ids of involved texts are broadcast up to this number (8 bytes each), beyond it they are joined by shuffle.
BROADCAST_IDS = 500_000
#: Leads that a node is compared with first.
FIRST_LEADS = 4
#: Signatures and texts in a block, and cells of the matrices that two blocks are compared with at once.
BLOCK_NODES = 512
BLOCK_TEXTS = 256
BLOCK_CELLS = 1 << 21
#: Words whose hash a Python worker remembers.
REMEMBERED = 100_000
BLOCK_ROWS = 128


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


@lru_cache(maxsize=1)
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(3)
    return tuple(rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of ``size`` words; with fewer words, of all as one."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and white space of 9 to 13 and 32 only
    if not words:
        return np.zeros(0, np.uint64)
    known = word_hashes()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mixed(out + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """CHUNKS whole numbers of CHUNK_BYTES bytes: one byte of the smallest of each permutation's values."""
    a, b = multipliers()
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        low = np.minimum(low, mixed(shingles[at : at + 4096, None] * a[None, :] + b[None, :]).min(axis=0))
    places = (low >> np.uint64(17) & np.uint64(255)).reshape(CHUNKS, CHUNK_BYTES)
    return (places << (np.arange(CHUNK_BYTES, dtype=np.uint64) * np.uint64(8))).sum(axis=1).astype(np.int64)


def describe(docs: DataFrame, size: int) -> DataFrame:
    """Per document: doc_id, n_shingles, set_key (null for an empty set), text_key, signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for b in (batch.slice(at, BLOCK_ROWS) for at in range(0, batch.num_rows, BLOCK_ROWS)):
                sets = [shingle_set(t, size) for t in b.column("text").to_pylist()]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                signed = [signature(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(signed, schema.types[4])], schema=schema)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = plain.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return keyed.mapInArrow(run, "doc_id long, text_key long, n_shingles long, set_key binary, signature array<long>")


def keys_of(chunks: Column) -> Column:
    """All keys of a signature: each chunk with one of its bytes left out, hashed with the place."""
    masks = F.array(*[F.lit((1 << 8 * CHUNK_BYTES) - 1 ^ 255 << 8 * p).cast("long") for p in range(CHUNK_BYTES)])
    chunk = lambda j: F.get(chunks, F.floor(j / CHUNK_BYTES).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(HASHES - 1)), lambda j: F.xxhash64(j, chunk(j).bitwiseAND(F.get(masks, j % CHUNK_BYTES))))


def apart(a: Column, b: Column) -> Column:
    """For each chunk of two signatures: a number with one bit set, the highest, for each byte that differs."""
    low = sum(0x7F << 8 * p for p in range(CHUNK_BYTES))
    high = sum(0x80 << 8 * p for p in range(CHUNK_BYTES))

    def marks(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        return (d.bitwiseAND(F.lit(low).cast("long")) + F.lit(low).cast("long")).bitwiseOR(d).bitwiseAND(F.lit(high).cast("long"))

    return F.zip_with(a, b, marks)


def errors(marks: Column) -> Column:
    """Number of bytes that differ."""
    return sum((F.bit_count(F.get(marks, F.lit(c))) for c in range(1, CHUNKS)), F.bit_count(F.get(marks, F.lit(0))))


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(text_key, text) for the text keys in ``ids``."""
    texts = docs.select(F.col("text").cast("string").alias("text")).select("text", F.xxhash64("text").alias("text_key"))
    return join_counted(texts, ids, "text_key", "left_semi", BROADCAST_IDS).groupBy("text_key").agg(F.min("text").alias("text"))


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (src, dst) of text keys whose full shingle sets are similar enough."""
    texts = texts_of(cut(pairs.select(F.col("src").alias("text_key")).union(pairs.select("dst")).distinct()), docs)
    both = pairs.join(texts.select(F.col("text_key").alias("src"), F.col("text").alias("a")), "src").join(texts.select(F.col("text_key").alias("dst"), F.col("text").alias("b")), "dst")
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(batches):
        seen: dict[int, np.ndarray] = {}

        def set_of(key, column, i):
            if key not in seen:
                if len(seen) > 64:
                    seen.clear()
                seen[key] = shingle_set(column[i].as_py(), size)
            return seen[key]

        for batch in batches:
            src, dst = batch.column("src").to_pylist(), batch.column("dst").to_pylist()
            good = []
            for i, (x, y) in enumerate(zip(src, dst)):
                p, q = set_of(x, batch.column("a"), i), set_of(y, batch.column("b"), i)
                if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                    shared = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * shared >= percent * (len(p) + len(q) - shared):
                        good.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in (0, 1)], schema=schema)

    return both.select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def within_distance(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose signatures differ in at most MOST_ERRORS bytes."""
    signed = lambda end: nodes.select(F.col("node").alias(end), F.col("signature").alias(f"{end}_signature"))
    both = pairs.join(signed("src"), "src").join(signed("dst"), "dst")
    near = let(apart(F.col("src_signature"), F.col("dst_signature")), errors) <= MOST_ERRORS
    return both.where(near).select("src", "dst")


def nearest(candidates: DataFrame, k: int) -> DataFrame:
    """For each node the ``k`` pairs (src, dst) in which it shares most keys with the other end."""
    pair = F.struct(F.col("common"), F.xxhash64("src", "dst").alias("draw"), F.col("src"), F.col("dst"))
    each = candidates.select(F.explode(F.array(F.struct(F.col("src").alias("of"), pair.alias("p")), F.struct(F.col("dst").alias("of"), pair.alias("p")))).alias("x")).select("x.*")
    top = each.withColumn("place", F.row_number().over(Window.partitionBy("of").orderBy(F.desc("p")))).where(F.col("place") <= k)
    return top.select("p.src", "p.dst").distinct()


def near_forests(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (src, dst) of components with nodes within the signature distance; of each pair of blocks those that span all.

    ``rows`` come from ``in_blocks`` or ``among``.
    """
    rows = rows.join(nodes, "node")
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def run(batches):
        for group in runs(batches, ["place", "i", "j"]):
            bytes_of = np.array(group["signature"].tolist(), np.int64).view(np.uint8).reshape(len(group), -1)
            component = group["component"].to_numpy()
            left, right = (np.flatnonzero(group["few"].isna() | (group["few"] == few)) for few in (True, False))
            found = []
            step = max(1, BLOCK_CELLS * 8 // max(1, len(right) * bytes_of.shape[1]))
            for at in range(0, len(left), step):
                part = left[at : at + step]
                near = (bytes_of[part][:, None, :] != bytes_of[right][None, :, :]).sum(axis=2, dtype=np.int16) <= MOST_ERRORS
                near &= component[part][:, None] != component[right][None, :]
                x, y = np.nonzero(near)
                keep = forest(component[part[x]], component[right[y]])
                found.append((component[part[x[keep]]], component[right[y[keep]]]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found]), pa.int64()) for k in (0, 1)], schema=schema)

    dealt = rows.select("place", "i", "j", "few", "node", "component", "signature").repartition("place", "i", "j").sortWithinPartitions("place", "i", "j")
    return dealt.mapInArrow(run, "src long, dst long").distinct()


def link_components(nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, component) of the nodes, which are (node, signature); a node without links is its own component."""
    keys = nodes.select("node", F.explode(keys_of(F.col("signature"))).alias("key"))
    # the lowest node leads, and the lowest and highest after mixing with the key, which differ from key to key
    drawn = F.col("node").bitwiseXOR(F.col("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.min(drawn).alias("one"), F.max(drawn).alias("other")).where("n > 1")
    shared = cut(shared.select("key", "low", F.expr("one ^ key").alias("one"), F.expr("other ^ key").alias("other")))
    held = cut(keys.join(shared, "key"))
    tried = held.select("node", F.explode(F.array_distinct(F.array("low", "one", "other"))).alias("lead")).where("node <> lead")
    ends = tried.select(F.greatest("node", "lead").alias("src"), F.least("node", "lead").alias("dst"))
    candidates = ends.groupBy("src", "dst").agg(F.count("*").alias("common"))

    first = cut(within_distance(nearest(candidates, FIRST_LEADS), nodes))
    links = cut(confirmed(first, docs, size, percent))
    members = cut(nodes.select("node").join(connected_components(links).withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component")))

    # Keys with several components: all rows outside the largest one, as what is in it is one component already.
    placed = cut(held.select("node", "key").join(members, "node").select("key", "node", "component"))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    open_keys = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("n")).where("n > 1")
    open_keys = cut(open_keys.select("key", F.col("top.component").alias("largest")))
    outside = placed.join(open_keys, (placed["key"] == open_keys["key"]) & (placed["component"] != open_keys["largest"]))
    outside = cut(outside.select(placed["key"], "node", "component", "largest"))
    # They meet each other under their key, and the whole largest component once for all keys.
    several = outside.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p <> q").select("key")
    under_key = cut(outside.join(several, "key").select(F.col("key").alias("place"), "node", "component"))
    to_largest = cut(outside.select(F.col("largest").alias("place"), "node", "component").distinct())
    largest = members.join(to_largest.select(F.col("place").alias("component")).distinct(), "component").select(F.col("component").alias("place"), "node", "component")
    near = cut(near_forests(among(under_key, BLOCK_NODES).drop("own").unionByName(in_blocks(to_largest, largest, BLOCK_NODES)), nodes))

    # From here on components are the nodes of the graphs.
    clusters = connected_components(near).select(F.col("id").alias("component"), F.col("component").alias("cluster"))
    merged = connected_components(cut(compared(members.join(clusters, "component").select("node", "cluster", "component"), docs, size, percent)))
    last = merged.select(F.col("id").alias("component"), F.col("component").alias("last"))
    return members.join(last, "component", "left").select(F.col("node").alias("id"), F.coalesce("last", "component").alias("component"))


def compared(members: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (src, dst) of linked components of one cluster: all nodes outside its largest component against all its nodes.

    ``members`` is (node, cluster, component). Blocks are compared in one group for each pair of them.
    """
    members = cut(members)
    sizes = members.groupBy("cluster", "component").agg(F.count("*").alias("n"))  # clusters hold several components
    whole = sizes.groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("top")).select("cluster", F.col("top.component").alias("largest"))
    placed = cut(members.join(whole, "cluster").select(F.col("cluster").alias("place"), "node", "component", "largest"))
    every = placed.drop("largest")
    rows = in_blocks(placed.where("component <> largest").drop("largest"), every, BLOCK_TEXTS)
    ids = cut(placed.select(F.col("node").alias("text_key")))
    rows = rows.join(texts_of(ids, docs).withColumnRenamed("text_key", "node"), "node")

    def compare(group):
        import pandas as pd

        sets = [shingle_set(t, size) for t in group["text"]]
        component, is_few = group["component"].to_numpy(), group["few"].to_numpy()
        left, right = np.flatnonzero(is_few), np.flatnonzero(~is_few)
        if not len(left) or not len(right):
            return pd.DataFrame({"src": [], "dst": []}, dtype="int64")
        vocabulary = np.unique(np.concatenate([sets[k] for k in left]))
        known = [np.intersect1d(s, vocabulary, assume_unique=True) for s in sets]
        places = [np.searchsorted(vocabulary, s) for s in known]
        shared = np.zeros((len(left), len(right)), np.float64)
        step = max(256, BLOCK_CELLS // len(sets))
        for at in range(0, len(vocabulary), step):

            def dense(which):
                out = np.zeros((len(which), step), np.float32)
                for r, k in enumerate(which):
                    p = places[k]
                    out[r, p[np.searchsorted(p, at) : np.searchsorted(p, at + step)] - at] = 1
                return out

            shared += dense(left) @ dense(right).T
        n = np.array([len(s) for s in sets], np.float64)
        union = n[left][:, None] + n[right][None, :] - shared
        hit = (100 * shared >= percent * union) & (component[left][:, None] != component[right][None, :])
        x, y = np.nonzero(hit)
        keep = forest(component[left[x]], component[right[y]])
        return pd.DataFrame({"src": component[left[x[keep]]].astype("int64"), "dst": component[right[y[keep]]].astype("int64")})

    return rows.groupBy("place", "i", "j").applyInPandas(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, with_text_key: bool = False) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept``, and ``text_key`` (a hash of the text) if asked for.

    Words are lower-cased in A-Z and split at white space. Two documents are linked if 100 * shared >= percent * union
    of their shingle sets; ``component_id`` is the smallest doc_id that links lead to, and ``kept`` says that it is
    the document's own. Documents without words have an empty set and no links: they are their own component.
    Repeated rows and rows that repeat a doc_id are documents of their own; equal ids can both be kept. A null
    doc_id takes part in links: its component_id is null, and it is kept, if no linked document has an id.
    Other columns are ignored; an empty table gives no rows.
    """
    described = cut(describe(docs, shingle_words))
    filled = described.where("set_key is not null")
    nodes = filled.groupBy("set_key").agg(F.min("text_key").alias("node"), F.min("doc_id").alias("first_doc"), F.min_by("signature", "text_key").alias("signature"))
    nodes = cut(nodes)
    linked = link_components(nodes.select("node", "signature"), docs, shingle_words, percent)
    placed = cut(nodes.join(linked.withColumnRenamed("id", "node"), "node").select("set_key", "first_doc", "component"))
    # written before the join, so that Spark can split a large component's rows among tasks
    lowest = cut(placed.groupBy("component").agg(F.min("first_doc").alias("component_id")))
    sets = cut(placed.join(lowest, "component").select("set_key", "component_id"))
    key = ["text_key"] if with_text_key else []
    out = filled.select("doc_id", "n_shingles", "set_key", *key).join(sets, "set_key").select("doc_id", "n_shingles", "component_id", *key)
    empty = described.where("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *key)
    return out.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, in their own columns, with one of each group left: the one with the smallest id.

    Of rows with equal id and text one stays. Rows are told apart by a hash of id and text, so rows that repeat an id
    with another text go by themselves. Documents with a null doc_id stay if no linked document has an id.
    """
    name = "near_dup_row"
    while name in docs.columns:
        name += "_"
    row = lambda text_key: F.xxhash64(F.col("doc_id").cast("long"), text_key).alias(name)
    judged = cut(near_duplicates(docs, shingle_words, percent, with_text_key=True).select(row(F.col("text_key")), "kept"))
    counted = judged.groupBy(name).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    gone, twice = cut(counted.where("not kept").select(name)), cut(counted.where("kept and n > 1").select(name))
    left = join_counted(docs.withColumn(name, row(F.xxhash64(F.col("text").cast("string")))), gone, name, "left_anti", BROADCAST_IDS)
    single = join_counted(left, twice, name, "left_anti", BROADCAST_IDS)
    again = join_counted(left, twice, name, "left_semi", BROADCAST_IDS).dropDuplicates([name])
    return single.unionByName(again).select(docs.columns)
