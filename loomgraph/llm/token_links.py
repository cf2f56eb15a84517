"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

A text is cut into segments at single spaces between ordinary characters, and a segment into parts where a sign follows a
letter or a letter a line's end. Neither tokenizer joins characters across such a cut, so a text's tokens are those of its
segments in a row, and theirs those of their parts; a part is aligned once for as long as the task remembers it. The tokens
of a slice's new parts are laid out on one axis of bytes as two interval tables in DuckDB: ASOF joins find the first and the
last token of B that each token of A touches, a range join the ones between, and window sums over common ends number the
groups. A task counts in how many of its documents each linked pair of ids occurs; Spark merges these partial counts, and
every document's pairs are joined with the sums.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.packing import WRITTEN, tokenizer_at
from loomgraph.plans.shared import cut, ensure_checkpoint_dir, join_counted

#: Characters of texts, or of new segments, that a task looks at together.
SLICE_CHARS = 1 << 20
#: Segments (and parts), and their links, that a task remembers before it starts anew.
REMEMBERED = 300_000
REMEMBERED_TOKENS = 2_000_000
#: Counted pairs that a task holds before it merges or gives them out, and pairs in one row of partial counts.
HELD_PAIRS = 1_000_000
ROW_PAIRS = 8192
#: Pairs with their counts are broadcast up to this number (some 24 bytes each), beyond it they are joined by shuffle.
BROADCAST_PAIRS = 500_000

#: Characters that are no white space, control or other invisible sign for either tokenizer.
PLAIN = "[!-~\u00a1-\u00ac\u00ae-\u167f\u3001-\ufefe]"
CUT = re.compile(f" (?<={PLAIN} )(?={PLAIN})")
#: Such characters at both ends.
PLAIN_ENDS = re.compile(f"{PLAIN}(?:.*{PLAIN})?", re.DOTALL)
#: Latin letters, which both tokenizers hold for letters.
LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017E"
#: Between parts and between segments: characters that no text in UTF-8 has.
NEXT_PART, NEXT_SEGMENT = "\ud800", "\ud801"
#: New parts that tokenizer A gets in one text.
JOINED = 64

LINKS = pa.schema(
    [
        ("row_id", pa.int64()),
        ("doc_id", pa.int64()),
        *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
        ("groups_sha256", pa.string()),
        ("groups", pa.string()),
        ("pairs", pa.list_(pa.int64())),
        ("times", pa.list_(pa.int32())),
    ]
)
LINKS_DDL = "row_id long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<long>, times array<int>"

#: The number of each token's group: the ends that both have before it.
GROUPS_SQL = """
SELECT n, count(ends.e) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g
FROM {own} own LEFT JOIN (SELECT a.e FROM a SEMI JOIN b ON a.e = b.e) ends ON own.e = ends.e ORDER BY n
"""
LINKS_SQL = """
WITH touched AS (SELECT a.seg, a.id, lo.n AS first, hi.n AS last FROM a ASOF JOIN b lo ON a.s >= lo.s ASOF JOIN b hi ON a.e > hi.s)
SELECT t.seg, (t.id << 32) | b.id AS pair FROM touched t JOIN b ON b.n BETWEEN t.first AND t.last ORDER BY t.seg
"""
#: What follows an id in a written group: another of its side, the other side, another group, nothing.
MARKS = (",", "|", ";", "")


@lru_cache(maxsize=1)
def vocabularies(a_path: str, b_path: str):
    """Tokenizer A with its tokens' bytes, and the same of B."""
    import sentencepiece

    a = tokenizer_at(a_path)
    a.encode_special_tokens = True  # their strings in a text are ordinary text
    back = {ord(c): b for b, c in WRITTEN.items()}
    a_bytes = [(a.id_to_token(i) or "").translate(back).encode("latin-1") for i in range(a.get_vocab_size())]
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(b.id_to_piece(list(range(b.get_piece_size()))))]
    return a, a_bytes, b, b_bytes


@lru_cache(maxsize=1)
def part_cuts(a_path: str, b_path: str) -> list[tuple[re.Pattern, str]]:
    """Where segments are cut into parts, as patterns and what replaces them; none if these vocabularies don't allow it.

    A's pattern begins anew at a sign after a letter and at a letter after a single line's end, and B merges pieces only. A cut
    is made only where no token of either vocabulary has the two characters side by side, and at a line's end if A adds no
    space of its own, and B gives its tokens apart from what follows.
    """
    a, a_bytes, b, b_bytes = vocabularies(a_path, b_path)
    tokens = "\0".join(t.decode(errors="replace") for t in chain(a_bytes, b_bytes))
    adds_nothing = b"".join(a_bytes[i] for i in a.encode("x", add_special_tokens=False).ids) == b"x"
    if not adds_nothing or b"".join(b_bytes[i] for i in b.encode("\n")) != b" \n" or re.search(f"\n[{LETTERS}\ufffd{re.escape(punctuation)}]", tokens):
        return []
    joined = set(re.findall(f"(?<=[{LETTERS}\ufffd])[{re.escape(punctuation)}]", tokens))
    signs = re.escape("".join(c for c in punctuation if c not in joined))
    after_letters = [(re.compile(f"[{signs}](?<=[{LETTERS}].)"), rf"{NEXT_PART}\g<0>")] if signs else []
    return [*after_letters, (re.compile(f"\n(?<=[!-~]\n)(?=[{LETTERS}])"), f"\n{NEXT_PART}")]


def segmented(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """What CUT makes of the texts: different segments, each text's segments by their places there, all in a row, and where each text's end.

    Arrow splits at all spaces; texts with a space elsewhere than between ordinary characters are cut again.
    """
    split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    words = split.values.dictionary_encode()
    strings, codes, ends = words.dictionary, words.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().astype(np.int64)
    first, last = (pc.match_substring_regex(strings, x).to_numpy(zero_copy_only=False) for x in (f"^{PLAIN}", f"{PLAIN}\\z"))
    odd = np.append(~(last[codes[:-1]] & first[codes[1:]]), False)  # the space behind a word
    odd[ends[1:] - 1] = False
    other = np.flatnonzero(np.logical_or.reduceat(odd, ends[:-1]) | [not t for t in texts])
    plain = strings.to_numpy(zero_copy_only=False).tolist()
    if not len(other):
        return plain, codes, ends[1:]
    again = {k: CUT.split(texts[k]) if texts[k] else [] for k in other.tolist()}
    different: dict[str, int] = {}
    rows = [again[k] if k in again else list(map(plain.__getitem__, codes[ends[k] : ends[k + 1]].tolist())) for k in range(len(texts))]
    codes = np.array([different.setdefault(s, len(different)) for r in rows for s in r], np.int64)
    return list(different), codes, np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))


def gives_back(ids: np.ndarray, counts: np.ndarray, tokens: list[bytes], texts: list[bytes]) -> np.ndarray:
    """Whether the tokens' bytes are the text's, for each text; ``counts`` has the number of each one's tokens."""
    found = list(map(tokens.__getitem__, ids.tolist()))
    ends = np.cumsum(counts)
    before = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
    if (np.diff(before[np.concatenate([[0], ends])]) == list(map(len, texts))).all() and b"".join(found) == b"".join(texts):
        return np.ones(len(texts), bool)
    return np.array([b"".join(found[e - n : e]) == t for n, e, t in zip(counts.tolist(), ends.tolist(), texts)])


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and how many each text has."""
    return np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))


def intervals(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> pa.Table:
    """(n, seg, id, s, e): the tokens of all parts in a row, from byte s to e of one axis."""
    ends = np.cumsum(lengths[ids])
    return pa.table({"n": np.arange(len(ids)), "seg": np.repeat(np.arange(len(counts)), counts), "id": ids, "s": ends - lengths[ids], "e": ends})


def written_groups(a: pa.Table, b: pa.Table, a_group: np.ndarray, b_group: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of the parts that have tokens, and their groups as text; ``marked`` has every id with each of MARKS."""
    side = np.repeat([0, 1], [len(a_group), len(b_group)])
    group, seg = np.concatenate([a_group, b_group]), np.concatenate([a["seg"].to_numpy(), b["seg"].to_numpy()])
    # a token stands behind all of its side before it, and all of the other side's in groups before (for B: up to) its own
    order = np.empty(len(side), np.int64)
    order[np.arange(len(a_group)) + np.searchsorted(b_group, a_group, "left")] = np.arange(len(a_group))
    order[np.arange(len(b_group)) + np.searchsorted(a_group, b_group, "right")] = np.arange(len(b_group)) + len(a_group)
    side, group, seg = side[order], group[order], seg[order]
    same = lambda x: np.append(x[1:] == x[:-1], False)
    mark = np.where(same(group), np.where(same(side), 0, 1), np.where(same(seg), 2, 3))
    pieces = marked[np.concatenate([a["id"].to_numpy(), b["id"].to_numpy()])[order], mark].tolist()
    last = np.flatnonzero(mark == 3)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))[last].tolist()
    text = b"".join(pieces)
    return seg[last], [text[s:e] for s, e in zip([0, *ends], ends)]


class Known:
    """Alignments of the strings met so far; ``place`` has each one's number."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.sizes = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links
        self.whole = np.zeros(0, bool)  # both tokenizers' bytes are the string's
        self.pairs = np.zeros(0, np.int64)
        self.ends = np.zeros(1, np.int64)

    def full(self) -> bool:
        return len(self.place) > REMEMBERED or len(self.pairs) > REMEMBERED_TOKENS

    def add(self, new: list[str], groups: list[bytes], sizes: np.ndarray, whole: np.ndarray, pairs: np.ndarray) -> None:
        self.place.update(zip(new, range(len(self.groups), len(self.groups) + len(new))))
        self.groups += groups
        self.sizes = np.concatenate([self.sizes, sizes])
        self.whole = np.concatenate([self.whole, whole])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes[:, 3])])
        self.pairs = np.concatenate([self.pairs, pairs])

    def numbers(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, strings), np.int64, len(strings))

    def links(self, at: np.ndarray) -> np.ndarray:
        """The pairs of all these strings in a row."""
        n = self.sizes[at, 3]
        starts = self.ends[at] - np.concatenate([[0], np.cumsum(n)[:-1]])
        return self.pairs[np.repeat(starts, n) + np.arange(n.sum())]


class Segments(Known):
    """Alignments of the segments met so far, put together from those of their ``parts``."""

    def __init__(self, a_path: str, b_path: str):
        import duckdb

        super().__init__()
        self.parts = Known()
        self.a, self.a_bytes, self.b, self.b_bytes = vocabularies(a_path, b_path)
        self.cuts = part_cuts(a_path, b_path)
        ids = range(max(len(self.a_bytes), len(self.b_bytes)))
        self.marked = np.array([[f"{i}{m}".encode() for m in MARKS] for i in ids], object)
        self.a_lengths, self.b_lengths = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.duck = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": f"{tempfile.gettempdir()}/spilled-{uuid.uuid4().hex}"})

    def forget(self) -> None:
        """All segments; their parts are kept until there are too many."""
        super().__init__()

    def learn(self, segments: Iterable[str]) -> None:
        new, chars = [], 0
        for s in segments:
            if s in self.place:
                continue
            new.append(s)
            chars += len(s)
            if chars > SLICE_CHARS:
                self._put_together(new)
                new, chars = [], 0
        if new:
            self._put_together(new)

    def _put_together(self, new: list[str]) -> None:
        if self.parts.full():
            self.parts = Known()
        parts = " " + f"{NEXT_SEGMENT} ".join(new)
        for where, instead in self.cuts:
            parts = where.sub(instead, parts)
        counts = np.fromiter((s.count(NEXT_PART) + 1 for s in parts.split(NEXT_SEGMENT)), np.int64, len(new))
        every = parts.replace(NEXT_SEGMENT, NEXT_PART).split(NEXT_PART)
        if unknown := list(set(every) - self.parts.place.keys()):
            self._align(unknown)
        at = self.parts.numbers(every)
        starts = np.cumsum(counts) - counts
        found = list(map(self.parts.groups.__getitem__, at.tolist()))
        groups = [found[k] if n == 1 else b";".join(found[k : k + n]) for k, n in zip(starts.tolist(), counts.tolist())]
        self.add(new, groups, np.add.reduceat(self.parts.sizes[at], starts), np.logical_and.reduceat(self.parts.whole[at], starts), self.parts.links(at))

    def _a_ids(self, plain: list[str], other: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all these parts; the plain ones begin with a space, so that they are encoded many at a time."""
        alone = lambda texts: [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        own = [p.encode() for p in plain]
        ids, _ = flat(alone(["".join(plain[k : k + JOINED]) for k in range(0, len(plain), JOINED)]))
        ends, own_ends = np.cumsum(self.a_lengths[ids]), np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))
        at = np.searchsorted(ends, own_ends)
        if len(own) and not (ends[-1] == own_ends[-1] and (ends[at] == own_ends).all() and b"".join(map(self.a_bytes.__getitem__, ids.tolist())) == b"".join(own)):
            return flat(alone(plain + other))
        rest, counts = flat(alone(other))
        return np.concatenate([ids, rest]), np.concatenate([np.diff(at, prepend=-1), counts])

    def _b_ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """B's ids of all these parts; those without a space are encoded behind a line's end, whose own ids are left out."""
        ids = self.b.encode([p[1:] if p[0] == " " else f"\n{p}" for p in parts], num_threads=1)
        lead = len(self.b.encode("\n"))
        return flat([x if p[0] == " " else x[lead:] for p, x in zip(parts, ids)])

    def _align(self, new: list[str]) -> None:
        plain = [p for p in new if p[0] == " " and PLAIN_ENDS.fullmatch(p, 1)]
        other = list(set(new).difference(plain))
        new = plain + other
        own = [p.encode() for p in new]
        (a_ids, a_counts), (b_ids, b_counts) = self._a_ids(plain, other), self._b_ids(new)
        whole = gives_back(a_ids, a_counts, self.a_bytes, own) & gives_back(b_ids, b_counts, self.b_bytes, own)
        if not whole.all():
            a_ids, b_ids = a_ids[np.repeat(whole, a_counts)], b_ids[np.repeat(whole, b_counts)]
            a_counts, b_counts = a_counts * whole, b_counts * whole
        sizes = np.zeros((len(new), 4), np.int64)
        groups = [b""] * len(new)
        sizes[:, 0], sizes[:, 1] = a_counts, b_counts
        pairs = np.zeros(0, np.int64)
        if whole.any():
            a, b = intervals(a_ids, a_counts, self.a_lengths), intervals(b_ids, b_counts, self.b_lengths)
            self.duck.register("a", a)
            self.duck.register("b", b)
            a_group, b_group = (self.duck.sql(GROUPS_SQL.format(own=x)).to_arrow_table()["g"].to_numpy() for x in "ab")
            sizes[:, 2] = np.bincount(a["seg"].to_numpy()[np.flatnonzero(np.diff(a_group, prepend=-1))], minlength=len(new))
            for k, g in zip(*written_groups(a, b, a_group, b_group, self.marked)):
                groups[k] = g
            found = self.duck.sql(LINKS_SQL).to_arrow_table()
            pairs = found["pair"].to_numpy()
            sizes[:, 3] = np.bincount(found["seg"].to_numpy(), minlength=len(new))
        self.parts.add(new, groups, sizes, whole, pairs)

    def row(self, segments: list[str], with_groups: bool) -> tuple | None:
        return self.row_of(self.numbers(segments), with_groups)

    def row_of(self, at: np.ndarray, with_groups: bool) -> tuple | None:
        """Sizes, digest, groups, and the different pairs with how often each is linked; None without tokens."""
        if not len(at) or not self.whole[at].all():
            return None
        groups = b";".join(map(self.groups.__getitem__, at.tolist()))
        pairs, times = np.unique(self.links(at), return_counts=True)
        return self.sizes[at].sum(axis=0).tolist(), hashlib.sha256(groups).hexdigest(), groups.decode() if with_groups else None, pairs, times.astype(np.int32)


class PartialCounts:
    """How many documents of a task hold each pair; merged whenever HELD_PAIRS are held, so the space is bounded."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, pairs: np.ndarray) -> None:
        self.keys.append(pairs)
        self.counts.append(np.ones(len(pairs), np.int64))
        self.held += len(pairs)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([np.zeros(0, np.int64), *self.keys]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([np.zeros(0, np.int64), *self.counts]), minlength=len(keys)).astype(np.int64)
        self.keys, self.counts, self.held = [keys], [counts], len(keys)
        return keys, counts

    def rows(self) -> pa.RecordBatch:
        """All counts as rows without row_id, and none held any more."""
        keys, counts = self.merged()
        self.__init__()
        parts = [slice(k, k + ROW_PAIRS) for k in range(0, len(keys), ROW_PAIRS)]
        columns = {"pairs": [keys[p] for p in parts], "times": [counts[p].astype(np.int32) for p in parts]}
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * len(parts)), f.type) for f in LINKS], schema=LINKS)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of up to SLICE_CHARS characters, or of one longer text."""
    ids, texts, chars = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            ids.append(doc_id.as_py())
            texts.append(text.as_py() or "")
            chars += len(texts[-1])
            if chars > SLICE_CHARS:
                yield ids, texts
                ids, texts, chars = [], [], 0
    if ids:
        yield ids, texts


def linked(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """Links of each document, written to the shared folder: a row for each document, and rows of partial counts.

    A document's row has a ``row_id`` and its different ``pairs`` (A's id in the upper half of a long, B's in the lower) with
    the ``times`` each is linked. Rows without ``row_id`` say how many documents of a task hold each pair.
    """

    def run(batches):
        known, counts = Segments(a_path, b_path), PartialCounts()
        row_id = TaskContext.get().partitionId() << 33
        for ids, texts in slices(batches):
            if known.full():
                known.forget()
            segments, codes, ends = segmented(texts)
            known.learn(segments)
            at = known.numbers(segments)[codes]
            columns: list[list] = [[] for _ in LINKS]
            for doc_id, own in zip(ids, np.split(at, ends[:-1])):
                found = known.row_of(own, with_groups)
                sizes, sha, groups, pairs, times = found or ([0] * 4, "", "" if with_groups else None, np.zeros(0, np.int64), np.zeros(0, np.int32))
                if found:
                    counts.add(pairs)
                for c, x in zip(columns, (row_id, doc_id, *sizes, sha, groups, pairs, times)):
                    c.append(x)
                row_id += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, LINKS)], schema=LINKS)
            if counts.held > HELD_PAIRS and len(counts.merged()[0]) > HELD_PAIRS // 2:
                yield counts.rows()
        yield counts.rows()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/token-links-{uuid.uuid4().hex}"
    plain.mapInArrow(run, LINKS_DDL).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(LINKS_DDL).parquet(folder)


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, n_docs, best): in how many documents ids are linked, and whether no id of B has more with A's id.

    The windows hold the partners of one id, at most as many as the other vocabulary has.
    """
    partial = links.where("row_id is null").select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("n"))))
    summed = partial.groupBy("pair").agg(F.sum("n").alias("n_docs"))
    ids = summed.select("pair", F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b_id"), "n_docs")
    return ids.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a_id")))


def align(docs: DataFrame, a_path: str, b_path: str, with_groups: bool = False, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, and ``groups`` if asked for.

    A encodes a space and the text, B the text, which adds the space. Texts that are null or empty, or whose bytes either
    tokenizer doesn't give back, have no tokens: zeros, and an empty digest. Links are all pairs of tokens that share a byte;
    ``n_best`` counts those whose pair of ids occurs in as many documents as any of A's id, ``count_sum`` adds up
    the pairs' numbers of documents. Repeated rows and rows without id are documents of their own; other
    columns are ignored; an empty table gives no rows.
    """
    links = linked(docs, a_path, b_path, with_groups)
    counts = cut(pair_counts(links).select("pair", "n_docs", "best"))
    own = links.where("row_id is not null")
    each = own.select("row_id", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("n"))))
    summed = (
        join_counted(each, counts, "pair", "inner", broadcast_pairs)
        .groupBy("row_id")
        .agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("n_docs")).alias("count_sum"))
    )
    sizes = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return (
        own.select("row_id", *sizes, "groups_sha256", *(["groups"] if with_groups else []))
        .join(summed, "row_id", "left")
        .select(*sizes, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256", *(["groups"] if with_groups else []))
    )
