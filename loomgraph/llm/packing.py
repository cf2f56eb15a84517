"""Best-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised where they are read; only ids and lengths of the pieces are shuffled. Pieces are dealt out
by a hash and put in a fixed order, and every task packs its share online into a fixed number of open bins. The
free space of the open bins is kept in one integer used as a bitset, so the tightest bin that still fits is found
with two bit operations. A task takes LOOK_AHEAD pieces at a time, longest first. If all bins are open and none fits, the fullest one is closed for the new one.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
OPEN_BINS = 1024
END_ID = 0
#: Pieces that a task looks at together, longest first.
LOOK_AHEAD = 1024
#: Texts tokenised at once in a task, in characters.
SLICE_CHARS = 1 << 20
#: Words whose ids a task remembers.
REMEMBERED = 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


@lru_cache(maxsize=2)
def tokenizer_at(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Byte-level vocabularies write the bytes that don't print as the characters from 256 on, in order.
UNPRINTED = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
WRITTEN = {b: chr(256 + i) for i, b in enumerate(UNPRINTED)}
#: A word in Latin letters, each with one lower-case form, and the signs after it.
LATIN_WORD = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0132-\u0148\u014A-\u017E]+)([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{|}~]*)")


class WordIds(dict):
    """Ids, as little-endian bytes, of the parts of a text between spaces and line ends.

    The tokenizer never joins characters across white space, which it drops, so a text's ids are those of its parts
    in a row. It lowers case and never joins a letter and a sign, so a part of Latin letters and then ASCII signs
    has the ids of its lower-cased letters, which the merges alone give, and then those of the signs.
    At most REMEMBERED parts are kept twice over: those in use, and those in use before.
    """

    def __init__(self, tokenizer):
        super().__init__()
        self.encode = lambda part: tokenizer.encode(part, add_special_tokens=False).ids
        self.merge = tokenizer.model.tokenize
        self.before: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        if part in self.before:
            ids = self.before[part]
        elif m := LATIN_WORD.fullmatch(part):
            letters, signs = m[1].lower(), m[2]
            if signs or letters != part:
                ids = self[letters] + (self[signs] if signs else b"")
            else:
                ids = array("I", [t.id for t in self.merge(part.encode().decode("latin-1").translate(WRITTEN))]).tobytes()
        else:
            ids = array("I", self.encode(part)).tobytes()
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        self[part] = ids
        return ids


@lru_cache(maxsize=1)
def words_known(path: str) -> WordIds:
    """What this Python worker has learned, for all its tasks."""
    return WordIds(tokenizer_at(path))


def ids_of(texts: list[str | None], known: WordIds) -> Iterator[bytes]:
    """The ids of each text and END_ID, four bytes each."""
    end = array("I", [END_ID]).tobytes()
    for t in texts:
        yield b"".join(map(known.__getitem__, (t or "").replace("\n", " ").split(" "))) + end


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``doc_id, piece, start, length, ids_crc32``, and ``ids`` if asked for.

    A document is its text's ids and END_ID; only longer ones are cut, and then every ``capacity`` tokens. A
    null text is like an empty one: END_ID alone. Repeated rows and null ids give pieces of their own; other
    columns are ignored; an empty table gives no pieces.
    """
    names = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(names + [("ids", pa.binary())] * with_ids)

    def rows(ids: list, texts: list, known: WordIds) -> pa.RecordBatch:
        columns: list[list] = [[] for _ in schema.names]
        for doc_id, data in zip(ids, ids_of(texts, known)):
            for k, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                for c, x in zip(columns, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part)):
                    c.append(x)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    def run(batches):
        known = words_known(tokenizer_path)
        for batch in batches:
            ids, texts, chars = [], [], 0
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                chars += len(texts[-1] or "")
                if chars > SLICE_CHARS:
                    yield rows(ids, texts, known)
                    ids, texts, chars = [], [], 0
            if ids:
                yield rows(ids, texts, known)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, PIECES + ", ids binary" * with_ids)


class OpenBins:
    """At most ``most`` open bins of ``capacity``; ``put`` gives (bin, offset)."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made = 0, 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.open == self.most:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self._take(fullest)
            space, bin_ = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:
            self.by_space[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.capacity - space

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        bin_ = bins.pop()
        if not bins:
            self.bits &= ~(1 << space)
        self.open -= 1
        return bin_


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (columns of ``token_pieces`` without ids).

    Every piece lies whole in one sequence, sequences are filled from 0 without gaps, and none exceeds
    ``capacity``. The order of a task's pieces is fixed by hash and all columns, so a task that runs again packs
    the same way; equal pieces can stand for one another.
    """
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.withColumn("order", order).repartition("order").sortWithinPartitions("order", "doc_id", "piece", "start", "length", "ids_crc32")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        bins, first = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in (b.slice(at, LOOK_AHEAD) for b in batches for at in range(0, b.num_rows, LOOK_AHEAD)):
            batch = batch.sort_by([("length", "descending")])
            places = [bins.put(n) for n in batch.column("length").to_pylist()]
            columns = [batch.column(c) for c in schema.names[:5]]
            columns += [pa.array([first + b for b, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return dealt.drop("order").mapInArrow(run, PACKED)
