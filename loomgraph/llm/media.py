"""Media columns: texts stored as AVI motion-JPEG, read back, and cut into timed clips.

A payload is stored as 8-bit samples in grey frames of 64 x 16, each a lossless JPEG (process SOF3, predictor 1, a
restart after every line) in a RIFF AVI file with an ``idx1`` index. The reader walks the RIFF chunks, takes the
frames from the index, and decodes the lines of many frames in step: one pass over a batch for each sample of a
line. Shots are cut where the histogram difference of two frames exceeds what the differences just before lead to
expect. All work is on one row at a time or on slices of bounded size; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT, FPS = 64, 16, 25
FRAME = WIDTH * HEIGHT
BLOCK = 64
#: Payload bytes handled at once in a task.
SLICE_BYTES = 1 << 20

# A Huffman table for difference categories 0 to 8 by code length (3, 4 and 5 bits).
CODE_COUNTS = (0, 0, 7, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
CODE_VALUES = (4, 3, 7, 5, 2, 6, 1, 0, 8)

HISTOGRAM_BINS = 32
WINDOW = 8
DEVIATIONS = 3.0
LEAST_DIFFERENCE = 0.12

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, "
    "clips array<struct<clip:int,first_frame:int,last_frame:int,start_s:double,end_s:double,level:double>>"
)


def canonical_codes(counts, values) -> list[tuple[int, int, int]]:
    """(value, code, length) of a JPEG Huffman table."""
    out, code, at = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((values[at], code, length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(maxsize=8)
def decode_table(counts: tuple, values: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit prefix: the category and the length of its code."""
    kind, length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for value, code, n in canonical_codes(counts, values):
        kind[code << (16 - n) : (code + 1) << (16 - n)] = value
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
    return kind, length


@lru_cache(maxsize=1)
def encode_tables() -> tuple[np.ndarray, np.ndarray]:
    """Bits and number of bits for each difference -255 .. 255."""
    codes = {value: (code, n) for value, code, n in canonical_codes(CODE_COUNTS, CODE_VALUES)}
    bits, size = np.zeros(511, np.uint64), np.zeros(511, np.uint64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, n = codes[s]
        bits[d + 255] = (code << s) | ((d if d > 0 else d + (1 << s) - 1) if s else 0)
        size[d + 255] = n + s
    return bits, size


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=1)
def frame_header() -> bytes:
    """Everything of a frame before its lines."""
    return (
        b"\xff\xd8"
        + _segment(0xC4, bytes([0, *CODE_COUNTS, *CODE_VALUES]))
        + _segment(0xC3, struct.pack(">BHHBBBB", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0))
        + _segment(0xDD, struct.pack(">H", WIDTH))
        + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
    )


def encode_lines(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines (n x WIDTH) as entropy-coded bytes, each followed by its marker; and where each line ends."""
    bits, size = encode_tables()
    wide = samples.astype(np.int16)
    d = np.diff(wide, axis=1, prepend=np.int16(128)) + 255
    v, n = bits[d], size[d]
    for _ in range(2):  # four samples of at most 13 bits fit a word
        v, n = (v[:, 0::2] << n[:, 1::2]) | v[:, 1::2], n[:, 0::2] + n[:, 1::2]
    ends = np.cumsum(n, axis=1, dtype=np.uint64)
    total = ends[:, -1]
    rows, words = np.arange(len(samples)), np.zeros((len(samples), WIDTH * 13 // 64 + 2), np.uint64)
    for k in range(v.shape[1]):
        start = ends[:, k] - n[:, k]
        word, room = (start >> np.uint64(6)).astype(np.intp), np.uint64(64) - (start & np.uint64(63))
        fits = n[:, k] <= room
        words[rows, word] |= np.where(fits, v[:, k] << (room - np.where(fits, n[:, k], room)), v[:, k] >> (np.where(fits, room, n[:, k]) - room))
        over = np.flatnonzero(~fits)
        if len(over):
            words[over, word[over] + 1] |= v[over, k] << (np.uint64(64) - (n[over, k] - room[over]))
    data = words.byteswap().view(np.uint8)
    length = ((total + np.uint64(7)) >> np.uint64(3)).astype(np.intp)
    data[rows, length - 1] |= ((1 << ((-total.astype(np.int64)) % 8)) - 1).astype(np.uint8)
    flat = data[np.arange(data.shape[1])[None, :] < length[:, None]]
    # a zero after each 255, and two bytes for a marker after each line
    width = 1 + (flat == 255)
    last = np.cumsum(length) - 1
    width[last] += 2
    at = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    out[at] = flat
    line_end = at[last] + width[last]
    out[line_end - 2] = 0xFF
    k = rows % HEIGHT
    out[line_end - 1] = np.where(k == HEIGHT - 1, 0xD9, 0xD0 + k % 8)
    return out, line_end


def avi_file(frames: list[bytes], payload_bytes: int) -> bytes:
    """A RIFF AVI file of JPEG frames; chunk ``plen`` holds how many samples are payload."""
    chunk = lambda name, body: struct.pack("<4sI", name, len(body)) + body + b"\0" * (len(body) % 2)
    listed = lambda name, body: chunk(b"LIST", name + body)
    n = len(frames)
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, 0, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, 0, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    header = listed(b"hdrl", chunk(b"avih", avih) + listed(b"strl", chunk(b"strh", strh) + chunk(b"strf", strf)))
    movi, index, at = [], [], 4
    for f in frames:
        body = chunk(b"00dc", f)
        movi.append(body)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(body)
    rest = header + chunk(b"plen", struct.pack("<Q", payload_bytes)) + listed(b"movi", b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return struct.pack("<4sI4s", b"RIFF", len(rest) + 4, b"AVI ") + rest


def encode_videos(payloads: list[bytes]) -> list[bytes]:
    """One AVI file for each payload."""
    counts = [max(1, -(-len(p) // FRAME)) for p in payloads]
    samples = np.frombuffer(b"".join(p.ljust(c * FRAME, b"\0") for p, c in zip(payloads, counts)), np.uint8)
    stream, ends = encode_lines(samples.reshape(-1, WIDTH))
    stream, frame_end = stream.tobytes(), ends[HEIGHT - 1 :: HEIGHT].tolist()
    head, out, at, start = frame_header(), [], 0, 0
    for p, c in zip(payloads, counts):
        frames = []
        for end in frame_end[at : at + c]:
            frames.append(head + stream[start:end])
            start = end
        out.append(avi_file(frames, len(p)))
        at += c
    return out


def riff_chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks in a range; lists are named by their type."""
    while start + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, start)
        body = start + 8
        yield (data[body : body + 4], body + 4, body + size) if name in (b"LIST", b"RIFF") else (name, body, body + size)
        start = body + size + size % 2


def index_frames(data: bytes) -> tuple[list[tuple[int, int]], int]:
    """Places of the frames by the file's index, and how many samples are payload."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    top = {name: (a, b) for name, a, b in riff_chunks(data, 12, len(data))}
    movi = top[b"movi"][0] - 4
    a, b = top[b"idx1"]
    frames = [(movi + at + 8, movi + at + 8 + size) for name, _, at, size in struct.iter_unpack("<4sIII", data[a:b]) if name == b"00dc"]
    return frames, struct.unpack_from("<Q", data, top[b"plen"][0])[0]


@lru_cache(maxsize=64)
def parse_header(head: bytes) -> tuple[tuple, tuple]:
    """(Huffman counts, Huffman values) of a frame header; only frames as written here can be decoded."""
    counts = values = None
    at, seen = 2, {}
    while at < len(head):
        marker, size = struct.unpack_from(">xBH", head, at)
        seen[marker] = body = head[at + 4 : at + 2 + size]
        if marker == 0xC4:
            counts = tuple(body[1:17])
            values = tuple(body[17 : 17 + sum(counts)])
        at += 2 + size
    if 0xC3 not in seen or struct.unpack_from(">BHHB", seen[0xC3]) != (8, HEIGHT, WIDTH, 1) or seen.get(0xDD) != struct.pack(">H", WIDTH) or seen[0xDA][3] != 1:
        raise ValueError("only grey lossless frames of this size, with predictor 1 and a restart for each line, can be decoded")
    return counts, values


def header_end(data: bytes, start: int) -> int:
    """Where the entropy-coded data of the frame at ``start`` begins."""
    at = start + 2
    while True:
        marker, size = struct.unpack_from(">xBH", data, at)
        at += 2 + size
        if marker == 0xDA:
            return at


def decode_lines(scan: np.ndarray, counts: tuple, values: tuple) -> np.ndarray:
    """Samples (lines x WIDTH) of concatenated scans, all lines in step."""
    kind, length = decode_table(counts, values)
    after = np.empty(len(scan), np.uint8)
    after[:-1], after[-1] = scan[1:], 0
    full = scan == 255
    marker = full & (after != 0)
    keep = np.ones(len(scan), bool)
    keep[1:] = ~(full[:-1] & (scan[1:] == 0))
    place = np.cumsum(keep) - 1
    ends = place[np.flatnonzero(marker)]
    starts = np.concatenate([[0], ends[:-1] + 2])
    b = np.concatenate([scan[keep], np.zeros(8, np.uint8)]).astype(np.uint32)
    window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    bit = (starts * 8).astype(np.int64)
    out = np.empty((WIDTH, len(starts)), np.uint8)
    value = np.full(len(starts), 128, np.int32)
    for k in range(WIDTH):
        w = window[bit >> 3] << (bit & 7).astype(np.uint32)
        top = w >> np.uint32(16)
        s, n = kind[top].astype(np.uint32), length[top].astype(np.uint32)
        extra = ((w << n) >> (np.uint32(31) - s) >> np.uint32(1)).astype(np.int32)
        # a first extra bit of 0 marks a negative difference
        negative = (extra >> np.maximum(s.astype(np.int32) - 1, 0)) == 0
        value += extra - np.where(negative, (np.int32(1) << s.astype(np.int32)) - 1, 0).astype(np.int32)
        out[k] = value
        bit += s + n
    return out.T


def decode_videos(files: list[bytes]) -> list[tuple[np.ndarray, int]]:
    """(frames x FRAME samples, payload bytes) of each file."""
    scans: dict[tuple, list[bytes]] = {}
    places: list[tuple[list, int]] = []
    for data in files:
        frames, n = index_frames(data)
        own = []
        for start, end in frames:
            body = header_end(data, start)
            tables = parse_header(data[start:body])
            group = scans.setdefault(tables, [])
            own.append((tables, len(group)))
            group.append(data[body:end])
        places.append((own, n))
    decoded = {t: decode_lines(np.frombuffer(b"".join(parts), np.uint8), *t).reshape(-1, FRAME) for t, parts in scans.items()}
    return [(np.stack([decoded[t][i] for t, i in own]), n) for own, n in places]


def find_clips(frames: np.ndarray, payload_bytes: int) -> list[dict]:
    """Timed clips of one video.

    A clip ends before frame i if half the absolute difference of its histogram to the one before exceeds both
    LEAST_DIFFERENCE and the mean plus DEVIATIONS standard deviations of the last WINDOW differences. Samples after
    the payload are left out.
    """
    n = len(frames)
    used = np.clip(payload_bytes - np.arange(n) * FRAME, 0, FRAME)
    real = np.arange(FRAME)[None, :] < used[:, None]
    bins = (frames >> 3) + np.arange(n)[:, None] * HISTOGRAM_BINS
    h = np.bincount(bins[real], minlength=n * HISTOGRAM_BINS).reshape(n, HISTOGRAM_BINS) / np.maximum(used, 1)[:, None]
    d = np.abs(np.diff(h, axis=0)).sum(axis=1) / 2
    i = np.arange(len(d))
    first = np.maximum(i - WINDOW, 0)
    sums, squares = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    m = np.maximum(i - first, 1)
    mean = (sums[i] - sums[first]) / m
    spread = np.sqrt(np.maximum((squares[i] - squares[first]) / m - mean * mean, 0))
    cuts = np.flatnonzero(d > np.maximum(LEAST_DIFFERENCE, mean + DEVIATIONS * spread)) + 1
    level = np.where(real, frames, 0).sum(axis=1)
    edges = [0, *cuts.tolist(), n]
    return [
        {"clip": k, "first_frame": a, "last_frame": b - 1, "start_s": a / FPS, "end_s": b / FPS, "level": float(round(level[a:b].sum() / max(1, used[a:b].sum()), 3))}
        for k, (a, b) in enumerate(zip(edges, edges[1:]))
    ]


def describe(ids: list, texts: list) -> dict[str, list]:
    """Columns of SCHEMA for some documents: stored, read back and described."""
    raw = [(t or "").encode() for t in texts]
    files = encode_videos([r.ljust(max(BLOCK, -(-len(r) // BLOCK) * BLOCK), b"\0") for r in raw])
    out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "clips")}
    for doc_id, r, media, (frames, n) in zip(ids, raw, files, decode_videos(files)):
        payload = frames.tobytes()[:n]
        row = (doc_id, len(r), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), media, find_clips(frames, n))
        for c, x in zip(out, row):
            out[c].append(x)
    return out


def media_rows(docs: DataFrame) -> DataFrame:
    """Per document: its text as stored media, digests of the payload read back, and its clips.

    A null text is stored like an empty one: one block of zeros. Rows are independent: equal texts give equal
    media, repeated rows and null ids stay, an empty table gives no rows, other columns are ignored. A very long
    text is a slice of its own.
    """
    kinds = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media", pa.binary()),
        ("clips", pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("level", pa.float64())]))),
    ])

    def run(batches):
        for batch in batches:
            start, size, texts = 0, 0, batch.column("text")
            for i in range(batch.num_rows + 1):
                if i == batch.num_rows or (size > SLICE_BYTES and i > start):
                    if i > start:
                        part = batch.slice(start, i - start)
                        yield pa.RecordBatch.from_pydict(describe(part.column("doc_id").to_pylist(), part.column("text").to_pylist()), schema=kinds)
                    start, size = i, 0
                if i < batch.num_rows:
                    size += max(FRAME, len(texts[i].as_py() or ""))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def clip_rows(media: DataFrame) -> DataFrame:
    """One row for each clip: doc_id, clip, first_frame, last_frame, start_s, end_s, level."""
    return media.select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")
