"""Media, packing, near-duplicates, classifiers, secrets and the pipeline: brute-force versions, round trips, odd rows."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomgraph.llm import media, near_dup, packing, quality_knn, queries, secret_scan, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, label int"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "two three"), (7, LONG), (8, "é😀 漢字 a<|endoftext|>b It's \x1c x")]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "r", 0.0, 1) for i, t in rows], DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# --- media


def test_any_bytes_survive_storage():
    rng = np.random.default_rng(0)
    payloads = [bytes(rng.integers(0, 256, 64 * k, dtype=np.uint8)) for k in (1, 2, 15, 16, 17, 40)] + [b"\xff" * 128, b"\0" * 64, bytes([0, 255]) * 64]
    files = media.encode_videos(payloads)
    for p, f, (frames, n) in zip(payloads, files, media.decode_videos(files)):
        assert frames.tobytes()[:n] == p and n == len(p)
        assert f[:4] == b"RIFF" and struct.unpack("<I", f[4:8])[0] == len(f) - 8
    with pytest.raises(ValueError):
        media.index_frames(b"no video at all")


def test_cuts_follow_the_picture():
    calm = np.tile(np.arange(media.FRAME) % 7, (12, 1)).astype(np.uint8)
    frames = np.concatenate([calm, calm + 100, calm])
    clips = media.find_clips(frames, frames.size)
    assert [(c["first_frame"], c["last_frame"]) for c in clips] == [(0, 11), (12, 23), (24, 35)]
    assert clips[1]["start_s"] == 12 / media.FPS


def test_media_rows(spark):
    out = media.media_rows(docs(spark, ODD)).collect()
    texts = sorted((t or "").encode() for _, t in ODD)
    assert sorted(r["n_bytes"] for r in out) == sorted(map(len, texts))
    want = {hashlib.sha256(t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")).hexdigest() for t in texts}
    assert {r["payload_sha256"] for r in out} == want
    for r in out:
        frames, n = media.decode_videos([bytes(r["media"])])[0]
        assert n == r["payload_bytes"] and zlib.crc32(frames.tobytes()[:n][-64:]) == r["tail_crc32"]
    assert media.clip_rows(media.media_rows(docs(spark, ODD))).count() == sum(len(r["clips"]) for r in out)
    assert media.media_rows(docs(spark, [])).count() == 0


# --- packing


def test_ids_are_those_of_the_whole_text():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    known = packing.WordIds(packing.tokenizer_at(TOKENIZER))
    texts = [t for _, t in ODD] + ["x́ ́y", "ΣΑΣ ΣΑ", "İ I ı", "a\r\nb", "'s 't it's", "***a!!b A**-- a.b.C,", "x\x00\x1f.", "Ünïcode, Ĳ ŉ ſ", "1 23 4a"]
    for text, ids in zip(texts, packing.ids_of(texts, known)):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], text


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    known = packing.WordIds(packing.tokenizer_at(TOKENIZER))
    text = " ".join(f"w{i}" for i in range(100))
    assert list(packing.ids_of([text, text], known))[0] == next(packing.ids_of([text], packing.WordIds(packing.tokenizer_at(TOKENIZER))))
    assert len(known) <= 12 and len(known.before) <= 12


def test_bins_take_the_tightest_fit_and_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n) for n in (6, 5, 4, 5)] == [(0, 0), (1, 0), (0, 6), (1, 5)]
    bins = packing.OpenBins(10, 2)
    assert [bins.put(n) for n in (9, 8, 7, 1)] == [(0, 0), (1, 0), (2, 0), (1, 8)]


@pytest.mark.parametrize("most", [1, 3, 20])
def test_placement_is_plain_best_fit(most):
    """Against a list of open bins: tightest fit, of equal ones the last used; the fullest closes when one too many would be open."""
    rng = random.Random(most)
    lengths = [rng.choice([1, 2, 3, 7, 30, 50, 64, rng.randint(1, 64)]) for _ in range(3000)]
    bins, made, stamp, open_ = packing.OpenBins(64, most), 0, 0, []  # open: [free, stamp, bin]
    for n in lengths:
        fits = [b for b in open_ if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: (b[0], -b[1]))
        else:
            if len(open_) == most:
                open_.remove(min(open_, key=lambda b: (b[0], -b[1])))
            b = [64, 0, made]
            made += 1
            open_.append(b)
        assert bins.put(n) == (b[2], 64 - b[0])
        stamp += 1
        b[0], b[1] = b[0] - n, stamp
        if not b[0]:
            open_.remove(b)
    assert bins.made == made


def test_packing_is_whole_and_gapless(spark):
    rows = ODD + [(100 + i, " ".join(["word"] * (i * 37 % 1900))) for i in range(120)]
    pieces = packing.token_pieces(docs(spark, rows), TOKENIZER, with_ids=True)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    whole = sorted((i or -1, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    got = pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert sum(n for _, n in whole) == sum(r["n"] for r in got)
    assert all(r["length"] == packing.CAPACITY for r in pieces.join(pieces.groupBy("doc_id").agg(F.max("piece").alias("last")), "doc_id").where("piece < last").collect())
    packed = packing.pack(pieces.drop("ids")).collect()
    assert len(packed) == pieces.count()
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(by) <= 1.05 * sum(r["length"] for r in packed) / packing.CAPACITY + 4
    assert packing.pack(packing.token_pieces(docs(spark, []), TOKENIZER)).count() == 0


# --- near-duplicates


def brute_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    least = {k: min((d for d in g if d is not None), default=None) for k, g in groups.items()}
    return sorted((str(doc), len(sets[i]), str(least[find(i)])) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("size", [2, 5])
def test_components_match_brute_force(spark, size):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = list(ODD) + [(9, "Two THREE"), (None, "alone here now yes it is")]
    for group in range(6):
        base = [rng.choice(words) for _ in range(60)]
        for k in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 9) if size == 2 else rng.randint(0, 3)):
                copy[rng.randrange(60)] = rng.choice(words)
            rows.append((1000 * group + 50 + k, " ".join(copy)))
        rows.append((1000 * group + 99, " ".join(base)))
    got = near_dup.near_duplicates(docs(spark, rows), size, 80).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == brute_components(rows, size, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_signatures_within_the_distance_share_a_key(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, near_dup.HASHES)
    rows = []
    for n in range(near_dup.MOST_ERRORS + 1):
        b = a.copy()
        at = rng.permutation(near_dup.HASHES)[:n]
        b[at] = (b[at] + rng.integers(1, 256, n)) % 256
        pack = lambda x: [int(sum(int(v) << 8 * p for p, v in enumerate(c))) for c in x.reshape(near_dup.CHUNKS, near_dup.CHUNK_BYTES)]
        rows.append((n, pack(a), pack(b)))
    df = spark.createDataFrame(rows, "n int, a array<long>, b array<long>")
    same = F.exists(F.zip_with(near_dup.keys_of(F.col("a")), near_dup.keys_of(F.col("b")), lambda x, y: x == y), lambda x: x)
    for r in df.select("n", near_dup.errors(near_dup.apart(F.col("a"), F.col("b"))).alias("e"), same.alias("same")).collect():
        assert r["e"] == r["n"] and r["same"]


def test_links_inside_a_large_family_are_found(spark):
    """10,000 texts that are more than half one passage, so all share keys, and 300 planted pairs between them far from any lead."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(60)]
    rows, linked = [], {}
    for i in range(10_000):
        own = [f"w{i}x{k}" for k in range(45)]
        rows.append((i, " ".join(passage + own)))
        if i < 300:
            for k in rng.sample(range(45), 4):
                own[k] = f"v{i}x{k}"
            rows.append((20_000 + i, " ".join(passage + own)))
            linked[20_000 + i] = i
    sets = {d: {tuple(w[k : k + 2]) for w in [t.split()] for k in range(len(w) - 1)} for d, t in rows if d < 300 or d >= 20_000}
    alike = {b: a for b, a in linked.items() if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert len(alike) > 200
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs(spark, rows), 2, 80).collect()}
    assert {d: c for d, c in got.items() if d != c} == alike


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (3, text), (3, text), (9, text + " more"), (6, "other text of its own here"), (None, "no id but words of its own"), (7, None), (8, "")]
    out = near_dup.without_near_duplicates(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["3", "6", "7", "8", "None"]
    assert near_dup.without_near_duplicates(docs(spark, [])).count() == 0
    named = docs(spark, rows).withColumn("near_dup_row", F.lit(7))
    left = near_dup.without_near_duplicates(named)
    assert left.columns == named.columns and {r["near_dup_row"] for r in left.collect()} == {7}


# --- classifiers


def good(i):
    return " ".join(f"{w}{(i * k) % 11}" for k, w in enumerate("the quick brown fox went over to see a lazy dog sleep near an old barn".split())) + "."


def junk(i):
    return " ".join(f"W{i * k % 7}*** $$$ {k}%%" for k in range(20))


def test_quality_held_out_and_odd_rows(spark):
    rows = [(i, good(i) if i % 4 else junk(i)) for i in range(200)] + ODD
    marks = [(i, int(i % 4 > 0), 0) for i in range(200)] + [(None, 1, 0), (5, None, None), (100000, 1, 1)]
    frame = docs(spark, rows)
    out = quality_knn.score_quality(frame, labels(spark, marks)).select(F.col("row.doc_id").alias("id"), F.col("row.text").alias("text"), "held_out", "score").collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    for r in out[:200]:  # the odd rows come after
        assert r["held_out"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1)
        assert (r["score"] >= 0.5) == bool(r["id"] % 4)
    kept = quality_knn.accepted_documents(frame, labels(spark, marks))
    assert kept.columns == frame.columns and kept.where("doc_id % 4 = 0 and doc_id > 3 and text <> 'one'").count() == 0
    none = quality_knn.score_quality(frame, labels(spark, [])).select("score").distinct().collect()
    assert [r[0] for r in none] == [0.5]
    assert quality_knn.score_quality(docs(spark, []), labels(spark, marks)).count() == 0


def test_votes_are_those_of_all_neighbours():
    """Cosines and votes against loops, with ties for the last places shared."""
    rng = np.random.default_rng(1)
    texts = [good(i % 9) if i % 2 else junk(i % 5) for i in range(60)]
    shares = np.array([quality_knn.term_shares(t) for t in texts], np.float64)
    labels_ = np.array([float(i % 2 or i % 7 == 0) for i in range(60)])
    space = quality_knn.Neighbours(rng.normal(size=(quality_knn.N_TERMS, 8)), np.zeros((0, 1)), labels_, 0.5)
    space.vectors = space.place(shares)
    asked = [good(100), junk(100), "", "the quick", texts[0]]
    got = space.score(np.array([quality_knn.term_shares(t) for t in asked], np.float64))
    for t, score in zip(asked, got):
        v = quality_knn.term_shares(t).astype(float) @ space.weights
        near = []
        for u, label in zip(space.vectors, labels_):
            size = float(np.sqrt((v * v).sum()))
            near.append((round(float((v * u).sum() / size), quality_knn.DIGITS) if size else 0.0, label))
        near.sort(reverse=True)
        last = near[quality_knn.NEIGHBOURS - 1][0]
        tied = [x for x in near if x[0] == last]
        free = quality_knn.NEIGHBOURS - sum(x[0] > last for x in near)
        votes = [(max(c, 0) ** quality_knn.SHARPNESS * (1 if c > last else free / len(tied)), label) for c, label in near if c >= last]
        total = sum(w for w, _ in votes)
        assert score == pytest.approx(sum(w * y for w, y in votes) / total if total else 0.5, abs=1e-6)


def test_samples_are_bounded_by_rows(spark):
    """One labelled id on thousands of rows is one row of the sample, whatever their order."""
    rows = [(1, f"text {i % 50}") for i in range(5000)] + [(2, "other"), (3, None)]
    marks = [(1, 1, 1), (1, 0, 0), (2, 0, 0), (3, 0, 0)]
    picked = [quality_knn.labelled_sample(docs(spark, r), labels(spark, marks), "quality", {0: 10, 1: 10}).collect() for r in (rows, rows[::-1])]
    assert sorted((r["doc_id"], r["label"]) for r in picked[0]) == [(1, 1), (2, 0), (3, 0)]
    assert sorted(map(str, picked[0])) == sorted(map(str, picked[1]))


def test_toxicity_scores_match_loops():
    """A document's score from each run's mean over its words' subwords."""
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), -0.5)
    words = ["Scrum,", "ab", "été", "x" * 70, "\u6c34" * 30, "a/b", "--", "I"]
    texts = [" ".join(words * 3), "one", "", None, " ".join(words[:5]), LONG[:4000]]
    known = toxicity.WordValues(model)
    for text, got in zip(texts, toxicity.score_texts(texts, known)):
        ws = toxicity.words_of(text)
        value = []
        for w in ws:
            data = b"<" + toxicity.normal(w).encode() + b">"
            buckets = [zlib.crc32(data) % toxicity.BUCKETS]
            for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1):
                for at in range(len(data) - n + 1):
                    code = 0
                    for b in data[at : at + n]:
                        code = (code * 257 + b) % 2**64
                    buckets.append(((code + n) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BUCKET_BITS))
            value.append(np.mean([model.values[b] for b in buckets]))
        runs = [sum(value[at : at + toxicity.SEGMENT]) / toxicity.SEGMENT for at in range(0, max(1, len(ws) - toxicity.SEGMENT // 2), toxicity.SEGMENT // 2)] if ws else [0.0]
        assert got == pytest.approx(1 / (1 + np.exp(-(max(runs) + model.bias))), abs=1e-9)


def test_toxicity_catches_unseen_spellings(spark):
    rng = random.Random(2)
    words = [a + b + c for a in ("ba", "de", "fi", "go") for b in ("lu", "me", "ni") for c in ("ra", "se", "ti")]
    bad = [f"scrumple{x}" for x in ("s", "d", "r", "ing", "y", "o", "ish", "um")]
    rows = []
    for i in range(400):
        text = [rng.choice(words) for _ in range(40)]
        if i % 4 == 0:
            text[rng.randrange(40)] = rng.choice(bad[:-2])
        rows.append((i, " ".join(text)))
    marks = [(i, 1, int(i % 4 == 0)) for i in range(400)]
    new = [(1000 + k, " ".join([rng.choice(words) for _ in range(60)] + [w] + [rng.choice(words) for _ in range(60)])) for k, w in enumerate(bad[-2:])]
    frame = docs(spark, rows + new + [(i and i + 5000, t) for i, t in ODD])  # without labels
    out = toxicity.score_toxicity(frame, labels(spark, marks)).select(F.col("row.doc_id").alias("id"), "held_out", "score").collect()
    score = {r["id"]: r["score"] for r in out}
    held = [r for r in out[:400] if r["held_out"]]
    right = sum((r["score"] >= 0.3) == (r["id"] % 4 == 0) for r in held)
    assert right >= 0.95 * len(held) and score[1000] >= 0.3 and score[1001] >= 0.3
    assert all(0 <= r["score"] <= 1 for r in out) and score[1] < 0.3
    assert toxicity.score_toxicity(docs(spark, []), labels(spark, [])).count() == 0


@pytest.mark.parametrize("far", ["", "毒" * 6, "ü" * 40 + "x"])
def test_long_runs_count_whole(far):
    run = "清" * 200 + far + "水" * 50
    parts = toxicity.pieces_of(run)
    assert all(len(p.encode()) <= toxicity.LONGEST_WORD for p in parts)
    data, pieces = run.encode(), [p.encode() for p in parts]
    for n in range(1, toxicity.LONGEST + 1):
        assert {data[k : k + n] for k in range(len(data) - n + 1)} == {p[k : k + n] for p in pieces for k in range(len(p) - n + 1)}
    assert "scrumple" in toxicity.pieces_of("clean/" * 20 + "scrumple、fine") and toxicity.words_of("a " + "-" * 100) == ["a", "-" * 100]
    again = " ".join(toxicity.words_of("one " + "it's_fine/" * 30 + run))
    assert toxicity.words_of(again) == again.split()


def test_toxic_part_of_a_long_run_is_scored():
    rng = random.Random(4)
    words = [a + b + c for a in ("ba", "de", "fi", "go") for b in ("lu", "me", "ni") for c in ("ra", "se", "ti")]
    clean = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(300)]
    marks = np.array([float(i % 3 == 0) for i in range(300)])
    swapped = lambda t, k: " ".join("scrumple" if j == k else w for j, w in enumerate(t.split()))
    texts = [swapped(t, rng.randrange(40)) if m else t for t, m in zip(clean, marks)]
    known = toxicity.WordValues(toxicity.train(texts, marks))
    long = "/".join(clean[1].split())
    fine, bad = toxicity.score_texts([long, long + "/scrumple/" + long], known)
    assert fine < 0.3 <= bad


# --- secrets

SECRETS = [
    'x Password: "hunter22", token=abc, API_KEY = \'k/e+y=1.2-3_4\' and apikey:abcdef',
    "AKIA" + "A1" * 8 + " AKIASHORT AKIAAKIA" + "B2" * 9,
    "deadbeef" * 3 + " " + "ab" * 11 + "g" + "0123456789abcdef" * 2,
    'secret=token":abcdefgh paſſword=abcdefgh',
    "password=password=abcdefghijk token : token",
]


def brute_secrets(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_secrets_and_models(spark):
    rng = random.Random(9)
    plain = [(100 + i, f"the function get_user_name_from_{w} calls internationalization_of_{w}_settings again") for i, w in enumerate("alpha beta gamma delta epsilon theta kappa lambda sigma omega".split())]
    key = "".join(rng.choices(secret_scan.ALPHABET[:62], k=40))
    rows = ODD + [(50 + i, t) for i, t in enumerate(SECRETS)] + plain + [(99, f"use {key} for now")]
    frame = docs(spark, rows)
    out = secret_scan.scan(frame).select("doc_id", "text", "spans", secret_scan.redacted(F.col("text"), F.col("spans")).alias("clean")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] < 3] == brute_secrets(r["text"])
        if r["doc_id"] == 99:
            assert r["clean"] == "use [SECRET] for now"
        if (r["doc_id"] or 0) >= 100:
            assert not r["spans"]
    assert secret_scan.scan(docs(spark, [])).count() == 0


def test_copies_of_a_text_are_one_training_text(spark):
    """The models of a table with one text repeated thousands of times are those of the different texts."""
    different = [(i, f"call get_value_{w}_of_item and password = hunter{i}x") for i, w in enumerate("alpha beta gamma delta".split())]
    copies = different + [(100 + i, different[0][1]) for i in range(3000)]
    one, many = (secret_scan.train(docs(spark, r), sample_documents=3) for r in (different, copies))
    assert all((a.log == b.log).all() for a, b in zip(one, many))


# --- queries and pipeline


def test_pipeline_stages_keep_their_promises(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "minhash_near_dedup", "pii", "mixing", "best_fit_packing"]
    accepted = stages["quality_classifier"](spark, source, sf_dir).cache()
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert accepted.join(marks, "doc_id").where("quality = 1").count() >= 0.97 * source.join(marks, "doc_id").where("quality = 1").count()
    rows = [(r["doc_id"], r["text"]) for r in accepted.collect()]
    kept = stages["minhash_near_dedup"](spark, accepted, sf_dir).cache()
    want = sorted(d for d, _, c in brute_components(rows, 5, 80) if d == c)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want
    clean = stages["pii"](spark, kept, sf_dir).cache()
    assert clean.columns == source.columns and clean.count() == kept.count()
    mixed = stages["mixing"](spark, clean, sf_dir).cache()
    assert mixed.columns == source.columns and mixed.count() > 0
    pieces = stages["best_fit_packing"](spark, mixed, sf_dir)
    assert pieces.where("piece = 0").count() == mixed.count()


def landed(spark, folder, rows, marks):
    """A folder of tables, and the rows in the order of their ids."""
    docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labels(spark, marks).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_the_whole_pipeline_against_its_parts(spark, tmp_path):
    """run() on odd rows: what the last stage packs are the tokens of the texts that plain versions of the stages leave."""
    rows = [(i, good(i) if i % 4 else junk(i)) for i in range(100, 160)] + [(i + 1000, good(i) + " extra") for i in range(100, 104)] + [(i and i + 5000, t) for i, t in ODD if t != LONG]
    marks = [(i, int(i % 4 > 0), 0) for i in range(100, 160)] + [(None, 1, None), (101, None, 0)]
    folder = landed(spark, tmp_path / "some", rows, marks)
    out = corpus_pipeline.run(spark, folder).collect()
    accepted = [(r["doc_id"], r["text"]) for r in quality_knn.accepted_documents(docs(spark, rows), labels(spark, marks)).collect()]
    assert not [i for i, t in accepted if t == junk(i or 0)]
    kept = [d for d, _, c in brute_components(accepted, 5, 80) if d == c]
    assert {str(r["doc_id"]) for r in out} <= set(kept)
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out) and sum(r["length"] for r in out) > 0
    texts = dict(accepted)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for r in out:
        if r["doc_id"] is not None and texts.get(r["doc_id"]) and r["piece"] == 0:
            assert r["length"] <= min(packing.CAPACITY, len(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids) + 1)
    assert corpus_pipeline.run(spark, landed(spark, tmp_path / "none", [], [])).count() == 0


def test_free_queries_cover_all_documents(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op1_avi_media", "op3_minhash_near_dup", "op4_quality_neighbours", "op6_secret_scan", "op10_toxicity"):
        assert queries.queries()[name](spark, sf_dir).count() == n, name
    assert queries.op2_best_fit_packing(spark, sf_dir).where("piece = 0").count() == n
