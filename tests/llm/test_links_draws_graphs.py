"""Token links, importance resampling and graph search: brute-force versions and odd rows."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from loomgraph.llm import graph_search, importance, token_links

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, pairs string, n_docs double, row_id string, rank int"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "two three"), (7, LONG), (8, "é😀 漢字 a<|endoftext|>b It's \x1c x"), (9, "a▁b c"), (10, "x" * 5000), (11, "\x00   </s><s>\r\n\n  q  "), (12, "Ünïcôde  two  spaces.  thin")]


def docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "p", 0.5, "r", 3) for i, t in rows], DOCS)


# --- token links


def plain_links(texts):
    """Tokens of whole texts, walked side by side."""
    a, a_bytes, b, b_bytes = token_links.vocabularies(A, B)
    rows, corpus = [], Counter()
    for text in texts:
        own = (" " + (text or "")).encode()
        x, y = a.encode(own.decode(), add_special_tokens=False).ids, b.encode(text or "")
        if not text or b"".join(a_bytes[i] for i in x) != own or b"".join(b_bytes[i] for i in y) != own:
            rows.append(None)
            continue
        spans = lambda ids, pieces: np.cumsum([0, *(len(pieces[i]) for i in ids)]).tolist()
        p, q = spans(x, a_bytes), spans(y, b_bytes)
        links, first = [], 0
        for i in range(len(x)):
            while q[first + 1] <= p[i]:
                first += 1
            j = first
            while j < len(y) and q[j] < p[i + 1]:
                links.append((x[i], y[j]))
                j += 1
        ends = sorted(set(p[1:]) & set(q[1:]))
        groups, i, j = [], 0, 0
        for e in ends:
            to_i, to_j = p.index(e, i) if e in p else 0, q.index(e, j)
            groups.append(f"{','.join(map(str, x[i:to_i]))}|{','.join(map(str, y[j:to_j]))}")
            i, j = to_i, to_j
        rows.append((len(x), len(y), len(groups), links, ";".join(groups)))
        corpus.update(set(links))
    best = {}
    for (i, _), n in corpus.items():
        best[i] = max(n, best.get(i, 0))
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((*r[:3], len(r[3]), sum(corpus[x] == best[x[0]] for x in r[3]), sum(corpus[x] for x in r[3]), hashlib.sha256(r[4].encode()).hexdigest()))
    return out


@pytest.mark.parametrize("broadcast", [token_links.BROADCAST_PAIRS, 0])
def test_links_of_odd_texts(spark, broadcast):
    rows = [r for r in ODD if r[0] != 7] + [(7, LONG[:3000])]
    out = token_links.align(docs(spark, rows), A, B, broadcast_pairs=broadcast)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = sorted((str(r[0]), *r[1:]) for r in out.collect())
    assert found == sorted((str(i), *want) for (i, _), want in zip(rows, plain_links([t for _, t in rows])))
    zero = {r[0] for r in found if r[1:] == (0, 0, 0, 0, 0, 0, "")}
    assert {"1", "2", "9"} <= zero and "8" not in zero


def test_links_of_real_texts(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 4000")
    rows = table.select("doc_id", "text").collect()
    found = {r[0]: tuple(r[1:]) for r in token_links.align(table, A, B).collect()}
    want = dict(zip([r[0] for r in rows], plain_links([r[1] for r in rows])))
    assert found == want


def test_groups_are_given_and_tasks_forget(spark, monkeypatch):
    text = "The quick brown fox, naïve 123456 tests."
    out = token_links.align(docs(spark, [(1, text)]), A, B, with_groups=True).first()
    assert hashlib.sha256(out["groups"].encode()).hexdigest() == out["groups_sha256"]
    known = token_links.Segments(A, B)
    known.learn({"The", "quick"})
    one = known.row(["The", "quick", "The"], True)
    known.forget()
    known.learn({"quick", "The", "more"})
    again = known.row(["The", "quick", "The"], True)
    assert one[:3] == again[:3] and one[3].tolist() == again[3].tolist() and one[4].tolist() == again[4].tolist()


def test_parts_of_segments_are_aligned_once():
    known, given = token_links.Segments(A, B), []

    class Counted:
        def __init__(self, b):
            self.encode = lambda texts, **named: (given.extend([texts] if isinstance(texts, str) else texts), b.encode(texts, **named))[1]

    known.b = Counted(known.b)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(10)]
    known.learn({w + end for w in words for end in ("", ".", ",", "!", "...", "'s", ".\nThen", ";\nThen")})
    assert len(given) <= 120  # not all 800
    assert known.row(["waa.\nThen", "wab's"], True)[0][0] > 5


def test_links_of_signs_and_line_ends_between_letters(spark):
    seed = np.random.default_rng(3)
    signs = [*"aBñÉ \n\r\t.,;!?'|<>$&_-/7é漢😀", "  ", "\n\n", " The", "n't", "<s>", "</s>", "<|endoftext|>", ". ", ".\nThe ", " word, "]
    rows = [(i, "".join(seed.choice(signs, seed.integers(1, 40)))) for i in range(400)]
    found = sorted(tuple(r) for r in token_links.align(docs(spark, rows), A, B).collect())
    assert found == [(i, *want) for (i, _), want in zip(rows, plain_links([t for _, t in rows]))]


def test_texts_are_cut_as_by_the_pattern():
    texts = ["", " ", "a b", " a b", "a b ", "a  b c", "a \u00a0b c", "é 漢 x\n y z", "one", "a b c d"]
    segments, codes, ends = token_links.segmented(texts)
    assert [[segments[k] for k in x] for x in np.split(codes, ends[:-1])] == [token_links.CUT.split(t) if t else [] for t in texts]
    assert ends[-1] == len(codes)


def test_no_cut_where_a_vocabulary_joins(monkeypatch):
    given = token_links.vocabularies(A, B)
    found = lambda: token_links.part_cuts.__wrapped__(A, B)
    cut = lambda s: [s := where.sub(instead, s) for where, instead in found()][-1].split(token_links.NEXT_PART)
    assert cut(" one.\nTwo,") == [" one", ".\n", "Two", ","]
    monkeypatch.setattr(token_links, "vocabularies", lambda *_: (*given[:3], [*given[3], b"s."]))
    assert cut(" one.\nTwo,") == [" one.\n", "Two", ","]
    monkeypatch.setattr(token_links, "vocabularies", lambda *_: (given[0], [*given[1], b"\nTwo"], *given[2:]))
    assert found() == []


def test_partial_counts_merge():
    held = token_links.PartialCounts()
    held.add(np.array([1, 5]))
    held.add(np.array([5, 7]))
    assert [x.tolist() for x in held.merged()] == [[1, 5, 7], [1, 2, 1]]
    held.add(np.array([7]))
    rows = held.rows().to_pydict()
    assert rows["pairs"] == [[1, 5, 7]] and rows["times"] == [[1, 2, 2]] and rows["row_id"] == [None]
    assert held.rows().num_rows == 0


def test_no_documents_no_links(spark):
    assert token_links.align(docs(spark, []), A, B).collect() == []


# --- importance resampling


def plain_draw(rows, target, longest, buckets, percent, least):
    def found(text):
        words = [w for w in importance.WORD.findall(text or "")]
        words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for i in range(len(words)) for k in range(1, longest + 1) if i + k <= len(words)]

    each, aims = [found(t) for _, t in rows], [found(t) for t in target]
    s, t = Counter(b for _, x in each for b in x), Counter(b for _, x in aims for b in x)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    scored = []
    for (i, _), (n, x) in zip(rows, each):
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        scored.append((i, n, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    place = {}
    for k, r in enumerate(able[: len(able) * percent // 100]):
        place.setdefault(r, []).append(k + 1)
    return sorted((*map(str, r), str(place[r].pop(0) if place.get(r) else None)) for r in scored)


@pytest.mark.parametrize("longest", [1, 3])
def test_draw_of_odd_texts(spark, longest):
    rows = ODD + [(100 + i, f"alpha beta {'gamma ' * i} Delta-{i}") for i in range(40)]
    target = ["gamma delta gamma", None, "Alpha"]
    out = importance.resample(docs(spark, rows), docs(spark, list(enumerate(target))), longest=longest, buckets=997, percent=30, least_words=5, chunk_chars=500)
    assert sorted(tuple(map(str, r)) for r in out.collect()) == plain_draw(rows, target, longest, 997, 30, 5)


def test_chunks_own_every_word_once():
    for text in (LONG, "x" * 999, " ,; " * 50, "ab cd" * 40, ""):
        for chars in (1, 7, 64):
            parts = list(importance.chunks(text, 3, chars))
            assert "".join(own for own, _ in parts) == text
            got = [x for own, carry in parts for x in importance.features(own, carry, 3)[0]]
            assert sorted(got) == sorted(importance.features(text, "", 3)[0])


def test_drawn_documents_and_empty_tables(spark):
    rows = [(i, " ".join(["word"] * 30) + f" {i}") for i in range(50)]
    drawn = importance.resampled_documents(docs(spark, rows), docs(spark, [(1, "word")]))
    assert drawn.columns == docs(spark, []).columns and drawn.count() == 5
    assert importance.resample(docs(spark, []), docs(spark, [])).collect() == []
    assert {r["rank"] for r in importance.resample(docs(spark, [(1, "few words")]), docs(spark, [])).collect()} == {None}


# --- graph search


VECTORS = "vec_id long, embedding array<float>, size int, shard string, score double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "s", 0.0) for i, v in rows], VECTORS)


def brute(rows, asked, k):
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in fine:
        if q in asked:
            near = sorted((math.dist(v, w), i) for i, w in fine if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, round(d, 9)) for n, (d, i) in enumerate(near)]
    return sorted(out)


def test_search_of_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(300)]
    rows += [(300 + i, [1.0, 2.0, -1.0, 0.0]) for i in range(60)]  # copies and ties
    rows += [(400, None), (401, [0.0] * 4), (402, [1.0, None, 0.0, 1.0]), (403, [1.0, float("nan"), 0.0, 1.0]), (404, [float("inf")] * 4), (405, [2.0, 3.0]), (406, [2.0, 5.0]), (None, [1.0] * 4), (407, []), (408, [-0.0, 1.0, 0.0, 2.0])]
    table = vectors(spark, rows)
    out = graph_search.nearest(table, table.where("vec_id % 5 = 0"), k=7, shard_rows=100, block_queries=9)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((r[0], r[1], r[2], round(r[3], 9)) for r in out.collect()) == brute(rows, set(range(0, 1000, 5)), 7)


def test_few_candidates_and_none(spark):
    table = vectors(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0])])
    out = graph_search.nearest(table, table.where("vec_id = 1")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in out] == [(1, 1, 2), (1, 2, 2)]
    assert graph_search.nearest(vectors(spark, []), vectors(spark, [])).collect() == []
    assert graph_search.nearest(table, table.where("false")).collect() == []


def test_recall_in_one_shard():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges, start = graph_search.graph(x)
    assert edges.shape == (6000, graph_search.DEGREE) and not (edges == np.arange(6000)[:, None]).any()
    q = x[::40]
    norms = np.einsum("ij,ij->i", x, x)
    found, _ = graph_search.walk(x, norms, edges, start, q, graph_search.BEAM)
    best = np.argsort(norms - 2 * q @ x.T, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(best, found[:, :10])]) >= 0.95


def test_pruning_keeps_directions():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1], [-3, 0]], np.float32)
    norms = (x * x).sum(axis=1)
    ids = np.array([[1, 2, 3, 4]])
    kept = graph_search.prune(x, norms, ids, norms[ids], 4)
    assert sorted(kept[kept >= 0].tolist()) == [1, 3, 4]  # 2 lies behind 1


def test_index_holds_every_vector(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(500)] + [(1000 + i, [1.0, 1.0, 1.0]) for i in range(40)]
    nodes = graph_search.index(vectors(spark, rows), k=10, shard_rows=150).collect()
    assert len(nodes) == 501 and {len(r["edges"]) for r in nodes} == {graph_search.DEGREE}
    assert {i for r in nodes for i in r["ids"]} == set(range(500)) | set(range(1000, 1011))
    assert isinstance(graph_search.beam_search(pa.table({"node": []}), pa.table({"v": []}), 3, 9), pa.Table)
