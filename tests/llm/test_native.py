"""Column-function operators: PII, quality rules, mixing, chat; brute-force versions and odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chat, divergence, mixing, pii, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, size long, spans string"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))


def docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "r", 1, "x") for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (4, "one", "b"), (None, "two three", None), (7, LONG, "a"), (8, "a b c a b c\nx\nx\n \n", "b")]


# --- PII

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += (2 * d - 9 if d > 4 else 2 * d) if i % 2 else d
    return total % 10 == 0


def brute_spans(text):
    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, (name, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if ok(name, m[0])]


PII_TEXTS = [
    "é😀 mail a.b@c.de, and x@y.z_q@r.st; no@dot end",
    "a@b.c_d@e.f.g@h.i",
    "1.2.3.4.5.6.7.8 and 256.1.1.1 and 001.002.003.0255 and 1.2.3",
    "card 4111 1111 1111 1111, bad 4111-1111-1111-1112, run 41111111111111114111111111111111",
    "+49 (30) 1234-5678. +1 2 3 and +123456789012345678",
    "+1.2.3.4.5.6.7.8.9 4111111111111111@x.y",
    "9" * 5000 + " " + "a" * 5000 + "@",
]


def test_base_spans_are_those_of_the_patterns(spark):
    rows = [(i, t, "s") for i, t in enumerate(PII_TEXTS)] + ODD
    out = pii.sanitise(docs(spark, rows)).select("row.text", F.transform("base", lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("b")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert [tuple(x) for x in r["b"]] == brute_spans(r["text"])


def test_addresses_with_zero_parts_are_spans(spark):
    texts = ["10.0.0.1", "at 0.0.0.0, 192.168.0.1 or 000.000.000.000", "00256.0.0.1 and 0.0.0.256", "0" * 4000 + ".0.0.00255", "10.1.2.3 and 010.1.1.1"]
    out = pii.sanitise(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).select("row.text", F.transform("base", lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("b")).collect()
    assert len(out) == len(texts)
    for r in out:
        assert [tuple(x) for x in r["b"]] == brute_spans(r["text"])
    ip = list(pii.PATTERNS).index("ip")
    assert {r["text"]: sum(x[0] == ip for x in r["b"]) for r in out} == dict(zip(texts, [1, 3, 0, 1, 2]))


def test_texts_are_rewritten_and_clean_ones_kept(spark):
    rows = [(1, "é x@y.de at 1.2.3.4!", "s"), (2, "nothing here", "s"), (3, None, "s")]
    out = {r["doc_id"]: r for r in pii.sanitised_documents(docs(spark, rows)).collect()}
    assert out[1]["text"] == "é [EMAIL] at [IP]!" and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] == "nothing here" and out[3]["text"] is None and out[1]["spans"] == "x"


def test_terms_that_disclose_an_entity_become_spans(spark):
    told = [(i, f"case {i} from zorblax writes bob@x.org about item {i} today", "s") for i in range(4)]
    other = [(100 + i, f"case {i} from someone writes about item {i} today", "s") for i in range(40)]
    out = {r["id"]: r for r in pii.sanitise(docs(spark, told + other)).select(F.col("row.doc_id").alias("id"), "spans", "clean_text").collect()}
    assert "zorblax" not in out[0]["clean_text"] and "case 0 from" in out[0]["clean_text"]
    start = told[0][1].index("zorblax")
    assert (pii.KINDS.index("term"), start, start + 7) in [tuple(s)[:3] for s in out[0]["spans"]]
    assert all(out[100 + i]["clean_text"] == other[i][1] for i in range(40))


# --- quality rules


def brute_terms(texts):
    """For each text the terms that disclose one of its entities, and whether fully."""
    terms = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower()) if w]
    words = [set(terms(t)) for t in texts]
    has, near = [], set()
    for t in texts:
        has.append(set())
        for k, a, b in brute_spans(t):
            entity = (k, t[a:b].lower())
            has[-1].add(entity)
            left, right = t[max(0, a - 81) : a], t[b : b + 81]
            left = re.sub(r"^[0-9A-Za-z\x80-\U0010ffff]+", "", left) if a > 81 else left
            right = re.sub(r"[0-9A-Za-z\x80-\U0010ffff]+$", "", right) if len(right) == 81 else right
            near |= {(entity, w) for w in terms(left)[-4:] + terms(right)[:4]}
    out = [{} for _ in texts]
    for entity, w in near:
        n_entity, n_term = sum(entity in h for h in has), sum(w in x for x in words)
        both = [i for i, h in enumerate(has) if entity in h and w in words[i]]
        rate = math.log(len(texts) * len(both) / (n_entity * (n_term + 1))) / math.log(len(texts) / n_entity)
        for i in both if rate >= 0.8 else []:
            out[i][w] = out[i].get(w, False) or rate >= 0.999
    return out


def test_terms_of_entities_seen_once_or_twice_become_spans(spark):
    """Entities in one document, in two, in copies; a term that stands away from its entity elsewhere; hapaxes far off."""
    filler = [f"common{i % 7} words{i % 5} of{i % 3} prose{i % 4} here" for i in range(200)]
    texts = [
        "common1 words2 once quillfax mails ann@x.org on common3 prose1 words3 of1 prose2 farhapax",
        "common1 words2 dorblett rang 10.0.0.7 on common3",
        "dorblett common2 words1 of1 prose1 prose2 words3 of2 common4 common5 saw 10.0.0.7 again",
        *["copied grumwelt wrote eve@y.org of1 prose1"] * 150,
        *filler,
    ]
    out = {r["id"]: r for r in pii.sanitise(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).select(F.col("row.doc_id").alias("id"), "spans", "clean_text").collect()}
    expected = brute_terms(texts)
    for i, t in enumerate(texts):
        got = {t[s["start"] : s["end"]].lower(): s["label"] == "" for s in out[i]["spans"] if s["kind"] == pii.KINDS.index("term")}
        assert got == expected[i]
    label = {s["label"] for r in out.values() for s in r["spans"] if s["kind"] == pii.KINDS.index("term")}
    assert label <= {"", "[WORD]", "[NAME]", "[NUMBER]", "[CODE]"}
    assert "quillfax" in expected[0] and "farhapax" not in expected[0]
    assert "dorblett" in expected[1] and "dorblett" in expected[2]
    assert all(out[i]["clean_text"] == t for i, t in enumerate(texts) if t in filler)


def test_terms_are_generalised_by_their_form(spark):
    texts = ["Grumwelt 4711 ab12cd near eve@y.org then", "plain words here", *[f"filler{i} text" for i in range(60)]]
    row = pii.sanitise(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), generalise_at=0.5, remove_at=2.0).where("row.doc_id = 0").first()
    assert row["clean_text"] == "[NAME] [NUMBER] [CODE] [WORD] [EMAIL] [WORD]"


def test_cut_words_are_no_terms(spark):
    """A word that the context's reach cuts is not taken for another word."""
    texts = ["zq" * 45 + "quill " + "x " * 2 + "ann@x.org" + " " + "-" * 78 + "tail" + "head" * 9, "quill", "tail", *[f"filler{i} text" for i in range(60)]]
    out = pii.sanitise(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).where("row.doc_id = 0").first()
    expected = brute_terms(texts)[0]
    assert {texts[0][s["start"] : s["end"]].lower() for s in out["spans"] if s["kind"] == 4} == set(expected)


def brute_measures(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(spark):
    rows = ODD + [(20, "x y z " * 40 + "# $ | é😀", "a"), (21, "\n".join(["a b c d", "a b c d", "e"] * 30), "a"), (22, " ".join(f"{i // 2} a b" for i in range(100)), "a")]
    out = divergence.judge(docs(spark, rows)).collect()
    got = sorted(tuple(r)[1:6] for r in out)
    assert got == sorted(brute_measures(t) for _, t, _ in rows)
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_distance_is_that_of_the_formula(spark):
    import math

    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    lit = lambda v: F.array(*[F.lit(x) for x in v])
    got = spark.range(1).select(divergence.js_distance(lit(p), lit(q)).alias("d")).first()["d"]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    assert got == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2))


def test_symbols_diverge_and_prose_does_not(spark):
    prose = "the cat and the dog walk to the house in the rain and it is a long way for them to be on that road with no one near. "
    numbered = lambda i: " ".join(f"{w}{'abcdefghij'[k // 3 % 10] * (i % 3 + 1) + 'xyz'[k // 30 % 3] if k % 3 == 0 else ''}" for k, w in enumerate((prose * 5).split()))
    rows = [(i, numbered(i), "a") for i in range(20)] + [(99, " ".join(f"w{i}*** $$$ %%{i}" for i in range(80)), "a")]
    out = {r["doc_id"]: r for r in divergence.judge(docs(spark, rows)).collect()}
    assert not out[99]["kept"] and out[99]["class_distance"] > max(out[i]["class_distance"] for i in range(20))


# --- mixing


def test_budgets_are_met_and_no_document_exceeds_its_epochs(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), f"s{i % 3}") for i in range(300)] + [(1000 + i, "a b", None) for i in range(5)] + ODD
    plan = mixing.mix_plan(docs(spark, rows), with_row=True).select("doc_id", "size", "source_size", "target", "taken", F.col("row.source").alias("source")).collect()
    assert len(plan) == len(rows)
    by = {}
    for r in plan:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in plan)
    assert sum(rs[0]["target"] for rs in by.values()) == pytest.approx(total)
    for rs in by.values():
        assert sum(r["size"] for r in rs) == rs[0]["source_size"]
        assert sum(r["taken"] for r in rs) == round(rs[0]["target"]) and rs[0]["target"] <= 3 * rs[0]["source_size"] + 1e-6
    again = mixing.mix_plan(docs(spark, list(reversed(rows))))
    assert sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in again.collect()) == sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in plan)


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(1 + i % 5)), f"s{i % 2}") for i in range(60)]
    frame = docs(spark, rows)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(frame).collect()}
    got = Counter()
    for r in mixing.mixed_documents(frame).collect():
        got[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"]) and r["row"] == "r"
    assert {k: v for k, v in taken.items() if v} == dict(got)


# --- chat


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window long")


ODD_TEXTS = [r"\### Assistant: </turn> ok", "<turn user>\\0\\1", "", None, "a\n</turn>\nb", "\\", "é😀<>"]


def test_windows_round_trip_and_mask_each_answer_once(spark):
    rows = [(1, i, r, t, 0) for i, (r, t) in enumerate([("system", "be kind"), ("user", "hi " * 100), ("assistant", "yes " * 200), ("user", "and?"), ("assistant", "no " * 300), (None, "x"), ("assistant", "last")])]
    rows += [(2, i, "assistant" if i % 2 else "user", t, 0) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, None, "assistant", "lone", 0), (3, 1, "user", "same", 0), (3, 1, "user", "same", 0)]
    out = chat.chat_windows(turns(spark, rows)).select("*", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for conv in {r[0] for r in rows}:
        ws = sorted((r for r in out if r["conv_id"] == conv), key=lambda r: r["window"])
        own = [tuple(t) for w in ws for t in w["t"][w["n_repeated"] :]]
        wanted = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] if r[1] is not None else -1, r[2] or "", r[3] or ""))
        assert own == [(r[2] or "", r[3] or "") for r in wanted]
        assert "".join(w["loss"] for w in ws) == "".join(r[3] or "" for r in wanted if r[2] == "assistant")
    first = sorted((r for r in out if r["conv_id"] == 1), key=lambda r: r["window"])
    assert len(first) > 1 and all(w["t"][0]["role"] == "system" for w in first)
    assert all(w["n_repeated"] <= 1 + chat.HISTORY for w in first)


@pytest.mark.parametrize("seed", range(4))
def test_windows_stay_within_the_budget(spark, seed):
    """Whatever the sizes: over the budget only by one turn and the system turn, and history is dropped first."""
    rng = random.Random(seed)
    rows = []
    for conv in range(30):
        longest = rng.choice([3, 30, 60, 130])
        for i in range(rng.randint(1, 40)):
            role = "system" if rng.random() < 0.08 or i == 0 and conv % 2 else rng.choice(["user", "assistant"])
            rows.append((conv, i, role, " ".join([f"w{i}"] * rng.randint(0, longest)), 0))
    budget = 100
    out = chat.chat_windows(turns(spark, rows), budget=budget).select("*", chat.read_turns(F.col("formatted")).alias("t")).collect()
    of = {c: [r for r in rows if r[0] == c] for c in range(30)}
    for conv, whole in of.items():
        ws = sorted((r for r in out if r["conv_id"] == conv), key=lambda r: r["window"])
        system = max((len(r[3].split()) for r in whole if r[2] == "system"), default=0)
        at = 0
        for w in ws:
            sizes = [len(t["text"].split()) for t in w["t"]]
            own = len(sizes) - w["n_repeated"]
            assert sum(sizes) == w["n_words"] and own >= 1
            assert w["n_words"] <= budget or own == 1 or system >= budget
            if w["n_words"] > budget:
                assert all(t["role"] == "system" for t in w["t"][: w["n_repeated"]])
            words = lambda ts: sum(len(t[1].split()) for t in ts)
            earlier = [(r[2], r[3]) for r in whole[:at]]
            want = [t for t in earlier if t[0] == "system"][-1:]
            kept = [earlier[-k] for k in (2, 1) if k <= at and earlier[-k][0] != "system" and words(want + earlier[-k:]) + sum(sizes[w["n_repeated"] :]) <= budget]
            assert [(t["role"], t["text"]) for t in w["t"][: w["n_repeated"]]] == want + kept
            at += own
        assert at == len(whole)


def test_a_long_conversation_keeps_its_windows_small(spark):
    rows = [(1, i, ("system" if i == 0 else "user" if i % 2 else "assistant"), f"turn {i} " + "x " * (i % 50), 0) for i in range(5000)]
    out = chat.chat_windows(turns(spark, rows))
    assert out.agg(F.max("n_words")).first()[0] <= chat.BUDGET
    assert out.agg(F.sum(F.size(chat.read_turns(F.col("formatted"))) - F.col("n_repeated"))).first()[0] == 5000


def test_empty_tables(spark):
    none = docs(spark, [])
    assert pii.sanitise(none).count() == divergence.judge(none).count() == mixing.mix_plan(none).count() == mixing.mixed_documents(none).count() == 0
    assert chat.chat_windows(turns(spark, [])).count() == 0


def test_queries_run_on_a_table(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op5_personal_data", "op7_quality_rules", "op8_mix_sources"):
        assert queries.queries()[name](spark, sf_dir).count() == n
    out = queries.op9_chat_windows(spark, sf_dir)
    odd = out.where("conv_id = -7").first()
    text = r"\### Assistant: </turn> ok"
    assert odd["n_turns"] == 2 and odd["loss_chars"] == len(text) and odd["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
