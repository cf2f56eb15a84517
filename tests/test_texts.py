"""Text operators without SQL against plain versions: chunks, mentions in context, pages."""

import random
import re

from pyspark.sql import functions as F

from loomgraph.functions import chunks, extraction
from loomgraph.sources.html import PageText, page_text


def plain_chunks(text, size, overlap):
    """Lines added while they fit; the next chunk repeats the fewest last lines that reach the overlap."""
    out, current = [], []
    width = lambda ls: sum(len(x) + 1 for x in ls)
    for line in text.split("\n"):
        if current and width(current) + len(line) + 1 > size:
            out.append("\n".join(current))
            tail = []
            while len(tail) < len(current) and width(tail) < overlap:
                tail = current[len(current) - len(tail) - 1 :]
            current = tail if width(tail) >= overlap else []
        current = [*current, line]
    return [*out, "\n".join(current)]


def test_chunks_match_a_plain_version(spark):
    rng = random.Random(7)
    texts = ["", "one", "\n\n", "x" * 300] + ["\n".join("w" * rng.randint(0, 40) for _ in range(rng.randint(1, 60))) for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "id long, t string")
    got = {}
    for r in chunks.chunk_rows(df, "id", "t", 120, 30).orderBy("id", "chunk").collect():
        got.setdefault(r["id"], []).append(r["text"])
    assert got == {i: plain_chunks(t, 120, 30) for i, t in enumerate(texts)}


def test_mentions_have_their_surroundings(spark):
    pattern = r"(?i)COCOS\s*(?:=\s*)?[0-9]{1,2}"
    texts = ["", None, "COCOS 11", "é" * 60 + "cocos=7" + "ü" * 60 + "COCOS 3 and COCOS 17", "none at all", "COCOS11COCOS12"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", extraction.with_context(F.col("t"), pattern, 50).alias("x")).collect()
    for r in out:
        want = [(m[0], r["t"][max(0, m.start() - 50) : m.end() + 50]) for m in re.finditer(pattern, r["t"] or "")]
        assert [tuple(x) for x in r["x"] or []] == want


def test_pages(spark):
    pages = ["<h1>A &amp; b</h1><p>x<br>y</p><table><tr><td>1</td><td>2</td></tr></table><h2>C</h2>z", None, "", "plain", "<div><p>open", "<style>p{}</style><!-- no --><p>yes</p>"]
    out = [tuple(r) for r in page_text(spark.createDataFrame(list(enumerate(pages)), "k long, html string"), "k", "html").orderBy("k").collect()]
    assert out[0][1] == "A & b\nx\ny\n1 | 2\nC\nz" and out[0][2] == {"A & b": "xy12", "C": "z"}
    assert out[1][1] is None and [r[1] for r in out[2:]] == ["", "plain", "open", "yes"]


def test_content_area_of_a_wiki_page():
    def text(page):
        parser = PageText()
        parser.feed(page)
        parser.close()
        return parser.result()[0]

    assert text('<div id="nav">menu</div><div id="bodyContent"><p>kept</p></div><div class="printfooter">foot</div>') == "menu\nkept\nfoot"
    from loomgraph.sources.html import content_area

    wiki = '<div id="nav">menu</div><div id="bodyContent"><p>kept</p><div class="printfooter">foot</div></div>'
    assert text(content_area(wiki)) == "kept"
    assert text(content_area('<p>menu</p><div class="a mw-parser-output b"><p>kept</p></div><div class="printfooter">x</div>')) == "kept"
    assert text(content_area('<p>menu</p><div class="patternTopic"><p>kept</p></div><!-- /patternTopic--><p>x</p>')) == "kept"
    assert content_area("<p>all</p>") == "<p>all</p>"


def test_code_is_cut_between_units():
    rng = random.Random(2)
    unit = lambda i: f"def f{i}(x):\n" + "\n".join("    y = x" for _ in range(rng.randint(1, 6)))
    for text in ["", "x = 1", "\n\n", "# only\n@a\n", "\n\n".join(unit(i) for i in range(30)), "z" * 500]:
        for size in (40, 120, 10_000):
            out = list(chunks.code_chunks(text, size, 0))
            assert "\n".join(t for _, _, t in out) == text
            assert [a for a, _, _ in out] == [0, *(b + 1 for _, b, _ in out)][: len(out)]
            assert all(len(t) + 1 <= size or "\n" not in t for _, _, t in out)
    parts = [t for _, _, t in chunks.code_chunks("\n".join(unit(i) for i in range(30)), 200, 0)]
    assert all(p.startswith("def ") for p in parts)
