"""HTML pages to text with sections."""

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose text is no content, elements that end a line, and headings.
SKIPPED = {"script", "style", "noscript", "template", "title"}
BLOCKS = {"p", "div", "li", "tr", "br", "ul", "ol", "table", "section", "article", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}
#: A new part of the page ends what was skipped; so does the end of one.
CONTENT = {"body", "article", "main", "section", "h1", "h2"}
CLOSING = {"body", "html", "head"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


# What marks the content of wiki pages, in order: where it begins, and what ends it.
AREAS = (
    (r'class="patternTopic">', r"</div>\s*<!--\s*/patternTopic"),
    (r'<div id="bodyContent">', r'<div class="printfooter">'),
    (r'(?i)<div[^>]*class="[^"]*mw-parser-output[^"]*"[^>]*>', r'(?i)</div>\s*<div[^>]*class="[^"]*printfooter'),
)


def content_area(page: str) -> str:
    """The content of a wiki page without what stands around it; any other page as it is. Without an end it goes on to the page's."""
    for begin, end in AREAS:
        if found := re.search(begin, page):
            rest = page[found.end() :]
            stop = re.search(end, rest)
            return rest[: stop.start()] if stop else rest
    return page


class PageText(HTMLParser):
    """Collects lines, and the lines under each heading; table cells are parted by bars."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = [""]
        self.sections: dict[str, list[str]] = {}
        self.skip: list[str] = []
        self.heading, self.current = None, None

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip.append(tag)
        elif tag in CONTENT and self.skip:  # an element that was never closed
            self.skip.clear()
        if tag in HEADINGS:
            self.heading = ""
        if tag in BLOCKS:
            self.lines.append("")
        elif tag in ("td", "th") and self.lines[-1].strip():
            self.lines[-1] += " | "

    def handle_endtag(self, tag):
        if tag in self.skip:
            del self.skip[self.skip.index(tag) :]
        elif tag in CLOSING:
            self.skip.clear()
        if tag in HEADINGS and self.heading is not None:
            self.current, self.heading = " ".join(self.heading.split()), None
            self.sections.setdefault(self.current, [])
        if tag in BLOCKS:
            self.lines.append("")

    def handle_data(self, data):
        if self.skip:
            return
        self.lines[-1] += data
        if self.heading is not None:
            self.heading += data
        elif self.current is not None:
            self.sections[self.current].append(data)

    def result(self) -> tuple[str, dict[str, str]]:
        lines = [" ".join(x.split()) for x in self.lines]
        return "\n".join(x for x in lines if x), {k: " ".join("".join(v).split()) for k, v in self.sections.items()}


def page_text(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text, sections): null pages give null text and no sections."""
    @F.pandas_udf("text string, sections map<string,string>")
    def parse(column: pd.Series) -> pd.DataFrame:
        rows = []
        for page in column:
            parser = PageText()
            if page is not None:
                parser.feed(content_area(page))
                parser.close()
            rows.append(parser.result() if page is not None else (None, {}))
        return pd.DataFrame(rows, columns=["text", "sections"])

    return pages.select(key, parse(html).alias("r")).select(key, "r.text", "r.sections")
