"""PII: spans of personal data, and information-theoretic sanitisation of what gives them away.

Four kinds of entity come from patterns. The corpus then tells which plain terms disclose an entity. Candidates are
the few words on either side of an entity. For entity c and term t the disclosure is PMI(c; t) / IC(c), with
PMI = log(N n(c,t) / (n(c) (n(t) + UNSEEN))) and IC = log(N / n(c)), where N counts documents and n(c), n(t) and n(c,t)
those that contain c, t and both, t anywhere in them. That is 1 + log P(c|t) / IC(c), with UNSEEN documents put beside
those with t that don't hold c: a term seen once with an entity seen once is rated, as P = 1/2, and nears 1 as evidence
grows. Terms at or over the threshold become spans of kind ``term`` in every document that contains both: generalised
to the class of their form ([NUMBER], [CODE], [NAME], [WORD]), or removed where they disclose c fully.

Counts cover all documents. Only column functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.expr import let, no_items, positions, total
from loomgraph.plans.shared import cut, join_counted

# The patterns of the four kinds, in order. Possessive repeats and the look-behinds don't change what
# matches; they keep the search linear in long runs and off the stack.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of these has no valid match of the kind either.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
KINDS = (*PATTERNS, "term")
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

CONTEXT_WORDS = 4
CONTEXT_CHARS = 80
#: Documents with a term but without the entity that are assumed beside those counted.
UNSEEN = 1
GENERALISE_AT = 0.8
REMOVE_AT = 0.999
#: Terms are runs of letters, digits and anything outside ASCII, in lower case.
BETWEEN_TERMS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
IN_TERM = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"

SPAN = "struct<kind:int,start:int,end:int,label:string>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def share(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        doubled = F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, doubled).otherwise(d)

    return total(F.transform(positions(n), share), "int") % 10 == 0


def is_valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(match, F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
    if kind == "card":
        return let(F.regexp_replace(match, "[ -]", ""), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def matches_at(text: Column, pattern: Column, valid) -> Column:
    """Array of (start, end, match) of the valid matches in order; code points, end exclusive.

    Places follow from the lengths of the matches and of what stands between them.
    """

    def place(m: Column, gap: Column, i: Column) -> Column:
        before = total(F.slice(gap, 1, i + 1), "int") + total(F.transform(F.slice(m, 1, i), lambda x: F.length(x)), "int")
        return let(before, lambda s: F.struct(s.alias("start"), (s + F.length(F.get(m, i))).alias("end"), F.get(m, i).alias("match")))

    def places(m: Column, gap: Column) -> Column:
        good = F.filter(positions(F.size(m)), lambda i: valid(F.get(m, i)))
        return F.transform(good, lambda i: place(m, gap, i))

    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: let(gaps, lambda g: places(m, g)))


def entity_spans(text: Column, kind: str) -> Column:
    """Array of (start, end, match) for one kind; empty if a cheap search finds no hint of it."""
    hint = F.contains(text, F.lit(HINTS[kind])) if kind == "email" else F.regexp_like(text, F.lit(HINTS[kind]))
    found = matches_at(text, F.lit(PATTERNS[kind]), lambda m: is_valid(kind, m))
    return F.when(hint, found).otherwise(no_items("struct<start:int,end:int,match:string>"))


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BETWEEN_TERMS), lambda w: w != "")


def base_spans(text: Column) -> Column:
    """All base spans as an array of (kind, start, end, match), by kind and then start."""
    tagged = lambda k, kind: F.transform(
        entity_spans(text, kind), lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"))
    )
    return F.concat(*[tagged(k, kind) for k, kind in enumerate(PATTERNS)])


def context_of(text: Column, span: Column) -> Column:
    """Distinct terms among the CONTEXT_WORDS before and after a span, within CONTEXT_CHARS on either side.

    A term that those characters cut is left out: with one character more, it is what touches the far end.
    """
    lead = F.greatest(F.lit(0), span["start"] - CONTEXT_CHARS - 1)
    left = F.substring(text, lead + 1, span["start"] - lead)
    right = F.substring(text, span["end"] + 1, F.lit(CONTEXT_CHARS + 1))
    before = terms_of(F.when(lead > 0, F.regexp_replace(left, f"^{IN_TERM}+", "")).otherwise(left))
    after = terms_of(F.when(F.length(right) > CONTEXT_CHARS, F.regexp_replace(right, f"{IN_TERM}+$", "")).otherwise(right))
    near = lambda b: F.slice(b, F.greatest(F.size(b) - CONTEXT_WORDS + 1, F.lit(1)), F.lit(CONTEXT_WORDS))
    return F.array_distinct(F.concat(let(before, near), F.slice(after, 1, CONTEXT_WORDS)))


def entities_in(text: Column, spans: Column) -> Column:
    """Array of (entity, terms) for the base spans of a text."""
    kinds = F.array(*[F.lit(k) for k in PATTERNS])
    name = lambda s: F.concat(F.get(kinds, s["kind"]), F.lit(":"), F.lower(s["match"]))
    return F.transform(spans, lambda s: F.struct(name(s).alias("entity"), F.sort_array(context_of(text, s)).alias("terms")))


def disclosing_terms(found: DataFrame, texts: DataFrame, generalise_at: float, remove_at: float) -> DataFrame:
    """(text_key, term, label): the terms of each text that disclose one of its entities at or over ``generalise_at``.

    ``found`` has arrays ``entities`` and ``words`` (all terms) and the number of documents ``copies`` for each text
    with entities, ``texts`` the column text of all documents.
    """
    n_docs = texts.count()
    held = cut(found.select("text_key", "copies", F.explode(F.array_distinct(F.transform("entities", lambda e: e["entity"]))).alias("entity")))
    n_entity = held.groupBy("entity").agg(F.sum("copies").alias("n_entity"))
    plain = lambda e: F.transform(e["terms"], lambda t: F.struct(e["entity"].alias("entity"), t.alias("term")))
    pairs = cut(found.select(F.explode(F.array_distinct(F.flatten(F.transform("entities", plain)))).alias("s")).select("s.*").distinct())
    all_terms = texts.select(F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    # counted before the join, which then meets one row for each term instead of one for each document with it
    # (an inner join with distinct terms, as the optimizer would move a semi-join below the count again)
    n_term = join_counted(all_terms.groupBy("term").agg(F.count("*").alias("n_term")), cut(pairs.select("term").distinct()), "term", "inner")

    def disclosure(n_both: Column) -> Column:
        pmi = F.log(F.lit(float(n_docs)) * n_both / (F.col("n_entity") * (F.col("n_term") + UNSEEN)))
        content = F.log(F.lit(float(n_docs)) / F.col("n_entity"))
        return F.when(content > 0, pmi / content)

    # n_both is at most the smaller of the two counts, so what falls short with that needs no count of both
    likely = pairs.join(n_entity, "entity").join(n_term, "term").where(disclosure(F.least("n_entity", "n_term")) >= generalise_at)
    words = found.select("text_key", F.explode("words").alias("term"))
    both = join_counted(words, cut(likely), "term", "inner").join(held, ["text_key", "entity"])
    both = cut(both.select("text_key", "copies", "entity", "term", "n_entity", "n_term"))
    counted = both.groupBy("entity", "term").agg(F.sum("copies").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    rated = counted.withColumn("disclosure", disclosure(F.col("n_both"))).where(F.col("disclosure") >= generalise_at)
    told = both.select("text_key", "entity", "term").join(rated.select("entity", "term", "disclosure"), ["entity", "term"])
    label = F.when(F.max("disclosure") >= remove_at, F.lit("")).otherwise(class_of(F.col("term")))
    return told.groupBy("text_key", "term").agg(label.alias("label"))


def class_of(term: Column) -> Column:
    """The class that a term is generalised to by its form: a number, a code with digits in it, or a word."""
    has_digit = F.regexp_like(term, F.lit("[0-9]"))
    return F.when(F.regexp_like(term, F.lit("^[0-9]+$")), "[NUMBER]").when(has_digit, "[CODE]").otherwise("[WORD]")


def term_spans(text: Column, terms: Column, base: Column) -> Column:
    """Spans of the given (term, label) as whole terms outside the base spans."""
    longest_first = F.array_sort(F.transform(terms, lambda t: t["term"]), lambda a, b: F.length(b) - F.length(a))
    pattern = F.concat(F.lit(rf"(?iu)(?<!{IN_TERM})(?:"), F.array_join(longest_first, "|"), F.lit(rf")(?!{IN_TERM})"))
    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    given = lambda s: F.coalesce(F.get(F.filter(terms, lambda t: t["term"] == F.lower(s["match"])), F.lit(0))["label"], F.lit("[WORD]"))
    is_name = lambda s: (given(s) == "[WORD]") & F.regexp_like(s["match"], F.lit(r"^\p{Lu}"))
    label = lambda s: F.when(is_name(s), "[NAME]").otherwise(given(s))
    as_span = lambda s: F.struct(F.lit(KINDS.index("term")).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), label(s).alias("label"))
    found = let(pattern, lambda p: F.transform(F.filter(matches_at(text, p, lambda m: F.lit(True)), free), as_span))
    return F.when(F.size(terms) > 0, found).otherwise(no_items(SPAN))


def rewritten(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its label; spans that overlap become one, named by the first."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        between = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        fresh = F.struct(s["end"].alias("at"), F.concat(a["out"], between, s["label"]).alias("out"))
        longer = F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))
        return F.when(s["start"] >= a["at"], fresh).otherwise(longer)

    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    done = F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def sanitise(docs: DataFrame, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """Per document: ``row`` (the input row), ``base``, ``spans`` (kind, start, end, label) and ``clean_text``.

    Null and empty texts have no spans and an empty ``clean_text``. Equal texts get equal results; repeated rows
    stay. Documents without entities keep their text. Input columns can have any names, as they stay in ``row``.
    An empty table gives an empty result.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    spotted = whole.select("row", "text", F.md5(F.col("text").cast("binary")).alias("text_key"), let(F.col("text"), base_spans).alias("base"))
    found = spotted.where(F.size("base") > 0).select("text_key", entities_in(F.col("text"), F.col("base")).alias("entities"), F.array_distinct(terms_of(F.col("text"))).alias("words"))
    found = cut(found.groupBy("text_key").agg(F.first("entities").alias("entities"), F.first("words").alias("words"), F.count("*").alias("copies")))
    disclosing = disclosing_terms(found, whole.select("text"), generalise_at, remove_at)
    terms = disclosing.groupBy("text_key").agg(F.collect_list(F.struct("term", "label")).alias("terms"))
    out = join_counted(spotted, cut(terms), "text_key", "left")
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in PATTERNS])
    named = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.get(labels, s["kind"]).alias("label")))
    none = no_items("struct<term:string,label:string>")
    more = let(F.coalesce(F.col("terms"), none), lambda t: term_spans(F.col("text"), t, F.col("base")))
    out = out.withColumn("spans", F.concat(named, more))
    return out.select("row", "base", "spans", rewritten(F.col("text"), F.col("spans")).alias("clean_text"))


def sanitised_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with sanitised texts; a null text stays null, and ``n_chars``, if there, is set to the new length."""
    out = sanitise(docs, **how)
    text = F.when(F.col("row.text").isNotNull(), F.col("clean_text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        changed = F.size("spans") > 0
        new["n_chars"] = F.when(changed, F.length("clean_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
