"""Quality rules by distribution divergence.

Each document gets two histograms: its characters by class, and its words over common words of four languages.
Both are compared with a reference for the document's language by Jensen-Shannon distance (base 2, so 0 to 1).
References are the mean histograms of all documents of a language that pass the base rules and are long enough;
documents in other languages, or none, are compared with the mean over all of those documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.expr import let, positions, total
from loomgraph.functions.text import words
from loomgraph.plans.shared import cut

# Frequent words of the languages that have a reference.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "on", "are"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
}
LANGUAGES = tuple(COMMON_WORDS)
VOCABULARY = sorted({w for ws in COMMON_WORDS.values() for w in ws})
#: One sign for each common word, so that a text's words become a short string that counts fast.
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"[: len(VOCABULARY)]
LONGEST_COMMON = max(map(len, VOCABULARY))
# Classes of characters, each counted in what the classes before it leave.
CHARACTER_CLASSES = (
    ("lower", r"[a-z]+"),
    ("space", r"[\x20\x09-\x0D]+"),
    ("upper", r"[A-Z]+"),
    ("symbol", r"[#*$%&|<>]+"),
    ("digit", r"[0-9]+"),
    ("stop", r"[.,;:!?'\"()-]+"),
)

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Shorter documents are not judged by divergence: too few draws to tell.
MIN_CHARS_FOR_CLASSES = 200
MIN_WORDS_FOR_COMMON = 100
MAX_CLASS_DISTANCE = 0.3
MAX_COMMON_DISTANCE = 0.36


def repeated_words(w: Column) -> Column:
    """Number of words in 3-word windows that occur twice or more; windows are compared by 64-bit hash."""

    def covered(starts: Column) -> Column:
        step = lambda s, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - s, F.lit(3)))
        return total(F.transform(starts, step))

    def by_search(grams: Column, again: Column) -> Column:
        return F.filter(positions(F.size(grams)), lambda i: F.array_contains(again, F.get(grams, i)))

    def by_sort(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        equal = lambda p, z, i: F.coalesce(F.get(p, i)["g"] == z["g"], F.lit(False))
        twice = let(pairs, lambda p: F.filter(p, lambda z, i: ((i > 0) & equal(p, z, i - 1)) | equal(p, z, i + 1)))
        return F.sort_array(F.transform(twice, lambda z: z["i"]))

    def count(grams: Column) -> Column:
        ordered = F.sort_array(grams)
        again = let(ordered, lambda o: F.array_distinct(F.filter(o, lambda g, i: (i > 0) & (g == F.get(o, i - 1)))))
        starts = lambda d: F.when(F.size(d) <= 24, by_search(grams, d)).otherwise(by_sort(grams))
        return let(again, lambda d: F.when(F.size(d) == 0, F.lit(0).cast("long")).otherwise(let(starts(d), covered)))

    grams = lambda w: F.transform(positions(F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return let(w, lambda w: let(grams(w), count))


def measure(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, lang, the base counts, ``classes`` and ``commons`` (arrays of counts)."""
    out = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("t0"))
    names = []
    for i, (name, pattern) in enumerate(CHARACTER_CLASSES):
        out = out.withColumn(f"t{i + 1}", F.regexp_replace(f"t{i}", pattern, ""))
        names.append((F.length(f"t{i}") - F.length(f"t{i + 1}")).cast("long").alias(name))
    left = F.length(f"t{len(CHARACTER_CLASSES)}").cast("long")
    out = out.select("doc_id", "lang", F.col("t0").alias("text"), *names, left.alias("other"), F.length("t0").cast("long").alias("n_chars"))
    out = out.withColumn("w", words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    vocabulary = F.array(*[F.lit(w) for w in VOCABULARY])
    sign = lambda w: F.when(
        F.length(w) <= LONGEST_COMMON, F.substring(F.lit("." + SIGNS), F.array_position(vocabulary, F.lower(w)).cast("int") + 1, F.lit(1))
    ).otherwise(F.lit("."))
    signs = F.array_join(F.transform("w", sign), "")
    counted = lambda s: F.array(*[(F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))).cast("long") for c in SIGNS])
    out = out.select(
        "doc_id",
        "lang",
        F.size("w").cast("long").alias("n_words"),
        (F.col("n_chars") - F.col("space")).alias("word_chars"),
        F.col("symbol").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
        F.array(*[name for name, _ in CHARACTER_CLASSES], "other").alias("classes"),
        let(signs, counted).alias("named"),
    )
    rest = F.col("n_words") - total(F.col("named"))
    out = out.withColumn("commons", F.concat("named", F.array(rest))).drop("named")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def shares(counts: Column) -> Column:
    """Counts as shares of their sum; all 0 for an empty histogram."""
    return let(total(counts), lambda n: F.transform(counts, lambda c: F.when(n > 0, c / n).otherwise(F.lit(0.0))))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, base 2."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    return F.sqrt(F.greatest(F.lit(0.0), total(F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2), "double")))


def language_references(measured: DataFrame) -> dict[str | None, dict[str, list[float]]]:
    """Mean histograms: at most one row for each of the four languages and one for all; None has that for all."""
    known = F.when(F.col("lang").isin(*LANGUAGES), F.col("lang"))
    usable = measured.where(~F.col("base_failed") & (F.col("n_words") >= MIN_WORDS_FOR_COMMON)).select(
        known.alias("known"), shares(F.col("classes")).alias("classes"), shares(F.col("commons")).alias("commons")
    )
    sizes = {"classes": len(CHARACTER_CLASSES) + 1, "commons": len(VOCABULARY) + 1}
    means = [F.sum(F.col(name)[i]).alias(f"{name}_{i}") for name, n in sizes.items() for i in range(n)]
    rows = usable.groupBy("known").agg(F.count("*").alias("n"), *means).collect()
    of = lambda some: {name: [sum(r[f"{name}_{i}"] for r in some) / max(1, sum(r["n"] for r in some)) for i in range(n)] for name, n in sizes.items()}
    return {r["known"]: of([r]) for r in rows if r["known"]} | {None: of(rows)}


def judge(docs: DataFrame, max_class_distance: float = MAX_CLASS_DISTANCE, max_common_distance: float = MAX_COMMON_DISTANCE) -> DataFrame:
    """Per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    common_distance, kept``.

    A null or empty text has counts 0 and fails the base rules. Distances are null for documents under their
    minimum length, which are then not judged by them; so are all if no document can serve as reference.
    Repeated rows are judged one by one; other columns are ignored.
    """
    measured = cut(measure(docs))
    references = language_references(measured)

    def reference(name: str) -> Column:
        flat = lambda values: F.array(*[F.lit(float(v)) for v in values])
        out = flat(references[None][name])
        for lang in LANGUAGES:
            if lang in references:
                out = F.when(F.col("lang").eqNullSafe(lang), flat(references[lang][name])).otherwise(out)
        return out

    def distance(name: str, long_enough: Column) -> Column:
        if not sum(references[None][name]):
            return F.lit(None).cast("double")
        return F.when(long_enough, let(reference(name), lambda q: let(shares(F.col(name)), lambda p: js_distance(p, q))))

    judged = measured.withColumn("class_distance", distance("classes", total(F.col("classes")) >= MIN_CHARS_FOR_CLASSES))
    judged = judged.withColumn("common_distance", distance("commons", F.col("n_words") >= MIN_WORDS_FOR_COMMON))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= max_class_distance) & (F.coalesce("common_distance", F.lit(0.0)) <= max_common_distance)
    return judged.withColumn("kept", ~F.col("base_failed") & near).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "common_distance", "kept"
    )
