"""Landed files as tables: dictionary XML, notebooks, equilibria, JSON documents, wiki markup, code by extension."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Language and kind of a file by its extension.
LANGUAGES = {"py": "python", "f90": "fortran", "f": "fortran", "m": "matlab", "pro": "idl", "c": "c", "cpp": "cpp", "h": "c", "jl": "julia", "sh": "bash", "java": "java", "tdi": "tdi", "fun": "tdi"}
KINDS = {"ipynb": "notebook", "pdf": "document", "docx": "document", "pptx": "presentation", "xlsx": "spreadsheet", "csv": "data", "h5": "data", "nc": "data", "json": "config", "yaml": "config", "xml": "config"}

PATHS = "file string, path string, parent_path string, name string, data_type string, units string, documentation string, label string, depth int, is_leaf boolean"


def whole_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, value): the files of a folder as texts."""
    return spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("file"), "value")


def dictionary_paths(texts: DataFrame, root: str = "IDS", child: str = "field") -> DataFrame:
    """One row for each field of dictionary files (file, value), with its whole path; a file is parsed in one task."""

    def walk(node, prefix: str, depth: int) -> Iterator[tuple]:
        name = node.get("name")
        path = f"{prefix}/{name}" if prefix else name
        inner = node.findall(child)
        yield path, prefix or None, name, node.get("data_type"), node.get("units"), node.get("documentation"), node.get("cocos_label_transformation"), depth, not inner
        for x in inner:
            yield from walk(x, path, depth + 1)

    def run(batches):
        import pandas as pd

        for batch in batches:
            for file, text in zip(batch["file"], batch["value"]):
                rows = [(file, *r) for top in ET.fromstring(text).iter(root) for r in walk(top, "", 0)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PATHS.split(", ")])

    return texts.select("file", "value").mapInPandas(run, PATHS)


def dictionary_conventions(texts: DataFrame) -> DataFrame:
    """(file, convention, n_labelled): the convention that a dictionary file declares, and its labelled fields."""
    number = F.regexp_extract("value", r"<cocos>\s*([0-9]+)\s*</cocos>", 1)
    labels = F.regexp_count("value", F.lit(r"cocos_label_transformation=\"[^\"]"))
    return texts.select("file", F.nullif(number, F.lit("")).cast("int").alias("convention"), labels.alias("n_labelled"))


def identifier_catalogue(schemas: DataFrame) -> DataFrame:
    """(schema, n, options): enumerations from rows (schema, options), options as JSON of {name, index, description}, by index."""
    kind = "array<struct<name:string,index:int,description:string>>"
    each = schemas.select("schema", F.explode(F.from_json("options", kind)).alias("o")).select("schema", "o.*").where("name is not null").distinct()
    listed = F.sort_array(F.collect_list(F.struct("index", "name", "description")))
    return each.groupBy("schema").agg(F.count("*").alias("n"), listed.alias("options"))


def notebook_cells(texts: DataFrame) -> DataFrame:
    """(file, cell, kind, text) of notebooks (file, value); what is no notebook has no cells."""
    read = texts.select("file", F.posexplode(F.from_json("value", "cells array<struct<cell_type:string,source:array<string>>>").cells).alias("cell", "c"))
    return read.select("file", "cell", F.col("c.cell_type").alias("kind"), F.array_join("c.source", "").alias("text"))


def json_rows(texts: DataFrame, schema: str) -> DataFrame:
    """(file, ...): the fields of JSON documents (file, value) as columns; what can't be read gives nulls."""
    return texts.select("file", F.from_json("value", schema).alias("d")).select("file", "d.*")


def json_documents(spark: SparkSession, folder: str, schema: str, only: list[str] | None = None, key: str = "ids") -> DataFrame:
    """JSON documents of a folder, those of some groups only if asked for; the filter is pushed into the reader."""
    read = spark.read.schema(schema).json(folder, multiLine=True)
    return read.where(F.col(key).isin(*only)) if only else read


def equilibria(texts: DataFrame) -> DataFrame:
    """(file, psi_axis, psi_edge, field, current) of equilibrium files (file, value) with fixed-width numbers."""
    text = texts.select("file", F.split("value", "\n").alias("line"))
    numbers = lambda k: F.regexp_extract_all(F.get("line", F.lit(k)), F.lit(r"[ +-]?[0-9]\.[0-9]+[Ee][+-][0-9]{2}"), F.lit(0))
    value = lambda k, i: F.trim(F.get(numbers(k), F.lit(i))).cast("double")
    return text.select("file", value(2, 2).alias("psi_axis"), value(2, 3).alias("psi_edge"), value(2, 4).alias("field"), value(3, 0).alias("current"))


#: The numbers that stand before the profiles of an equilibrium file, those of its format that have a meaning.
EQUILIBRIUM_SCALARS = {"r_size": 0, "z_size": 1, "r_centre": 2, "r_left": 3, "z_middle": 4, "r_axis": 5, "z_axis": 6, "psi_axis": 7, "psi_edge": 8, "field": 9, "current": 10}
SCALARS = 20
#: The profiles after them, in order; the flux on the grid comes before the last.
PROFILES = ("poloidal_current", "pressure", "current_slope", "pressure_slope")
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[EeDd][+-]?[0-9]+)?"


def whole_equilibria(texts: DataFrame) -> DataFrame:
    """One row for each equilibrium file (file, value): title, nr, nz, scalars, profiles, flux, safety factor, boundary, limiter, error.

    The first line ends with the numbers of points; then all numbers follow in a row, of fixed width and not always with a space
    between them: scalars, profiles of nr values, the flux as nz rows of nr values, the safety factor, two counts and as many
    points (r, z) of boundary and limiter. ``error`` says what is wrong with a file: ``header`` without numbers of points, ``short``
    with the numbers there and needed; the rest is null then. Counts that are missing mean no points. Null texts are ``header``.
    """
    head = F.substring_index(F.coalesce("value", F.lit("")), "\n", 1)
    size = F.regexp_extract_all(head, F.lit(r"[0-9]+"), F.lit(0))
    body = F.translate(F.expr("substring(value, length(head) + 2)"), "Dd", "EE")
    rows = texts.select("file", "value", head.alias("head"), F.regexp_like(head, F.lit(r"(?:^|\s)[0-9]+\s+[0-9]+\s*$")).alias("sized"), size.alias("size"))
    rows = rows.withColumns({"nr": F.when(F.col("sized"), F.try_element_at("size", F.lit(-2)).cast("int")), "nz": F.when(F.col("sized"), F.try_element_at("size", F.lit(-1)).cast("int"))})
    rows = rows.select("file", "nr", "nz", F.trim(F.regexp_replace("head", r"(?:\s+[0-9]+){2,3}\s*$", "")).alias("title"), F.transform(F.regexp_extract_all(body, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double")).alias("numbers"))
    rows = rows.select("file", "nr", "nz", "title", F.explode(F.array("numbers")).alias("x"))  # so that the numbers are read once
    n, m, x = F.col("nr"), F.col("nz"), F.col("x")
    tail = SCALARS + (len(PROFILES) + 1) * n + n * m
    rows = rows.withColumn("error", F.when(n.isNull() | (n < 1) | (m < 1), "header").when(F.size(x) < tail, F.format_string("short: %d of %d", F.size(x), tail)))
    fine = lambda c: F.when(F.col("error").isNull(), c)
    count = lambda k: F.coalesce(F.get(x, tail + k).cast("int"), F.lit(0))
    points = lambda start, k: F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(F.get(x, start + 2 * i).alias("r"), F.get(x, start + 2 * i + 1).alias("z")))
    none = F.array().cast("array<struct<r:double,z:double>>")
    rows = rows.withColumns({"n_boundary": count(0), "n_limiter": count(1)})
    boundary = F.when(F.col("n_boundary") > 0, points(tail + 2, F.col("n_boundary"))).otherwise(none)
    limiter = F.when(F.col("n_limiter") > 0, points(tail + 2 + 2 * F.col("n_boundary"), F.col("n_limiter"))).otherwise(none)
    part = lambda start, length: F.slice(x, (start + 1).cast("int"), length)
    return rows.select(
        "file", "title", "nr", "nz",
        *[fine(F.get(x, F.lit(k))).alias(name) for name, k in EQUILIBRIUM_SCALARS.items()],
        *[fine(part(SCALARS + k * n, n)).alias(name) for k, name in enumerate(PROFILES)],
        fine(part(SCALARS + len(PROFILES) * n, n * m)).alias("flux"), fine(part(tail - n, n)).alias("safety_factor"),
        fine(boundary).alias("boundary"), fine(limiter).alias("limiter"), "error",
    )


def flux_grid(equilibria: DataFrame) -> DataFrame:
    """(file, i, j, r, z, psi): the flux of ``whole_equilibria`` as rows, with the place of each point; files with errors have none."""
    cells = equilibria.where("error is null").select("file", "nr", "nz", "r_left", "r_size", "z_middle", "z_size", F.posexplode("flux").alias("k", "psi"))
    i, j = F.col("k") % F.col("nr"), F.floor(F.col("k") / F.col("nr")).cast("int")
    step = lambda size, n: F.when(F.col(n) > 1, F.col(size) / (F.col(n) - 1)).otherwise(F.lit(0.0))
    return cells.select("file", i.alias("i"), j.alias("j"), (F.col("r_left") + step("r_size", "nr") * i).alias("r"), (F.col("z_middle") - F.col("z_size") / 2 + step("z_size", "nz") * j).alias("z"), "psi")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column) -> Column:
    """Language of a source file, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), extension(path))


def file_kind(path: Column) -> Column:
    """code, or what the extension stands for, or other."""
    named = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), extension(path))
    return F.when(language(path).isNotNull(), "code").otherwise(F.coalesce(named, F.lit("other")))


def markup_to_html(markup: Column) -> Column:
    """Wiki markup with headings, lists, emphasis, code and links as HTML, by one replacement for each construct."""
    rules = [(rf"(?m)^---\+{{{n}}}\s*(.+)$", rf"<h{n}>$1</h{n}>") for n in range(6, 0, -1)]
    rules += [(r"(?m)^\s{3,}[*]\s+(.+)$", "<li>$1</li>"), (r"\[\[([^\]]+)\]\[([^\]]+)\]\]", '<a href="$1">$2</a>'), (r"\[\[([^\]]+)\]\]", '<a href="$1">$1</a>')]
    rules += [(r"(?<![\w*])\*([^*\n]+)\*(?![\w*])", "<b>$1</b>"), (r"(?<![\w_])_([^_\n]+)_(?![\w_])", "<i>$1</i>"), (r"(?<![\w=])=([^=\n]+)=(?![\w=])", "<code>$1</code>")]
    out = markup
    for pattern, by in rules:
        out = F.regexp_replace(out, pattern, by)
    return out


def merged_versions(versions: DataFrame, key: str, order: Column) -> DataFrame:
    """(key, first, last, n): over which versions a path is there."""
    return versions.groupBy(key).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
