"""Text chunks of bounded size with overlap, cut at separators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.syntax import SYNTAXES, unit_lines


def chunks(text: str, size: int = 10_000, overlap: int = 200, separator: str = "\n") -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text) of each chunk.

    A chunk closes before the line that would take it past ``size``. The next one repeats the fewest last lines
    that reach ``overlap`` characters, or none if all of them don't.
    """
    lines = text.split(separator)
    lengths = [len(x) + len(separator) for x in lines]
    start, filled = 0, 0
    for at, n in enumerate(lengths):
        if filled + n > size and at > start:
            yield start, at - 1, separator.join(lines[start:at])
            back, total = at, 0
            while back > start and total < overlap:
                back -= 1
                total += lengths[back]
            start, filled = (back, total) if total >= overlap else (at, 0)
        filled += n
    yield start, len(lines) - 1, separator.join(lines[start:])


#: Lines at the start of a line that go on with what is before: closing signs and branches.
GOES_ON = ("}", ")", "]", "else", "elif", "except", "finally", "end", "catch")


def code_units(text: str) -> list[list[str]]:
    """The lines of a source text in units: a line without indentation begins one, unless it closes or goes on with the last.

    Decorators and comments stay with what follows them, blank lines with what is before.
    """
    units: list[list[str]] = [[]]
    leads = False
    for line in text.split("\n"):
        own = line[:1].strip() and not line.startswith(GOES_ON)
        if own and not leads and units[-1]:
            units.append([])
        units[-1].append(line)
        if own:
            leads = line.startswith(("@", "#", "!", "//"))
    return units


def code_chunks(text: str, size: int = 10_000, overlap: int = 10, language: str | None = None) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text) of chunks that end between units of code; the next repeats the last ``overlap`` lines.

    A unit over ``size`` is cut like text, without lines repeated before it. A language that isn't known goes by indentation.
    """
    start, lines, filled = 0, [], 0
    for unit in unit_lines(text, language) if language in SYNTAXES else code_units(text):
        n = sum(map(len, unit)) + len(unit)
        if lines and filled + n > size:
            yield start, start + len(lines) - 1, "\n".join(lines)
            kept = lines[len(lines) - min(overlap, len(lines)) :] if n <= size else []
            start, lines = start + len(lines) - len(kept), list(kept)
            filled = sum(map(len, lines)) + len(lines)
        if n > size:
            for first, last, part in chunks("\n".join(unit), size, overlap * 60):
                yield start + first, start + last, part
            start, lines, filled = start + len(unit), [], 0
            continue
        lines += unit
        filled += n
    if lines:
        yield start, start + len(lines) - 1, "\n".join(lines)


def chunk_rows(df: DataFrame, key: str, text: str, size: int = 10_000, overlap: int = 200, separator: str = "\n", code: bool = False, language: str | None = None) -> DataFrame:
    """(key, chunk, start_line, end_line, text) for every row; a null text gives no chunks.

    With ``code`` chunks end between units of code and ``overlap`` counts lines; ``language`` names the column that has the language.
    """
    cut = (lambda t, x: code_chunks(t, size, overlap, x)) if code else (lambda t, x: chunks(t, size, overlap, separator))
    schema = pa.schema([(key, pa.int64()), ("chunk", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                rows = [(k, n, *c) for k, t, x in zip(*(part.column(c).to_pylist() for c in range(3))) if t is not None for n, c in enumerate(cut(t, x))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    spoken = F.col(language) if language else F.lit(None).cast("string")
    return df.select(F.col(key).cast("long").alias(key), F.col(text), spoken.alias("spoken")).mapInArrow(run, f"{key} long, chunk int, start_line int, end_line int, text string")
