"""Units of source texts: where a statement begins that is inside nothing, by a small reader for each family of languages.

A text is read line by line in a state: the sign that ends an open string or comment, the depth of brackets and blocks, and
whether a statement goes on in the next line. Strings and comments are blanked, so signs and words in them count for nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache


@dataclass(frozen=True)
class Syntax:
    """What a family of languages is read by."""

    line_comments: tuple[str, ...] = ()
    block_comments: tuple[tuple[str, str], ...] = ()
    strings: tuple[str, ...] = ('"', "'")
    long_strings: tuple[str, ...] = ()  # may go over several lines
    escape: str = "\\"  # empty: a doubled quote stands for itself
    begins: str = ""  # statements that begin a block
    ends: str = ""
    goes_on: str = ""  # statements that belong to the unit before them
    continued: str = r"\\$"  # lines whose statement goes on in the next one
    by_indent: bool = False
    any_case: bool = False


C = Syntax(line_comments=("//",), block_comments=(("/*", "*/"),), goes_on=r"[{})\]]|else\b|catch\b|finally\b")
FORTRAN = Syntax(
    line_comments=("!",), escape="", any_case=True, continued=r"&$",
    begins=r"(?:(?:pure|elemental|recursive|impure|integer|real|complex|logical|character|double\s+precision|type\s*\([^)]*\))\b(?:\s*\([^)]*\))?\s*)*(?:subroutine|function)\s+\w|program\s+\w|module\s+(?!procedure\b)\w|(?:abstract\s+)?interface\b|type\s*(?:::|,|\s\w)|(?:\w+\s*:\s*)?do\b|(?:\w+\s*:\s*)?if\s*\(.*\)\s*then\b|select\s+(?:case|type)\b|associate\s*\(|block\b",
    ends=r"end(?:$|\s*(?:subroutine|function|program|module|interface|type|do|if|select|associate|block)?\b(?!\s*[=(]))",
    goes_on=r"contains\b|else\b|elseif\b|case\b",
)
#: By the name of the language.
SYNTAXES = {
    "python": Syntax(line_comments=("#",), long_strings=('"""', "'''"), by_indent=True, goes_on=r"[)\]}]|else\b|elif\b|except\b|finally\b"),
    "c": C,
    "cpp": C,
    "java": C,
    "fortran": FORTRAN,
    "matlab": Syntax(line_comments=("%",), block_comments=(("%{", "%}"),), escape="", continued=r"\.\.\.$", begins=r"(?:function|if|for|while|switch|try|parfor|classdef|properties|methods)\b", ends=r"end\b", goes_on=r"else\b|elseif\b|case\b|otherwise\b|catch\b"),
    "julia": Syntax(line_comments=("#",), block_comments=(("#=", "=#"),), strings=('"',), long_strings=('"""',), begins=r"(?:function|if|for|while|try|struct|mutable\s+struct|module|begin|let|macro|quote)\b", ends=r"end\b", goes_on=r"else\b|elseif\b|catch\b|finally\b", continued=r"[,=+*]$"),
    "idl": Syntax(line_comments=(";",), escape="", any_case=True, continued=r"\$$", begins=r"(?:pro|function)\s+\w|.*\bbegin$", ends=r"end(?:if|else|for|foreach|while|case|switch|rep)?\b(?!\s*=)"),
    "bash": Syntax(line_comments=("#",), long_strings=('"', "'"), strings=(), begins=r"(?:if|for|while|until|case)\b", ends=r"(?:fi|done|esac)\b", goes_on=r"[})]|else\b|elif\b"),
}


@lru_cache(maxsize=32)
def openings(syntax: Syntax) -> re.Pattern:
    """What ends ordinary code: comments and strings, the longest signs first."""
    signs = [*syntax.line_comments, *(a for a, _ in syntax.block_comments), *syntax.strings, *syntax.long_strings]
    return re.compile("|".join(re.escape(s) for s in sorted(set(signs), key=lambda s: (-len(s), s))))


def closing(line: str, at: int, sign: str, syntax: Syntax) -> int:
    """Where the string or comment that ``sign`` ends stops being open, or -1."""
    quote = sign in syntax.strings or sign in syntax.long_strings
    while True:
        found = line.find(sign, at)
        if found < 0 or not quote:
            return found + len(sign) if found >= 0 else -1
        if syntax.escape:
            back = len(line[:found]) - len(line[:found].rstrip(syntax.escape))
            if back % 2:
                at = found + 1
                continue
        elif len(sign) == 1 and line.startswith(sign * 2, found):
            at = found + 2
            continue
        return found + len(sign)


def bare_lines(text: str, syntax: Syntax) -> Iterator[tuple[str, str, bool]]:
    """(line, the same with strings and comments blanked, whether it begins inside of one)."""
    opens, ends = openings(syntax), dict(syntax.block_comments)
    until = None
    for line in text.split("\n"):
        bare, at, inside = [], 0, until is not None
        while at < len(line):
            if until is not None:
                to = closing(line, at, until, syntax)
                if to < 0:
                    break
                bare.append("" if until in ends.values() else "_")
                at, until = to, None
                continue
            m = opens.search(line, at)
            if not m:
                bare.append(line[at:])
                break
            bare.append(line[at : m.start()])
            sign, at = m[0], m.end()
            if sign in syntax.line_comments and sign not in ends:
                break
            if sign in ends or sign in syntax.long_strings:
                until = ends.get(sign, sign)
                continue
            to = closing(line, at, sign, syntax)
            bare.append("_")
            if to < 0:
                break
            at = to
        yield line, "".join(bare), inside


def unit_lines(text: str, language: str) -> list[list[str]]:
    """The lines of a source text in units; comments and decorators stay with what follows them, the rest with what is before."""
    syntax = SYNTAXES[language]
    flags = re.IGNORECASE if syntax.any_case else 0
    matches = lambda pattern, code: bool(pattern) and re.match(pattern, code, flags) is not None
    units: list[list[str]] = [[]]
    ahead: list[str] = []  # comments and decorators of a unit to come
    depth, continued, decorating = 0, False, False
    for line, bare, inside in bare_lines(text, syntax):
        code = bare.strip()
        free = depth == 0 and not inside and not continued
        if (free or (ahead and inside and depth == 0)) and not code and line.strip():
            ahead.append(line)
            continue
        if decorating or (free and code.startswith("@") and syntax.by_indent and not line[:1].isspace()):
            ahead.append(line)
            depth += sum(map(code.count, "([{")) - sum(map(code.count, ")]}"))
            continued = re.search(syntax.continued, code) is not None
            decorating = depth > 0 or continued
            continue
        own = free and bool(code) and not (syntax.by_indent and line[:1].isspace()) and not matches(syntax.goes_on, code)
        if own and any(x.strip() for x in units[-1]):
            units.append([])
        units[-1] += [*ahead, line]
        ahead = []
        depth += sum(map(bare.count, "([{")) - sum(map(bare.count, ")]}"))
        if not continued and not inside:
            depth += matches(syntax.begins, code) - matches(syntax.ends, code)
        depth = max(depth, 0)
        continued = re.search(syntax.continued, bare.rstrip()) is not None if code else continued
    units[-1] += ahead
    return units
