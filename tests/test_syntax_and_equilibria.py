"""Units of source texts, and whole equilibrium files written by a plain formatter."""

import random

import pytest

from loomgraph.functions import chunks, syntax
from loomgraph.sources import files

CASES = {
    "python": [
        ["import a"],
        ["x = {", "'b': 1,", "}", ""],
        ["# why", "@deco(", "  1)", "class C:", "    '''doc", "def fake():", "'''", "", "    def m(self):", '        return "#" + \\', "y", ""],
        ["if x:", "    pass", "else:", "    s = 'it\\'s (['", ""],
        ["def last(a,", "b):  # ([{", "    return a"],
    ],
    "c": [
        ["#include <x.h>"],
        ["/* a {", "   b } */", "int f(int a,", "      int b)", "{", '  char *s = "}\\"{";', "  if (a) { return '}'; } // }", "}", ""],
        ["struct s {", "  int x;", "};"],
        ["int g(void) { return 1; }"],
    ],
    "fortran": [
        ["! lead", "module m", "  implicit none", "contains", "  pure real function f(x)", "    if (x > 0) then ! end", "      f = 'end ''if'", "    else", "      do i = 1, 3", "      end do", "    endif", "  end function f", "END MODULE m", ""],
        ["SUBROUTINE s(a, &", "  endless)", "  endless = 1", "  if (a) return", "end"],
    ],
    "matlab": [["function y = f(x)", "  % end", "  if x, y = 'end'; ", "  for k = 1:3", "  end", "  end", "end", ""], ["function g()", "  disp('it''s')", "end"]],
    "julia": [["#= end", "=#", "function f(x)", '    s = """', "end", '"""', "    while true", "    end", "end", ""], ["g(x) = x"]],
    "idl": [["; lead", "pro p, a, $", "  b", "  if a then begin", "    x = 'end'", "  endif else begin", "    y = 1", "  endelse", "end", ""], ["function q", "  return, 1", "end"]],
    "bash": [["if true; then", '  echo "fi', 'done"', "fi", ""], ["for x in a; do", "  f", "done"], ["g"]],
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_units(language):
    units = CASES[language]
    text = "\n".join(line for u in units for line in u)
    assert syntax.unit_lines(text, language) == units
    got = list(chunks.code_chunks(text, max(sum(map(len, u)) + len(u) for u in units), 0, language))
    lines = text.split("\n")
    assert "\n".join(t for _, _, t in got) == text and all("\n".join(lines[a : b + 1]) == t for a, b, t in got)


@pytest.mark.parametrize("language", sorted(syntax.SYNTAXES))
def test_no_line_is_lost(language):
    rng = random.Random(1)
    signs = ["def f():", "  x", "{", "}", '"', "'''", "/*", "*/", "# c", "! c", "end", "if (a) then", "do", "", "(", ")", "@d", "else", "a & ", "\\", "%{", "x = 'a"]
    for _ in range(200):
        text = "\n".join(rng.choices(signs, k=rng.randint(0, 30)))
        assert "\n".join(line for u in syntax.unit_lines(text, language) for line in u) == text


def test_languages_in_rows(spark):
    rows = spark.createDataFrame([(1, "c", "int f() {\n}\nint g;"), (2, None, "a\nb"), (3, "c", None), (4, "unknown", "x\n y")], "id long, lang string, text string")
    found = [tuple(r) for r in chunks.chunk_rows(rows, "id", "text", 12, 0, code=True, language="lang").orderBy("id", "chunk").collect()]
    assert found == [(1, 0, 0, 1, "int f() {\n}"), (1, 1, 2, 2, "int g;"), (2, 0, 0, 1, "a\nb"), (4, 0, 0, 1, "x\n y")]


def equilibrium(rng, nr, nz, n_boundary, n_limiter, points=True):
    number = lambda x: f"{x:16.9E}"
    scalars, profiles = [rng.uniform(-9, 9) for _ in range(20)], [[rng.uniform(-9, 9) for _ in range(nr)] for _ in range(4)]
    flux, safety = [rng.uniform(-9, 9) for _ in range(nr * nz)], [rng.uniform(1, 9) for _ in range(nr)]
    ends = [[(rng.uniform(1, 2), rng.uniform(-1, 1)) for _ in range(n)] for n in (n_boundary, n_limiter)]
    lines = [f"  CODE  02/03/99 # 1234 10ms     3 {nr:3d} {nz:3d}"]
    for block in (scalars, *profiles, flux, safety):
        lines += ["".join(map(number, block[k : k + 5])) for k in range(0, len(block), 5)]
    if points:
        lines.append(f"{n_boundary:5d}{n_limiter:5d}")
        for block in ends:
            flat = [x for p in block for x in p]
            lines += ["".join(map(number, flat[k : k + 5])) for k in range(0, len(flat), 5)]
    return "\n".join(lines) + "\n", scalars, profiles, flux, safety, ends if points else [[], []]


def test_whole_equilibria(spark):
    rng = random.Random(2)
    made = {f"f{k}": equilibrium(rng, *size) for k, size in enumerate([(5, 4, 7, 3), (1, 1, 0, 0), (33, 9, 12, 0), (4, 4, 2, 2, False)])}
    near = pytest.approx
    rows = [(f, m[0]) for f, m in made.items()] + [("bad", "no sizes\n1 2 3"), ("short", "x 0 2 2\n 1.0 2.0"), ("none", None), ("empty", ""), ("d", made["f0"][0].replace("E+", "D+").replace("E-", "d-"))]
    frame = spark.createDataFrame(rows, "file string, value string")
    found = {r["file"]: r for r in files.whole_equilibria(frame).collect()}
    for f, (_, scalars, profiles, flux, safety, ends) in [*made.items(), ("d", made["f0"])]:
        r = found[f]
        assert r["error"] is None and [r[c] for c in files.EQUILIBRIUM_SCALARS] == near([scalars[k] for k in files.EQUILIBRIUM_SCALARS.values()])
        assert [r[c] for c in files.PROFILES] == [near(p) for p in profiles] and r["flux"] == near(flux) and r["safety_factor"] == near(safety)
        assert [[tuple(p) for p in r[c]] for c in ("boundary", "limiter")] == [[near(p) for p in e] for e in ends]
    assert {f: found[f]["error"] for f in ("bad", "short", "none", "empty")} == {"bad": "header", "short": "short: 2 of 34", "none": "header", "empty": "header"}
    assert found["short"]["flux"] is None and found["bad"]["psi_axis"] is None
    grid = files.flux_grid(files.whole_equilibria(frame)).where("file = 'f0'").orderBy("j", "i").collect()
    _, s, _, flux, _, _ = made["f0"]
    assert [r["psi"] for r in grid] == near(flux) and (grid[0]["r"], grid[0]["z"]) == near((s[3], s[4] - s[1] / 2)) and (grid[-1]["r"], grid[-1]["z"]) == near((s[3] + s[0], s[4] + s[1] / 2))
