"""Literals that only brackets end: what a unit and the code in its literals are split into."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codelode.functions import literals
from codelode.operators import extract

JS, PY = "javascript", "python"

# language, text, literals of the unit, code in them with line and column
CASES = [
    (JS, "a++ / 2; b-- / 3; c.return / 4; d[0] / 5; (e) / 6; `f` / 7 / g", ["`f`"], []),
    (JS, "x = /[/'\"]/g; y = { a: 1 } / 2; if (z) /'/.test(w); s.replace(/>/g, '').replace(/\\s*/g, '')",
     ["/[/'\"]/g", "/'/", "/>/g", "/\\s*/g"], []),
    (JS, "// it's `\n/* ' ` */ f(`a${ {b: `${c(d)}`}.b }`)", ["`a${ {b: `${c(d)}`}.b }`"],
     [("c(d)", 2, 25), (" {b: `${c(d)}`}.b ", 2, 17)]),
    (JS, "return <p a='}' b={f(g)}>don't {h(\"</p>\")} <br/> <>i</> </p>; a <b; c > d",
     ["<p a='}' b={f(g)}>don't {h(\"</p>\")} <br/> <>i</> </p>"], [("f(g)", 1, 20), ('h("</p>")', 1, 33)]),
    # Without an end: the mark that begins it stands alone, and what follows is found.
    (JS, "a = `open ${ b; c = `${d(e)}`", ["`${d(e)}`"], [("d(e)", 1, 24)]),
    (JS, "a = (<b, c(`${d}`)", ["`${d}`"], [("d", 1, 15)]),
    (PY, "f\"{a:>{w(3)}} {{b}} {c!r} {'}'}\" rf'\\{d}'", ["f\"{a:>{w(3)}} {{b}} {c!r} {'}'}\"", "rf'\\{d}'"],
     [("a", 1, 4), ("w(3)", 1, 8), ("c", 1, 22), ("'}'", 1, 28), ("d", 1, 39)]),
    (PY, "f'''é\n{a(\n1)}''' # f\"{\nb = {'f': f\"{x(f\"{y}\")}\"}", ["f'''é\n{a(\n1)}'''", 'f"{x(f"{y}")}"'],
     [("a(\n1)", 2, 2), ("y", 4, 19), ('x(f"{y}")', 4, 14)]),
    (PY, "a = f\"{b\nc = f\"{d(e)}\"\nf = f'{g}'", ['f"{d(e)}"', "f'{g}'"], [("d(e)", 2, 8), ("g", 3, 8)]),
    (PY, "print('{', \"f'\")", [], []),
    (PY, "print('{')", None, None),
]


@pytest.fixture(scope="module")
def split(spark):
    rows = [(n, language, text) for n, (language, text, _, _) in enumerate(CASES)]
    units = spark.createDataFrame(rows, "n int, language string, content string")
    found = units.select("n", "language", F.explode(literals.pieces()).alias("found")).select("n", "language", "found.*")
    elements = literals.elements(F.col("language"), F.col("content"), F.col("literals"))
    result: dict[int, list] = {}
    for row in found.withColumn("elements", elements).collect():
        result.setdefault(row.n, []).append(row)
    return result


@pytest.mark.parametrize("n", range(len(CASES)))
def test_pieces(split, n):
    _, text, wanted, codes = CASES[n]
    unit, *inner = split[n]
    raw = text.encode()
    assert unit.piece == "" and "".join(unit.elements) == text
    places = None if unit.literals is None else [raw[x.begin : x.end].decode() for x in unit.literals]
    assert places == wanted
    assert [(row.content, *map(int, row.piece.split(":")[:2])) for row in inner] == (codes or [])
    for row in inner:
        _, _, begin, size = map(int, row.piece.split(":"))
        assert raw[begin : begin + size].decode() == row.content == "".join(row.elements)


def test_a_unit_with_many_open_literals_keeps_its_text(spark):
    text = "a = (<b;\n" * 60 + "eval(c)"
    units = spark.createDataFrame([("a.js", JS, text)], "path string, language string, content string")
    calls = extract.calls(units).collect()
    assert [(c.line, c.function_name) for c in calls][-1] == (61, "eval")


def test_no_python_runs_over_the_units(spark):
    units = spark.createDataFrame([("a.py", PY, "f'{a(b)}'")], "path string, language string, content string")
    plan = extract.calls(units)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
