from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codelode import catalog
from codelode.operators import extract
from codelode.plans import report
from codelode.plans.findings import numbered, ordered, scan, write
from codelode.plans.rules import (
    DEFAULT_RULES,
    FINDING_COLUMNS,
    FINDINGS,
    UNSAFE_CODE_EXECUTION,
    FunctionRule,
    RuleSet,
    candidate_units,
)

TEXTS = {
    "all.py": 'from a import b\n\nsecret = "zz-top-1"\n\ncompile(source)\n\nos.popen(line)\n',
    "sorted.py": 'compile(p)\n\napi_key = "abcdef-1"\n\nfrom c import d\n\nos.popen(q)\n',
    "safe.py": 'name = "World"\nmessage = f"Hello {name}"\nprint(message)\n',
    "all.java": 'class T {\n  void r() {\n    String password = "secret123";\n    e.eval(c);\n'
    "    Runtime.getRuntime().exec(d);\n  }\n}",
    "all.js": 'const password = "secret123";\n\neval(code);\n\nexec(command);',
    # One row per quirk or edge of a rule.
    "edges.py": 'token = "12345"\nTOKEN = "123456"\nclientSecret = "abcdef"\npass_word = "abcdef"\n'
    'builtins.exec()\nx.y.eval()\nmybuiltins.execute(z)\nos.system("a", "b")\nos.system("a", b)\n'
    "os.system()\nre.compile(x)\nsubprocess.call(x)\nexec(x)\nbuiltins.exec(x)\n"
    'os.popen(f"a {b}")\nPopen([a])\nf(x).eval(y)\n',
    "edges.js": "regex.exec(s);\nnew Function(a);\nFunction(a);\nvm.runInContext(a);\n"
    "exec(`a`);\nclass A { password = 'abcdef' }\nrun.exec`a`;\n",
    "edges.java": 'class A { String key = ""; void f() { Runtime.getRuntime(); key += "abcdef"; '
    "new ProcessBuilder(a).start(); ProcessBuilder.start(a); } }",
}
EXPECTED = {
    "all.py": [(3, 1, "GEN001"), (5, 1, "GEN002"), (7, 1, "GEN003")],
    "sorted.py": [(1, 1, "GEN002"), (3, 1, "GEN001"), (7, 1, "GEN003")],
    "all.java": [(3, 12, "GEN001"), (4, 7, "GEN002"), (5, 26, "GEN003")],
    "all.js": [(1, 7, "GEN001"), (3, 1, "GEN002"), (5, 1, "GEN003")],
    "edges.py": [
        (2, 1, "GEN001"), (3, 1, "GEN001"), (5, 1, "GEN002"), (6, 1, "GEN002"), (9, 1, "GEN003"),
        (11, 1, "GEN002"), (13, 1, "GEN003"), (14, 1, "GEN002"), (14, 1, "GEN003"),
        (16, 1, "GEN003"), (17, 1, "GEN002"),
    ],
    "edges.js": [(1, 1, "GEN003"), (3, 1, "GEN002"), (4, 1, "GEN002"), (5, 1, "GEN003")],
    "edges.java": [(1, 61, "GEN001"), (1, 124, "GEN003")],
}


@pytest.fixture(scope="module")
def found(units):
    rows = scan(units(TEXTS)).cache()
    rows.count()
    return rows


def test_findings(found):
    got: dict[str, list] = {}
    for r in numbered(found).orderBy("source_file_path", "finding_no").collect():
        got.setdefault(r.source_file_path, []).append(
            (r.line_number, r.column_number, r.vulnerability_rule_id)
        )
    assert got == EXPECTED


def test_messages(found):
    rows = {
        (r.source_file_path, r.line_number, r.vulnerability_rule_id): r for r in found.collect()
    }
    unsafe = rows["edges.py", 6, "GEN002"]
    assert unsafe.description == "Unsafe function 'x.y.eval' detected."
    assert unsafe.severity == "HIGH" and unsafe.programming_language == "python"
    assert rows["edges.py", 17, "GEN002"].description == "Unsafe function 'f(x).eval' detected."
    assert rows["edges.py", 9, "GEN003"].description == "Potential command injection detected."
    assert rows["edges.py", 9, "GEN003"].severity == "CRITICAL"
    assert rows["edges.py", 2, "GEN001"].severity == "HIGH"


def test_dimensions(spark):
    assert catalog.credential_names(spark).distinct().count() == 57
    catalogue = catalog.function_catalogue(spark)
    counts = {r.rule_id: r["count"] for r in catalogue.groupBy("rule_id").count().collect()}
    assert counts == {"GEN002": 19, "GEN003": 16}
    assert catalog.languages(spark).count() == 3
    assert [r.severity for r in catalog.severities(spark).orderBy("rank").collect()] == [
        "LOW", "MEDIUM", "HIGH", "CRITICAL",
    ]


def _dummy(rows):
    return FunctionRule(
        "T001",
        "Dummy",
        "Dummy.",
        lambda context: context.units.sparkSession.createDataFrame(rows, FINDINGS),
    )


def _row(path, line, col, rule="T001"):
    return (rule, "Dummy", "d", "r", "LOW", path, "python", line, col)


def test_rule_sets(spark):
    rules = RuleSet()
    assert rules.rules == DEFAULT_RULES and len(rules.rules) == 3
    assert [r.rule_id for r in rules.table(spark).orderBy("rule_ordinal").collect()] == [
        "GEN001", "GEN002", "GEN003",
    ]
    extra = _dummy([])
    more = rules.register(extra)
    assert more.rules[-1] is extra and len(rules.rules) == 3
    with pytest.raises(ValueError):
        more.register(extra)
    assert more.unregister(extra).rules == DEFAULT_RULES
    with pytest.raises(ValueError):
        rules.unregister(extra)
    assert UNSAFE_CODE_EXECUTION not in rules.unregister(UNSAFE_CODE_EXECUTION).rules


def test_no_rules_give_no_findings(units):
    empty = scan(units(TEXTS), RuleSet(()))
    assert empty.count() == 0 and empty.columns[: len(FINDING_COLUMNS)] == FINDING_COLUMNS


def test_a_failing_rule_is_not_hidden(units):
    def fail(context):
        raise RuntimeError("Test exception")

    with pytest.raises(RuntimeError):
        scan(units(TEXTS), RuleSet((FunctionRule("F001", "Fails", "Fails.", fail),)))


def test_rules_share_one_pass_over_the_tokens(units, found, monkeypatch):
    """Function rules that ask for calls and assignments, and the term rules beside them, have the units scanned once."""
    passes, parts = [], extract._parts
    monkeypatch.setattr(extract, "_parts", lambda units: passes.append(units) or parts(units))

    def asked(context):
        columns = FINDING_COLUMNS
        named = context.calls.select("path", "language", "line", "col", F.col("function_name").alias("name"))
        named = named.unionByName(context.assignments.select("path", "language", "line", "col", F.col("variable").alias("name")))
        return named.select(
            *(F.lit("T002").alias(name) for name in columns[:4]), F.lit("LOW").alias("severity"),
            F.col("path").alias("source_file_path"), F.col("language").alias("programming_language"),
            F.col("line").alias("line_number"), F.col("col").alias("column_number"),
        )

    rules = RuleSet().register(FunctionRule("T002", "All", "All.", asked))
    both = scan(units(TEXTS), rules)
    assert len(passes) == 1
    own = both.filter(F.col("vulnerability_rule_id") == "T002")
    assert own.count() == extract.calls(units(TEXTS)).count() + extract.assignments(units(TEXTS)).count() > 0
    others = both.filter(F.col("vulnerability_rule_id") != "T002")
    assert sorted(others.select(*found.columns).collect()) == sorted(found.collect())


def test_order(units):
    first = _dummy([_row("b.py", 20, 1), _row("a.py", 10, 1), _row("a-b/c.py", 1, 1)])
    second = _dummy([_row("a.py", 5, 2), _row("a.py", 5, 1), _row("a/b.py", 1, 1), _row("a.py", 10, 1, "T002")])
    rows = ordered(scan(units({"x.py": ""}), RuleSet((first, second)))).collect()
    assert [(r.source_file_path, r.line_number, r.column_number) for r in rows] == [
        ("a/b.py", 1, 1), ("a-b/c.py", 1, 1), ("a.py", 5, 1), ("a.py", 5, 2), ("a.py", 10, 1),
        ("a.py", 10, 1), ("b.py", 20, 1),
    ]
    assert [r.vulnerability_rule_id for r in rows if r.line_number == 10] == ["T001", "T002"]


def test_summary(found, spark):
    rows = report.severity_summary(found).collect()
    assert [(r.severity, r.n) for r in rows] == [
        ("LOW", 0), ("MEDIUM", 0), ("HIGH", 18), ("CRITICAL", 11),
    ]
    assert rows[0].line == "LOW      : 0" and rows[3].line == "CRITICAL : 11"
    assert rows[0].heading == "Total findings : 29"
    none = report.severity_summary(found.filter("false")).collect()
    assert [r.n for r in none] == [0, 0, 0, 0]
    assert none[0].heading == "No vulnerabilities detected."


def test_by_file(found):
    rows = {r.source_file_path: r for r in report.findings_by_file(found).collect()}
    assert set(rows) == set(EXPECTED)
    assert rows["all.py"].n_findings == 3 and rows["all.py"].rules == "GEN001,GEN002,GEN003"
    assert (rows["all.py"].first_line, rows["all.py"].last_line) == (3, 7)
    assert {r.vulnerability_rule_id for r in report.rules_detected(found).collect()} == {
        "GEN001", "GEN002", "GEN003",
    }


def test_context_and_blocks(spark, units):
    texts = {"a.py": "line1\r\nline2\nline3\nline4\nline5\n", "b.py": "only"}
    rows = [_row("a.py", 3, 1), _row("a.py", 1, 1), _row("b.py", 3, 1)]
    source = units(texts)
    findings = scan(source, RuleSet((_dummy(rows),)))
    lines = report.code_context(findings, source).orderBy("source_file_path", "finding_no", "line")
    got = [(r.source_file_path, r.finding_no, r.code_line) for r in lines.collect()]
    assert got[:3] == [
        ("a.py", 1, ">    1 | line1"), ("a.py", 1, "     2 | line2"), ("a.py", 1, "     3 | line3"),
    ]
    assert [g[2] for g in got if g[:2] == ("a.py", 2)] == [
        "     1 | line1", "     2 | line2", ">    3 | line3", "     4 | line4", "     5 | line5",
    ]
    # A line past the end shows what there is.
    assert [g[2] for g in got if g[0] == "b.py"] == ["     1 | only"]
    blocks = report.finding_blocks(findings, source).orderBy("source_file_path", "finding_no").collect()
    assert sum("File: a.py" in b.block for b in blocks) == 1
    assert "[LOW] Dummy (T001)\n\nLocation:\n  a.py:1:1\n" in blocks[0].block
    assert blocks[1].block.endswith("     5 | line5")


def test_settled_findings_are_not_broadcast(spark, units, found, tmp_path):
    """As files they look like a small table, but they grow with the corpus."""
    found.write.parquet(str(tmp_path / "findings"))
    findings, source = spark.read.parquet(str(tmp_path / "findings")), units(TEXTS)
    for frame in (report.code_context(findings, source), report.finding_blocks(findings, source)):
        assert "BroadcastHashJoin" not in frame._jdf.queryExecution().executedPlan().toString()
        rows = frame.collect()
        assert rows and "BroadcastHashJoin" not in frame._jdf.queryExecution().executedPlan().toString()


def test_units_without_findings_are_left_out(units):
    clean = {f"c{n}.py": f"key_{n} = user_{n}\nruntime(start)\nprint(x.execute(key))\n" for n in range(20)}
    texts = units({**TEXTS, **clean})
    kept = {r.path for r in candidate_units(texts, list(DEFAULT_RULES)).collect()}
    assert not kept & set(clean) and {p for p, rows in EXPECTED.items() if rows} <= kept
    gaps = units({"a.py": "eval \\\n (x)", "b.js": "eval?. (x); exec // c\n(y)", "c.java": "char password [] = x;", "d.py": "password : str = 'abcdef'"})
    assert candidate_units(gaps, list(DEFAULT_RULES)).count() == 4


def test_sink(found, spark, tmp_path):
    for _ in range(2):  # a run that is repeated adds nothing
        write(found, str(tmp_path / "findings"), "a")
    back = spark.read.parquet(str(tmp_path / "findings"))
    assert back.filter(F.col("programming_language") == "java").count() == 5
