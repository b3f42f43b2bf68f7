"""DuckDB statements for the corpus queries, built from the expected rows per statement."""

from __future__ import annotations

import corpus_expected as ex
from codelode import catalog
from codelode.sources.corpus import STATEMENTS


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    def cell(value: object) -> str:
        return str(value) if isinstance(value, int) else _text(value)

    body = ",\n".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def _place(col: int) -> tuple[int, int]:
    return (col - ex.U, 1) if col >= ex.U else (col, 0)


_statements = [
    (language_no, template, text.count("\n") + 1, text)
    for language_no, (language, _) in enumerate(catalog.LANGUAGES)
    for template, text in enumerate(STATEMENTS[language])
]
BASE = "WITH " + _values("st", "l, t, n, text", _statements) + """,
ev AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS u, event_id // 20 AS f, event_id % 20 AS i,
         event_id % 31 AS t, (event_id // 20) % 3 AS l
  FROM events
),
placed AS (
  SELECT ev.*, st.n, replace(st.text, '{u}', u) AS text,
         'corpus/f' || lpad(CAST(f AS VARCHAR), 7, '0')
           || CASE ev.l WHEN 0 THEN '.py' WHEN 1 THEN '.java' ELSE '.js' END AS path,
         CASE ev.l WHEN 0 THEN 'python' WHEN 1 THEN 'java' ELSE 'javascript' END AS language,
         1 + coalesce(sum(st.n + CASE WHEN event_id % 5 = 4 THEN 1 ELSE 0 END) OVER (
           PARTITION BY f ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
         ), 0) AS line0
  FROM ev JOIN st ON ev.l = st.l AND ev.t = st.t
)"""

_ASSIGNMENTS = _values(
    "xa",
    "l, t, dline, c, shift, variable, kind, vtext",
    [
        (l, t, line, *_place(col), variable, kind, text)
        for (l, t), rows in ex.ASSIGNMENTS.items()
        for line, col, variable, kind, text in rows
    ],
)
_CALLS = _values(
    "xc",
    "l, t, k, dline, c, shift, qualifier, function_name, kinds, n_arguments",
    [
        (l, t, k, line, *_place(col), qualifier, name, ",".join(kind for kind, _ in args), len(args))
        for (l, t), rows in ex.CALLS.items()
        for k, (line, col, qualifier, name, args) in enumerate(rows)
    ],
)
_ARGUMENTS = _values(
    "xr",
    "l, t, k, function_name, argument_no, kind, atext",
    [
        (l, t, k, name, n, kind, text)
        for (l, t), rows in ex.CALLS.items()
        for k, (_, _, _, name, args) in enumerate(rows)
        for n, (kind, text) in enumerate(args)
    ],
)
_RULES = _values(
    "ru",
    "rule_no, rule, rule_name, recommendation, severity",
    [
        (1, "GEN001", "Hardcoded Credentials",
         "Keep credentials in a secret store or in the environment.", "HIGH"),
        (2, "GEN002", "Unsafe Code Execution", "Avoid eval/exec-style APIs whenever possible.", "HIGH"),
        (3, "GEN003", "Potential Command Injection",
         "Avoid passing user input directly to command execution APIs.", "CRITICAL"),
        (4, "DBG001", "Debug Output", "Use a logger.", "LOW"),
    ],
)


def _description(rule: str, name: str | None) -> str:
    return {
        "GEN001": f"Hardcoded credential in variable '{name}' detected.",
        "GEN002": f"Unsafe function '{name}' detected.",
        "GEN003": "Potential command injection detected.",
    }[rule]


_FOUND = [
    (l, t, rule, line, *_place(col), _description(rule, name))
    for (l, t), rows in ex.FINDINGS.items()
    for rule, line, col, name in rows
]
_DEBUG = [
    (l, t, "DBG001", line, *_place(col), "Debug output left in code.")
    for (l, t), rows in ex.DEBUG_OUTPUT.items()
    for line, col in rows
]
_COLUMN = "CAST(c + shift * length(u) AS INTEGER)"
_LINE = "CAST(line0 + dline AS INTEGER)"


def _findings(rows: list[tuple] = _FOUND) -> str:
    """CTEs up to `fi`, the findings with their number in the file."""
    return f"""{BASE}, {_values("xf", "l, t, rule, dline, c, shift, description", rows)}, {_RULES},
fi AS (
  SELECT path AS source_file_path, language AS programming_language, rule AS vulnerability_rule_id,
         rule_name AS vulnerability_rule_name, description, recommendation, severity,
         {_LINE} AS line_number, {_COLUMN} AS column_number,
         row_number() OVER (PARTITION BY path ORDER BY line0 + dline, c + shift * length(u), rule_no)
           AS finding_no
  FROM placed JOIN xf USING (l, t) JOIN ru USING (rule)
)"""


_LINES = _values(
    "ln",
    "l, t, j, ltext",
    [(l, t, j, line) for l, t, _, text in _statements for j, line in enumerate(text.split("\n"))],
)
_CONTEXT = f"""{_findings()}, {_LINES},
code AS (
  SELECT path, CAST(line0 + j AS INTEGER) AS line, replace(ltext, '{{u}}', u) AS text
  FROM placed JOIN ln USING (l, t)
  UNION ALL
  SELECT path, CAST(line0 + n AS INTEGER), '' FROM placed WHERE event_id % 5 = 4 AND i <> 19
),
cx AS (
  SELECT source_file_path, finding_no, line,
         CASE WHEN line = line_number THEN '>' ELSE ' ' END AS marker, text,
         CASE WHEN line = line_number THEN '>' ELSE ' ' END
           || lpad(CAST(line AS VARCHAR), 5, ' ') || ' | ' || text AS code_line
  FROM fi JOIN code ON code.path = source_file_path AND line BETWEEN line_number - 2 AND line_number + 2
)"""

_ALL = (
    "source_file_path, finding_no, programming_language, vulnerability_rule_id, "
    "vulnerability_rule_name, description, recommendation, severity, line_number, column_number"
)
_SUMMARY = """,
sv(rank, severity) AS (VALUES (1, 'LOW'), (2, 'MEDIUM'), (3, 'HIGH'), (4, 'CRITICAL'))
SELECT CAST(rank AS INTEGER) AS rank, severity, count(description) AS n,
       (SELECT count(*) FROM fi) AS total,
       rpad(severity, 8, ' ') || ' : ' || count(description) AS line,
       'Total findings : ' || (SELECT count(*) FROM fi) AS heading
FROM sv LEFT JOIN fi USING (severity) GROUP BY rank, severity"""


def _rule(rule: str) -> str:
    return f"""{_findings()}
SELECT source_file_path, line_number, column_number, severity, description FROM fi
WHERE vulnerability_rule_id = '{rule}'"""


def statements() -> dict[str, str]:
    return {
        "units_corpus": f"""{BASE}
SELECT path, language, count(*) AS n_statements, CAST(sum(strlen(text)
         + CASE WHEN event_id % 5 = 4 THEN 1 ELSE 0 END) + count(*) - 1 AS BIGINT) AS n_bytes
FROM placed GROUP BY path, language""".replace("count(*) AS n_statements, ", ""),
        "assignments_corpus": f"""{BASE}, {_ASSIGNMENTS}
SELECT path, language, {_LINE} AS line, {_COLUMN} AS col, variable, kind,
       replace(vtext, '{{u}}', u) AS text,
       row_number() OVER (PARTITION BY path ORDER BY line0 + dline, c + shift * length(u)) AS ordinal
FROM placed JOIN xa USING (l, t)""",
        "calls_corpus": f"""{BASE}, {_CALLS}
SELECT path, language, {_LINE} AS line, {_COLUMN} AS col, qualifier, function_name,
       CASE WHEN qualifier IS NULL THEN '' ELSE qualifier || '.' END || function_name AS display_name,
       kinds, CAST(n_arguments AS INTEGER) AS n_arguments,
       row_number() OVER (PARTITION BY path ORDER BY line0, k) AS ordinal
FROM placed JOIN xc USING (l, t)""",
        "call_arguments": f"""{BASE}, {_ARGUMENTS}
SELECT path, function_name, CAST(line0 AS INTEGER) AS statement_line,
       CAST(argument_no AS INTEGER) AS argument_no, kind, replace(atext, '{{u}}', u) AS text
FROM placed JOIN xr USING (l, t)""".replace("CAST(line0 AS INTEGER) AS statement_line,\n       ", ""),
        "source_health": f"""{BASE}
SELECT path, (f % 10) IN (3, 6, 9) AS has_error FROM placed GROUP BY path, f""",
        "gen001_corpus": _rule("GEN001"),
        "gen002_corpus": _rule("GEN002"),
        "gen003_corpus": _rule("GEN003"),
        "findings_all": f"{_findings()} SELECT {_ALL} FROM fi",
        "incremental_findings": f"{_findings()} SELECT {_ALL} FROM fi".replace("finding_no, ", "", 1),
        "custom_rule": _findings([row for row in _FOUND if row[2] != "GEN002"] + _DEBUG)
        + f" SELECT {_ALL} FROM fi",
        "severity_summary": _findings() + _SUMMARY,
        "findings_by_file": _findings()
        + """
SELECT source_file_path, programming_language, count(*) AS n_findings,
       count(*) FILTER (WHERE severity = 'LOW') AS n_low,
       count(*) FILTER (WHERE severity = 'MEDIUM') AS n_medium,
       count(*) FILTER (WHERE severity = 'HIGH') AS n_high,
       count(*) FILTER (WHERE severity = 'CRITICAL') AS n_critical,
       min(line_number) AS first_line, max(line_number) AS last_line,
       string_agg(DISTINCT vulnerability_rule_id, ',' ORDER BY vulnerability_rule_id) AS rules
FROM fi GROUP BY source_file_path, programming_language""",
        "rules_detected": _findings()
        + """
SELECT vulnerability_rule_id, count(*) AS n_findings, count(DISTINCT source_file_path) AS n_files
FROM fi GROUP BY vulnerability_rule_id""",
        "findings_rank": f"""{_findings()}
SELECT row_number() OVER (ORDER BY source_file_path, finding_no) AS rank, {_ALL} FROM fi""".replace(
            "finding_no, programming", "programming", 1
        ),
        "findings_sink": f"""{_findings()}
SELECT CAST(run AS INTEGER) AS run, {_ALL} FROM fi, (VALUES (1), (2)) AS r(run)
WHERE run = 1 OR severity = 'CRITICAL'""".replace("finding_no, programming", "programming", 1),
        "rules_overview": f"""{_findings()}
SELECT CAST(rule_no AS INTEGER) AS rule_ordinal, rule AS rule_id, ru.rule_name AS name, ru.recommendation,
       ru.severity, nullif(count(description), 0) AS n_findings,
       nullif(count(DISTINCT source_file_path), 0) AS n_files
FROM ru LEFT JOIN fi ON rule = vulnerability_rule_id WHERE rule_no < 4
GROUP BY rule_no, rule, ru.rule_name, ru.recommendation, ru.severity""",
        "code_context": f"{_CONTEXT} SELECT source_file_path, finding_no, line, marker, text, code_line FROM cx",
        "finding_blocks": _CONTEXT
        + """,
cb AS (
  SELECT source_file_path, finding_no, string_agg(code_line, chr(10) ORDER BY line) AS code
  FROM cx GROUP BY source_file_path, finding_no
)
SELECT source_file_path, finding_no,
       CASE WHEN finding_no = 1 THEN 'File: ' || source_file_path || chr(10) || chr(10) ELSE '' END
       || repeat('-', 80) || chr(10) || '[' || severity || '] ' || vulnerability_rule_name
       || ' (' || vulnerability_rule_id || ')' || chr(10) || chr(10) || 'Location:' || chr(10)
       || '  ' || source_file_path || ':' || line_number || ':' || column_number || chr(10)
       || chr(10) || 'Description:' || chr(10) || '  ' || description || chr(10)
       || chr(10) || 'Recommendation:' || chr(10) || '  ' || recommendation || chr(10)
       || chr(10) || 'Code:' || chr(10) || chr(10) || code AS block
FROM fi JOIN cb USING (source_file_path, finding_no)""",
        "read_files": f"""{BASE}
SELECT path, language, CAST(sum(strlen(text) + CASE WHEN event_id % 5 = 4 THEN 1 ELSE 0 END)
         + count(*) - 1 AS BIGINT) AS n_bytes
FROM placed GROUP BY path, language""",
    }
