from __future__ import annotations

import pathlib
from collections import Counter

import pytest

import __spark_entry__ as entry
from check_oracle import TABLES
from codelode.sources import files, tables
from codelode.sources.shared import shared_folder
from codelode.streaming.incremental import read_findings, scan_stream

SF = "/root/testdata/sf0.001"


def test_files(spark, tmp_path):
    for name, content in {
        "a.py": b"eval(x)", "b.JAVA": b"", "sub/c.js": "é".encode(), "d.c": b"\xff",
        "e.py": b"\xff\xfe", "f": b"",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(content)
    listing = spark.createDataFrame([(f"file:{tmp_path}/{n}", 0) for n in ("b.JAVA", "f")], "path string, length long")
    read = files.read_files(spark, f"file://{tmp_path}", listing)
    units = {pathlib.Path(r.path).name: r for r in files.units(read).collect()}
    assert {n: r.language for n, r in units.items()} == {
        "a.py": "python", "b.JAVA": "java", "c.js": "javascript",
    }
    assert units["b.JAVA"].content == "" and units["c.js"].n_bytes == 2
    asked = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in ("a.py", "gone.py")], "path string")
    bad = {pathlib.Path(r.path).name: r for r in files.rejects(read, asked).collect()}
    assert {n: r.reason for n, r in bad.items()} == {
        "d.c": "UNSUPPORTED", "e.py": "INVALID_UTF8", "f": "UNSUPPORTED",
        "gone.py": "MISSING",
    }
    assert bad["d.c"].message.startswith("Unsupported file extension '.c'.\n\nSupported languages:\n")


def test_text_places(spark):
    text = 'a "x" token = "abcdef" é password="123456"\n\nSECRET =\n "zzzzzz" pwd = "1" other = "abcdef"'
    rows = spark.createDataFrame([(7, text), (8, "none")], "id long, text string")
    got = [
        (r.path, r.line, r.col, r.variable, r.value)
        for r in tables.text_credentials(rows, "id", "text").orderBy("ordinal").collect()
    ]
    assert got == [
        (7, 1, 7, "token", "abcdef"), (7, 1, 27, "password", "123456"), (7, 3, 1, "SECRET", "zzzzzz"),
    ]


def test_stream_goes_on_where_it_stopped(spark, units, tmp_path):
    source, found, marks = (str(tmp_path / n) for n in ("units", "findings", "marks"))
    units({"a.py": "eval(x)", "b.py": "exec(y)"}).coalesce(1).write.parquet(source)
    scan_stream(spark, source, found, marks).awaitTermination()
    assert read_findings(spark, found).count() == 2
    units({"c.js": "eval(z)"}).coalesce(1).write.mode("append").parquet(source)
    scan_stream(spark, source, found, marks).awaitTermination()
    assert sorted(r.source_file_path for r in read_findings(spark, found).collect()) == [
        "a.py", "b.py", "c.js",
    ]


def test_new_checkpoints_keep_earlier_findings(spark, units, tmp_path):
    found = str(tmp_path / "findings")
    for n, text in enumerate(("eval(x)", "exec(y)")):
        units({f"{n}.py": text}).coalesce(1).write.parquet(f"{tmp_path}/units{n}")
        scan_stream(spark, f"{tmp_path}/units{n}", found, f"{tmp_path}/marks{n}").awaitTermination()
    assert sorted(r.source_file_path for r in read_findings(spark, found).collect()) == ["0.py", "1.py"]


def test_shared_folder_follows_the_session():
    class Session:
        def __init__(self, folder):
            self.conf = {"spark.checkpoint.dir": folder}
            self.sparkContext = type("Context", (), {"master": "spark://cluster"})

    assert shared_folder(Session("s3://all/see"), "x").startswith("s3://all/see/x-")
    with pytest.raises(ValueError):
        shared_folder(Session(None), "x")


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_against_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    database = duckdb.connect()
    for table in TABLES:
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = database.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    expected = Counter(tuple(row[names.index(c)] for c in sorted(names)) for row in result.fetchall())
    frame = entry.queries()[name](spark, SF)
    assert sorted(frame.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in sorted(names)) for r in frame.collect()) == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
