"""The driver's contract: every query has a name of its own, SQL belongs to a query, and nothing but llm imports llm."""

import pathlib
import re

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_queries_and_sql():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 60


def test_nothing_else_imports_llm():
    for p in (ROOT / "loomgraph").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"loomgraph\.llm|from \.+llm", p.read_text()), p


def test_no_forbidden_calls():
    for p in (ROOT / "loomgraph").rglob("*.py"):
        assert not re.search(r"localCheckpoint|crossJoin|\.sample\(", p.read_text()), p


def test_a_query_on_tables(spark):
    d = pathlib.Path("/root/testdata/sf0.001")
    if d.exists():
        assert entry.entry(spark).columns[:3] == ["student_id", "from_kp", "to_kp"]
