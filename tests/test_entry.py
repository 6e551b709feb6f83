"""The driver's contract: names, SQL, and life without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from foliospark import queries

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(rows):
    return sorted(tuple("<null>" if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_give_what_their_sql_gives(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    expected = duck.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})")
    lower = lambda rows: [tuple(str(v).lower() if isinstance(v, bool) else v for v in r) for r in rows]
    assert plain(lower(got.select(*columns).collect())) == plain(lower(expected.fetchall()))


def test_the_flagship_query_has_rows(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1


def test_every_sql_names_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_library_stands_without_the_optional_parts(tmp_path):
    for name in ("foliospark", "__spark_entry__.py"):
        source = ROOT / name
        copy = shutil.copytree if source.is_dir() else shutil.copy
        copy(source, tmp_path / name)
    shutil.rmtree(tmp_path / "foliospark/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(queries.QUERIES))] * 2
