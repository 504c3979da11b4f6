"""Every query with an oracle against DuckDB on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tagloom import queries as own

TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fixed = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted(repr([fixed(r[i]) for i in order]) for r in found)


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query(spark, duck, name):
    df = own.queries()[name](spark, str(TABLES))
    found = df.collect()
    if name not in own.oracle_sql():
        assert found
        return
    result = duck.execute(own.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, found) == rows(columns, result.fetchall())


def test_entry_survives_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "tagloom", tmp_path / "tagloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["vocabulary_document_documents", "vocab_bundle_documents"])
def test_vocabularies_are_made_from_written_counts(spark, monkeypatch, name):
    """The texts are not tokenized again for each list and count."""
    seen = []
    for f in ("document_lines", "bundle"):
        monkeypatch.setattr(own, f, lambda *args, real=getattr(own, f): seen.extend(args[:2]) or real(*args))
    own.queries()[name](spark, str(TABLES))
    assert len(seen) == 2 and not any(path.endswith("documents.parquet") for t in seen for path in t.inputFiles())
