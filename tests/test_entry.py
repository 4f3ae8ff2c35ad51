"""Every registered query with SQL against DuckDB; the optional parts may be missing."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(pdf):
    return sorted(repr([x.item() if hasattr(x, "item") else x for x in r]) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_equal_sql(spark):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    queries = e.queries()
    for name, sql in e.oracle_sql().items():
        got, want = queries[name](spark, SF).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns), name
        assert rows(got) == rows(want), name
    assert e.entry(spark).count() == 50


def copied(tmp_path, *, without):
    for n in ("delimkit", "__spark_entry__.py", "corpus_pipeline.py", "tests"):
        if os.path.exists(f"{ROOT}/{n}") and n not in without:
            (shutil.copytree if os.path.isdir(f"{ROOT}/{n}") else shutil.copy)(f"{ROOT}/{n}", f"{tmp_path}/{n}")
    for n in without:
        shutil.rmtree(f"{tmp_path}/{n}", ignore_errors=True)
    return {"cwd": tmp_path, "check": True, "env": {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, "timeout": 900}


def test_imports_without_the_optional_parts(tmp_path):
    """Without the operators and the pipeline the rest imports, and its tests pass."""
    how = copied(tmp_path, without=("delimkit/llm", "tests/llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], **how)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_text.py", "tests/test_documents.py"], **how)


def test_each_optional_part_may_be_missing_by_itself(tmp_path):
    if not os.path.isdir(f"{ROOT}/delimkit/llm"):
        pytest.skip("the optional parts are gone")
    how = copied(tmp_path, without=("corpus_pipeline.py",))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'op7_decontamination' in q"], **how)
    shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    shutil.rmtree(f"{tmp_path}/delimkit/llm")
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and q"], **how)
