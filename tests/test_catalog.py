"""Every registered query against its SQL."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from rillframe.plans import catalog

ROOT = Path(__file__).resolve().parent.parent

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sql(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(round(v, 6)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, sql, small, name):
    got = catalog.QUERIES[name](spark, small)
    cols = sorted(got.columns)
    ours = sorted(tuple(_plain(r[c]) for c in cols) for r in got.collect())
    cur = sql.execute(catalog.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(_plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


@pytest.mark.parametrize("gone", [["rillframe/llm", "tests/llm", "corpus_pipeline.py"], ["rillframe/llm", "tests/llm"]])
def test_queries_without_the_corpus_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__") or str((Path(folder) / n).relative_to(ROOT)) in gone])
    code = "import __spark_entry__ as e, sys; q, s = e.queries(), e.oracle_sql(); assert not any('llm' in m for m in sys.modules if m.startswith('rillframe')); print(len(q), len(s))"
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.SQL))]


def test_workers_get_the_library(tmp_path):
    """A session of another process, in another folder and without PYTHONPATH, whose workers can't import the library by themselves."""
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.warehouse.dir", {str(tmp_path)!r}).getOrCreate()
print("rows", e.queries()["limit_fps"](spark, "/root/testdata/sf0.001").count())
"""
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=True)
    assert int(said.stdout.split("rows ")[1]) > 0


def test_entry(spark):
    import __spark_entry__

    assert {"stream_id", "seq", "frame_num", "kbitrate"} == set(__spark_entry__.entry(spark).columns)
