"""Every registered query against its DuckDB twin on the smallest tables."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from proctrace.operators.scans import ONE_TASK
from proctrace.plans import registry

D = os.environ.get("TWINS_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    return v


#: Queries whose plan is another one where the input is too large for one task.
SPLIT = ["all_keypoints", "frame_task_asof", "progress_marks", "rate_throttle", "running_bending", "segment_frames", "segments", "task_status_feed", "task_summary", "trajectory"]


@pytest.mark.parametrize("name", SPLIT)
def test_twin_split_by_hour(spark, duck, name):
    spark.conf.set(ONE_TASK[0], "0")
    try:
        test_twin(spark, duck, name)
    finally:
        spark.conf.unset(ONE_TASK[0])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_twin(spark, duck, name):
    df = registry.QUERIES[name](spark, D)
    order = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    result = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == order
    expected = [tuple(plain(r[names.index(c)]) for c in order) for r in result.fetchall()]
    assert sorted(got, key=str) == sorted(expected, key=str) and got


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_what_the_llm_operators_need():
    """If they can't be imported, for whatever is missing, the other queries are there."""
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); assert 'segments' in q and not [n for n in q if n.startswith('op')], q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
