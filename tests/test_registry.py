"""The registered queries: complete, importable without a session, equal to their SQL."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entries
from registry.book import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent

SAMPLE = [
    "quarantine_stay", "quarantine_out_of_window", "silver_stay", "silver_diag", "fact_stay", "readmission_30d",
    "length_of_stay", "occupancy_daily", "share_within_group", "acts_per_service", "billing", "cohort_description",
    "profile_pairs", "k_anonymity", "project_whitelist", "identity_leak", "days_pending", "tolerant_timestamp",
]


def test_every_query_has_its_sql_or_a_reason():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entries.queries()) and set(entries.oracle_sql()) <= set(entries.queries())


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def plain(value):
    return repr(round(value, 9) + 0.0) if isinstance(value, float) else str(value)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_equal_to_its_sql(spark, db, name):
    frame = entries.queries()[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(v) for v in row) for row in frame.select(*columns).collect())
    result = db.execute(f"SELECT {', '.join(columns)} FROM ({entries.oracle_sql()[name]})")
    assert got and got == sorted(tuple(plain(v) for v in row) for row in result.fetchall())


PLANS = ["readmission_30d", "occupancy_sweep", "silver_reading", "cohort_prevalence", "origin_share", "profile_pairs"]


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables not here")
@pytest.mark.parametrize("name", PLANS)
def test_no_plan_pairs_rows_up(spark, name):
    frame = entries.queries()[name](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan
