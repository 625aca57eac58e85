"""Every query over the smallest tables against its SQL."""

import glob
import os

import duckdb
import pytest
from conftest import SF

from logloom.plans.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(cols, data):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in data), key=str)


#: Assertions that the monitors' queries reported.
SEEN: set[str] = set()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = rows(cols, df.select(*cols).collect())
    if name.startswith("monitor_"):
        SEEN.update(r[cols.index("assertion")] for r in got)
    if name not in ORACLE:
        assert got
        return
    rel = db.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    assert got == rows(cols, rel.select(*(f'"{c}"' for c in cols)).fetchall())


def test_every_assertion_is_triggered():
    if "A25" not in SEEN or "A26" not in SEEN:
        pytest.skip("the monitors were not all run")
    assert sorted(SEEN, key=lambda a: int(a[1:])) == [f"A{i}" for i in range(1, 31)]


#: Queries that ask for the end of the log or collect state from it.
ENDS = "replay_range replay_dense_check chain_ends tombstones repair_plan repair_report truncate_plan dead_sweep register_fold admission_check in_order_completion canonical_prefix".split()


@pytest.mark.parametrize("name", ENDS)
def test_query_of_an_empty_log(spark, name, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == (1 if name == "replay_dense_check" else 0)


def test_entry_without_llm():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
