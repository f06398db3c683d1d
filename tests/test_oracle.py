"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from provenir.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def quoted(name):
    return f'"{name}"'


def text_rows(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    sql = duck.sql(ORACLE_SQL[name])
    names = sorted(df.columns)
    assert names == sorted(sql.columns)
    found = duck.sql(f"SELECT {', '.join(map(quoted, names))} FROM ({ORACLE_SQL[name]})").fetchall()
    assert text_rows(df.select(*names).collect()) == text_rows(found)


def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() == 5 and "percent" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_prune_columns_and_push_filters(spark, sf):
    plan = QUERIES["grade_floor"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in plan
    plan = QUERIES["active_session_asof"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,purchase)" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


#: Ordered folds, digests over sorted lines, and files read by position.
PYTHON = {"ledger_stateful", "ledger_uncapped", "manifest_digest", "span_reads", "spool_files", "walked_tree", "patch_groups", "patch_ids", "claims_scan", "structural_redaction"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in PYTHON])
def test_no_python_on_the_hot_path(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


def test_claims_beyond_the_broadcast_bound(spark, sf, monkeypatch):
    from provenir.operators import claims

    few = text_rows(QUERIES["claims_scan"](spark, sf).collect())
    monkeypatch.setattr(claims, "BOUND", 3)
    assert text_rows(QUERIES["claims_scan"](spark, sf).collect()) == few != []
