"""Every registered query against its SQL in DuckDB, and plans that must not degrade."""

import datetime as dt
import math

import duckdb
import pytest
from tenderlens.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else f"{x:.9g}"
    return x.isoformat() if isinstance(x, (dt.date, dt.datetime)) else x


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = table(df.columns, df.collect())
    relation = duck.sql(ORACLES[name])
    assert got == table(list(relation.columns), relation.fetchall())


@pytest.mark.parametrize(
    "name",
    ["f1_company_prefixes", "c4_seed_codes", "m4b_paired_bootstrap", "e10_verify_quotes", "j2_won_by", "k4_company_spend", "e3_locate", "m1_filter_recall", "p1_parse_notices"],
)
def test_plan_has_no_nested_loops(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = QUERIES["v3_versions_until"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_partkey" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
