import re

import duckdb
import pytest

from sparkloom.plans import sql
from sparkloom.plans.catalog import ORACLE_SQL, QUERIES

from compare import connect, same


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, small, con, name):
    same(QUERIES[name](spark, small), con, ORACLE_SQL[name])


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


def test_cte_correlated_never_compares_all_tops_with_all_orders(spark, small):
    plan = QUERIES["sql_cte_correlated"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|Cartesian", plan)


def test_cte_correlated_on_odd_rows(spark, tmp_path):
    """Null, NaN, infinite, negative and equal prices, one order, no order, a customer twice, orders of no customer."""
    con = duckdb.connect()
    con.execute("CREATE TABLE customer AS SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 8, NULL])::BIGINT AS c_custkey")
    prices = {1: [10, 5, 5.01, None], 2: [None, None], 3: ["NaN", 1], 4: ["inf", 9], 5: [-4, -2, -1], 6: [0, "-0.0"], 8: [7, 7, 3], 99: [1], "NULL": [50]}
    rows = ", ".join(f"({k}, '{p}'::DOUBLE)" if p is not None else f"({k}, NULL)" for k, ps in prices.items() for p in ps)
    con.execute(f"CREATE TABLE orders AS SELECT k::BIGINT AS o_custkey, p::DOUBLE AS o_totalprice FROM (VALUES {rows}) v(k, p)")
    for t in ("customer", "orders"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    same(QUERIES["sql_cte_correlated"](spark, str(tmp_path)), con, ORACLE_SQL["sql_cte_correlated"])


def test_pass_through_of_a_correlated_text(spark, small, con):
    text = ORACLE_SQL["sql_cte_correlated"]
    asked, mine = sql.query(spark, text, small), QUERIES["sql_cte_correlated"](spark, small)
    same(asked, con, text)
    assert asked.dtypes == mine.dtypes
