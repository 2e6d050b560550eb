"""Fills are gathered once and by narrow rows, with the results of the SQL on odd tables too."""

import random
import re
import statistics

import duckdb
import pytest

from tests.test_queries import QUERIES, SQL, plain
from tidewatch import tables
from tidewatch.operators import book


@pytest.fixture(scope="module")
def odd(sf_dir, tmp_path_factory):
    """sf0.001 with lines of no order long before and after all others, and markets without a type."""
    folder, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    of = {t: f"select * from '{sf_dir}/{t}.parquet'" for t in ("region", "nation", "customer", "supplier", "part", "orders", "events")}
    of["part"] = f"select * replace (case when p_partkey % 9 = 0 then null else p_type end as p_type) from '{sf_dir}/part.parquet'"
    line = f"'{sf_dir}/lineitem.parquet'"
    of["lineitem"] = f"from {line} union all select * replace (-1 as l_orderkey, d as l_shipdate) from (from {line} limit 1), (values (timestamp '1970-01-05'), (timestamp '2190-01-01')) x(d)"
    of["lineitem"] = of["lineitem"].replace("select * replace", "select * exclude (d) replace")
    for name, query in of.items():
        con.execute(f"copy ({query}) to '{folder}/{name}.parquet'")
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["score_outcome_probability", "cal_walk_forward_trained", "score_liquidity", "book_depth"])
def test_odd_tables_give_the_rows_of_the_sql(spark, odd, name):
    folder, con = odd
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(map(plain, QUERIES[name](spark, folder).select(*names).collect())) == sorted(map(plain, want.fetchall()))


@pytest.mark.parametrize("name", ["score_outcome_probability", "ml_wallet_clusters", "score_liquidity", "cal_walk_forward_trained"])
def test_fills_are_not_worked_out_again(spark, sf_dir, name):
    assert "l_orderkey" not in QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_books_travel_once_by_market_and_no_map_of_prices_does(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 1000)
    plan = QUERIES["book_depth"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower() and "median" not in plan.lower()
    keys = re.findall(r"hashpartitioning\((\w+)#", plan)
    assert keys.count("market") + keys.count("l_partkey") == 1 and "book" not in keys


def test_medians_are_those_of_the_values(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(30), rng.choice([None, float(rng.randrange(9)), rng.random()])) for _ in range(200)] + [(99, None)]
    got = {r.k: r.m for r in book.with_median(spark.createDataFrame(rows, "k long, v double"), "k", "v").collect()}
    values = {k: [v for i, v in rows if i == k and v is not None] for k, _ in rows}
    assert got == {k: statistics.median(v) if v else None for k, v in values.items()}


def test_rolling_sorts_rows_for_chunks_and_not_the_points_of_frames(spark, sf_dir):
    plan = QUERIES["seq_rolling_volume"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("min(_row") :]
    assert "Generate" not in below[: below.index("Relation")]
