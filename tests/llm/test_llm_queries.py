"""The registered queries against their SQL at the smallest scale."""

import os

import pytest

from lexshift.llm import queries as q
from test_queries import FOLDER, compare, duck  # noqa: F401

there = os.path.exists(FOLDER)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()) if there else [])
def test_like_sql(spark, duck, name):  # noqa: F811
    compare(spark, duck, q.queries(), q.oracle_sql(), name)


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())) if there else [])
def test_runs(spark, name):
    assert q.queries()[name](spark, FOLDER).count() > 0


@pytest.mark.skipif(not there, reason="no test data")
def test_all_pairs(spark, duck):  # noqa: F811
    """The counts of every pair, and the cases among them."""
    got = {(r["item_a"], r["item_b"]): r for r in q.p3_pairs(spark, FOLDER).collect()}
    want = duck.sql("""WITH m AS (SELECT row_number() OVER () AS i, list_distinct(any_value(top_terms)) AS k FROM substitutes GROUP BY term, line_id, token_index), x AS (SELECT i, unnest(k) AS w FROM m)
SELECT a.w, b.w, count(*) FROM x a JOIN x b ON a.i = b.i AND a.w < b.w GROUP BY ALL""").fetchall()
    assert {k: r["n_ab"] for k, r in got.items()} == {(a, b): n for a, b, n in want}
    cases = {k for k, r in got.items() if r["n_ab"] >= 5 and r["n_ab"] * r["n"] >= 10 * r["n_a"] * r["n_b"]}
    assert cases == set(duck.sql(q.oracle_sql()["p3_found"]).fetchall())
