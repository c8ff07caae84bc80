"""Every registered query against its SQL, both over whole tables."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

from cairn.queries import ORACLE_SQL, QUERIES


def plain(v):
    """A value as both engines give it, to nine digits."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return str(v)


#: Queries that SQL can't express, and the test that holds each to plain code or to its rules.
HELD = {
    "agg_18_bootstrap": "test_solvers.py::test_bootstrap_interval_is_near_the_normal_one",
    "agg_19_paired": "test_solvers.py::test_paired_difference",
    "agg_27_match_scores": "test_steps.py::test_scores_of_all_walks",
    "j_11_twins": "test_resolve.py::test_queries_are_the_rules",
    "j_21_greedy_match": "test_solvers.py::test_greedy_matches_follow_the_order_of_the_reference",
    "opt_01_tours": "test_solvers.py::test_short_walks_are_ordered_as_by_trying_all",
    "opt_07_trimmed": "test_solvers.py::test_plans_are_trimmed_to_budget_and_longest_leg",
    "opt_10_reachable": "test_solvers.py::test_only_the_isolated_stop_goes",
    "opt_11_pruned": "test_solvers.py::test_pruned_stops_are_over_the_cap",
    "opt_16_reference": "test_solvers.py::test_the_shortest_of_all_walks",
    "opt_17_measured": "test_solvers.py::test_a_measured_walk_leaves_out_what_cannot_be_walked_to",
    "opt_17_step_free": "test_solvers.py::test_the_price_of_walks_without_steps",
    "set_04_collapsed": "test_resolve.py::test_queries_are_the_rules",
    "stm_06_progress_stream": "test_streams.py::test_the_guided_query_is_plain_code",
    "top_09_thinned": "test_solvers.py::test_thinned_places_keep_their_distance",
}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    answer = duck.execute(ORACLE_SQL[name])
    named = sorted((d[0], i) for i, d in enumerate(answer.description))
    assert columns == [n for n, _ in named]
    assert got == sorted(repr(tuple(plain(r[i]) for _, i in named)) for r in answer.fetchall())


def test_every_sql_has_its_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_every_query_without_sql_is_held_by_a_test():
    assert set(HELD) == set(QUERIES) - set(ORACLE_SQL)
    for where in HELD.values():
        file, name = where.split("::")
        assert f"def {name}(" in (Path(__file__).parent / file).read_text()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
