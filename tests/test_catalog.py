"""Every registered query of the library against DuckDB on the same tables."""

import datetime
import math

import duckdb
import pytest

from evidra import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    want = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def test_overlap_join_is_no_nested_loop(spark, sf_dir):
    plan = catalog.QUERIES["alloc_overlap_anti"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_folds_against_plain_loops(spark, sf_dir):
    from evidra.operators.history import History, Limiter

    got = {r.id: r.accepted for r in catalog.QUERIES["rate_limit"](spark, sf_dir).collect()}
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", "user_id", "event_type", "unix_timestamp(cast(ts as timestamp)) ts").collect()
    limiters = {}
    for e in sorted(events, key=lambda e: (e.ts, e.event_id)):
        assert got[e.event_id] == limiters.setdefault(e.user_id, Limiter()).ask(e.ts)
    got = {r.id: r.current for r in catalog.QUERIES["nav_history"](spark, sf_dir).collect()}
    sessions = {}
    for e in sorted(events, key=lambda e: e.event_id):
        action = {"view": "back", "signup": "forward"}.get(e.event_type, "visit")
        assert got[e.event_id] == sessions.setdefault(e.user_id, History()).step(action, f"/{e.event_type}/{e.event_id}")
