"""Every registered query with SQL against DuckDB, on the smallest tables; those without run."""

import datetime as dt
import os
import random

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in entry.oracle_sql() and not n.startswith("op")])
def test_matches_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert plain(df.select(*columns).collect()) == plain([tuple(r[i] for i in order) for r in want.fetchall()])


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def excursions_of(spark, path, rows):
    """t10_excursions over events (event_id, seconds or None, user_id, value), stored in the order given."""
    at = [None if t is None else dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=t) for _, t, _, _ in rows]
    spark.createDataFrame([(i, ts, u, "x", v) for (i, _, u, v), ts in zip(rows, at)], EVENTS).coalesce(1).write.parquet(f"{path}/events.parquet")
    out = entry.queries()["t10_excursions"](spark, str(path))
    zero = int(dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp())
    return sorted((r.device, r.start - zero, r.end - zero, r.peak) for r in out.collect())


def runs_by_hand(rows):
    """The same, row by row, in order of time and then event_id."""
    out, runs = [], {}
    for _, t, u, v in sorted(rows, key=lambda r: (r[1], r[0])):
        if v > 40:
            runs.setdefault(u, []).append((t, v))
        elif u in runs:
            out.append((u, runs.pop(u)))
    out += list(runs.items())
    return sorted((u, r[0][0], r[-1][0], max(v for _, v in r)) for u, r in out if r[-1][0] - r[0][0] >= 3600)


def test_excursions_with_tied_times(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.randrange(60) * 1800, rng.randrange(8), rng.choice([20.0, 45.0, 50.0 + i])) for i in range(600)]
    want = runs_by_hand(rows)
    assert len(want) > 20
    for n, order in enumerate((rows, rows[::-1], rng.sample(rows, len(rows)))):
        assert excursions_of(spark, tmp_path / str(n), order) == want


def test_excursions_without_time(spark, tmp_path):
    rows = [(0, 0, 1, 10.0), (1, 100, 1, 50.0), (2, 4000, 1, 60.0), (3, None, 1, 99.0), (4, 0, 2, 50.0), (5, 4000, 2, 60.0), (6, None, 2, 10.0)]
    con = duckdb.connect()
    got = excursions_of(spark, tmp_path, rows)
    con.execute(f"create view events as select * replace (ts::timestamp as ts) from '{tmp_path}/events.parquet/*.parquet'")
    con.execute("set timezone = 'UTC'")
    zero = int(dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp())
    assert got == sorted((d, s - zero, e - zero, p) for d, s, e, p in con.sql(entry.oracle_sql()["t10_excursions"]).fetchall()) == [(1, 100, 4000, 99.0), (2, 0, 4000, 60.0)]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
