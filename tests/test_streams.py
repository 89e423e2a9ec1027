"""Streams whose files are not in the order of time, restarts, and batches that are repeated."""

import os
from datetime import datetime, timedelta

import duckdb
import pytest

from intervale.plans.catalogue import ORACLES, QUERIES
from intervale.streaming import events as S

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DAYS = [20, 0, 10]


def events(day, first):
    begin = datetime(2024, 1, 1) + timedelta(days=day)
    kinds = ["signup", "click", "view", "click"]
    return [(first + i, begin + timedelta(hours=i), 1 + i % 2 if i else 1, kinds[i], float(first + i), None) for i in range(4)]


def save(spark, folder, day, number):
    """One file of events, older than those saved after it."""
    part = f"{folder}/part{number}"
    spark.createDataFrame(events(day, 4 * number), SCHEMA).coalesce(1).write.parquet(part)
    (name,) = [n for n in os.listdir(part) if n.endswith(".parquet")]
    os.makedirs(f"{folder}/events.parquet", exist_ok=True)
    to = f"{folder}/events.parquet/{number}.parquet"
    os.rename(f"{part}/{name}", to)
    os.utime(to, (1_700_000_000 + 60 * number,) * 2)


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("shuffled")
    for number, day in enumerate(DAYS):
        save(spark, folder, day, number)
    return str(folder)


def normal(rows):
    return sorted(tuple(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("stream_")))
def test_files_in_any_order_give_the_table(spark, shuffled, name):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{shuffled}/events.parquet/*.parquet')")
    want = db.sql(ORACLES[name])
    assert normal(QUERIES[name](spark, shuffled).select(*want.columns).collect()) == normal(want.fetchall())


def test_a_run_is_taken_up_where_it_ended(spark, tmp_path):
    """Two files, then a third one that is older than both, in a second run with the same state."""
    state = f"file://{tmp_path}/run"
    for number in (0, 2):
        save(spark, tmp_path, DAYS[number], number)
    source = f"{tmp_path}/events.parquet"
    first = S.drained(spark, S.running_intervals(S.stream(spark, source, late="60 days")), "update", ["user_id"], state).collect()
    assert {r["user_id"]: r["n"] for r in first} == {1: 3, 2: 3}
    save(spark, tmp_path, DAYS[1], 1)
    found = {r["user_id"]: r for r in S.drained(spark, S.running_intervals(S.stream(spark, source, late="60 days")), "update", ["user_id"], state).collect()}
    assert {u: (r["n"], r["n_late"]) for u, r in found.items()} == {1: (5, 0), 2: (5, 0)}
    assert abs(found[1]["mean_gap"] - (20 * 86400 + 2 * 3600) / 5) < 1e-6


def test_what_comes_too_late_is_counted(spark, tmp_path):
    """Day 20 is folded for good when day 40 has moved the watermark and day 0 has come; day 10 comes after that."""
    for number, day in enumerate([20, 40, 0, 10]):
        save(spark, tmp_path, day, number)
    found = S.drained(spark, S.running_intervals(S.stream(spark, f"{tmp_path}/events.parquet", late="5 days")), "update", ["user_id"])
    assert {r["user_id"]: (r["n"], r["n_late"]) for r in found.collect()} == {1: (5, 2), 2: (5, 2)}


def test_a_repeated_batch_takes_its_own_place(spark, tmp_path):
    keep = S.keeper(f"file://{tmp_path}")
    batch = spark.range(5)
    for number in (0, 1, 1):
        keep(batch, number)
    assert spark.read.parquet(f"file://{tmp_path}/rows/*").count() == 10
