"""Loads that count once, latest records kept up to date, and records as of a time."""

import json
import random
from datetime import datetime, timedelta

import pytest

from answergrid import as_of, latest_per_entity, validity
from answergrid.sources import append_load, commit_load, loads_of, read_latest, read_loads, refresh_latest, write_load

AT = datetime(2024, 1, 15, 10, 30)
HISTORY = "entity_id STRING, data STRING, loaded_at_utc TIMESTAMP"


def load(spark, rows):
    return spark.createDataFrame([(e, json.dumps({"v": v}), AT + timedelta(minutes=m)) for e, v, m in rows], HISTORY)


def test_a_load_counts_once(spark, tmp_path):
    path = str(tmp_path / "h")
    assert read_loads(spark, path).count() == 0
    one = load(spark, [("a", 1, 0), ("b", 2, 0)])
    assert append_load(one, path, "one")
    assert not append_load(one, path, "one")
    write_load(one, path)  # broken off before it is committed
    assert read_loads(spark, path).count() == 2
    # Two that ran at once: readers take one of them.
    first, second = write_load(one, path), write_load(one, path)
    commit_load(spark, path, "two", first)
    commit_load(spark, path, "two", second)
    assert set(loads_of(spark, path)) == {"one", "two"}
    assert read_loads(spark, path).count() == 4
    assert read_loads(spark, path, ["two"]).count() == 2


def test_latest_is_kept_up_to_date(spark, tmp_path):
    path, state = str(tmp_path / "h"), str(tmp_path / "s")
    rng = random.Random(2)
    assert read_latest(spark, state).count() == 0
    assert refresh_latest(spark, path, state, buckets=8) == []
    for number in range(4):
        few = [f"e{i}" for i in (range(40) if number < 2 else [number])]
        append_load(load(spark, [(e, rng.randint(0, 9), rng.randint(0, 5)) for e in few for _ in range(3)]), path, str(number))
        touched = refresh_latest(spark, path, state, buckets=8)
        assert len(touched) == (8 if number < 2 else 1)
        assert sorted(read_latest(spark, state).collect()) == sorted(latest_per_entity(read_loads(spark, path)).collect())
    assert refresh_latest(spark, path, state, buckets=8) == []
    # A bucket that no new entity is in keeps its file, so a refresh has read and written one.
    files = {r["f"] for r in read_latest(spark, state).selectExpr("input_file_name() AS f").distinct().collect()}
    assert len({f.split("/bucket=")[0] for f in files}) > 1


def brute_as_of(events, history):
    out = []
    for event_id, user, at in events:
        known = [(t, tie) for k, t, tie in history if k is not None and k == user and t is not None and at is not None and t <= at]
        out.append((event_id, max(known)[1] if known else None))
    return sorted(out)


@pytest.mark.parametrize("span", [timedelta(minutes=1), timedelta(hours=2), timedelta(days=400)])
def test_records_as_of_a_time(spark, span):
    rng = random.Random(3)
    at = lambda: None if rng.random() < 0.05 else AT + timedelta(minutes=rng.randint(-600, 600))
    user = lambda: rng.choice([None, "hot", "hot", "hot", "a", "b", "c"])
    events = [(i, user(), at()) for i in range(400)]
    history = [(user(), at(), f"r{i:03}") for i in range(120)] + [("a", AT, "tie1"), ("a", AT, "tie2")]
    left = spark.createDataFrame([(*e, 1, 2) for e in events], "event LONG, entity STRING, time TIMESTAMP, record INT, part INT")
    right = spark.createDataFrame(history, "entity STRING, rec TIMESTAMP, tie STRING")
    found = as_of(left, right, key="entity", at="time", history_key="entity", order="rec", tie="tie", span=span)
    assert found.columns == ["event", "entity", "time", "part", "record"]
    assert sorted((r["event"], r["record"] and r["record"]["tie"]) for r in found.collect()) == brute_as_of(events, history)
    nothing = as_of(left, right.limit(0), key="entity", at="time", history_key="entity", order="rec", tie="tie")
    assert nothing.where("record IS NULL").count() == 400
    assert as_of(left.limit(0), right, key="entity", at="time", history_key="entity", order="rec", tie="tie").count() == 0


def test_validity(spark):
    df = load(spark, [("a", 1, 0), ("a", 3, 0), ("a", 2, 5), ("b", 1, 1)])
    got = {(r["entity_id"], json.loads(r["data"])["v"], r["valid_until"]) for r in validity(df).collect()}
    assert got == {("a", 3, AT + timedelta(minutes=5)), ("a", 2, None), ("b", 1, None)}
