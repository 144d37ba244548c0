import random

import pytest
from pyspark.sql import functions as F

from vigil.config import Settings
from vigil.functions.scalars import DAY_US, HOUR_US
from vigil.operators.sender import account_history, window_history, with_learned
from vigil.operators.timeline import neighbours, positions, running_at, time_slices
from vigil.operators.topk import top_per_key

from builders import NOW, event, events
from datetime import timedelta


def test_running_at_equals_brute_force(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), rng.randrange(0, 20 * HOUR_US), rng.randrange(1, 9)) for _ in range(300)]
    asks = [(rng.choice("abc"), rng.randrange(0, 20 * HOUR_US), i) for i in range(100)]
    got = running_at(
        spark.createDataFrame([(k, t, v, t) for k, t, v in data], "k string, at long, v long, m long"),
        spark.createDataFrame(asks, "k string, at long, q int"), ["k"], "at", sums=["v"], maxs=["m"],
    ).collect()
    assert len(got) == 100
    for row in got:
        past = [(t, v) for k, t, v in data if k == row["k"] and t <= row["at"]]
        assert row["v"] == sum(v for _, v in past)
        assert row["m"] == max((t for t, _ in past), default=None)


def test_neighbours_and_positions(spark):
    rows = [("a", t, f"e{i}") for i, t in enumerate([5, 5, 7, HOUR_US * 3, HOUR_US * 9])]
    df = spark.createDataFrame(rows, "k string, at long, id string")
    near = {r["id"]: r for r in neighbours(df, ["k"], "at", "id", F.lit(True)).collect()}
    assert near["e1"]["prev_at"] == 5 and near["e1"]["prev_strict"] is None
    assert near["e2"]["next_at"] == 3 * HOUR_US and near["e3"]["prev_strict"] == 7
    placed = {r["id"]: (r["position"], r["total"]) for r in positions(df, ["k"], "at", ["id"], HOUR_US).collect()}
    assert placed == {"e0": (1, 5), "e1": (2, 5), "e2": (3, 5), "e3": (4, 5), "e4": (5, 5)}


def test_slices_cover_every_row_once_at_home(spark):
    rows = [("hot", i * HOUR_US // 4) for i in range(400)] + [("cold", i * HOUR_US) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, at long")
    cut = time_slices(df, "at", 10 * HOUR_US).toPandas()
    assert cut["_home"].sum() == 405
    hot = cut[cut["k"] == "hot"]
    assert hot["_slice"].nunique() > 3
    for _, part in hot.groupby("_slice"):
        home = part[part["_home"]]["at"].min()
        assert home != home or (part["at"] < home).sum() == sum(1 for k, t in rows if k == "hot" and home - 10 * HOUR_US <= t < home)


@pytest.mark.parametrize("days", [1, 2, 30])
def test_history_is_the_whole_look_back(spark, days):
    """All rows of the look-back count, in every slice of time."""
    rng = random.Random(3)
    rows = []
    for i in range(150):
        at = NOW + timedelta(minutes=i * 37 + rng.randrange(30))
        rows.append(event(f"ev-{i:04d}", "acct_1", at, amount=float(rng.randrange(1, 9) * 100),
                          channel=rng.choice(["app", "ussd"]), recipient_id=rng.choice("xyz"),
                          event_type=rng.choice(["purchase", "transfer", "login", "failed_login"])))
    settings = Settings(lookback_days=days)
    df = account_history(events(spark, rows), settings).select(
        "event_id", "h_events", "h_txns", "h_recipient", "h_channel", "h_txn_1h", "h_failed_24h",
        F.col("h_amount_n").alias("listed"), "h_from_app")
    got = {r["event_id"]: r for r in df.collect()}
    assert len(got) == 150
    for e in rows:
        history = [r for r in rows if e["occurred_at"] - timedelta(days=days) <= r["occurred_at"] < e["occurred_at"]]
        trusted = [r for r in history if r["event_type"] != "failed_login"]
        txns = [r for r in trusted if r["event_type"] in ("purchase", "transfer")]
        row = got[e["event_id"]]
        assert row["h_events"] == len(history)
        assert row["h_txns"] == row["listed"] == len(txns)
        assert row["h_recipient"] == sum(r["recipient_id"] == e["recipient_id"] for r in txns)
        assert row["h_channel"] == sum(r["channel"] == e["channel"] for r in trusted)
        assert row["h_txn_1h"] == sum(e["occurred_at"] - timedelta(hours=1) <= r["occurred_at"] for r in txns)
        assert row["h_failed_24h"] == sum(
            r["event_type"] == "failed_login" and e["occurred_at"] - timedelta(hours=24) <= r["occurred_at"]
            for r in history)


def test_no_copies_into_slices_without_home_rows(spark):
    """A row is copied into the next slice only if the slice begins before the latest event; every look-back stays whole."""
    lookback, latest = 10, 33
    df = spark.createDataFrame([(None,)] + [(t,) for t in range(-25, latest + 1)], "at long")
    sliced = time_slices(df, "at", lookback, latest).collect()
    held = {(r["at"], r["_slice"]) for r in sliced}
    assert len(held) == len(sliced) and (None, None) in held
    assert {r["_slice"] for r in sliced if r["at"] is not None} == set(range(-2, 2))
    for t in range(-25, latest + 1):
        assert [r["_slice"] for r in sliced if r["at"] == t and r["_home"]] == [t // 20]
        assert all((s, t // 20) in held for s in range(max(-25, t - lookback), t))
    assert len(time_slices(df, "at", lookback).collect()) > len(sliced)


def test_latest_time_changes_no_history(spark):
    rng = random.Random(12)
    rows = [event(f"e{i}", rng.choice("ab"), NOW + timedelta(hours=rng.randrange(24 * 9)), amount=float(rng.randint(1, 50)),
                  recipient_id=rng.choice(["r1", "r2"])) for i in range(80)]
    df = events(spark, rows)
    settings = Settings(lookback_days=2)
    until = df.agg(F.max("ts_us")).first()[0]
    plain = account_history(df, settings)
    known = with_learned(window_history(df, settings, until), df, settings, until=until)
    def key(row):
        return row["event_id"]
    assert sorted(known.select(*plain.columns).collect(), key=key) == sorted(plain.collect(), key=key)


def test_top_per_key(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    got = top_per_key(df, ["k"], [F.col("id").desc()], 3, "id").collect()
    assert sorted(r["id"] for r in got) == [994, 995, 996, 997, 998, 999]


def test_day_is_whole_buckets():
    assert DAY_US % HOUR_US == 0
