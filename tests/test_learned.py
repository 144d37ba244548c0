"""What an account has learned, against lists; the ranked multiset against statistics."""

import random
import statistics
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from vigil.config import Settings
from vigil.functions import ranked
from vigil.functions.scalars import DAY_US
from vigil.operators.sender import account_history

from builders import NOW, event, events


def test_ranked_multiset(monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK", 3)
    rng = random.Random(1)
    for _ in range(60):
        own, plain = ranked.Ranked(), []
        for _ in range(60):
            if plain and rng.random() < 0.4:
                value = plain.pop(rng.randrange(len(plain)))
                own.remove(value)
            else:
                value = rng.choice([float(rng.randint(0, 5)), rng.random() * 5])
                plain.append(value)
                own.add(value)
            assert [own[i] for i in range(len(own))] == sorted(plain)
            if plain:
                centre = own.median()
                assert centre == statistics.median(plain)
                for c in (centre, rng.random() * 6):
                    assert own.spread(c) == statistics.median(abs(v - c) for v in plain)
                assert own.below(value) == sum(v < value for v in plain)
    empty = ranked.Ranked()
    assert empty.median() is None and empty.spread(1.0) == 0.0
    with pytest.raises(IndexError):
        empty[0]


def test_ranking_stays_cheap():
    """Work of one more event hardly grows with the history: blocks, not rows, are passed."""
    def steps(n):
        own = ranked.Ranked()
        for i in range(n):
            own.add(float(i * 7919 % n))
        return len(own.blocks), max(map(len, own.blocks))

    assert steps(100) == (1, 100)
    blocks, longest = steps(20_000)
    assert longest <= 2 * ranked.BLOCK and blocks <= 20_000 / ranked.BLOCK


def history(rows, e, days):
    return [r for r in rows if r["account_id"] == e["account_id"] and e["occurred_at"] - timedelta(days=days) <= r["occurred_at"] < e["occurred_at"]]


@pytest.mark.parametrize("days, dated", [(2, False), (2, True), (30, True)])
def test_learned_equals_lists(spark, days, dated):
    rng = random.Random(days)
    rows = []
    for i in range(160):
        at = NOW + timedelta(minutes=i * 47 + rng.randrange(30))
        rows.append(event(f"ev-{i:04d}", rng.choice(["a", "b"]), at, amount=float(rng.randrange(0, 9) * 100), channel=rng.choice(["app", "ussd"]),
                          recipient_id=rng.choice(["x", "y", None]), device_id=rng.choice(["d1", "d2", None]), event_type=rng.choice(["purchase", "transfer", "login", "failed_login"]),
                          keystroke_interval_ms=rng.choice([None, 100.0, 140.0, 190.5]), latitude=rng.choice([None, 6.5]), longitude=3.4, input_method=rng.choice(["typed", "pasted", "unknown"]),
                          profile_eligible=rng.random() < 0.8))
    df = events(spark, rows)
    trust, learned = {}, None
    if dated:
        for r in rows:
            if rng.random() < 0.8:
                start = r["occurred_at"] + timedelta(hours=rng.choice([0, 5, 24]))
                trust[r["event_id"]] = (start, rng.choice([None, start + timedelta(hours=rng.randrange(1, 40))]))
        learned = spark.createDataFrame(
            [("t", k, a, b) for k, (a, b) in trust.items()], "tenant_id string, event_id string, a timestamp, b timestamp").select(
            "tenant_id", "event_id", F.unix_micros("a").alias("from_us"), F.unix_micros("b").alias("to_us"))
    got = {r.event_id: r for r in account_history(df, Settings(lookback_days=days), learned).collect()}
    assert len(got) == len(rows)
    for e in rows:
        past, t = history(rows, e, days), e["occurred_at"]

        def known(r):
            if r["event_type"] == "failed_login":
                return False
            if not dated:
                return r["profile_eligible"]
            start, end = trust.get(r["event_id"], (None, None))
            return start is not None and start <= t and (end is None or t < end)

        own = [r for r in past if known(r)]
        txns = [r for r in own if r["event_type"] in ("purchase", "transfer")]
        amounts = [r["amount"] for r in txns if r["amount"] > 0]
        row = got[e["event_id"]]
        centre = statistics.median(amounts) if amounts else None
        assert (row.h_txns, row.h_amount_n, row.h_amount_median) == (len(txns), len(amounts), centre)
        assert row.h_amount_mad == (statistics.median(abs(a - centre) for a in amounts) if amounts else 0.0)
        typed = [r["keystroke_interval_ms"] for r in own if r["channel"] == e["channel"] and r["keystroke_interval_ms"] is not None]
        assert (row.h_typing_n, row.h_typing_median) == (len(typed), statistics.median(typed) if typed else None)
        assert row.h_channel == sum(r["channel"] == e["channel"] for r in own)
        assert row.h_pasted == sum(r["channel"] == e["channel"] and r["input_method"] == "pasted" for r in own)
        if e["device_id"]:
            assert row.h_device == sum(r["device_id"] == e["device_id"] for r in own)
        if e["recipient_id"]:
            assert row.h_recipient == sum(r["recipient_id"] == e["recipient_id"] for r in txns)
            paid = [r for r in past if r["recipient_id"] == e["recipient_id"] and r["event_type"] in ("purchase", "transfer") and r["amount"] > 0]
            months = {r["occurred_at"].month for r in paid if abs(r["occurred_at"].day - t.day) <= 3 and abs(r["amount"] - e["amount"]) / max(e["amount"], 1.0) <= 0.2}
            assert row.h_similar_months == len(months)
        hours = {}
        for r in txns:
            hours.setdefault(r["occurred_at"].hour, []).append(r["occurred_at"])
        assert row.h_common_hours == sorted(hours, key=lambda h: (-len(hours[h]), min(hours[h])))[:5]
        dated_days = [r["occurred_at"].day for r in past if r["event_type"] in ("purchase", "transfer")]
        assert row.h_nearest_day == min((abs(d - t.day) for d in dated_days), default=None)
        placed = [r for r in own if r["latitude"] is not None]
        assert (row.h_location and row.h_location.at) == (int(placed[-1]["occurred_at"].timestamp() * 1_000_000) if placed else None)
        signed = [r for r in past if r["event_type"] == "login" and r["occurred_at"] >= t - timedelta(hours=24)]
        rare = any(r["channel"] != e["channel"] and (sum(o["channel"] == r["channel"] for o in own) <= 1
                   or (r["device_id"] is not None and sum(o["device_id"] == r["device_id"] for o in own) <= 1)) for r in signed)
        assert row.h_enrolled_24h == (rare and e["event_type"] in ("purchase", "transfer"))


def test_an_empty_table(spark):
    none = events(spark, [event("e", "a")]).where("event_id = 'x'")
    assert account_history(none).count() == 0
    assert DAY_US == 86_400_000_000
