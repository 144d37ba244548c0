import random

import pytest

from vigil.functions.scalars import HOUR_US
from vigil.operators.resilience import DEPS, mode_timeline

FLAGS = ", ".join(f"{d} boolean" for d in DEPS)


def walk(beats, completions):
    """The state machine one step after the other."""
    modes = {}
    for tenant in {b[0] for b in beats}:
        steps = [(at, 0, bid, flags) for t, at, bid, *flags in beats if t == tenant]
        steps += [(at, 1, "", None) for t, at in completions if t == tenant]
        mode = "online"
        for _, kind, bid, flags in sorted(steps, key=lambda s: s[:3]):
            if kind == 1:
                mode = "online" if mode == "reconciling" else mode
                continue
            named = dict(zip(DEPS, flags, strict=True))
            if not named["dep_core_banking"]:
                mode = "isolated"
            elif not all(flags):
                mode = "degraded"
            elif mode != "online":
                mode = "reconciling"
            modes[bid] = mode
    return modes


@pytest.mark.parametrize("seed", [1, 2])
def test_composed_transitions_equal_the_walk(spark, seed):
    """Outages and recoveries across days, days without heartbeats, completions at odd times, equal times."""
    rng = random.Random(seed)
    beats, completions = [], []
    for tenant, n, span in (("hot", 900, 6), ("slow", 150, 90), ("calm", 40, 200)):
        for i in range(n):
            at = rng.randrange(0, span * 24) * HOUR_US + rng.choice([0, 0, 7])
            flags = [rng.random() > (0.02 if tenant == "calm" else 0.06) for _ in DEPS]
            beats.append((tenant, at, f"{tenant}-{i:04d}", *flags))
        completions += [(tenant, rng.randrange(0, span * 24) * HOUR_US) for _ in range(n // 3)]
    got = mode_timeline(
        spark.createDataFrame(beats, f"tenant_id string, at_us long, heartbeat_id string, {FLAGS}"),
        spark.createDataFrame(completions + completions[:20], "tenant_id string, at_us long")).collect()
    want = walk(beats, completions)
    assert len(got) == len(beats)
    assert {r["heartbeat_id"]: r["mode"] for r in got} == want
    assert set(want.values()) == {"online", "degraded", "isolated", "reconciling"}


def test_a_completion_without_a_healthy_heartbeat_counts_for_nothing(spark):
    up, down = [True] * len(DEPS), [d == "dep_core_banking" for d in DEPS]
    day = 24 * HOUR_US
    beats = [("t", 1, "a", *down), ("t", 3 * day, "b", *up), ("t", 5 * day, "c", *up), ("t", 7 * day, "d", *up)]
    completions = [("t", 2), ("t", 2 * day), ("t", 6 * day)]
    got = mode_timeline(spark.createDataFrame(beats, f"tenant_id string, at_us long, heartbeat_id string, {FLAGS}"),
                        spark.createDataFrame(completions, "tenant_id string, at_us long")).collect()
    assert {r["heartbeat_id"]: r["mode"] for r in got} == {"a": "degraded", "b": "reconciling", "c": "reconciling", "d": "online"}


def test_no_heartbeats(spark):
    beats = spark.createDataFrame([], f"tenant_id string, at_us long, heartbeat_id string, {FLAGS}")
    assert mode_timeline(beats, spark.createDataFrame([("t", 5)], "tenant_id string, at_us long")).collect() == []
