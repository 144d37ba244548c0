import random

import pytest
from pyspark.sql import functions as F

from vigil.functions.scalars import DAY_US, HOUR_US
from vigil.operators import resilience
from vigil.operators.asof import as_of, interval_tree
from vigil.operators.reputation import RECIPIENT, reputation_asof


@pytest.mark.parametrize("fan", [3, 64])
def test_as_of_equals_brute_force(spark, fan):
    """Crowded and sparse keys, times at, before and after changes, repeated queries, nulls in keys and times."""
    rng = random.Random(fan)
    log = {(k, rng.randrange(HOUR_US if k == "hot" else 90 * DAY_US)): rng.randrange(99) for k in ["hot"] * 400 + ["b"] * 20 + ["c"]}
    rows = [(k, t, v) for (k, t), v in log.items()]
    times = [t for _, t, _ in rows]
    asks = [(rng.choice(["hot", "b", "c", "none", None]), rng.choice(times) + rng.choice([-1, 0, 1, DAY_US]), i) for i in range(600)]
    asks += [("hot", None, -1), ("hot", times[0], -2), ("hot", times[0], -2)]
    changes = spark.createDataFrame([*rows, (None, 5, 1), ("b", None, 1)], "k string, at long, v int")
    got = as_of(spark.createDataFrame(asks, "k string, at long, q int"), changes, ["k"], "at", ["v"], fan).collect()
    assert len(got) == len(asks)
    for row in got:
        past = [(t, v) for k, t, v in rows if row["at"] is not None and k == row["k"] and t <= row["at"]]
        assert row["v"] == (max(past)[1] if past else None)


def test_nodes_have_few_children(spark):
    rows = [("hot", i) for i in range(1000)] + [("cold", 7)]
    levels = interval_tree(spark.createDataFrame(rows, "k string, at long"), ["k"], "at", [], 8)
    assert len(levels) == 4
    for level in levels:
        assert level.groupBy("k", "_node").count().agg(F.max("count")).first()[0] <= 8
    assert levels[0].where("_node <> 0").count() == 0


def test_empty_log_and_no_queries(spark):
    changes = spark.createDataFrame([], "k string, at long, v int")
    asks = spark.createDataFrame([("a", 1)], "k string, at long")
    assert [tuple(r) for r in as_of(asks, changes, ["k"], "at", ["v"]).collect()] == [("a", 1, None)]
    assert as_of(asks.limit(0), changes, ["k"], "at", ["v"]).collect() == []


def test_events_pass_through_joins_alone(spark):
    """No window and no sort over events: what is ordered is the stored log."""
    asks = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"))
    changes = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"), F.col("id").alias("v"))
    plan = as_of(asks, changes, ["k"], "at", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_reputation_as_of_a_time(spark):
    rows = [("r", "x", 10), ("r", "x", 20), ("r", "y", 20), ("s", "z", 5)]
    confirmed = spark.createDataFrame(rows, "recipient_key string, account_id string, confirmed_us long")
    asks = [("r", t) for t in (9, 10, 19, 20, 20 + 90 * DAY_US)] + [("q", 50)]
    got = {(r["recipient_key"], r["at"]): (r["confirmed_reports"], r["distinct_accounts"], r["status"])
           for r in reputation_asof(spark.createDataFrame(asks, "recipient_key string, at long"), confirmed, RECIPIENT).collect()}
    assert got[("r", 10)] == got[("r", 19)] == (1, 1, "monitor")
    assert got[("r", 20)] == (3, 2, "elevated")
    assert got[("r", 20 + 90 * DAY_US)] == (3, 2, "expired")
    assert got[("r", 9)] == got[("q", 50)] == (0, 0, "clear")


def test_context_takes_the_state_of_its_time(spark):
    flags = ", ".join(f"{d} boolean" for d in resilience.DEPS)
    up = [True] * len(resilience.DEPS)
    down = [d != "dep_model_runtime" for d in resilience.DEPS]
    timeline = spark.createDataFrame([("t", 10, "degraded", *down), ("t", 20, "online", *up)], f"tenant_id string, at_us long, mode string, {flags}")
    capsules = spark.createDataFrame([("t", 12), ("t", 12)], "tenant_id string, issued_us long")
    asks = spark.createDataFrame([("t", "a", 9), ("t", "b", 10), ("t", "c", 15), ("t", "d", 20), ("u", "e", 15)], "tenant_id string, event_id string, ts_us long")
    got = {r["event_id"]: (r["resilience_mode"], r["capsule_valid"], r["confidence_multiplier"], r["unavailable_sources"])
           for r in resilience.context_asof(asks, timeline, capsules).collect()}
    assert got == {"a": ("online", False, 1.0, ""), "b": ("degraded", False, 0.25, "model_runtime"),
                   "c": ("degraded", True, 0.72, "model_runtime"), "d": ("online", True, 1.0, ""), "e": ("online", False, 1.0, "")}
