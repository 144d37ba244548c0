"""The replay against a walk in time order, and the checks that events pass before."""

import random
from datetime import timedelta

from pyspark.sql import functions as F

from vigil import config
from vigil.config import DEFAULTS
from vigil.functions.scalars import DAY_US, HOUR_US
from vigil.functions.storage import cut
from vigil.operators import policy
from vigil.operators.resilience import DEPS
from vigil.operators.sender import account_history
from vigil.plans import replay as R
from vigil.plans.scoring import feature_table, features_from, scored_events, with_contexts

from builders import NOW, TELCO, event, events

DAYS, ACCOUNTS = 4, 50
START = NOW.replace(hour=0)


def recorded():
    rng, rows = random.Random(8), []
    for a in range(ACCOUNTS):
        for i in range(rng.randint(5, 9)):
            at = START + timedelta(seconds=rng.randrange(DAYS * 86_400))
            odd = rng.random() < 0.35
            kind = rng.choice(["transfer", "purchase", "withdrawal", "login", "pin_reset" if odd else "purchase"])
            amount = 0.0 if kind in ("login", "pin_reset") else float(rng.choice([200, 220, 260, 4000 if odd else 240]))
            rows.append(event(f"ev-{a:02d}-{i}", f"acct_{a}", at, event_type=kind, amount=amount, available_balance_before=4200.0 if amount else None,
                              channel=rng.choice(["app", "app", "ussd"]), recipient_id=f"shop{rng.randrange(4)}" if amount else None,
                              device_id=f"dev-{a}" if not odd else f"dev-x{rng.randrange(3)}", sim_id=f"sim-{a}" if rng.random() < 0.8 else "sim-y", ip_prefix=f"10.{a}",
                              keystroke_interval_ms=rng.choice([None, 100.0, 400.0]),
                              telco_assurance={**TELCO, "imsi_changed": odd, "iccid_changed": False, "sim_changes_30d": 2} if rng.random() < 0.3 else None))
    return rows


def test_replay_equals_the_walk_in_time_order(spark):
    """Days one after another, each scored with what the decided days before it left; budgets counted event by event."""
    rows = recorded()
    df = events(spark, rows)
    modes = spark.createDataFrame(
        [("t", r["event_id"], m, 0.82 if m == "degraded" else 1.0, *[not (m == "degraded" and d == "dep_telco_gateway") for d in DEPS])
         for r in rows for m in ["degraded" if r["occurred_at"].hour in (3, 4, 5) else "online"]],
        "tenant_id string, event_id string, resilience_mode string, confidence_multiplier double, " + ", ".join(f"{d} boolean" for d in DEPS))
    judged = [("ev-01-0", "confirmed_fraud"), ("ev-02-1", "legitimate"), ("ev-03-0", "legitimate"), ("ev-04-2", "confirmed_fraud")]
    feedback = spark.createDataFrame(judged, "event_id string, label string").join(
        df.select("event_id", (F.col("ts_us") + 30 * HOUR_US).alias("confirmed_us")), "event_id")
    done = R.replay(df, feedback=feedback, outage=modes)
    assert done.changes[-1] == 0 and done.changes[0] > 0 and done.rejected.count() == 0
    got = {r.event_id: r for r in done.decisions.select("event_id", "fused_score", "action", "regret_used").collect()}
    assert len(got) == len(rows)

    accepted = cut(R.admit(df, modes)[0].drop("rejections"))
    contexts = cut(R.without_graph(with_contexts(accepted, None)))
    labels = {k: v for k, v in judged}
    decided: dict[str, tuple] = {}
    at = {r.event_id: (r.ts_us, r.account_id, r.resilience_mode) for r in accepted.collect()}
    start = min(t for t, _, _ in at.values()) // DAY_US * DAY_US
    taken: dict[str, list[int]] = {}
    for day in range(DAYS + 1):
        now = [k for k, (t, _, _) in at.items() if t // DAY_US == start // DAY_US + day]
        if not now:
            continue
        trust = []
        for k, (score, action, _) in decided.items():
            safe = action in (config.ALLOW, config.ALLOW_MONITOR) and score < 0.48 and at[k][2] == "online"
            begin = at[k][0] + 24 * HOUR_US if safe else None
            told = at[k][0] + 30 * HOUR_US
            if labels.get(k) == "legitimate":
                begin = told if begin is None else min(begin, told)
            end = told if labels.get(k) in config.FRAUD_LABELS else None
            if begin is not None:
                trust.append(("t", k, begin, end))
        learned = spark.createDataFrame(trust, "tenant_id string, event_id string, from_us long, to_us long")
        features = cut(features_from(account_history(contexts, DEFAULTS, learned), contexts.columns))
        scored = cut(scored_events(features).where(F.col("event_id").isin(now)))
        # Every budget that could be met, answered at once; the walk picks the one that holds.
        options = cut(policy.safety_envelope(policy.decide(scored.withColumn("regret_used", F.explode(F.sequence(F.lit(0), F.lit(12)))))).select(
            "event_id", "regret_used", "fused_score", "action"))
        answer = {(r.event_id, r.regret_used): r for r in options.collect()}
        for k in sorted(now, key=lambda k: at[k][0]):
            t, account, _ = at[k]
            used = sum(t - 30 * DAY_US <= x < t for x in taken.get(account, []))
            r = answer[k, min(used, 12)]
            decided[k] = (r.fused_score, r.action, used)
            if r.action in config.INTRUSIVE_ACTIONS:
                taken.setdefault(account, []).append(t)
    assert {k: (v.fused_score, v.action, v.regret_used) for k, v in got.items()} == decided
    assert max(v[2] for v in decided.values()) >= 3
    trusted = {r.event_id for r in done.trust.collect()}
    assert "ev-02-1" in trusted and 0 < len(trusted) < len(rows)


def test_events_pass_the_checks(spark):
    stale = {"gateway_observed_at": (NOW - timedelta(hours=2)).isoformat()}
    swap = {**TELCO, "imsi_changed": True}
    rows = [event("ok-event-1", "acct_1", NOW, amount=10.0), event("ok-event-1", "acct_1", NOW + timedelta(hours=1), amount=11.0), event("ok-event-1", "acct_1", NOW, amount=10.0),
            event("bad-amount", "acct_1", NOW, amount=-1.0), event("bad-login1", "acct_1", NOW, event_type="login", amount=5.0),
            event("stale-one", "acct_1", NOW, amount=1.0, telco_assurance=swap, metadata=stale), event("masked-one", "acct_1", NOW, amount=1.0, telco_assurance=swap),
            event("plain-one", "acct_1", NOW, amount=1.0, telco_assurance=swap)]
    outage = spark.createDataFrame([("t", "masked-one", "degraded", 0.82, *[d != "dep_telco_gateway" for d in DEPS])],
                                   "tenant_id string, event_id string, resilience_mode string, confidence_multiplier double, " + ", ".join(f"{d} boolean" for d in DEPS))
    accepted, rejected = R.admit(events(spark, rows), outage)
    got = {r.event_id: r for r in accepted.collect()}
    assert sorted(got) == ["masked-one", "ok-event-1", "plain-one", "stale-one"] and accepted.count() == 4
    assert got["ok-event-1"].amount == 10.0
    assert [got[k].telco_assurance.gateway_attested for k in ("stale-one", "masked-one", "plain-one")] == [False, False, True]
    assert (got["masked-one"].resilience_mode, got["plain-one"].resilience_mode, got["plain-one"].confidence_multiplier) == ("degraded", "online", 1.0)
    why = sorted((r.event_id, *r.rejections) for r in rejected.collect())
    assert [w[0] for w in why] == ["bad-amount", "bad-login1", "ok-event-1", "ok-event-1"]
    assert why[2][1:] == why[3][1:] == ("duplicate_event",) and "non_transaction_amount" in why[1]


def test_budget_rounds_settle(spark):
    """Long rows of interventions: the first ones use a budget up, later ones are eased until it opens again."""
    rows = [event(f"ev-{a}-{i:03d}", f"acct_{a}", NOW + timedelta(days=4 * i), event_type="transfer", amount=float(1900 + 100 * i), available_balance_before=4000.0, recipient_id=f"m{i}", device_id=f"d{i}", sim_id="s")
            for a in (0, 2) for i in range(16)]
    accounts = spark.createDataFrame([("acct_0", False, 0), ("acct_2", False, 2)], "account_id string, shared_device_allowed boolean, regret_limit_30d int")
    scored = cut(scored_events(cut(feature_table(events(spark, rows), accounts))))
    got = R.with_budget(scored).select("account_id", "ts_us", "action", "regret_used").collect()
    assert len(got) == 32 and max(r.regret_used for r in got) > 0
    for r in got:
        assert r.regret_used == sum(o.account_id == r.account_id and o.action in config.INTRUSIVE_ACTIONS and r.ts_us - 30 * DAY_US <= o.ts_us < r.ts_us for o in got)


def test_nothing_to_replay(spark):
    none = events(spark, [event("e", "a")]).where("event_id = 'x'")
    done = R.replay(none)
    assert done.decisions.count() == done.rejected.count() == 0 and done.changes == [0]
