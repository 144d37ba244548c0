from datetime import timedelta

import pytest

from vigil import config
from vigil.operators.campaign import with_campaign
from vigil.operators.scoring import anomaly, fuse
from vigil.operators.sender import sender_features
from vigil.plans.scoring import feature_table, score_features
from pyspark.sql import functions as F

from builders import AGENT, NOW, TELCO, event, events, normal_history, one


def test_normal_against_attack(spark):
    rows = normal_history() + [
        event("normal", "acct_1", NOW, amount=2100.0, available_balance_before=40_000.0, recipient_id="shop",
              device_id="dev-a", sim_id="sim-a", ip_prefix="10.0", latitude=6.5, longitude=3.4),
        event("attack", "acct_1", NOW + timedelta(minutes=1), event_type="transfer", amount=39_000.0,
              available_balance_before=40_000.0, recipient_id="mule", device_id="dev-x", sim_id="sim-x",
              ip_prefix="99.9", latitude=9.5, longitude=8.4),
    ]
    df = sender_features(events(spark, rows))
    normal, attack = one(df, "normal"), one(df, "attack")
    assert normal["history_confidence"] > 0.80
    assert normal["new_recipient"] == normal["new_device"] == normal["new_sim"] == 0
    assert normal["amount_deviation"] < 0.20
    assert attack["new_recipient"] == attack["new_device"] == attack["new_sim"] == attack["new_ip_prefix"] == 1
    assert attack["amount_deviation"] > 0.90 and attack["balance_drain_ratio"] > 0.90
    assert attack["impossible_travel"] > 0


def test_unattested_telco_is_ignored(spark):
    swap = {**TELCO, "imsi_changed": True, "sim_activation_age_hours": 1.0}
    rows = [event("on", "a", NOW, telco_assurance=swap),
            event("off", "b", NOW, telco_assurance={**swap, "gateway_attested": False})]
    df = sender_features(events(spark, rows))
    assert one(df, "on")["imsi_change"] == 1 and one(df, "on")["recent_sim_activation"] > 0.9
    assert one(df, "off")["imsi_change"] == 0 and one(df, "off")["telco_assurance_coverage"] == 0


def test_risk_window_decays(spark):
    rows = [event("recovery", "a", NOW, event_type="account_recovery")]
    rows += [event(f"h{h:02d}", "a", NOW + timedelta(hours=h), amount=10.0) for h in (1, 24, 71, 73)]
    df = sender_features(events(spark, rows))
    scores = [one(df, f"h{h:02d}")["account_hazard_score"] for h in (1, 24, 71, 73)]
    assert scores[0] > scores[1] > scores[2] > 0 and scores[3] == 0
    assert one(df, "h01")["risk_window_state"] == "elevated"
    assert one(df, "h01")["active_precursors"] == ["account recovery"]


def test_monthly_pattern(spark):
    rows = [event(f"m{m}", "a", NOW.replace(month=m), event_type="transfer", amount=5000.0, recipient_id="rent")
            for m in (3, 4, 5)]
    rows.append(event("now", "a", NOW, event_type="transfer", amount=5100.0, recipient_id="rent"))
    row = one(sender_features(events(spark, rows)), "now")
    assert row["recurring_payment_match"] == 1.0 and row["calendar_confidence"] == 0.75
    assert row["day_of_month_deviation"] == 0


def test_mule_and_popular_merchant(spark):
    rows = [event(f"feed-{i}", f"s{i}", NOW - timedelta(minutes=50 - i), event_type="transfer", amount=50_000.0,
                  recipient_id="mule") for i in range(6)]
    rows.append(event("cash", "mule", NOW - timedelta(minutes=5), event_type="withdrawal", amount=250_000.0))
    rows.append(event("victim", "v", NOW, event_type="transfer", amount=40_000.0, recipient_id="mule"))
    rows += [event(f"buy-{i}", f"b{i}", NOW - timedelta(minutes=40 - i), amount=900.0, recipient_id="market")
             for i in range(9)]
    rows.append(event("buyer", "b9x", NOW, amount=900.0, recipient_id="market"))
    df = fuse(anomaly(feature_table(events(spark, rows)).withColumn("model_score", F.lit(None).cast("double"))))
    victim, buyer = one(df, "victim"), one(df, "buyer")
    assert victim["unique_senders_24h"] == 7 and victim["first_time_sender_ratio_24h"] == 1.0
    assert victim["recipient_rapid_cashout_ratio_1h"] > 0.80
    assert "MULE_FAN_IN_CASHOUT" in victim["security_floor_codes"] and victim["fused_score"] >= 0.76
    assert "MULE_FAN_IN_CASHOUT" not in buyer["security_floor_codes"] and buyer["fused_score"] < 0.76


def test_terminal_concentration(spark):
    rows = [event(f"t{i}", f"c{i}", NOW - timedelta(minutes=30 - i), event_type="transfer", channel="agent",
                  amount=1000.0, recipient_id="hub", agent_assurance=AGENT) for i in range(5)]
    rows.append(event("last", "c9", NOW, event_type="transfer", channel="agent", amount=1000.0,
                      recipient_id="other", agent_assurance=AGENT))
    row = one(feature_table(events(spark, rows)), "last")
    assert row["agent_customer_diversity_1h"] == 0.5
    assert row["agent_recipient_concentration_24h"] == pytest.approx(5 / 6, abs=1e-6)


def test_later_events_do_not_change_earlier_rows(spark):
    rows = normal_history(10)
    later = [event("later", "acct_1", NOW + timedelta(days=1), amount=9.0, recipient_id="z")]
    names = ["event_id", *config.FEATURES]
    before = {r["event_id"]: r for r in feature_table(events(spark, rows)).select(*names).collect()}
    after = {r["event_id"]: r for r in feature_table(events(spark, rows + later)).select(*names).collect()}
    assert all(after[k] == v for k, v in before.items())


def test_campaign_and_invariants(spark):
    rows = []
    for i in range(4):
        rows.append(event(f"rec-{i}", f"v{i}", NOW - timedelta(hours=1), event_type="account_recovery"))
        rows += [event(f"h-{i}-{j}", f"v{i}", NOW - timedelta(days=9 - j), amount=100.0, recipient_id="shop",
                       device_id="old", sim_id="old") for j in range(8)]
        rows.append(event(f"out-{i}", f"v{i}", NOW + timedelta(minutes=i), event_type="transfer", amount=900.0,
                          available_balance_before=1000.0, recipient_id="new", device_id="new", sim_id="new"))
    features = feature_table(events(spark, rows))
    staged = one(with_campaign(features), "out-3")
    assert staged["campaign_accounts"] == 4 and staged["campaign_is_eligible"] and staged["campaign_risk"] >= 0.70
    for row in score_features(features).collect():
        assert 0 <= row["fused_score"] <= 1 and row["fused_score"] >= row["security_floor"]
        assert row["action"] in config.ACTIONS and len(row["reasons"]) <= 8
