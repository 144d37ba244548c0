"""Rules against numbers worked out by hand, one row for each floor, compound signature and threshold, and near misses."""

import pytest
from pyspark.sql import functions as F

from vigil import config
from vigil.functions import rules
from vigil.operators.scoring import compound_codes, floor_codes

SWAP = {"new_sim": 1, "recent_sim_activation": 0.70, "imsi_change": 1}
OTP = {"new_sim": 1, "otp_sim_change_proximity": 0.75, "otp_sim_geo_mismatch": 0.60}
MULE = {"recipient_sender_diversity_24h": 0.5, "recipient_first_time_sender_ratio_24h": 0.6, "recipient_rapid_cashout_ratio_1h": 0.45}
CROSS = {"new_channel_enrollment_24h": 1, "channel_transition_novelty": 0.7, "app_to_ussd_handoff": 1}
TERMINAL = {"agent_evidence_coverage": 0.5, "agent_customer_diversity_1h": 0.4, "agent_recipient_concentration_24h": 0.6, "agent_location_mismatch": 0.35}
FORCED = {"coercion_evidence_coverage": 0.5, "call_transfer_overlap": 1, "new_recipient": 1, "screen_sharing_signal": 0.6}
BOTH = {"new_device": 1, "new_sim": 1}

#: (floor, features that fire it, score that it must give, one feature changed so that it must not fire)
FLOORS = [
    ("DEVICE_SIM_COCHANGE", BOTH | {"history_confidence": 0.25, "balance_drain_ratio": 0.4}, 0.76, {"history_confidence": 0.24}),
    ("RECOVERY_THEN_NEW_RECIPIENT", {"recovery_signal_72h": 1, "new_recipient": 1}, 0.78, {"new_recipient": 0}),
    ("FAILED_AUTH_NEW_DEVICE", {"failed_auth_24h": 0.6, "new_device": 1}, 0.82, {"failed_auth_24h": 0.59}),
    ("IMPOSSIBLE_TRAVEL_NEW_DEVICE", {"impossible_travel": 0.7, "new_device": 1}, 0.76, {"impossible_travel": 0.69}),
    ("ATTESTED_SIM_IDENTITY_CHANGE", SWAP, 0.80, {"verified_sim_change": 1}),
    ("OTP_AFTER_SIM_CHANGE", OTP, 0.84, {"otp_sim_geo_mismatch": 0.59}),
    ("MULE_FAN_IN_CASHOUT", MULE, 0.76, {"recipient_rapid_cashout_ratio_1h": 0.44}),
    ("AGENT_SINGLE_REPORT", {"agent_confirmed_fraud_score": 0.1}, 0.42, {"agent_confirmed_fraud_score": 0}),
    ("AGENT_MULTI_VICTIM", {"agent_confirmed_accounts": 2 / 3}, 0.76, {"agent_confirmed_accounts": 1 / 3}),
    ("AGENT_CAMPAIGN_PATTERN", TERMINAL, 0.74, {"agent_location_mismatch": 0.34}),
    ("RISK_WINDOW_NEW_RECIPIENT", {"account_hazard_score": 0.35, "new_recipient": 1}, 0.66, {"account_hazard_score": 0.34}),
    ("CROSS_CHANNEL_SEQUENCE", CROSS, 0.72, {"app_to_ussd_handoff": 0}),
    ("RECIPIENT_SINGLE_REPORT", {"recipient_confirmed_fraud_score": 0.3}, 0.42, {"recipient_confirmed_fraud_score": 0}),
    ("RECIPIENT_MULTI_ACCOUNT", {"recipient_confirmed_accounts": 1}, 0.76, {"recipient_confirmed_accounts": 1 / 3}),
    ("COERCION_DURING_CALL", FORCED, 0.70, {"screen_sharing_signal": 0.59}),
]

#: (signature, features that fire it, what it must add, one feature changed so that it must not fire)
COMPOUNDS = [
    ("DEVICE_SIM_COCHANGE", BOTH | {"history_confidence": 0.5, "shared_device_allowed": 1}, 0.12 * 0.5 * 0.25, {"history_confidence": 0.19}),
    ("CROSS_CHANNEL_TAKEOVER_SEQUENCE", CROSS, 0.13, {"channel_transition_novelty": 0.69}),
    ("CONFIRMED_RECIPIENT_REPUTATION", {"recipient_confirmed_fraud_score": 0.5}, 0.04, {"recipient_confirmed_fraud_score": 0}),
    ("CONFIRMED_AGENT_TERMINAL", {"agent_confirmed_fraud_score": 0.25}, 0.02, {"agent_confirmed_fraud_score": 0}),
    ("RECOVERY_THEN_NEW_RECIPIENT", {"recovery_signal_72h": 1, "new_recipient": 1}, 0.12, {"recovery_signal_72h": 0}),
    ("UNUSUAL_BALANCE_DRAIN", {"balance_drain_ratio": 0.7, "amount_deviation": 0.45}, 0.09, {"amount_deviation": 0.44}),
    ("FAILED_AUTH_NEW_DEVICE", {"failed_auth_24h": 0.4, "new_device": 1}, 0.08, {"failed_auth_24h": 0.39}),
    ("USSD_RHYTHM_BURST", {"is_ussd": 1, "interaction_speed_deviation": 0.5, "velocity_5m": 0.4}, 0.06, {"velocity_5m": 0.39}),
    ("TELCO_SIM_SWAP_SIGNATURE", SWAP, 0.14, {"recent_sim_activation": 0.69}),
    ("OTP_SIM_GEO_CONFLICT", OTP, 0.12, {"otp_sim_change_proximity": 0.74}),
    ("MULE_COLLECTION_SIGNATURE", MULE, 0.14, {"recipient_sender_diversity_24h": 0.49}),
    ("AGENT_TERMINAL_CAMPAIGN", TERMINAL, 0.16, {"agent_evidence_coverage": 0}),
    ("ACCOUNT_RISK_WINDOW", {"account_hazard_score": 0.3, "new_recipient": 1}, 0.10, {"account_hazard_score": 0.29}),
    ("COERCION_SESSION_SIGNATURE", FORCED, 0.14, {"call_transfer_overlap": 0}),
]


def _rows(spark, cases):
    zero = {n: 0.0 for n in config.FEATURES + config.AGENT_FEATURES} | {"shared_device_allowed": 0.0, "history_confidence": 0.0}
    names = sorted(set(zero).union(*cases))
    rows = [(i, *[float((zero | case).get(n, 0.0)) for n in names]) for i, case in enumerate(cases)]
    return spark.createDataFrame(rows, ", ".join(["i int", *[f"{n} double" for n in names]]))


def test_every_rule_has_a_row():
    assert [c for c, *_ in FLOORS] == [c for c, *_ in config.FLOORS]
    assert [c for c, *_ in COMPOUNDS] == [c for c, *_ in config.COMPOUNDS]


def test_floors(spark):
    cases = [x for _, fires, _, miss in FLOORS for x in (fires, fires | miss)]
    df = _rows(spark, cases).select("i", floor_codes().alias("codes"), *[F.expr(rules.floor_value(c, v)).alias(code) for code, c, v in config.FLOORS])
    got = {r.i: r for r in df.collect()}
    for k, (code, _, score, _) in enumerate(FLOORS):
        assert code in got[2 * k].codes and got[2 * k][code] == pytest.approx(score), code
        assert code not in got[2 * k + 1].codes and got[2 * k + 1][code] == 0, code


def test_compounds(spark):
    cases = [x for _, fires, _, miss in COMPOUNDS for x in (fires, fires | miss)]
    df = _rows(spark, cases)
    df = df.select("i", compound_codes(df).alias("codes"), *[F.expr(rules.compound(c, v)).alias(code) for code, c, v, _ in config.COMPOUNDS])
    got = {r.i: r for r in df.collect()}
    for k, (code, _, added, _) in enumerate(COMPOUNDS):
        assert code in got[2 * k].codes and got[2 * k][code] == pytest.approx(added), code
        assert code not in got[2 * k + 1].codes and got[2 * k + 1][code] == 0, code


def test_the_largest_floor_counts(spark):
    df = _rows(spark, [SWAP | OTP | MULE, {}]).select(F.expr(rules.security_floor()).alias("x"))
    assert [r.x for r in df.collect()] == [pytest.approx(0.84), 0.0]


def test_levels_change_at_the_thresholds(spark):
    scores = [0.0, 0.2999, 0.30, 0.4799, 0.48, 0.6599, 0.66, 0.8399, 0.84, 1.0]
    df = spark.createDataFrame([(x,) for x in scores], "s double").select(F.expr(rules.risk_level("s")).alias("x"))
    assert [r.x for r in df.collect()] == ["low", "low", "guarded", "guarded", "elevated", "elevated", "high", "high", "critical", "critical"]


def test_model_and_rules_blend_by_maturity(spark):
    rows = [(None, 0.5, 0.9), (0.8, 0.5, 0.29), (0.8, 0.5, 0.30)]
    df = spark.createDataFrame(rows, "model_score double, anomaly_score double, history_confidence double").select(F.expr(rules.blended()).alias("x"))
    # 0.68 * 0.8 + 0.32 * 0.5 and 0.58 * 0.8 + 0.42 * 0.5
    assert [r.x for r in df.collect()] == pytest.approx([0.5, 0.704, 0.674])
