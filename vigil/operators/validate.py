"""Validation, normalisation and evidence gating of incoming events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import config
from vigil.config import DEFAULTS, Settings
from vigil.operators.sender import is_trusted, is_txn

ID_PATTERN = r"^[A-Za-z0-9_.:-]+$"


def _length(name: str, low: int, high: int) -> Column:
    return F.length(name).between(low, high)


def _optional(name: str, low: float, high: float) -> Column:
    return F.col(name).isNull() | F.col(name).between(low, high)


def event_rules() -> dict[str, Column]:
    """Rule name -> condition that a valid event satisfies."""
    rules: dict[str, Column] = {
        "event_id": _length("event_id", 6, 100) & F.col("event_id").rlike(ID_PATTERN),
        "account_id": _length("account_id", 3, 80) & F.col("account_id").rlike(ID_PATTERN),
        "occurred_at": F.col("occurred_at").isNotNull(),
        "event_type": F.col("event_type").isin(config.EVENT_TYPES),
        "channel": F.col("channel").isin(config.CHANNELS),
        "input_method": F.col("input_method").isin(config.INPUT_METHODS),
        "amount": F.col("amount").between(0.0, 1e9),
        "available_balance_before": _optional("available_balance_before", 0.0, 1e10),
        "latitude": _optional("latitude", -90.0, 90.0),
        "longitude": _optional("longitude", -180.0, 180.0),
        "interaction_ms": _optional("interaction_ms", 50, 3_600_000),
        "menu_depth": _optional("menu_depth", 1, 100),
        "keystroke_interval_ms": _optional("keystroke_interval_ms", 20.0, 5000.0),
        "device_tilt_variance": _optional("device_tilt_variance", 0.0, 10_000.0),
    }
    for name, high in {"recipient_id": 100, "device_id": 160, "sim_id": 160, "ip_prefix": 80,
                       "session_id": 160, "navigation_signature": 120}.items():
        rules[name] = F.col(name).isNull() | (F.length(name) <= high)
    ranges = {
        "telco_assurance": {"sim_activation_age_hours": (0, 100_000), "sim_changes_30d": (0, 30),
                            "previous_sim_tenure_days": (0, 10_000),
                            "otp_to_sim_change_minutes": (0, 100_000),
                            "otp_sim_geo_distance_km": (0, 20_100)},
        "coercion_signals": {"recipient_replacements": (0, 20), "confirmation_backtracks": (0, 30),
                             "amount_edits": (0, 30), "pause_before_confirmation_ms": (0, 3_600_000),
                             "on_device_coercion_score": (0, 1)},
        "agent_assurance": {"registered_latitude": (-90, 90), "registered_longitude": (-180, 180),
                            "shift_start_hour": (0, 23), "shift_end_hour": (0, 23),
                            "terminal_age_days": (0, 10_000)},
    }
    for struct, fields in ranges.items():
        ok = F.lit(True)
        for field, (low, high) in fields.items():
            value = F.col(struct)[field]
            ok = ok & (value.isNull() | value.between(low, high))
        rules[struct] = ok
    agent = F.col("agent_assurance")
    for token in ("agent_token", "terminal_token"):
        rules[token] = agent.isNull() | (
            F.length(agent[token]).between(8, 96) & agent[token].rlike(ID_PATTERN))
    return rules


def pair_rules() -> dict[str, Column]:
    agent = F.col("agent_assurance")
    return {
        "coordinates_together": F.col("latitude").isNull() == F.col("longitude").isNull(),
        "non_transaction_amount": is_txn() | (F.col("amount") == 0),
        "menu_depth_needs_interaction": F.col("menu_depth").isNull() | F.col("interaction_ms").isNotNull(),
        "agent_envelope_channel": agent.isNull() | (F.col("channel") == "agent"),
        "terminal_coordinates_together": agent.isNull() | (
            agent["registered_latitude"].isNull() == agent["registered_longitude"].isNull()),
        "shift_hours_together": agent.isNull() | (
            agent["shift_start_hour"].isNull() == agent["shift_end_hour"].isNull()),
    }


def violations(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()
    ]))


def validate_events(df: DataFrame) -> DataFrame:
    """Adds ``violations``; an empty array means the event is valid."""
    return df.withColumn("violations", violations({**event_rules(), **pair_rules()}))


def normalise_time(df: DataFrame, text: str = "occurred_text") -> DataFrame:
    """ISO text to a UTC instant; text without an offset is rejected (null, has_zone false)."""
    has_zone = F.col(text).rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return df.withColumn("has_zone", has_zone).withColumn(
        "occurred_at", F.when(has_zone, F.try_to_timestamp(F.col(text)))
    )


def _clear(struct: str, field: str, condition: Column) -> Column:
    s = F.col(struct)
    return F.when(s.isNotNull() & condition, s.withField(field, F.lit(False))).otherwise(s)


def enforce_freshness(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Clears attestations of evidence observed too far from the event, and marks the metadata."""
    observed_text = F.col("metadata")["gateway_observed_at"]
    # An unreadable time counts as a day old.
    observed = F.coalesce(
        F.unix_micros(F.try_to_timestamp(observed_text)), F.col("ts_us") - 86_400_000_000)
    stale = observed_text.isNotNull() & (observed_text != "") & (
        F.abs(F.col("ts_us") - observed) > settings.evidence_max_age_seconds * 1_000_000)
    stale = F.coalesce(stale, F.lit(False))
    return df.withColumns({
        "telco_assurance": _clear("telco_assurance", "gateway_attested", stale),
        "coercion_signals": _clear("coercion_signals", "consented_device_attested", stale),
        "agent_assurance": _clear("agent_assurance", "gateway_attested", stale),
        "metadata": F.when(
            stale,
            F.map_concat(
                F.map_filter("metadata", lambda k, v: k != "evidence_freshness_status"),
                F.create_map(F.lit("evidence_freshness_status"), F.lit("stale_ignored"))),
        ).otherwise(F.col("metadata")),
    })


def mask_unavailable(df: DataFrame) -> DataFrame:
    """Clears telco / terminal attestation while that gateway is out (columns dep_<name>)."""
    return df.withColumns({
        "telco_assurance": _clear("telco_assurance", "gateway_attested", ~F.col("dep_telco_gateway")),
        "agent_assurance": _clear("agent_assurance", "gateway_attested", ~F.col("dep_agent_integrity")),
    })


def trusted_filter(df: DataFrame) -> DataFrame:
    return df.filter(is_trusted())


def transaction_filter(df: DataFrame) -> DataFrame:
    return df.filter(is_txn())


def tenant_filter(df: DataFrame, tenant: str) -> DataFrame:
    return df.filter(F.col("tenant_id") == tenant)


def schema_hash(names: list[str]) -> Column:
    """Digest of an ordered feature list; a model with another digest is rejected."""
    return F.sha2(F.lit("|".join(names)), 256)
