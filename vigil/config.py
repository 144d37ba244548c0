"""Fixed values of the risk model: names, weights, rules, thresholds and texts.

Everything here is data.  Operators turn these tables into column expressions, so a calibration
changes a table and never the logic.  Rule conditions are SQL predicates over feature columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --------------------------------------------------------------------------- fixed values: enums
CHANNELS = ["app", "ussd", "web", "agent"]
INPUT_METHODS = ["unknown", "typed", "pasted", "mixed"]
EVENT_TYPES = [
    "login", "failed_login", "transfer", "paybill", "purchase", "withdrawal", "deposit",
    "pin_reset", "account_recovery",
]
TRANSACTION_TYPES = ["transfer", "paybill", "purchase", "withdrawal", "deposit"]
UNTRUSTED_TYPES = ["failed_login", "pin_reset", "account_recovery"]
AUTH_TYPES = ["login", "account_recovery", "pin_reset"]
RISK_LEVELS = ["low", "guarded", "elevated", "high", "critical"]
RESILIENCE_MODES = ["online", "degraded", "isolated", "reconciling"]
FRAUD_LABELS = ["account_takeover", "other_fraud"]
INDICATOR_TYPES = ["recipient", "agent_terminal", "campaign"]

ALLOW = "allow"
ALLOW_MONITOR = "allow_with_monitoring"
STEP_UP = "trusted_channel_confirmation"
DELAY = "reversible_settlement_delay"
HOLD = "reversible_hold_and_review"
SAFE_PAUSE = "private_safety_pause"
ACTIONS = [ALLOW, ALLOW_MONITOR, STEP_UP, DELAY, HOLD, SAFE_PAUSE]  # ascending severity
INTRUSIVE_ACTIONS = [STEP_UP, DELAY, HOLD, SAFE_PAUSE]


@dataclass(frozen=True)
class Settings:
    """Tunable parameters with the reference defaults."""

    lookback_days: int = 180
    network_lookback_days: int = 7
    campaign_window_hours: int = 24
    evidence_max_age_seconds: int = 300
    learning_quarantine_hours: int = 24
    sketch_max_age_seconds: int = 900
    sketch_epoch_days: int = 7
    sketch_retention_days: int = 30
    sketch_capsule_ttl_hours: int = 24
    sketch_reports_per_hour: int = 100
    heartbeat_max_age_seconds: int = 300
    edge_capsule_ttl_hours: int = 8
    recovery_batch_size: int = 100
    # Scale knobs (no effect on results): the width of the time buckets of the two-level running aggregates.
    bucket_hours: int = 1
    terminal_bucket_hours: int = 6
    # Keys are supplied by the deployment; these placeholders only make fixtures reproducible.
    token_namespace: str = "sketch-v1"
    token_key: str = "fixture-token-key"
    recipient_key: str = "fixture-recipient-key"
    anchor_key: str = "fixture-anchor-key"
    policy_version: str = "policy-1.4.0"
    model_version: str = "rules-only"
    institution_keys: dict[str, str] = field(default_factory=dict)


DEFAULTS = Settings()

# ------------------------------------------------------------------- fixed values: feature names
FEATURES = [
    "amount_deviation", "amount_to_median", "balance_drain_ratio", "unusual_hour", "new_recipient",
    "recipient_rarity", "recipient_sender_diversity_24h", "recipient_first_time_sender_ratio_24h",
    "recipient_inflow_velocity_1h", "recipient_rapid_cashout_ratio_1h", "recipient_network_coverage",
    "recipient_confirmed_fraud_score", "recipient_confirmed_accounts", "recipient_watchlist_coverage",
    "new_device", "device_rarity", "new_sim", "new_ip_prefix", "new_channel",
    "channel_transition_novelty", "cross_channel_events_15m", "new_channel_enrollment_24h",
    "app_to_ussd_handoff", "cross_channel_device_mismatch", "velocity_5m", "velocity_1h",
    "failed_auth_24h", "recovery_signal_72h", "account_hazard_score", "risk_window_hours_remaining",
    "impossible_travel", "interaction_speed_deviation", "typing_cadence_deviation", "paste_anomaly",
    "device_handling_deviation", "navigation_novelty", "day_of_month_deviation",
    "recurring_payment_match", "calendar_confidence", "call_transfer_overlap",
    "screen_sharing_signal", "recipient_edit_anomaly", "confirmation_friction",
    "coercion_on_device_score", "coercion_evidence_coverage", "verified_sim_change",
    "recent_sim_activation", "repeat_sim_change", "imsi_change", "iccid_change", "sim_type_change",
    "otp_sim_change_proximity", "otp_sim_geo_mismatch", "short_previous_sim_tenure",
    "telco_assurance_coverage", "evidence_coverage", "history_confidence", "shared_device_allowed",
    "is_ussd", "is_transfer", "is_withdrawal",
]
AGENT_FEATURES = [
    "is_agent", "agent_customer_diversity_1h", "agent_recipient_concentration_24h",
    "agent_first_time_recipient_ratio_24h", "agent_failed_auth_ratio_1h", "agent_value_velocity_1h",
    "agent_location_mismatch", "agent_after_hours", "agent_terminal_novelty",
    "agent_confirmed_fraud_score", "agent_confirmed_accounts", "agent_evidence_coverage",
]
MODEL_EXCLUDED = [
    "recipient_confirmed_fraud_score", "recipient_confirmed_accounts",
    "recipient_watchlist_coverage", "is_transfer", "is_withdrawal",
]
MODEL_FEATURES = [name for name in FEATURES if name not in MODEL_EXCLUDED]
DRIFT_FEATURES = [
    "balance_drain_ratio", "amount_to_median", "amount_deviation", "new_recipient", "new_device",
    "recipient_inflow_velocity_1h", "history_confidence", "evidence_coverage",
    "telco_assurance_coverage",
]

# ---------------------------------------------------------------- fixed values: anomaly weights
WEIGHTS = {
    "amount_deviation": 0.11,
    "amount_to_median": 0.05,
    "balance_drain_ratio": 0.09,
    "unusual_hour": 0.06,
    "new_recipient": 0.08,
    "recipient_rarity": 0.03,
    "recipient_sender_diversity_24h": 0.07,
    "recipient_first_time_sender_ratio_24h": 0.04,
    "recipient_inflow_velocity_1h": 0.06,
    "recipient_rapid_cashout_ratio_1h": 0.09,
    "recipient_confirmed_fraud_score": 0.13,
    "recipient_confirmed_accounts": 0.07,
    "new_device": 0.06,
    "device_rarity": 0.02,
    "new_sim": 0.11,
    "new_ip_prefix": 0.03,
    "new_channel": 0.02,
    "channel_transition_novelty": 0.04,
    "cross_channel_events_15m": 0.05,
    "new_channel_enrollment_24h": 0.09,
    "app_to_ussd_handoff": 0.04,
    "cross_channel_device_mismatch": 0.05,
    "velocity_5m": 0.10,
    "velocity_1h": 0.04,
    "failed_auth_24h": 0.10,
    "recovery_signal_72h": 0.10,
    "account_hazard_score": 0.10,
    "impossible_travel": 0.08,
    "interaction_speed_deviation": 0.05,
    "typing_cadence_deviation": 0.06,
    "paste_anomaly": 0.05,
    "device_handling_deviation": 0.04,
    "navigation_novelty": 0.05,
    "day_of_month_deviation": 0.035,
    "call_transfer_overlap": 0.03,
    "screen_sharing_signal": 0.09,
    "recipient_edit_anomaly": 0.05,
    "confirmation_friction": 0.05,
    "coercion_on_device_score": 0.08,
    "recent_sim_activation": 0.09,
    "repeat_sim_change": 0.06,
    "imsi_change": 0.05,
    "iccid_change": 0.05,
    "sim_type_change": 0.03,
    "otp_sim_change_proximity": 0.05,
    "otp_sim_geo_mismatch": 0.06,
    "short_previous_sim_tenure": 0.03,
    "agent_customer_diversity_1h": 0.03,
    "agent_recipient_concentration_24h": 0.04,
    "agent_first_time_recipient_ratio_24h": 0.02,
    "agent_failed_auth_ratio_1h": 0.07,
    "agent_value_velocity_1h": 0.04,
    "agent_location_mismatch": 0.08,
    "agent_after_hours": 0.03,
    "agent_terminal_novelty": 0.02,
    "agent_confirmed_fraud_score": 0.13,
    "agent_confirmed_accounts": 0.08,
}
# Features whose weight grows with profile confidence.
PROFILE_DEPENDENT = {
    "unusual_hour", "new_recipient", "recipient_rarity", "new_device", "device_rarity", "new_sim",
    "new_ip_prefix", "new_channel", "channel_transition_novelty", "new_channel_enrollment_24h",
    "app_to_ussd_handoff", "cross_channel_device_mismatch", "interaction_speed_deviation",
    "typing_cadence_deviation", "paste_anomaly", "device_handling_deviation", "navigation_novelty",
    "day_of_month_deviation",
}
SHARED_DEVICE_DAMPED = {"new_device", "device_rarity"}
VERIFIED_SIM_DAMPED = {
    "new_sim", "recent_sim_activation", "repeat_sim_change", "imsi_change", "iccid_change",
    "sim_type_change", "otp_sim_change_proximity", "otp_sim_geo_mismatch",
    "short_previous_sim_tenure",
}
CALENDAR_DAMPED = {
    "amount_deviation", "amount_to_median", "unusual_hour", "new_recipient", "recipient_rarity",
    "day_of_month_deviation",
}
ANOMALY_SCALE = 0.72
REASON_MINIMUM = 0.015
MAX_REASONS = 8

# ------------------------------------------------ fixed values: shared predicates over features
MULE = (
    "recipient_sender_diversity_24h >= 0.50 and recipient_first_time_sender_ratio_24h >= 0.60"
    " and recipient_rapid_cashout_ratio_1h >= 0.45"
)
CROSS_CHANNEL = (
    "new_channel_enrollment_24h >= 1 and channel_transition_novelty >= 0.70"
    " and greatest(app_to_ussd_handoff, cross_channel_device_mismatch) > 0"
)
TERMINAL_CAMPAIGN = (
    "agent_evidence_coverage > 0 and agent_customer_diversity_1h >= 0.40"
    " and agent_recipient_concentration_24h >= 0.60"
    " and greatest(recipient_rapid_cashout_ratio_1h, agent_failed_auth_ratio_1h,"
    " agent_location_mismatch, agent_confirmed_fraud_score) >= 0.35"
)
COERCION = (
    "coercion_evidence_coverage > 0 and call_transfer_overlap > 0 and new_recipient > 0"
    " and greatest(screen_sharing_signal, confirmation_friction, coercion_on_device_score) >= 0.60"
)
SIM_SWAP = (
    "new_sim > 0 and recent_sim_activation >= 0.70 and imsi_change + iccid_change >= 1"
    " and verified_sim_change = 0"
)
OTP_CONFLICT = (
    "new_sim > 0 and otp_sim_change_proximity >= 0.75 and otp_sim_geo_mismatch >= 0.60"
    " and verified_sim_change = 0"
)

# Compound signatures: (code, condition, added contribution, message).
COMPOUNDS = [
    ("DEVICE_SIM_COCHANGE",
     "new_device > 0 and new_sim > 0 and verified_sim_change = 0 and history_confidence >= 0.2",
     "0.12 * greatest(0.25, history_confidence)"
     " * case when shared_device_allowed > 0 then 0.25 else 1.0 end",
     "A new device and new SIM appeared together."),
    ("CROSS_CHANNEL_TAKEOVER_SEQUENCE", CROSS_CHANNEL, "0.13",
     "A new-channel authentication sequence was followed by a mismatched transfer."),
    ("CONFIRMED_RECIPIENT_REPUTATION", "recipient_confirmed_fraud_score > 0",
     "0.08 * recipient_confirmed_fraud_score",
     "Prior analyst-confirmed fraud reports involve this recipient."),
    ("CONFIRMED_AGENT_TERMINAL", "agent_confirmed_fraud_score > 0",
     "0.08 * agent_confirmed_fraud_score",
     "Prior analyst-confirmed fraud reports involve this agency terminal."),
    ("RECOVERY_THEN_NEW_RECIPIENT", "recovery_signal_72h > 0 and new_recipient > 0", "0.12",
     "A recovery event was followed by payment to a new recipient."),
    ("UNUSUAL_BALANCE_DRAIN", "balance_drain_ratio >= 0.70 and amount_deviation >= 0.45", "0.09",
     "An unusually large transaction would drain most of the balance."),
    ("FAILED_AUTH_NEW_DEVICE", "failed_auth_24h >= 0.40 and new_device > 0", "0.08",
     "Failed authentication attempts were followed by activity from a new device."),
    ("USSD_RHYTHM_BURST",
     "is_ussd > 0 and interaction_speed_deviation >= 0.50 and velocity_5m >= 0.40", "0.06",
     "USSD navigation rhythm and transaction velocity changed together."),
    ("TELCO_SIM_SWAP_SIGNATURE", SIM_SWAP, "0.14",
     "Attested telco evidence shows a recent identity-changing SIM replacement."),
    ("OTP_SIM_GEO_CONFLICT", OTP_CONFLICT, "0.12",
     "An OTP followed the SIM change from a distant location."),
    ("MULE_COLLECTION_SIGNATURE", MULE, "0.14",
     "The recipient combined many first-time senders with rapid fund movement."),
    ("AGENT_TERMINAL_CAMPAIGN", TERMINAL_CAMPAIGN, "0.16",
     "One attested agent terminal linked several customers to a concentrated suspicious pattern."),
    ("ACCOUNT_RISK_WINDOW", "account_hazard_score >= 0.30 and new_recipient > 0", "0.10",
     "This payment occurred during a decaying precursor-risk window."),
    ("COERCION_SESSION_SIGNATURE", COERCION, "0.14",
     "Attested session signals suggest the customer may be acting under direction."),
]

# Security floors: (code, condition, minimum score).
FLOORS = [
    ("DEVICE_SIM_COCHANGE",
     "new_device > 0 and new_sim > 0 and verified_sim_change = 0 and history_confidence >= 0.25",
     "0.70 + 0.15 * balance_drain_ratio"),
    ("RECOVERY_THEN_NEW_RECIPIENT", "recovery_signal_72h > 0 and new_recipient > 0", "0.78"),
    ("FAILED_AUTH_NEW_DEVICE", "failed_auth_24h >= 0.60 and new_device > 0", "0.82"),
    ("IMPOSSIBLE_TRAVEL_NEW_DEVICE", "impossible_travel >= 0.70 and new_device > 0", "0.76"),
    ("ATTESTED_SIM_IDENTITY_CHANGE", SIM_SWAP, "0.80"),
    ("OTP_AFTER_SIM_CHANGE", OTP_CONFLICT, "0.84"),
    ("MULE_FAN_IN_CASHOUT", MULE, "0.76"),
    ("AGENT_SINGLE_REPORT", "agent_confirmed_fraud_score > 0", "0.42"),
    ("AGENT_MULTI_VICTIM", "agent_confirmed_accounts * 3.0 >= 2.0", "0.76"),
    ("AGENT_CAMPAIGN_PATTERN", TERMINAL_CAMPAIGN, "0.74"),
    ("RISK_WINDOW_NEW_RECIPIENT", "account_hazard_score >= 0.35 and new_recipient > 0", "0.66"),
    ("CROSS_CHANNEL_SEQUENCE", CROSS_CHANNEL, "0.72"),
    ("RECIPIENT_SINGLE_REPORT", "recipient_confirmed_fraud_score > 0", "0.42"),
    ("RECIPIENT_MULTI_ACCOUNT", "recipient_confirmed_accounts * 3.0 >= 2.0", "0.76"),
    ("COERCION_DURING_CALL", COERCION, "0.70"),
]

# ------------------------------------------------------------------------ fixed values: fusion
IMMATURE_CONFIDENCE = 0.30
MODEL_WEIGHT_IMMATURE = 0.68
MODEL_WEIGHT_MATURE = 0.58
COLD_START_CONFIDENCE = 0.20
SPARSE_COVERAGE = 0.45
NOTE_NO_MODEL = "Population model unavailable; decision uses the transparent behavioural scorer."
NOTE_COLD_START = "Behavioural profile is immature; novelty findings carry reduced weight."
NOTE_SPARSE = "Only core transaction signals were available; the response remains reversible."

# ------------------------------------------------------------------------ fixed values: policy
THRESHOLDS = {"monitor": 0.30, "confirm": 0.48, "delay": 0.66, "hold": 0.84}
RESIDUAL_LOSS = {ALLOW: 0.98, ALLOW_MONITOR: 0.78, STEP_UP: 0.32, DELAY: 0.12, HOLD: 0.04}
BASE_FRICTION = {ALLOW: 0.0, ALLOW_MONITOR: 15.0, STEP_UP: 240.0, DELAY: 720.0, HOLD: 1900.0}
SAFE_PAUSE_RESIDUAL = 0.10
SAFE_PAUSE_FRICTION = 520.0
HOLD_SECONDS = {DELAY: 900, SAFE_PAUSE: 900, HOLD: 7200}
CRITICAL_SIGNAL = [
    "recovery_signal_72h > 0 and new_recipient > 0",
    "failed_auth_24h >= 0.60 and new_device > 0",
    "new_sim > 0 and new_device > 0 and verified_sim_change = 0 and balance_drain_ratio >= 0.60",
    SIM_SWAP,
    MULE,
    "recipient_confirmed_accounts * 3.0 >= 2.0",
    "new_channel_enrollment_24h > 0 and channel_transition_novelty >= 0.70"
    " and greatest(app_to_ussd_handoff, cross_channel_device_mismatch) > 0",
    "campaign_risk >= 0.75",
    "consortium_recipient_risk >= 0.75",
    "fraud_sketch_risk >= 0.75 and fraud_sketch_local_corroboration > 0",
    COERCION,
]
PERSONAL_BUDGET = "The account has reached its 30-day intervention budget."
PERSONAL_USSD = "USSD confirmation has higher customer effort."
PERSONAL_RECURRING = "This resembles a well-established monthly payment."
PERSONAL_LOW_CONFIDENCE = "Decision confidence is low, so irreversible friction is penalised."
PERSONAL_SINGLE_REPORT = "A single recipient report triggers monitoring, not customer interruption."
PERSONAL_SKETCH_MONITOR = (
    "Shared fraud sketches without local corroboration can only increase monitoring."
)
PERSONAL_SKETCH_DELAY = (
    "Cross-bank evidence can justify a reversible delay, but not a hold without stronger local"
    " evidence."
)
PERSONAL_STANDARD = "Standard risk, exposure and friction costs were applied."
OVERRIDE_LOW_CONFIDENCE = (
    "Low decision confidence changed an automatic hold to a reversible delay."
)
OVERRIDE_CRITICAL = "Security-critical evidence overrides the soft Regret Budget."
OVERRIDE_DELAY = "Regret Budget changed a settlement delay to trusted-channel confirmation."
OVERRIDE_STEP_UP = "Regret Budget changed repeated confirmation to monitored approval."
OUTAGE_ISOLATED = (
    "The payment rail is unavailable, so settlement remains pending and reversible."
)
OUTAGE_RISKY = (
    "Trusted intelligence is incomplete, so an unusual payment requires safe confirmation."
)
OUTAGE_MONITOR = "Trusted intelligence is incomplete, so the permitted activity is monitored."

# ---------------------------------------------------------------- fixed values: shared evidence
EVIDENCE_WEIGHTS = {
    "confirmed_customer_report": 1.0,
    "verified_account_takeover": 1.0,
    "confirmed_mule_cashout": 1.0,
    "confirmed_terminal_compromise": 1.0,
    "analyst_high_confidence": 0.90,
}
MATERIAL_STAGES = [
    "recovery", "new_channel", "recipient_change", "cashout", "sim_change", "identity_cochange",
]
# Campaign stages in alphabetical order, so that the filtered list is already sorted.
CAMPAIGN_STAGES = [
    ("cashout", "event_type in ('withdrawal','transfer') and balance_drain_ratio >= 0.5"),
    ("fast_interaction", "interaction_speed_deviation >= 0.65"),
    ("identity_cochange", "new_device >= 0.8 and new_sim >= 0.8"),
    ("new_channel", "greatest(channel_transition_novelty, new_channel) >= 0.45"),
    ("recipient_change", "new_recipient >= 0.8"),
    ("recovery", "event_type in ('account_recovery','pin_reset')"),
    ("sim_change", "greatest(imsi_change, iccid_change, recent_sim_activation) >= 0.5"),
]
LIFECYCLE_EDGES = {
    "created": ["authorized", "held", "cancelled"],
    "authorized": ["held", "settled", "cancelled"],
    "held": ["released", "cancelled"],
    "released": ["settled", "cancelled"],
    "settled": [],
    "cancelled": [],
}
DEPENDENCIES = [
    "core_banking", "telco_gateway", "consortium", "recipient_graph", "agent_integrity",
    "model_runtime",
]
# Hazard precursors: (name, weight, decay hours, limit hours).
PRECURSORS = [
    ("failed authentication", 0.08, 12, 24),
    ("account recovery", 0.35, 36, 72),
    ("PIN reset", 0.25, 24, 48),
    ("unverified SIM identity change", 0.40, 24, 48),
]

# --------------------------------------------------------- fixed values: evidence per channel
# Items whose presence counts towards evidence coverage.
COVERAGE_ITEMS = {
    "app": ["balance", "recipient", "device", "sim", "ip", "location", "interaction", "typing",
            "tilt", "navigation", "telco", "coercion"],
    "ussd": ["balance", "recipient", "sim", "ip", "location", "interaction", "navigation", "telco",
             "coercion"],
    "agent": ["balance", "recipient", "device", "ip", "location", "interaction", "telco",
              "coercion", "terminal"],
    "web": ["balance", "recipient", "device", "ip", "location", "interaction", "telco",
            "coercion"],
}
# Signals named in the evidence summary, in listing order.
SUMMARY_SIGNALS = [
    "balance context", "recipient history", "device identity", "SIM identity", "network prefix",
    "coarse location", "interaction rhythm", "typing cadence", "typed-or-pasted signal",
    "device handling", "navigation path", "attested telco SIM lifecycle",
    "recipient network history", "consented coercion-safety telemetry",
    "attested agent-terminal integrity",
]
SUMMARY_EXPECTED = {
    "app": SUMMARY_SIGNALS,
    "ussd": ["balance context", "recipient history", "SIM identity", "network prefix",
             "coarse location", "interaction rhythm", "navigation path",
             "attested telco SIM lifecycle", "recipient network history"],
    "agent": ["balance context", "recipient history", "device identity", "network prefix",
              "coarse location", "navigation path", "attested telco SIM lifecycle",
              "recipient network history", "attested agent-terminal integrity"],
    "web": ["balance context", "recipient history", "device identity", "network prefix",
            "coarse location", "interaction rhythm", "attested telco SIM lifecycle",
            "recipient network history"],
}

# ----------------------------------------------------------- fixed values: texts of reasons
REASON_MESSAGES = {
    "amount_deviation": "Amount differs sharply from this account's normal transaction range.",
    "amount_to_median": "Amount is many times larger than the account's typical transaction.",
    "balance_drain_ratio": "The transaction would remove a large share of the available balance.",
    "unusual_hour": "Activity occurred outside the account's usual operating hours.",
    "new_recipient": "The recipient has not previously been used by this account.",
    "recipient_rarity": "The recipient is rare in the account's historical activity.",
    "recipient_sender_diversity_24h": "The recipient recently received funds from many different senders.",
    "recipient_first_time_sender_ratio_24h": "Most recent senders had never paid this recipient before.",
    "recipient_inflow_velocity_1h": "Value is accumulating rapidly at the recipient.",
    "recipient_rapid_cashout_ratio_1h": "The recipient rapidly moved out recently received funds.",
    "recipient_confirmed_fraud_score": "Analyst-confirmed fraud reports are associated with this recipient.",
    "recipient_confirmed_accounts": "Multiple unrelated accounts reported fraud involving this recipient.",
    "new_device": "The event originated from a device not seen in the account history.",
    "device_rarity": "The device is unusual for this account.",
    "new_sim": "The SIM identity is new for this account.",
    "new_ip_prefix": "The network prefix has not previously been associated with the account.",
    "new_channel": "The customer switched to a channel not normally used by this account.",
    "channel_transition_novelty": "The sequence between banking channels is unusual for this account.",
    "cross_channel_events_15m": "Several different banking channels were used in a short period.",
    "new_channel_enrollment_24h": "A new-channel authentication event preceded this transaction.",
    "app_to_ussd_handoff": "App activity was followed quickly by a USSD transaction.",
    "cross_channel_device_mismatch": "Recent cross-channel activity used inconsistent devices.",
    "velocity_5m": "Several transactions occurred within five minutes.",
    "velocity_1h": "Transaction frequency is elevated over the last hour.",
    "failed_auth_24h": "Recent failed authentication attempts preceded this event.",
    "recovery_signal_72h": "A recent PIN reset or account-recovery event increases takeover risk.",
    "account_hazard_score": "Recent precursor events place this account inside a temporary risk window.",
    "impossible_travel": "Location changed faster than plausible physical travel.",
    "interaction_speed_deviation": "The app or USSD interaction rhythm differs from the user's norm.",
    "typing_cadence_deviation": "Typing cadence differs from the customer's usual rhythm.",
    "paste_anomaly": "Information was pasted where this customer normally types it.",
    "device_handling_deviation": "The way the phone was handled differs from the customer's usual pattern.",
    "navigation_novelty": "The sequence of screens or USSD menus is unfamiliar for this account.",
    "day_of_month_deviation": "The calendar date differs from this account's established monthly rhythm.",
    "call_transfer_overlap": "The transfer was prepared during an active call on a consented trusted device.",
    "screen_sharing_signal": "A consented trusted device detected screen sharing during the transfer.",
    "recipient_edit_anomaly": "The recipient was repeatedly replaced during this session.",
    "confirmation_friction": "Repeated edits, backtracking or hesitation occurred before confirmation.",
    "coercion_on_device_score": "A privacy-preserving on-device safety model detected possible coercion.",
    "recent_sim_activation": "A trusted telco signal shows that this SIM was activated recently.",
    "repeat_sim_change": "A trusted telco signal shows repeated SIM changes in the last 30 days.",
    "imsi_change": "The attested subscriber identity changed recently.",
    "iccid_change": "The attested SIM-card identity changed recently.",
    "sim_type_change": "The attested SIM type changed recently.",
    "otp_sim_change_proximity": "An OTP request closely followed the SIM change.",
    "otp_sim_geo_mismatch": "OTP and SIM-change locations were far apart.",
    "short_previous_sim_tenure": "The previous SIM had an unusually short tenure.",
    "agent_customer_diversity_1h": "The agent terminal handled many unrelated customers in a short period.",
    "agent_recipient_concentration_24h": "One recipient dominates this terminal's recent customer transfers.",
    "agent_first_time_recipient_ratio_24h": "Many customers used unfamiliar recipients through this terminal.",
    "agent_failed_auth_ratio_1h": "Authentication failures are concentrated at this terminal.",
    "agent_value_velocity_1h": "Unusually high value is moving through this terminal.",
    "agent_location_mismatch": "The terminal is operating far from its registered location.",
    "agent_after_hours": "The terminal is operating outside its registered service hours.",
    "agent_terminal_novelty": "The agency gateway reports a newly enrolled terminal.",
    "agent_confirmed_fraud_score": "Analyst-confirmed fraud reports are associated with this terminal.",
    "agent_confirmed_accounts": "Multiple unrelated customers reported fraud through this terminal.",
}

# Customer-facing phrases by reason code.
CUSTOMER_PHRASES = {
    "DEVICE_SIM_COCHANGE": "a new SIM and device appeared together",
    "RECOVERY_THEN_NEW_RECIPIENT": "a recent account recovery was followed by a new recipient",
    "UNUSUAL_BALANCE_DRAIN": "the amount was unusual and would move most of the available balance",
    "FAILED_AUTH_NEW_DEVICE": "failed sign-in attempts were followed by a new device",
    "USSD_RHYTHM_BURST": "the USSD timing and transaction pace changed together",
    "TELCO_SIM_SWAP_SIGNATURE": "a trusted network check found a very recent identity-changing SIM replacement",
    "OTP_SIM_GEO_CONFLICT": "an OTP followed the SIM change from a distant location",
    "MULE_COLLECTION_SIGNATURE": "the recipient showed a many-sender, rapid-movement pattern",
    "CONFIRMED_RECIPIENT_REPUTATION": "other confirmed fraud cases involved this recipient",
    "CROSS_CHANNEL_TAKEOVER_SEQUENCE": "a new cross-channel access sequence preceded the transfer",
    "CALENDAR_RHYTHM_MATCH": "the payment matched an established monthly pattern",
    "ACCOUNT_RISK_WINDOW": "recent recovery or authentication activity raised temporary account risk",
    "COERCION_SESSION_SIGNATURE": "the session showed signs that someone may be directing the customer",
    "AGENT_TERMINAL_CAMPAIGN": "the agency terminal connected several customers to a concentrated suspicious pattern",
    "CONFIRMED_AGENT_TERMINAL": "independent confirmed fraud reports involve this agency terminal",
    "AMOUNT_DEVIATION": "the amount differed from the account's usual range",
    "BALANCE_DRAIN_RATIO": "the transfer would move a large part of the available balance",
    "NEW_RECIPIENT": "the recipient had not been used before",
    "NEW_DEVICE": "the device had not been used on this account before",
    "NEW_SIM": "the SIM had not been seen on this account before",
    "UNUSUAL_HOUR": "the transaction occurred outside the account's usual hours",
    "FAILED_AUTH_24H": "there were recent failed sign-in attempts",
    "RECOVERY_SIGNAL_72H": "the account was recently recovered or its PIN was reset",
    "INTERACTION_SPEED_DEVIATION": "the app or USSD interaction rhythm changed",
    "TYPING_CADENCE_DEVIATION": "the typing rhythm changed",
    "PASTE_ANOMALY": "information was pasted where it is normally typed",
    "DEVICE_HANDLING_DEVIATION": "the way the phone was handled changed",
    "NAVIGATION_NOVELTY": "an unfamiliar screen or USSD menu path was used",
    "IMPOSSIBLE_TRAVEL": "the location change was faster than normal travel",
    "RECENT_SIM_ACTIVATION": "the network reported a newly activated SIM",
    "REPEAT_SIM_CHANGE": "the network reported repeated recent SIM changes",
    "RECIPIENT_SENDER_DIVERSITY_24H": "the recipient recently received funds from many unrelated senders",
    "RECIPIENT_RAPID_CASHOUT_RATIO_1H": "the recipient rapidly moved out recently received funds",
    "ACCOUNT_HAZARD_SCORE": "the account was already inside a temporary risk window",
    "POPULATION_MODEL_MATCH": "several signals matched account-takeover patterns",
}
PHRASE_DEFAULT = "the activity differed from the account's usual pattern"
EXPLAIN_VERIFIED = (
    "We approved this transaction because the SIM change was verified and the remaining "
    "activity matched the account's usual pattern."
)
EXPLAIN_ALLOW = "We approved this transaction because it matched the account's usual activity."
EXPLAIN_PREFIX = {
    ALLOW_MONITOR: "We approved this transaction but are monitoring it because",
    STEP_UP: "We need an extra confirmation because",
    DELAY: "We temporarily delayed this transaction because",
    HOLD: "We temporarily paused this transaction because",
    SAFE_PAUSE: "We privately paused this transaction because",
}
EXPLAIN_RECOURSE = {
    ALLOW_MONITOR: "You can review it in transaction history or contact the bank through its official channel",
    STEP_UP: "Confirm from a previously registered device or request an official bank callback",
    DELAY: "Confirm from a previously registered device or wait for the short safety delay to expire",
    HOLD: "Contact the bank through its official channel or wait for analyst review",
    SAFE_PAUSE: "End any call or screen-sharing session and confirm privately through the bank's official channel",
}
# Recourse routes: (code, description, clearance, channel).
RECOURSE = {
    "review": ("review_activity", "Review the recipient and amount in transaction history.",
               "No interruption", "bank app or statement"),
    "device": ("trusted_device_confirmation",
               "Confirm from a previously registered device after ending any call or screen share.",
               "Immediate after successful confirmation", "registered device"),
    "callback": ("official_bank_callback",
                 "Request a callback using the number in the bank's app, website or card.",
                 "After identity verification", "bank-initiated callback"),
    "expiry": ("automatic_review_or_expiry",
               "Take no action while the reversible safety period completes.", None, "automatic"),
}
CONFIDENCE_REASONS = {
    "profile": "The behavioural baseline is still immature.",
    "coverage": "Only part of the expected channel evidence was available.",
    "recipient": "No prior recipient-network or watchlist evidence was available.",
    "agent": "No attested agent-terminal evidence was available.",
    "no_model": "The population model was unavailable, so scorer agreement is unknown.",
    "disagree": "The population model and transparent scorer disagree.",
    "consistent": "The profile, evidence coverage and independent scorers are consistent.",
}
SKETCH_REASONS = {
    "PRIVATE_SKETCH_CORROBORATED": "Independent institutions observed a matching private fraud pattern, and local account evidence corroborates it.",
    "PRIVATE_SKETCH_UNCORROBORATED": "Independent institutions observed a matching private fraud pattern; without local corroboration it can only increase monitoring.",
    "PRIVATE_SKETCH_OBSERVE_ONLY": "One institution reported a matching private fraud pattern; a single report cannot trigger an intrusive action.",
}
EXTRA_REASONS = {
    "CROSS_ACCOUNT_CAMPAIGN_DNA": "The attack sequence matches a recent pattern across distinct accounts.",
    "INDEPENDENT_CONSORTIUM_REPORTS": "Multiple independent institutions reported the tokenised recipient.",
    "POPULATION_MODEL_MATCH": "The combination of signals resembles account-takeover patterns.",
    "NO_MATERIAL_ANOMALY": "No material departure from the available behavioural profile was detected.",
    "OUTAGE_EVIDENCE_DEGRADED": "One or more trusted services are unavailable; missing evidence lowered confidence and activated the outage safety policy.",
}
