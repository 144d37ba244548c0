"""SQL text generated from the rule tables.

Each function returns an expression over feature columns, ready for ``F.expr``.  Keeping the rules as
text means a wide scoring stage is parsed once by Spark instead of being built node by node, and the
same text can be shown to an auditor.
"""

from __future__ import annotations

from vigil import config


def rounded(expr: str, digits: int = 6) -> str:
    scale = f"{10**digits}.0"
    return (
        f"(floor(cast(({expr}) as double) * cast({scale} as double) + cast(0.5 as double))"
        f" / cast({scale} as double))"
    )


def clamped(expr: str) -> str:
    return f"greatest(cast(0 as double), least(cast(1 as double), cast({expr} as double)))"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def spark_text(value: str) -> str:
    return '"' + value.replace('"', '\\"') + '"'


def contribution(feature: str) -> str:
    """Weighted contribution of one feature with its multipliers."""
    parts = [str(config.WEIGHTS[feature]), feature]
    if feature in config.PROFILE_DEPENDENT:
        parts.append("greatest(0.10, history_confidence)")
    if feature in config.SHARED_DEVICE_DAMPED:
        parts.append("(case when shared_device_allowed > 0 then 0.25 else 1.0 end)")
    if feature in config.VERIFIED_SIM_DAMPED:
        parts.append("(case when verified_sim_change > 0 then 0.05 else 1.0 end)")
    if feature == "day_of_month_deviation":
        parts.append("calendar_confidence")
    if feature in config.CALENDAR_DAMPED:
        parts.append("(1.0 - 0.65 * recurring_payment_match * calendar_confidence)")
    return "cast(" + " * ".join(parts) + " as double)"


def compound(condition: str, value: str) -> str:
    return f"cast(case when {condition} then {value} else 0 end as double)"


def anomaly_total() -> str:
    base = [contribution(f) for f in config.WEIGHTS]
    extra = [compound(cond, value) for _, cond, value, _ in config.COMPOUNDS]
    return f"(({' + '.join(base)}) + ({' + '.join(extra)}))"


def anomaly_score() -> str:
    return rounded(clamped(f"{anomaly_total()} / {config.ANOMALY_SCALE}"))


def floor_value(condition: str, value: str) -> str:
    return rounded(f"case when {condition} then {value} else 0 end")


def security_floor() -> str:
    return clamped("greatest(" + ", ".join(floor_value(c, v) for _, c, v in config.FLOORS) + ")")


def model_weight() -> str:
    return (
        f"(case when model_score is null then null when history_confidence < {config.IMMATURE_CONFIDENCE}"
        f" then {config.MODEL_WEIGHT_IMMATURE} else {config.MODEL_WEIGHT_MATURE} end)"
    )


def blended() -> str:
    return (
        f"(case when model_score is null then anomaly_score else {model_weight()} * model_score"
        f" + (1.0 - {model_weight()}) * anomaly_score end)"
    )


def risk_level(score: str) -> str:
    t = config.THRESHOLDS
    return (
        f"case when {score} < {t['monitor']} then 'low' when {score} < {t['confirm']} then 'guarded'"
        f" when {score} < {t['delay']} then 'elevated' when {score} < {t['hold']} then 'high'"
        " else 'critical' end"
    )


# ------------------------------------------------------------------------- decision confidence
RECIPIENT_PRESENT = "(new_recipient <> 0 or recipient_rarity <> 0)"
RECIPIENT_COVERAGE = "greatest(recipient_network_coverage, recipient_watchlist_coverage)"


def data_coverage() -> str:
    evidence = clamped("evidence_coverage")
    base = (
        f"(case when {RECIPIENT_PRESENT} then {clamped(f'(0.75 * {evidence} + 0.25 * {RECIPIENT_COVERAGE})')}"
        f" else {evidence} end)"
    )
    return (
        f"(case when agent_evidence_coverage > 0 then"
        f" {clamped(f'(0.75 * {base} + 0.25 * agent_evidence_coverage)')} else {base} end)"
    )


def scorer_agreement() -> str:
    return (
        "(case when model_score is null then 0.55 else "
        + clamped("(1.0 - abs(model_score - anomaly_score))") + " end)"
    )


def confidence_score() -> str:
    """Over the columns data_coverage and scorer_agreement."""
    return rounded(
        clamped(
            f"(0.40 * {clamped('history_confidence')} + 0.35 * data_coverage + 0.25 * scorer_agreement)"
        )
    )


def confidence_level(score: str) -> str:
    return f"case when {score} >= 0.75 then 'high' when {score} >= 0.45 then 'medium' else 'low' end"


# -------------------------------------------------------------------------------------- policy
EXPOSURE = "greatest(500.0, amount, amount * balance_drain_ratio)"
REGRET_RATIO = "(regret_used / cast(greatest(1, regret_limit_30d) as double))"
FRICTION = (
    f"(cast((1.0 + least(2.0, {REGRET_RATIO})) as double)"
    " * (case when is_ussd > 0 then 1.25 else 1.0 end)"
    " * (case when recurring_payment_match >= 0.80 then 1.45 else 1.0 end)"
    " * (case when confidence_score < 0.45 then 1.35 else 1.0 end))"
)


def cost(residual: float, friction: float) -> str:
    return rounded(
        f"fused_score * {EXPOSURE} * {residual} + (1.0 - fused_score) * {friction} * {FRICTION}", 2
    )


CANDIDATES = {  # band upper threshold -> candidate actions, first wins a tie
    "monitor": [config.ALLOW, config.ALLOW_MONITOR],
    "confirm": [config.ALLOW_MONITOR, config.STEP_UP],
    "delay": [config.STEP_UP, config.DELAY],
    "hold": [config.DELAY, config.HOLD],
}


def banded_action() -> str:
    """Cheapest candidate of the score band, from the columns cost_0 .. cost_4."""
    place = {a: i for i, a in enumerate(config.RESIDUAL_LOSS)}
    arms = []
    for band, (first, second) in CANDIDATES.items():
        arms.append(
            f"when fused_score < {config.THRESHOLDS[band]} then (case when cost_{place[second]} <"
            f" cost_{place[first]} then '{second}' else '{first}' end)"
        )
    return f"case {' '.join(arms)} else '{config.HOLD}' end"


SINGLE_REPORT = (
    "recipient_confirmed_fraud_score > 0 and recipient_confirmed_accounts * 3.0 < 2.0"
    " and fused_score <= 0.45"
)
SKETCH_ALONE = (
    "fraud_sketch_risk > 0 and fraud_sketch_local_corroboration = 0 and fused_score <= 0.45"
)
SKETCH_CEILING = (
    "fraud_sketch_risk > 0 and fraud_sketch_local_corroboration > 0"
    " and fraud_sketch_pre_exchange_score < 0.66 and fused_score < 0.84"
)
CRITICAL = "(" + " or ".join(f"({c})" for c in config.CRITICAL_SIGNAL) + ")"


def ceiling_action() -> str:
    """Ceilings of shared evidence, then the coercion pause, over the column action_0."""
    return (
        f"case when {config.COERCION} then '{config.SAFE_PAUSE}'"
        f" when {SINGLE_REPORT} or {SKETCH_ALONE} then '{config.ALLOW_MONITOR}'"
        f" when action_0 = '{config.HOLD}' and {SKETCH_CEILING} then '{config.DELAY}'"
        " else action_0 end"
    )


def confident_action() -> str:
    return (
        f"case when action_1 = '{config.HOLD}' and confidence_score < 0.45 and not critical_signal"
        f" then '{config.DELAY}' else action_1 end"
    )


def _in(column: str, actions: list[str]) -> str:
    return f"{column} in ({', '.join(text(a) for a in actions)})"


OVER_BUDGET = (
    f"({_in('action_2', config.INTRUSIVE_ACTIONS)} and regret_used >= regret_limit_30d"
    " and regret_limit_30d >= 0)"
)
FORCED = "(critical_signal or fused_score >= 0.76)"


def budget_action() -> str:
    return (
        f"case when {OVER_BUDGET} and not {FORCED} and action_2 = '{config.DELAY}' then '{config.STEP_UP}'"
        f" when {OVER_BUDGET} and not {FORCED} and action_2 = '{config.STEP_UP}' then '{config.ALLOW_MONITOR}'"
        " else action_2 end"
    )


def override_code() -> str:
    return (
        f"case when {OVER_BUDGET} and {FORCED} then 'critical'"
        f" when {OVER_BUDGET} and action_2 = '{config.DELAY}' then 'delay'"
        f" when {OVER_BUDGET} and action_2 = '{config.STEP_UP}' then 'step_up'"
        " when action_2 <> action_1 then 'low_confidence' end"
    )


def hold_seconds(action: str) -> str:
    arms = " ".join(f"when '{a}' then {s}" for a, s in config.HOLD_SECONDS.items())
    return f"case {action} {arms} else 0 end"


# ------------------------------------------------------------------------------------ campaign
def campaign_stage_items() -> list[str]:
    return [f"case when {cond} then '{name}' end" for name, cond in config.CAMPAIGN_STAGES]


def review_priority(reports: str) -> str:
    return rounded(
        "least(1.0, 0.55 * fused_score + 0.2 * least(amount / 500000.0, 1.0)"
        f" + 0.15 * (1 - confidence_score) + 0.1 * cast(least({reports}, 3) as double) / 3.0)"
    )


# ----------------------------------------------------------------------------- safety envelope
RISKY_CHANGE = (
    "(new_recipient > 0 or recovery_signal_72h > 0 or new_sim + new_device >= 2"
    " or balance_drain_ratio >= 0.50)"
)


def action_rank(column: str) -> str:
    arms = " ".join(f"when '{a}' then {i}" for i, a in enumerate(config.ACTIONS))
    return f"case {column} {arms} end"


def rank_action(rank: str) -> str:
    arms = " ".join(f"when {i} then '{a}'" for i, a in enumerate(config.ACTIONS))
    return f"case {rank} {arms} end"


def envelope_rank(action: str, mode: str) -> str:
    rank = f"({action_rank(action)})"
    return (
        f"case when {mode} = 'online' then {rank}"
        f" when {mode} = 'isolated' and amount > 0 then greatest({rank}, 3)"
        f" when {RISKY_CHANGE} and amount > 0 then greatest({rank}, 2)"
        f" when {rank} = 0 then 1 else {rank} end"
    )
