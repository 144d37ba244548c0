"""Point-in-time sender features: one row per event, from strictly earlier events of its account.

History of an event = same tenant and account, earlier than the event, at most ``lookback_days``
old, without a limit on its rows.  A history row r therefore serves exactly the events with
``r.ts < t <= r._exp``, where ``_exp`` is its age limit.  Sliding counts are differences of growing sums, so
each costs O(1) per row; only the last 72 hours are ever listed.  What depends on trust in earlier events, and all
medians and calendar patterns, comes from one sweep of the account (``learned``).

All windows share one exchange on (tenant, account, slice); finer partition keys only re-sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil import config
from vigil.config import DEFAULTS, Settings
from vigil.functions.scalars import (
    DAY_US, HOUR_US, MINUTE_US, clamp, flag, haversine_km, rnd,
)
from vigil.operators.learned import learned_history
from vigil.operators.timeline import UNB, time_slices

KEYS = ["tenant_id", "account_id", "_slice"]


def is_txn() -> Column:
    return F.col("event_type").isin(config.TRANSACTION_TYPES)


def is_learnable() -> Column:
    return F.col("success") & ~F.col("event_type").isin(config.UNTRUSTED_TYPES)


def is_trusted() -> Column:
    return F.col("profile_eligible") & is_learnable()


def _hazard_code() -> Column:
    """Position of the event type in the precursor table; null for other events."""
    kind = F.col("event_type")
    return (
        F.when(kind == "failed_login", 0).when(kind == "account_recovery", 1)
        .when(kind == "pin_reset", 2)
    )


def _sim_swap() -> Column:
    telco = F.col("telco_assurance")
    return F.coalesce(
        telco["gateway_attested"] & ~F.col("sim_change_verified")
        & (telco["imsi_changed"] | telco["iccid_changed"]), F.lit(False),
    )


class History:
    """Sliding aggregates over an event's history, for one set of partition keys."""

    def __init__(self, lookback_us: int, *keys: str):
        self.lookback = lookback_us
        self.part = Window.partitionBy(*KEYS, *keys).orderBy("ts_us")
        self.before = self.part.rangeBetween(UNB, -1)

    def total(self, value: Column, window_us: int | None = None) -> Column:
        """Sum of a non-negative value over the history rows of the last ``window_us``.

        (sum before t) - (sum of rows too old for the window).
        """
        window_us = window_us or self.lookback
        zero = F.lit(0)
        return F.coalesce(F.sum(value).over(self.before), zero) - F.coalesce(
            F.sum(value).over(self.part.rangeBetween(UNB, -window_us - 1)), zero)

    def count(self, condition: Column, window_us: int | None = None) -> Column:
        return self.total(condition.cast("long"), window_us)

    def last(self, value: Column) -> Column:
        """Latest value before t (also when it has expired meanwhile)."""
        return F.last(value, True).over(self.before)

    def rows(self, value: Column, condition: Column, window_us: int) -> Column:
        """Array of the values of the last hours, oldest first."""
        item = F.when(condition, F.struct(value.alias("v")))
        listed = F.collect_list(item).over(self.part.rangeBetween(-window_us, -1))
        return F.transform(listed, lambda r: r["v"])


def window_history(events: DataFrame, settings: Settings = DEFAULTS, until: int | None = None) -> DataFrame:
    """Events with the history quantities (prefix ``h_``) that no trust in earlier events changes.

    ``until`` is the time of the latest event, when it is known (``time_slices``).
    """
    lookback = settings.lookback_days * DAY_US
    base = time_slices(events, "ts_us", lookback, until)
    order = Window.partitionBy(*KEYS).orderBy("ts_us", "event_id")
    base = base.select(
        "*",
        # Evaluated once here: a window frame re-reads its input columns for every row it covers.
        is_txn().alias("_tx"), _hazard_code().alias("_hazard"), _sim_swap().alias("_swap"),
        F.lag("channel").over(order).alias("_lag_channel"),
        F.lead("channel").over(order).alias("_lead_channel"),
    )
    base = base.withColumn("_exp", F.col("ts_us") + F.lit(lookback))
    tx = F.col("_tx")
    chan = History(lookback, "channel")
    base = base.select("*", *[
        chan.count(F.coalesce(F.col("_lag_channel") == c, F.lit(False))).alias(f"h_from_{c}") for c in config.CHANNELS])
    acct = History(lookback)
    kind = F.col("event_type")
    # Straddling channel pair: its left row is the newest expired row, its right row the oldest
    # history row, so it must not count as an adjacent pair inside the history.
    pair = F.struct(F.col("_exp").alias("exp"), F.col("channel").alias("left"),
                    F.col("_lead_channel").alias("right"))
    expired = F.last(pair, True).over(acct.part.rangeBetween(UNB, -lookback - 1))
    base = base.select(
        "*",
        acct.count(F.lit(True)).alias("h_events"),
        acct.count(tx, 5 * MINUTE_US).alias("h_txn_5m"),
        acct.count(tx, HOUR_US).alias("h_txn_1h"),
        acct.count(kind == "failed_login", 24 * HOUR_US).alias("h_failed_24h"),
        acct.count(kind.isin("pin_reset", "account_recovery"), 72 * HOUR_US).alias("h_recovery_72h"),
        acct.last(F.struct(F.col("_exp").alias("exp"), F.col("channel").alias("channel")))
        .alias("h_previous"),
        expired.alias("h_straddle"),
        acct.rows(F.struct(F.col("ts_us").alias("at"), F.col("_hazard").alias("code"),
                           F.col("_swap").alias("swap")),
                  F.col("_hazard").isNotNull() | F.col("_swap"), 72 * HOUR_US)
        .alias("h_precursors"),
        acct.rows(F.struct(F.col("ts_us").alias("at"), "channel", "device_id"), F.lit(True),
                  30 * MINUTE_US).alias("h_recent"),
    )
    home = base.filter(F.col("_home"))
    return _reduce(home).drop("_slice", "_home", "_tx", "_hazard", "_swap", "_lag_channel", "_lead_channel", "_exp")


def with_learned(history: DataFrame, events: DataFrame, settings: Settings = DEFAULTS, learned: DataFrame | None = None,
                 until: int | None = None) -> DataFrame:
    """``window_history`` rows of ``events`` with what their accounts have learned before them (``learned_history``)."""
    trusted = is_trusted() if learned is None else is_learnable()
    found = learned_history(events, trusted, is_txn(), settings, learned, until)
    return history.join(found, ["tenant_id", "account_id", "event_id"])


def account_history(events: DataFrame, settings: Settings = DEFAULTS, learned: DataFrame | None = None) -> DataFrame:
    """Events with the raw history quantities (prefix ``h_``) that the features read."""
    return with_learned(window_history(events, settings), events, settings, learned)


def _reduce(history: DataFrame) -> DataFrame:
    """Reduce the short arrays (at most 72 hours) to scalars, so that nothing wide travels further."""
    own_channel = F.col("channel")
    df = history.select(
        "*",
        F.filter(
            "h_recent",
            lambda r: (r["channel"] != own_channel)
            & (r["at"] >= F.col("ts_us") - 15 * MINUTE_US),
        ).alias("_cross"),
        F.exists("h_recent", lambda r: r["channel"] == "app").alias("h_app_30m"),
    ).drop("h_recent")
    cross_devices = F.filter(
        F.transform("_cross", lambda r: r["device_id"]), lambda d: d.isNotNull()
    )
    df = df.select(
        "*",
        F.size("_cross").alias("h_cross_15m"),
        ((F.size(cross_devices) > 0) & ~F.array_contains(cross_devices, F.col("device_id")))
        .alias("h_device_mismatch"),
    ).drop("_cross")

    def age(p: Column) -> Column:
        return (F.col("ts_us") - p["at"]) / F.lit(float(HOUR_US))

    def precursor_hit(code: int, limit: int):
        def hit(p: Column) -> Column:
            own = p["swap"] if code == len(config.PRECURSORS) - 1 else p["code"] == code
            return F.coalesce(own, F.lit(False)) & (age(p) <= limit)

        return hit

    rules = [
        (name, weight, float(decay), float(limit), precursor_hit(code, limit))
        for code, (name, weight, decay, limit) in enumerate(config.PRECURSORS)
    ]
    zero = F.lit(0.0)

    def added(acc: Column, p: Column) -> Column:
        for _, weight, decay, _, hit in rules:
            acc = acc + F.when(hit(p), F.lit(weight) * F.exp(-age(p) / F.lit(decay))).otherwise(zero)
        return acc

    def longest(acc: Column, p: Column) -> Column:
        left = [F.when(hit(p), F.lit(limit) - age(p)).otherwise(zero) for _, _, _, limit, hit in rules]
        return F.greatest(acc, *left)

    score = F.aggregate("h_precursors", zero, added)
    remaining = F.aggregate("h_precursors", zero, longest)
    present = [F.when(F.exists("h_precursors", hit), F.lit(name)) for name, _, _, _, hit in rules]
    return df.select(
        "*",
        clamp(score).alias("h_hazard"),
        rnd(remaining, 2).alias("h_hours_left"),
        F.sort_array(F.array_compact(F.array(*present))).alias("active_precursors"),
    ).drop("h_precursors")


def _confidence() -> Column:
    n = F.col("h_txns")
    return F.when(n > 0, rnd(F.least(F.lit(1.0), F.log1p(n) / F.log(F.lit(51.0))))).otherwise(
        F.lit(0.0)
    )


def _deviation(value: Column, stat: str, share: float, floor: float) -> Column:
    centre = F.col(f"{stat}_median")
    scale = F.greatest(F.lit(1.4826) * F.col(f"{stat}_mad"), centre * share, F.lit(floor))
    return F.when(
        value.isNotNull() & (F.col(f"{stat}_n") >= 3), clamp(F.abs(value - centre) / scale / 6.0)
    ).otherwise(F.lit(0.0))


def evidence_items() -> dict[str, Column]:
    """Presence of each evidence item of an event."""
    telco, session = F.col("telco_assurance"), F.col("coercion_signals")
    return {
        "balance": F.col("available_balance_before").isNotNull(),
        "recipient": F.col("recipient_id").isNotNull(),
        "device": F.col("device_id").isNotNull(),
        "sim": F.col("sim_id").isNotNull(),
        "ip": F.col("ip_prefix").isNotNull(),
        "location": F.col("latitude").isNotNull(),
        "interaction": F.col("interaction_ms").isNotNull(),
        "typing": F.col("keystroke_interval_ms").isNotNull(),
        "tilt": F.col("device_tilt_variance").isNotNull(),
        "navigation": F.col("navigation_signature").isNotNull(),
        "telco": F.coalesce(telco["gateway_attested"], F.lit(False)),
        "coercion": F.coalesce(session["consented_device_attested"], F.lit(False)),
        "terminal": F.coalesce(F.col("agent_assurance")["gateway_attested"], F.lit(False)),
    }


def stateless_features() -> dict[str, Column]:
    """Features of the event row alone (no history)."""
    telco, session = F.col("telco_assurance"), F.col("coercion_signals")
    attested = F.coalesce(telco["gateway_attested"], F.lit(False))
    consented = F.coalesce(session["consented_device_attested"], F.lit(False))

    def t(x: Column) -> Column:
        return F.when(attested & x.isNotNull(), x).otherwise(F.lit(0.0))

    def c(x: Column) -> Column:
        return F.when(consented & x.isNotNull(), x).otherwise(F.lit(0.0))

    pause = F.coalesce(session["pause_before_confirmation_ms"], F.lit(0))
    friction = F.greatest(
        clamp(session["confirmation_backtracks"] / 4.0), clamp(session["amount_edits"] / 5.0),
        clamp((pause - 30_000) / 120_000.0), flag(session["recipient_pasted_during_call"]),
    )
    items = evidence_items()
    coverage = F.lit(0.0)
    for channel, names in config.COVERAGE_ITEMS.items():
        share = sum((items[n].cast("int") for n in names), F.lit(0)) / F.lit(float(len(names)))
        coverage = F.when(F.col("channel") == channel, share).otherwise(coverage)
    optional = ["sim_activation_age_hours", "sim_changes_30d", "previous_sim_tenure_days",
                "otp_to_sim_change_minutes", "otp_sim_geo_distance_km"]
    return {
        "balance_drain_ratio": F.when(
            F.col("available_balance_before") > 0,
            clamp(F.col("amount") / F.col("available_balance_before")),
        ).otherwise(F.lit(0.0)),
        "call_transfer_overlap": flag(consented & session["active_call"]),
        "screen_sharing_signal": flag(consented & session["screen_sharing_detected"]),
        "recipient_edit_anomaly": c(clamp(session["recipient_replacements"] / 3.0)),
        "confirmation_friction": c(friction),
        "coercion_on_device_score": c(session["on_device_coercion_score"]),
        "coercion_evidence_coverage": F.when(
            consented,
            (F.lit(6) + session["pause_before_confirmation_ms"].isNotNull().cast("int")
             + session["on_device_coercion_score"].isNotNull().cast("int")) / 8.0,
        ).otherwise(F.lit(0.0)),
        "recent_sim_activation": t(clamp(1.0 - telco["sim_activation_age_hours"] / 168.0)),
        "repeat_sim_change": t(clamp(telco["sim_changes_30d"] / 3.0)),
        "imsi_change": flag(attested & telco["imsi_changed"]),
        "iccid_change": flag(attested & telco["iccid_changed"]),
        "sim_type_change": flag(attested & telco["sim_type_changed"]),
        "otp_sim_change_proximity": t(F.exp(-telco["otp_to_sim_change_minutes"] / 360.0)),
        "otp_sim_geo_mismatch": t(clamp(telco["otp_sim_geo_distance_km"] / 250.0)),
        "short_previous_sim_tenure": t(clamp(1.0 - telco["previous_sim_tenure_days"] / 365.0)),
        "telco_assurance_coverage": F.when(
            attested, (F.lit(3) + sum((telco[n].isNotNull().cast("int") for n in optional), F.lit(0))) / 8.0
        ).otherwise(F.lit(0.0)),
        "evidence_coverage": coverage,
        "is_ussd": flag(F.col("channel") == "ussd"),
        "is_transfer": flag(F.col("event_type") == "transfer"),
        "is_withdrawal": flag(F.col("event_type") == "withdrawal"),
        "is_agent": flag(F.col("channel") == "agent"),
    }


def history_features() -> dict[str, Column]:
    """Features read from the history quantities; ``history_confidence`` must exist."""
    conf = F.col("history_confidence")
    amount, median = F.col("amount"), rnd(F.coalesce("h_amount_median", F.lit(0.0)), 2)
    mad = rnd(F.col("h_amount_mad"), 2)
    priced = (amount > 0) & (median > 0)
    scale = F.greatest(F.lit(1.4826) * mad, median * 0.08, F.lit(50.0))
    hour = F.hour("occurred_at")
    gaps = F.transform(
        "h_common_hours", lambda h: F.least(F.abs(h - hour), F.lit(24) - F.abs(h - hour))
    )
    has_recipient, has_device = F.col("recipient_id").isNotNull(), F.col("device_id").isNotNull()

    previous = F.when(F.col("h_previous.exp") >= F.col("ts_us"), F.col("h_previous.channel"))
    followed = F.coalesce(
        *[F.when(previous == c, F.col(f"h_from_{c}")) for c in config.CHANNELS], F.lit(0)
    )
    straddles = flag(
        (F.col("h_straddle.left") == previous) & (F.col("h_straddle.right") == F.col("channel"))
    )
    pairs = F.col("h_events") - 1
    transition = (
        F.when(pairs > 0, clamp(F.lit(1.0) - (followed - straddles) / pairs))
        .when((F.col("h_events") == 1) & (previous != F.col("channel")), F.lit(0.75))
        .otherwise(F.lit(0.0))
    )

    place = F.col("h_location")
    hours = F.greatest(
        (F.col("ts_us") - place["at"]) / F.lit(float(HOUR_US)), F.lit(1.0) / F.lit(60.0)
    )
    speed = haversine_km(place["latitude"], place["longitude"], F.col("latitude"), F.col("longitude")) / hours
    travel = F.when(
        (place["exp"] >= F.col("ts_us")) & F.col("latitude").isNotNull()
        & F.col("longitude").isNotNull() & (speed > 250), clamp((speed - 250.0) / 750.0),
    ).otherwise(F.lit(0.0))

    current_speed = F.when(
        (F.col("interaction_ms") > 0) & (F.col("menu_depth") > 0),
        F.col("interaction_ms") / F.col("menu_depth"),
    )
    paste_rate = F.when(F.col("h_input") > 0, F.col("h_pasted") / F.col("h_input")).otherwise(0.0)
    calendar = clamp(F.col("h_months") / 4.0)
    monthly = F.col("h_months") >= 3
    new_sim = flag(F.col("sim_id").isNotNull() & (F.col("h_sim") == 0))
    return {
        "amount_deviation": F.when(
            priced, clamp(F.abs(amount - median) / scale / 6.0)).otherwise(F.lit(0.0)),
        "amount_to_median": F.when(
            priced, clamp(amount / F.greatest(median, F.lit(1.0)) / 8.0)).otherwise(F.lit(0.0)),
        "unusual_hour": F.when(
            (F.size("h_common_hours") > 0) & (conf > 0), clamp(F.array_min(gaps) / 8.0)
        ).otherwise(F.lit(0.25)),
        "new_recipient": flag(has_recipient & (F.col("h_recipient") == 0)),
        "recipient_rarity": F.when(
            has_recipient,
            clamp(F.lit(1.0) - F.col("h_recipient") / F.greatest(F.lit(1), F.col("h_recipient_total"))),
        ).otherwise(F.lit(0.0)),
        "new_device": flag(has_device & (F.col("h_device") == 0)),
        "device_rarity": F.when(
            has_device,
            clamp(F.lit(1.0) - F.col("h_device") / F.greatest(F.lit(1), F.col("h_device_total"))),
        ).otherwise(F.lit(0.0)),
        "new_sim": new_sim,
        "new_ip_prefix": flag(F.col("ip_prefix").isNotNull() & (F.col("h_ip") == 0)),
        "new_channel": flag((F.col("h_events") > 0) & (F.col("h_channel") == 0)),
        "channel_transition_novelty": transition,
        "cross_channel_events_15m": clamp(F.col("h_cross_15m") / 3.0),
        "new_channel_enrollment_24h": flag(is_txn() & F.col("h_enrolled_24h")),
        "app_to_ussd_handoff": flag((F.col("channel") == "ussd") & F.col("h_app_30m")),
        "cross_channel_device_mismatch": flag(has_device & F.col("h_device_mismatch")),
        "velocity_5m": clamp(F.col("h_txn_5m") / 5.0),
        "velocity_1h": clamp(F.col("h_txn_1h") / 15.0),
        "failed_auth_24h": clamp(F.col("h_failed_24h") / 5.0),
        "recovery_signal_72h": flag(F.col("h_recovery_72h") > 0),
        "account_hazard_score": F.col("h_hazard"),
        "risk_window_hours_remaining": clamp(F.col("h_hours_left") / 72.0),
        "impossible_travel": travel,
        "interaction_speed_deviation": _deviation(current_speed, "h_speed", 0.1, 50.0),
        "typing_cadence_deviation": _deviation(
            F.col("keystroke_interval_ms"), "h_typing", 0.1, 15.0),
        "paste_anomaly": F.when(
            F.col("input_method").isin("pasted", "mixed"),
            clamp((F.lit(1.0) - paste_rate) * F.greatest(F.lit(0.25), conf)),
        ).otherwise(F.lit(0.0)),
        "device_handling_deviation": _deviation(
            F.col("device_tilt_variance"), "h_tilt", 0.12, 0.05),
        "navigation_novelty": F.when(
            F.col("navigation_signature").isNotNull() & (F.col("h_events") > 0)
            & (F.col("h_navigation") == 0), F.greatest(F.lit(0.10), conf),
        ).otherwise(F.lit(0.0)),
        "calendar_confidence": calendar,
        "day_of_month_deviation": F.when(
            monthly, clamp(F.col("h_nearest_day") / 12.0)).otherwise(F.lit(0.0)),
        "recurring_payment_match": F.when(
            monthly & has_recipient & (amount > 0), clamp(F.col("h_similar_months") / 3.0)
        ).otherwise(F.lit(0.0)),
        "verified_sim_change": flag(F.col("sim_change_verified") & (new_sim > 0)),
    }


def risk_window_state(score: Column) -> Column:
    return (
        F.when(score >= 0.60, "high").when(score >= 0.30, "elevated").when(score > 0, "watch")
        .otherwise("clear")
    )


def sender_features(
    events: DataFrame,
    accounts: DataFrame | None = None,
    settings: Settings = DEFAULTS,
    learned: DataFrame | None = None,
) -> DataFrame:
    """Events plus all sender features (6 decimals), risk-window state and precursors."""
    return features_of(account_history(events, settings, learned), events.columns, accounts)


def features_of(history: DataFrame, columns: list[str], accounts: DataFrame | None = None) -> DataFrame:
    """``columns`` of ``account_history`` rows plus all sender features, risk-window state and precursors."""
    df = history.withColumn("history_confidence", _confidence())
    computed = {**stateless_features(), **history_features()}
    df = df.select(
        *columns, "history_confidence", "active_precursors",
        F.col("h_hours_left").alias("hazard_hours_left"), F.col("h_events").alias("history_events"),
        *[rnd(expr).alias(name) for name, expr in computed.items()],
    ).withColumn("risk_window_state", risk_window_state(F.col("account_hazard_score")))
    if accounts is None:
        return df.withColumn("shared_device_allowed", F.lit(0.0)).withColumn(
            "regret_limit_30d", F.lit(3)
        )
    dim = accounts.select(
        "account_id", flag(F.col("shared_device_allowed")).alias("shared_device_allowed"),
        "regret_limit_30d",
    )
    return (
        df.join(dim, "account_id", "left")
        .withColumn("shared_device_allowed", F.coalesce("shared_device_allowed", F.lit(0.0)))
        .withColumn("regret_limit_30d", F.coalesce("regret_limit_30d", F.lit(3)))
    )
