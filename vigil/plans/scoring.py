"""The flagship plan: validated events -> contexts -> features -> scores -> policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import config
from vigil.config import DEFAULTS, Settings
from vigil.functions import rules
from vigil.functions.scalars import clamp, flag, rnd
from vigil.operators.campaign import campaign_accounts, campaign_stages, with_campaign, without_campaign
from vigil.operators.exchange import (
    consortium_apply, event_indicators, keyed_token, sketch_apply, sketch_lookup, sketch_match,
)
from vigil.operators.network import recipient_context, recipient_features
from vigil.operators.reputation import event_reputation
from vigil.operators.policy import decide, regret_used, safety_envelope
from vigil.operators.scoring import (
    anomaly, customer_explanation, decision_confidence, evidence_summary, fuse, reason_assembly,
)
from vigil.operators.learned import learned_history
from vigil.operators.sender import features_of, is_trusted, is_txn, window_history
from vigil.operators.terminal import terminal_context, terminal_features
from vigil.functions.storage import cut, cut_by
from vigil.functions.wide import names_in, packed

EVENT_KEY = ["tenant_id", "event_id"]
#: What the steps of a decision read; all other columns pass through them as one value (``packed``).
IN_DECISIONS = names_in(
    rules.EXPOSURE, rules.FRICTION, rules.CRITICAL, rules.ceiling_action(), rules.OVER_BUDGET, rules.RISKY_CHANGE, rules.SINGLE_REPORT, rules.SKETCH_ALONE,
    rules.SKETCH_CEILING) | {
    *EVENT_KEY, "account_id", "ts_us", "regret_used", "resilience_mode", "sketch_ceiling", "sketch_institutions", "driver", "security_floor", "blended_score",
    "model_score", "consortium_score", "campaign_risk", "anomaly_reasons", "verified_sim_change"}
#: What the steps of a score read, up to the fused score and after it.
IN_CONFIDENCE = names_in(rules.data_coverage(), rules.RECIPIENT_PRESENT, rules.RECIPIENT_COVERAGE, rules.confidence_score(), rules.scorer_agreement()) | {
    *EVENT_KEY, "recipient_id", "fused_score", "anomaly_score", "model_score", "campaign_risk", "resilience_mode", "dep_consortium", "confidence_multiplier",
    "recipient_rep_score", "terminal_rep_score", "balance_drain_ratio", "is_agent", "channel", "available_balance_before", "device_id", "sim_id",
    "ip_prefix", "latitude", "interaction_ms", "menu_depth", "keystroke_interval_ms", "input_method", "device_tilt_variance", "navigation_signature",
    "telco_assurance", "coercion_evidence_coverage"}
IN_SCORES = IN_CONFIDENCE | names_in(rules.anomaly_total(), rules.security_floor(), *rules.campaign_stage_items())


def hashed(narrow: DataFrame) -> DataFrame:
    """A few columns per event, to be hashed in a join: the wide rows of the other side are then not sorted."""
    return narrow.hint("shuffle_hash")


def with_contexts(
    events: DataFrame, confirmed: DataFrame | None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Events joined with the narrow network, terminal and reputation contexts, once per key.

    Each context is stored: it is a few columns per event, keeps the final plan small, and a lost
    executor never replays more than one stage family.
    """
    df = events.join(hashed(cut(recipient_context(events, settings))), EVENT_KEY, "left").join(
        hashed(cut(terminal_context(events, settings))), EVENT_KEY, "left"
    )
    if confirmed is None:
        empty = {"score": "double", "confirmed_reports": "long", "distinct_accounts": "long",
                 "status": "string"}
        for prefix in ("recipient_rep", "terminal_rep"):
            for name, kind in empty.items():
                df = df.withColumn(f"{prefix}_{name}", F.lit(None).cast(kind))
        return df
    by_recipient, by_terminal = event_reputation(events, confirmed, settings)
    return df.join(hashed(cut(by_recipient)), EVENT_KEY, "left").join(hashed(cut(by_terminal)), EVENT_KEY, "left")


def feature_table(
    events: DataFrame,
    accounts: DataFrame | None = None,
    confirmed: DataFrame | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """One row per event: its columns, the 61 features and the 12 terminal features.

    The wide rows are stored in buckets of their key (again without a shuffle, if ``events`` are) and stay there: what history
    and learning add comes as a few columns per row.
    """
    wide = cut_by(with_contexts(events, confirmed, settings).withColumn("_row", F.monotonically_increasing_id()), EVENT_KEY, "contexts")
    columns = [c for c in wide.columns if c != "_row"]
    until = wide.agg(F.max("ts_us")).first()[0]
    history = window_history(wide, settings, until)
    history = cut(history.select(*EVENT_KEY, F.col("_row").alias("_of"), *[c for c in history.columns if c not in wide.columns]), "history")
    found = cut(learned_history(wide, is_trusted(), is_txn(), settings, until=until).withColumnRenamed("account_id", "_account"), "learned")
    # Both conditions are written so that they do not become keys of the join, for which the rows would be dealt anew.
    whole = wide.join(hashed(history), EVENT_KEY).where("_row - _of = 0").drop("_row", "_of")
    whole = whole.join(hashed(found), EVENT_KEY).where(F.array_contains(F.array("account_id"), F.col("_account"))).drop("_account")
    return features_from(whole, columns, accounts)


def features_from(history: DataFrame, columns: list[str], accounts: DataFrame | None = None) -> DataFrame:
    """The same table from stored ``account_history`` rows of events with their contexts (``columns``)."""
    return all_features(features_of(history, columns, accounts))


def all_features(df: DataFrame) -> DataFrame:
    """Sender features with the network, reputation and terminal features after them."""
    has_recipient = F.col("recipient_id").isNotNull()

    def number(name: str):
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))

    extra = {
        **recipient_features(df), **terminal_features(),
        "recipient_confirmed_fraud_score": clamp(number("recipient_rep_score")),
        "recipient_confirmed_accounts": clamp(number("recipient_rep_distinct_accounts") / 3.0),
        "recipient_watchlist_coverage": flag(has_recipient),
        "agent_confirmed_fraud_score": clamp(number("terminal_rep_score")),
        "agent_confirmed_accounts": clamp(number("terminal_rep_distinct_accounts") / 3.0),
    }
    df = df.select("*", *[rnd(expr).alias(name) for name, expr in extra.items()])
    keep = [c for c in df.columns if c not in config.FEATURES and c not in config.AGENT_FEATURES]
    return df.select(*keep, *config.FEATURES, *config.AGENT_FEATURES)


def scored_events(
    features: DataFrame,
    consortium: DataFrame | None = None,
    sketches: DataFrame | None = None,
    settings: Settings = DEFAULTS,
    campaign: DataFrame | None = None,
    campaign_evidence: bool = True,
) -> DataFrame:
    """Scores and confidence from a stored feature table; everything that no decision feeds back into.

    ``features`` is read several times, so store it first (``timeline.cut`` or a table).  The columns ``model_score``,
    ``resilience_mode`` and ``dep_consortium`` (false: shared evidence is out of reach) are used when present.
    ``campaign`` is a stored result of ``campaign_accounts`` over all events, when ``features`` are only some;
    without ``campaign_evidence`` no campaign counts.
    """
    df = features
    if "model_score" not in df.columns:
        df = df.withColumn("model_score", F.lit(None).cast("double"))
    if "resilience_mode" not in df.columns:
        df = df.withColumn("resilience_mode", F.lit("online"))
    if campaign_evidence and campaign is None:
        campaign = cut(campaign_accounts(campaign_stages(features), settings))

    def campaigned(some: DataFrame) -> DataFrame:
        return with_campaign(some, settings, campaign) if campaign_evidence else without_campaign(some)

    reachable = F.col("dep_consortium") if "dep_consortium" in features.columns else F.lit(True)
    df, whole = packed(df, IN_SCORES)
    df = campaigned(df)
    df = fuse(anomaly(df)).withColumn(
        "fused_score",
        F.when(F.col("campaign_risk") >= 0.62, F.greatest("fused_score", "campaign_risk"))
        .otherwise(F.col("fused_score")),
    )
    df, scored = packed(df, IN_CONFIDENCE | {"_rest"}, "_scored")
    if consortium is None:
        df = df.withColumn("consortium_score", F.lit(0.0))
    else:
        df = (
            df.withColumn("recipient_token", keyed_token(F.col("recipient_id"), settings.recipient_key))
            .join(consortium.select("recipient_token", "consortium_score"), "recipient_token", "left")
            .drop("recipient_token")
            .withColumn("consortium_score", F.when(reachable, F.coalesce("consortium_score", F.lit(0.0))).otherwise(0.0))
        )
    df = df.withColumn(
        "consortium_recipient_risk",
        F.when(F.col("consortium_score") >= 0.70, F.col("consortium_score")).otherwise(F.lit(0.0)),
    ).withColumn("pre_sketch_score", consortium_apply(F.col("fused_score"), F.col("consortium_score")))
    if sketches is None:
        for name, kind in {"sketch_best": "double", "sketch_institutions": "long",
                           "sketch_confidence": "double", "sketch_active_reports": "long",
                           "sketch_status": "string", "matches": "long",
                           "matched_indicators": "string"}.items():
            df = df.withColumn(name, F.lit(None).cast(kind))
    else:
        indicators = event_indicators(campaigned(features.where(reachable)))
        matches = cut(sketch_match(sketch_lookup(indicators, sketches, settings)))
        df = df.join(hashed(matches), EVENT_KEY, "left")
    df = decision_confidence(sketch_apply(df))
    outage = F.col("resilience_mode") != "online"
    if "confidence_multiplier" in df.columns:
        df = df.withColumn(
            "confidence_score",
            F.when(outage, rnd(F.col("confidence_score") * F.col("confidence_multiplier")))
            .otherwise(F.col("confidence_score")),
        ).withColumn("confidence_level", F.expr(rules.confidence_level("confidence_score")))
    done = scored(evidence_summary(df.withColumn("risk_level", F.expr(rules.risk_level("fused_score")))))
    return whole(done, EVENT_KEY if campaign_evidence or sketches is not None else ())


def decide_events(
    scored: DataFrame, prior_decisions: DataFrame | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Policy outcome, reasons and explanation of scored events.

    ``prior_decisions`` is the recorded decision log that the intervention budget counts.
    """
    if prior_decisions is None:
        df = scored.withColumn("regret_used", F.lit(0).cast("long"))
    else:
        used = regret_used(
            scored.select("tenant_id", "account_id", "ts_us", "event_id"), prior_decisions,
            settings=settings,
        ).select("tenant_id", "event_id", "regret_used")
        df = scored.join(hashed(used), EVENT_KEY)
    df, whole = packed(df, IN_DECISIONS)
    return whole(customer_explanation(reason_assembly(safety_envelope(decide(df)))))


def score_features(
    features: DataFrame,
    consortium: DataFrame | None = None,
    sketches: DataFrame | None = None,
    prior_decisions: DataFrame | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Decisions from a stored feature table: scores, then policy."""
    scored = scored_events(features, consortium, sketches, settings)
    return decide_events(cut(scored) if prior_decisions is not None else scored, prior_decisions, settings)
