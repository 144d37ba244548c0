"""Learning quarantine, transaction lifecycle, review cases and customer requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import config
from vigil.config import DEFAULTS, Settings
from vigil.functions import rules
from vigil.functions.scalars import HOUR_US
from vigil.operators.timeline import positions
from vigil.operators.topk import top_per_key


def trust_state(decisions: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds trust_state, eligible_after_us and trust_reason; needs created_us and ts_us."""
    wait = settings.learning_quarantine_hours * HOUR_US
    safe = F.col("action").isin(config.ALLOW, config.ALLOW_MONITOR) & (
        F.col("fused_score") < config.THRESHOLDS["confirm"])
    old = F.col("ts_us") <= F.col("created_us") - wait
    outage = F.col("resilience_mode") != "online"
    state = (
        F.when(outage, "excluded").when(safe & old, "trusted").when(safe, "pending").otherwise("excluded")
    )
    return decisions.withColumn("trust_state", state).withColumn(
        "eligible_after_us", F.when(F.col("trust_state") == "pending", F.col("created_us") + wait)
    ).withColumn(
        "trust_reason",
        F.when(outage, "outage_learning_frozen")
        .when(F.col("trust_state") == "pending", "safe_learning_quarantine").otherwise(F.col("action")),
    )


def mature_learning(trust: DataFrame, at_us: int) -> DataFrame:
    """Pending rows whose quarantine has passed, now trusted."""
    return trust.filter(
        (F.col("trust_state") == "pending") & (F.col("eligible_after_us") <= F.lit(at_us))
    ).withColumn("trust_state", F.lit("trusted"))


def matured_accounts(matured: DataFrame) -> DataFrame:
    return matured.select("tenant_id", "account_id").distinct()


def trust_latest(trust_log: DataFrame) -> DataFrame:
    """Latest trust row per event from an append-only log (event_id, trust_state, updated_us, seq)."""
    return trust_log.groupBy("event_id").agg(
        F.max_by("trust_state", F.struct("updated_us", "seq")).alias("trust_state"),
        F.count(F.lit(1)).alias("changes"),
    )


def apply_trust(events: DataFrame, latest: DataFrame) -> DataFrame:
    """Profile eligibility follows the latest trust state where one exists."""
    return events.join(latest.select("event_id", "trust_state"), "event_id", "left").withColumn(
        "profile_eligible",
        F.when(F.col("trust_state").isNull(), F.col("profile_eligible"))
        .otherwise(F.col("trust_state") == "trusted"),
    )


def feedback_trust(feedback: DataFrame) -> DataFrame:
    """Trust changes caused by analyst feedback."""
    return feedback.select(
        "event_id", "confirmed_us",
        F.when(F.col("label").isin(config.FRAUD_LABELS), "revoked")
        .when(F.col("label") == "legitimate", "trusted").alias("trust_state"), "label",
    ).filter("trust_state is not null")


def trusted_scan(events: DataFrame, latest: DataFrame) -> DataFrame:
    return events.join(latest.filter("trust_state = 'trusted'").select("event_id"), "event_id")


# ------------------------------------------------------------------------------- lifecycle
def allowed_transition(source: Column, target: Column) -> Column:
    ok = F.lit(False)
    for state, targets in config.LIFECYCLE_EDGES.items():
        if targets:
            ok = ok | ((source == state) & target.isin(targets))
    return ok


def lifecycle_log(log: DataFrame) -> DataFrame:
    """Requests without idempotent repeats: the first row of each idempotency key."""
    rest = [c for c in log.columns if c != "idempotency_key"]
    return log.groupBy("idempotency_key").agg(
        F.min_by(F.struct(*rest), F.struct("at_us", "seq")).alias("r")
    ).select("idempotency_key", "r.*")


def lifecycle_validate(log: DataFrame) -> DataFrame:
    """Adds from_state (previous state of the event, 'created' at first) and allowed."""
    placed = positions(log, ["event_id"], "at_us", ["seq"])
    before = placed.select("event_id", (F.col("position") + 1).alias("position"),
                           F.col("to_state").alias("from_state"))
    joined = placed.join(before, ["event_id", "position"], "left").withColumn(
        "from_state", F.coalesce("from_state", F.lit("created")))
    return joined.withColumn("allowed", allowed_transition(F.col("from_state"), F.col("to_state"))).drop(
        "position", "total")


def lifecycle_current(log: DataFrame) -> DataFrame:
    return log.groupBy("event_id").agg(
        F.max_by("to_state", F.struct("at_us", "seq")).alias("state"),
        F.count(F.lit(1)).alias("version"),
    )


def initial_state(action: Column) -> Column:
    return F.when(action.isin(config.HOLD, config.SAFE_PAUSE, config.DELAY), "held").otherwise("authorized")


# ----------------------------------------------------------------------------------- cases
def review_cases(decisions: DataFrame) -> DataFrame:
    """Decisions that become review cases, with priority; plus the 1 % hash audit sample."""
    reports = "(recipient_rep_confirmed_reports + terminal_rep_confirmed_reports + sketch_active_reports)"
    ready = decisions
    for name in ("recipient_rep_confirmed_reports", "terminal_rep_confirmed_reports",
                 "sketch_active_reports"):
        ready = ready.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    due = F.col("requires_analyst_review") | (F.col("fused_score") >= config.THRESHOLDS["hold"])
    digest = F.conv(F.substring(F.sha2("event_id", 256), 1, 6), 16, 10).cast("long")
    audit = ~due & (digest % 100 == 0)
    return ready.filter(due | audit).select(
        "tenant_id", "event_id", audit.alias("random_audit"),
        F.when(audit, F.lit(0.1)).otherwise(F.expr(rules.review_priority(reports))).alias("priority"),
        "ts_us",
    )


def case_queue(cases: DataFrame, limit: int = 100) -> DataFrame:
    """The ``limit`` most urgent cases of each tenant."""
    order = [F.col("priority").desc(), F.col("ts_us"), F.col("event_id")]
    return top_per_key(cases, ["tenant_id"], order, limit, "event_id")


def account_decisions(decisions: DataFrame, limit: int = 100) -> DataFrame:
    order = [F.col("ts_us").desc(), F.col("event_id")]
    return top_per_key(decisions, ["tenant_id", "account_id"], order, limit, "event_id", ways=4)


def appeals_join(appeals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Open appeals with the decision of the same tenant; appeals of unknown decisions are dropped."""
    return appeals.join(
        decisions.select("tenant_id", F.col("event_id").alias("decision_id"), "action", "fused_score"),
        ["tenant_id", "decision_id"],
    ).withColumn("status", F.lit("open"))


def privacy_queue(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Requests for existing accounts of the tenant, queued."""
    return requests.join(accounts.select("tenant_id", "account_id"), ["tenant_id", "account_id"],
                         "left_semi").withColumn("status", F.lit("queued"))


def privacy_export(events: DataFrame, requests: DataFrame) -> DataFrame:
    wanted = requests.filter("request_type = 'export'").select("tenant_id", "account_id").distinct()
    return events.join(wanted, ["tenant_id", "account_id"], "left_semi")


def privacy_delete(events: DataFrame, requests: DataFrame) -> DataFrame:
    """The table without the accounts that asked for deletion."""
    gone = requests.filter("request_type = 'delete'").select("tenant_id", "account_id").distinct()
    return events.join(gone, ["tenant_id", "account_id"], "left_anti")


def profile_succession(requests: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    approved = F.col("trusted_device_confirmed") & F.col("official_callback_confirmed")
    return requests.withColumn("approved", approved).withColumn(
        "mode", F.when(approved, "conservative_reseed").otherwise("verification_required")
    ).withColumn("learning_quarantine_hours", F.lit(settings.learning_quarantine_hours))


def outbox(decisions: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """One message per decision and per lifecycle change."""
    made = decisions.select(
        F.lit("decision.created").alias("topic"),
        F.to_json(F.struct(F.col("event_id").alias("decision_id"), "action")).alias("payload_json"))
    moved = lifecycle.select(
        F.lit("transaction.lifecycle").alias("topic"),
        F.to_json(F.struct("event_id", F.col("to_state").alias("state"))).alias("payload_json"))
    return made.unionByName(moved).withColumn("status", F.lit("pending"))
