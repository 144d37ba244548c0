"""Reputation of recipients and terminals from analyst-confirmed fraud, now and as of an event.

Confirmations are an append-only log; the reputation is a view over it.  The as-of form needs running
values only (reports so far, distinct accounts so far, time of the last report): a running aggregate over the
confirmations, whose rows are intervals that queries look up by equi-joins (``operators/asof.py``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import config
from vigil.config import DEFAULTS, Settings
from vigil.functions.scalars import DAY_US, HOUR_US, from_micros, rnd
from vigil.operators.asof import as_of
from vigil.operators.timeline import neighbours, running_at


@dataclass(frozen=True)
class ReputationKind:
    key: str
    days: int
    top_status: str
    scope: tuple[str, ...]


RECIPIENT = ReputationKind("recipient_key", 90, "high", ())
TERMINAL = ReputationKind("terminal_key", 60, "quarantined", ("tenant_id",))


def shared_key(identifier: Column) -> Column:
    """Pseudonymous key of an identifier for shared storage."""
    return F.sha2(F.lower(F.trim(identifier)), 256)


def _status(kind: ReputationKind, accounts: Column) -> Column:
    return (
        F.when(accounts >= 3, kind.top_status).when(accounts >= 2, "elevated").otherwise("monitor")
    )


def _score(kind: ReputationKind, accounts: Column, last_us: Column, at_us: Column) -> Column:
    base = F.when(accounts == 1, 0.35).when(accounts == 2, 0.75).otherwise(1.0)
    age = F.greatest(F.lit(0.0), (at_us - last_us) / float(DAY_US))
    alive = at_us < last_us + kind.days * DAY_US
    return F.when(alive, rnd(F.greatest(F.lit(0.0), base * (1.0 - age / float(kind.days))))).otherwise(
        F.lit(0.0)
    )


def reputation(confirmed: DataFrame, kind: ReputationKind) -> DataFrame:
    """Current reputation per key: partial aggregation, then one row per (key, account)."""
    keys = [*kind.scope, kind.key]
    per_account = confirmed.groupBy(*keys, "account_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("confirmed_us").alias("lo"), F.max("confirmed_us").alias("hi")
    )
    out = per_account.groupBy(*keys).agg(
        F.sum("n").alias("confirmed_reports"), F.count(F.lit(1)).alias("distinct_accounts"),
        F.min("lo").alias("first_us"), F.max("hi").alias("last_us"),
    )
    return out.select(
        *keys, "confirmed_reports", "distinct_accounts",
        from_micros(F.col("first_us")).alias("first_confirmed_at"),
        from_micros(F.col("last_us")).alias("last_confirmed_at"),
        from_micros(F.col("last_us") + kind.days * DAY_US).alias("expires_at"),
        _status(kind, F.col("distinct_accounts")).alias("status"),
    )


def reputation_asof(
    queries: DataFrame, confirmed: DataFrame, kind: ReputationKind, settings: Settings = DEFAULTS
) -> DataFrame:
    """Queries (scope, key, ``at``, payload) with the reputation at their time."""
    keys = [*kind.scope, kind.key]
    bucket = 24 * settings.bucket_hours * HOUR_US
    # Distinct accounts so far: +1 at the first report of each (key, account).
    firsts = confirmed.groupBy(*keys, "account_id").agg(F.min("confirmed_us").alias("at"))
    data = confirmed.select(
        *keys, F.col("confirmed_us").alias("at"), F.lit(1).cast("long").alias("confirmed_reports"),
        F.lit(0).cast("long").alias("distinct_accounts"), F.col("confirmed_us").alias("last_us"),
    ).unionByName(
        firsts.select(
            *keys, "at", F.lit(0).cast("long").alias("confirmed_reports"),
            F.lit(1).cast("long").alias("distinct_accounts"), F.lit(None).cast("long").alias("last_us"),
        )
    )
    # Only the confirmations run through windows; queries look their state up by interval joins.
    sums = ["confirmed_reports", "distinct_accounts"]
    log = running_at(data, data.select(*keys, "at").distinct(), keys, "at", sums=sums, maxs=["last_us"], bucket_us=bucket)
    found = as_of(queries, log, keys, "at", [*sums, "last_us"]).withColumns(
        {c: F.coalesce(c, F.lit(0).cast("long")) for c in sums})
    accounts, last, at = F.col("distinct_accounts"), F.col("last_us"), F.col("at")
    known = last.isNotNull()
    alive = at < last + kind.days * DAY_US
    return found.withColumn(
        "score", F.when(known, _score(kind, accounts, last, at)).otherwise(F.lit(0.0))
    ).withColumn(
        "status",
        F.when(~known, "clear").when(~alive, "expired").otherwise(_status(kind, accounts)),
    )


def confirmed_from_feedback(feedback: DataFrame, events: DataFrame) -> DataFrame:
    """Fraud feedback joined with its decided event: one row per confirmation."""
    fraud = feedback.filter(F.col("label").isin(config.FRAUD_LABELS))
    wanted = events.select(
        "event_id", "tenant_id", "account_id", "recipient_id",
        F.when(
            F.coalesce(F.col("agent_assurance")["gateway_attested"], F.lit(False)),
            F.col("agent_assurance")["terminal_token"],
        ).alias("terminal_token"),
    )
    return fraud.join(wanted, "event_id")


def recipient_confirmations(confirmed: DataFrame) -> DataFrame:
    return confirmed.filter("recipient_id is not null").select(
        shared_key(F.col("recipient_id")).alias("recipient_key"), "account_id", "confirmed_us"
    )


def terminal_confirmations(confirmed: DataFrame) -> DataFrame:
    return confirmed.filter("terminal_token is not null").select(
        "tenant_id", shared_key(F.col("terminal_token")).alias("terminal_key"), "account_id",
        "confirmed_us",
    )


def event_reputation(
    events: DataFrame, confirmed: DataFrame, settings: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """Recipient and terminal reputation as of each event that has one of them."""
    recipients = events.filter("recipient_id is not null").select(
        shared_key(F.col("recipient_id")).alias("recipient_key"), F.col("ts_us").alias("at"),
        "tenant_id", "event_id",
    )
    token = F.col("agent_assurance")["terminal_token"]
    terminals = events.filter(
        F.coalesce(F.col("agent_assurance")["gateway_attested"], F.lit(False))
    ).select("tenant_id", shared_key(token).alias("terminal_key"), F.col("ts_us").alias("at"), "event_id")

    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(
            "tenant_id", "event_id",
            *[F.col(c).alias(f"{prefix}_{c}")
              for c in ("status", "score", "confirmed_reports", "distinct_accounts")],
        )

    by_recipient = reputation_asof(recipients, recipient_confirmations(confirmed), RECIPIENT, settings)
    by_terminal = reputation_asof(terminals, terminal_confirmations(confirmed), TERMINAL, settings)
    return named(by_recipient, "recipient_rep"), named(by_terminal, "terminal_rep")


def dual_control_violations(
    feedback: DataFrame, events: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Fraud feedback that lacked an independent second approver although one was required.

    Required when the recipient (globally) or the attested terminal (per tenant) already had a report.
    """
    confirmed = confirmed_from_feedback(feedback, events)
    bucket = 24 * HOUR_US

    def strengthened(keys: list[str], present: str) -> DataFrame:
        return neighbours(
            confirmed.filter(f"{present} is not null").select(*keys, "event_id", "confirmed_us"),
            keys, "confirmed_us", "event_id", F.lit(True), bucket,
        ).filter("prev_at is not null").select("event_id").distinct()

    again = (
        strengthened(["recipient_id"], "recipient_id").withColumn("by_recipient", F.lit(True))
        .join(
            strengthened(["tenant_id", "terminal_token"], "terminal_token")
            .withColumn("by_terminal", F.lit(True)),
            "event_id", "full",
        )
    )
    missing = F.col("second_approver_id").isNull() & (
        F.col("by_recipient").isNotNull() | F.col("by_terminal").isNotNull()
    )
    same = F.coalesce(F.col("second_approver_id") == F.col("analyst_id"), F.lit(False))
    return (
        confirmed.join(again, "event_id", "left")
        .withColumn(
            "violation",
            F.when(missing, "second_approver_required").when(same, "approver_not_independent"),
        )
        .filter("violation is not null")
        .select("decision_id", "event_id", "label", "violation")
    )
