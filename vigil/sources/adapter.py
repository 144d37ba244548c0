"""Typed views over the generic test tables.

The shared test tables have no recipients, devices or channels; these are derived from the small
integer in ``props`` by plain arithmetic.  The expressions use the SQL subset that Spark and other
engines evaluate identically, so the same text also feeds the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.scalars import micros

TXN = "('transfer','paybill','purchase','withdrawal','deposit')"

# Column -> expression over (event_id, ts, user_id, raw_type, value, k).
KIND = {
    "etype": (
        "case when raw_type = 'purchase' then 'purchase' when raw_type = 'click' then 'transfer'"
        " when raw_type = 'view' then 'login'"
        " when raw_type = 'signup' then (case when k < 3 then 'account_recovery' when k < 6 then"
        " 'pin_reset' when k < 50 then 'withdrawal' else 'paybill' end)"
        " else (case when k < 15 then 'failed_login' else 'deposit' end) end"
    ),
    "channel": (
        "case k % 4 when 0 then 'app' when 1 then 'ussd' when 2 then 'agent' else 'web' end"
    ),
    "cents": "floor(value * 1000 + 0.5)",
}
EVENT = {
    "event_id": "'evt_' || cast(event_id + 100000 as string)",
    "account_id": "'acct_' || cast(user_id as string)",
    "tenant_id": "'tenant_' || cast(user_id % 3 as string)",
    "event_type": "etype",
    "channel": "channel",
    "amount": f"case when etype in {TXN} then cast(cents as double) else cast(0 as double) end",
    "available_balance_before": "cast(cents as double) * (1 + (k % 10) * cast(0.5 as double))",
    "recipient_id": (
        "case when etype in ('transfer','paybill','purchase','withdrawal')"
        " then 'acct_' || cast(user_id % 3 + 3 * (k % 20) as string) end"
    ),
    "device_id": (
        "'dev_' || cast(user_id * 10 + (case when k % 17 = 0 then 1 + k % 3 else 0 end) as string)"
    ),
    "sim_id": "'sim_' || cast(user_id * 10 + (case when k % 23 = 0 then 1 else 0 end) as string)",
    "ip_prefix": (
        "'10.' || cast(user_id % 50 as string) || '.'"
        " || cast((case when k % 19 = 0 then 1 else 0 end) as string)"
    ),
    "session_id": "'ses_' || cast(event_id as string)",
    "latitude": (
        "case when k % 20 = 5 then null else cast(6.5 as double) + (user_id % 7) *"
        " cast(0.5 as double) + (case when k % 29 = 0 then 5 else 0 end) end"
    ),
    "longitude": (
        "case when k % 20 = 5 then null else cast(3.4 as double) + (user_id % 5) *"
        " cast(0.5 as double) end"
    ),
    "interaction_ms": "cast(1000 * (5 + k % 7) as int)",
    "menu_depth": "cast(4 + user_id % 3 as int)",
    "input_method": (
        "case when channel <> 'app' then 'unknown' when k % 8 = 0 then 'pasted' else 'typed' end"
    ),
    "keystroke_interval_ms": "case when channel = 'app' then cast(150 + k % 60 as double) end",
    "device_tilt_variance": (
        "case when channel = 'app' then 1 + (k % 13) * cast(0.25 as double) end"
    ),
    "navigation_signature": "channel || '_' || cast(k % 6 as string)",
    "sim_change_verified": "k % 46 = 0",
    "success": "etype <> 'failed_login'",
    "profile_eligible": "k % 11 <> 0",
    # telco envelope (present when k % 3 = 0)
    "has_telco": "k % 3 = 0",
    "telco_attested": "k % 3 = 0 and k % 5 <> 4",
    "telco_imsi": "k % 23 = 0",
    "telco_iccid": "k % 46 = 0",
    "telco_type": "k % 31 = 0",
    "telco_age": "cast((k % 12) * 24 as double)",
    "telco_changes": "cast(k % 4 as int)",
    "telco_tenure": "cast(k * 10 as double)",
    "telco_otp": "case when k % 2 = 0 then cast(k * 7 as double) end",
    "telco_geo": "case when k % 2 = 0 then cast(k * 5 as double) end",
    # agent envelope (agent channel only)
    "has_terminal": "channel = 'agent'",
    "terminal_attested": "channel = 'agent' and k % 7 <> 6",
    "agent_token": "'agenttoken_' || cast(user_id % 3 as string)",
    "terminal_token": (
        "'terminal_' || cast((user_id % 3) * 10 + k % 5 as string)"
    ),
    "terminal_lat": "case when k % 9 = 0 then null else cast(6.5 as double) end",
    "terminal_lon": "case when k % 9 = 0 then null else cast(3.4 as double) end",
    "shift_start": "case when k % 10 = 2 then null else cast(k % 3 * 8 as int) end",
    "shift_end": "case when k % 10 = 2 then null else cast((k % 3 * 8 + 10) % 24 as int) end",
    "terminal_age": "case when k % 6 = 4 then null else cast(k as double) end",
    # consented session signals (app only)
    "has_session": "channel = 'app' and k % 12 = 0",
    "session_attested": "channel = 'app' and k % 12 = 0 and k <> 36",
    "active_call": "k % 24 = 0",
    "screen_sharing": "k % 36 = 0",
    "replacements": "cast(k % 4 as int)",
    "backtracks": "cast(k % 5 as int)",
    "amount_edits": "cast(k % 6 as int)",
    "pause_ms": "case when k = 60 then null else cast(k * 2000 as int) end",
    "pasted_in_call": "k = 72",
    "session_score": "case when k = 84 then null else (k % 10) / cast(10 as double) end",
    # evaluation labels
    "is_takeover": "case when k % 20 = 0 then 1 else 0 end",
    "scenario": (
        "case when k % 20 = 0 then 'takeover_' || cast(k % 3 as string)"
        " when k % 9 = 1 then 'hard_negative' else 'legitimate' end"
    ),
}
FEEDBACK_LABEL = (
    "case k when 7 then 'account_takeover' when 57 then 'other_fraud' when 77 then 'legitimate'"
    " when 78 then 'unknown' end"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        F.col("event_type").alias("raw_type"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    return raw.select("*", *[F.expr(text).alias(name) for name, text in KIND.items()])


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat row per event, with ``k`` kept for derived side tables."""
    return _base(spark, sf_dir).select(
        *[F.expr(text).alias(name) for name, text in EVENT.items()],
        F.col("ts").alias("occurred_at"),
        micros("ts").alias("ts_us"),
        "k",
    )


def _envelope(present: str, **fields: str) -> Column:
    return F.when(
        F.col(present), F.struct(*[F.col(src).alias(name) for name, src in fields.items()])
    )


def with_envelopes(flat: DataFrame) -> DataFrame:
    """Fold the flat evidence columns into the three nullable nested envelopes."""
    telco = _envelope(
        "has_telco", imsi_changed="telco_imsi", iccid_changed="telco_iccid",
        sim_type_changed="telco_type", sim_activation_age_hours="telco_age",
        sim_changes_30d="telco_changes", previous_sim_tenure_days="telco_tenure",
        otp_to_sim_change_minutes="telco_otp", otp_sim_geo_distance_km="telco_geo",
        gateway_attested="telco_attested",
    )
    agent = _envelope(
        "has_terminal", agent_token="agent_token", terminal_token="terminal_token",
        registered_latitude="terminal_lat", registered_longitude="terminal_lon",
        shift_start_hour="shift_start", shift_end_hour="shift_end",
        terminal_age_days="terminal_age", gateway_attested="terminal_attested",
    )
    session = _envelope(
        "has_session", active_call="active_call", screen_sharing_detected="screen_sharing",
        recipient_replacements="replacements", confirmation_backtracks="backtracks",
        amount_edits="amount_edits", pause_before_confirmation_ms="pause_ms",
        recipient_pasted_during_call="pasted_in_call", on_device_coercion_score="session_score",
        consented_device_attested="session_attested",
    )
    plain = [
        "event_id", "account_id", "tenant_id", "occurred_at", "ts_us", "event_type", "channel",
        "amount", "available_balance_before", "recipient_id", "device_id", "sim_id", "ip_prefix",
        "session_id", "latitude", "longitude", "interaction_ms", "menu_depth", "input_method",
        "keystroke_interval_ms", "device_tilt_variance", "navigation_signature",
        "sim_change_verified", "success", "profile_eligible",
    ]
    return flat.select(
        *plain,
        telco.alias("telco_assurance"),
        agent.alias("agent_assurance"),
        session.alias("coercion_signals"),
        F.create_map(F.lit("k"), F.col("k").cast("string")).alias("metadata"),
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_envelopes(flat_events(spark, sf_dir))


def read_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("acct_"), F.col("c_custkey").cast("string")).alias("account_id"),
        (F.col("c_custkey") % 6 == 0).alias("shared_device_allowed"),
        (F.lit(2) + F.col("c_custkey") % 3).cast("int").alias("regret_limit_30d"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_events(spark, sf_dir).select("event_id", "is_takeover", "scenario")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyst feedback on events, twelve hours after each labelled event."""
    return (
        flat_events(spark, sf_dir)
        .withColumn("label", F.expr(FEEDBACK_LABEL))
        .filter("label is not null")
        .select(
            F.col("event_id").alias("decision_id"), "event_id", "label",
            F.expr("'analyst_' || cast(k % 3 as string)").alias("analyst_id"),
            F.expr("case when k = 57 then 'analyst_0' when k = 7 then null else 'analyst_9' end")
            .alias("second_approver_id"),
            (F.col("ts_us") + F.lit(43_200_000_000)).alias("confirmed_us"),
        )
    )


def lineitem_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed-fraud reports from returned lines: a second, larger feedback log."""
    return (
        table(spark, sf_dir, "lineitem")
        .filter("l_returnflag = 'R'")
        .select(
            F.expr("'supp_' || cast(l_suppkey as string)").alias("recipient_id"),
            F.expr("'acct_' || cast(l_orderkey % 200 as string)").alias("account_id"),
            F.expr("'tenant_' || cast(l_suppkey % 3 as string)").alias("tenant_id"),
            micros("l_shipdate").alias("confirmed_us"),
        )
    )


EVIDENCE_BY_KEY = (
    "case o_orderkey % 5 when 0 then 'confirmed_customer_report'"
    " when 1 then 'verified_account_takeover' when 2 then 'confirmed_mule_cashout'"
    " when 3 then 'confirmed_terminal_compromise' else 'analyst_high_confidence' end"
)
REPORT = {
    "report_id": (
        "'report_' || cast((case when o_orderkey % 50 = 49 then o_orderkey - 1 else o_orderkey end)"
        " as string)"
    ),
    "indicator_type": (
        "case o_orderkey % 3 when 0 then 'recipient' when 1 then 'agent_terminal'"
        " else 'campaign' end"
    ),
    "indicator_value": (
        "case o_orderkey % 3 when 0 then ' ACCT_' || cast(o_custkey % 50 as string)"
        " when 1 then 'terminal_' || cast(o_custkey % 25 as string)"
        " else 'sim_change|recipient_change| cashout |cashout' end"
    ),
    "institution_id": "'Bank-' || substr(o_orderpriority, 1, 1)",
    "confidence": "cast(0.6 as double) + (o_orderkey % 40) / cast(100 as double)",
    "evidence_class": f"case when o_orderkey % 101 = 0 then 'rumour' else {EVIDENCE_BY_KEY} end",
    "ttl_hours": "cast(24 + 24 * (o_orderkey % 29) as int)",
    "nonce": (
        "'nonce_' || cast((case when o_orderkey % 40 = 33 then o_orderkey - 1 else o_orderkey end)"
        " as string)"
    ),
    "observed_us": "1704067200000000 + (o_orderkey % 720) * 3600000000",
    "delay_us": "(o_orderkey % 19) * 60000000 - 60000000",
    "forged": "o_orderkey % 97 = 0",
    "resent": "o_orderkey % 30 = 0",
    "withdrawn": "o_orderstatus = 'F' and o_orderkey % 4 = 0",
}


def sketch_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared-indicator reports from orders, on the event calendar (January 2024).

    Some are received late, reuse a nonce or a report id, and some are sent twice.
    """
    reports = table(spark, sf_dir, "orders").select(
        *[F.expr(text).alias(name) for name, text in REPORT.items()]
    ).withColumn("received_us", F.col("observed_us") + F.col("delay_us"))
    again = reports.filter("resent").withColumn("received_us", F.col("received_us") + 5_000_000)
    return reports.unionByName(again).drop("delay_us", "resent")


HEARTBEAT = {
    "heartbeat_id": "event_id",
    "institution_id": "'Bank-' || cast(1 + k % 3 as string)",
    "nonce": "'beat_' || cast((case when k % 19 = 3 then ts_us - ts_us % 86400000000 else ts_us end) as string)",
    "dep_core_banking": "k % 8 <> 7",
    "dep_telco_gateway": "k % 5 <> 1",
    "dep_consortium": "k % 7 <> 2",
    "dep_recipient_graph": "k % 11 <> 5",
    "dep_agent_integrity": "k % 6 <> 3",
    "dep_model_runtime": "k % 9 <> 4",
    "received_us": "ts_us + (case when k % 13 = 0 then 900000000 else 1000000 end)",
    "forged": "k % 29 = 1",
}


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency heartbeats from the deposit events of each tenant."""
    return flat_events(spark, sf_dir).filter("event_type = 'deposit'").select(
        "tenant_id", F.col("ts_us").alias("at_us"),
        *[F.expr(text).alias(name) for name, text in HEARTBEAT.items()],
    )


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished reconciliations, taken from the withdrawal events."""
    return flat_events(spark, sf_dir).filter("event_type = 'withdrawal'").select(
        "tenant_id", F.col("ts_us").alias("at_us"))


def edge_capsules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issued edge capsules, taken from the failed logins."""
    return flat_events(spark, sf_dir).filter("event_type = 'failed_login'").select(
        "tenant_id", F.col("ts_us").alias("issued_us"))


LIFECYCLE_STATE = (
    "case l_linenumber when 1 then 'authorized' when 2 then 'held' when 3 then 'released'"
    " when 4 then 'settled' when 5 then 'authorized' when 6 then 'held' else 'cancelled' end"
)


def lifecycle_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle requests from order lines; equal lines repeat their idempotency key."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr("'order_' || cast(l_orderkey as string)").alias("event_id"),
        F.expr(LIFECYCLE_STATE).alias("to_state"),
        micros("l_shipdate").alias("at_us"),
        F.expr(
            "cast(l_linenumber as bigint) * 1000000000000 + l_partkey * 100000 + l_suppkey"
        ).alias("seq"),
        F.expr("cast(l_orderkey as string) || '-' || cast(l_linenumber as string)")
        .alias("idempotency_key"),
    )


def consortium_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.expr("'acct_' || cast(o_custkey % 50 as string)").alias("recipient_id"),
        F.expr("'Bank-' || substr(o_orderpriority, 1, 1)").alias("institution_id"),
        F.expr(REPORT["confidence"]).alias("confidence"),
        F.expr(EVIDENCE_BY_KEY).alias("evidence_class"),
        micros("o_orderdate").alias("created_us"),
        F.col("o_orderkey").alias("report_seq"),
    )


def generic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled scores from documents and labels, for the evaluation operators."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    return docs.join(labels, "doc_id").select(
        "doc_id", F.col("toxic").alias("label"), F.col("lang").alias("channel"),
        F.col("source").alias("scenario"),
        F.expr("least(cast(1 as double), n_chars / cast(20000 as double))").alias("raw"),
        "quality",
    )
