"""Recipient-network ("mule graph") features, without any per-recipient window.

Edges are successful transactions sender -> recipient inside the tenant.  Every feature is a running
sum of interval deltas on the recipient's timeline:

* a sender is active in (t, t+24h] after a payment; overlapping intervals of one sender are merged
  by looking at its neighbouring payments, so the running sum counts distinct senders;
* a sender is first-time while exactly one payment lies in the 7-day look-back and that one is at
  most 24 h old;
* inflow and outflow are +amount / -amount one hour apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import config
from vigil.config import DEFAULTS, Settings
from vigil.functions.scalars import DAY_US, HOUR_US, clamp, flag, rnd
from vigil.functions.storage import cut
from vigil.operators.timeline import interval_deltas, neighbours, running_at

MONEY = "decimal(28,6)"  # exact running sums of amounts
VALUES = {"d_active": "bigint", "d_first": "bigint", "d_in": MONEY, "d_out": MONEY}


def recipient_context(events: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(tenant_id, event_id) and the recipient aggregates of events that name a recipient."""
    lookback = F.lit(settings.network_lookback_days * DAY_US)
    day, hour = F.lit(24 * HOUR_US), F.lit(HOUR_US)
    bucket = settings.bucket_hours * HOUR_US
    edges = events.select(
        "tenant_id", "event_id", "account_id", "recipient_id", "ts_us", "amount",
        (F.col("event_type").isin(config.TRANSACTION_TYPES) & F.col("success")).alias("is_edge"),
    )
    inbound = cut(neighbours(
        edges.filter("recipient_id is not null"),
        ["tenant_id", "recipient_id", "account_id"], "ts_us", "event_id", F.col("is_edge"), bucket,
    ), "inbound")

    t, prev, nxt = F.col("ts_us"), F.col("prev_at"), F.col("next_at")
    first_from = F.greatest(t, prev + lookback)
    first_to = F.least(t + day, nxt)
    alone = first_from < first_to
    cents = F.col("amount").cast(MONEY)
    one = F.lit(1)
    into = [
        (t + 1, {"d_in": cents, "d_active": F.when(prev >= t - day, 0).otherwise(1)}),
        (t + hour + 1, {"d_in": -cents}),
        (F.when(nxt.isNull() | (nxt > t + day), t + day + 1), {"d_active": -one}),
        (F.when(alone, first_from + 1), {"d_first": one}),
        (F.when(alone, first_to + 1), {"d_first": -one}),
    ]
    out_of = [(t + 1, {"d_out": cents}), (t + hour + 1, {"d_out": -cents})]
    names = list(VALUES)
    received = inbound.filter("is_edge").select(
        "tenant_id", F.col("recipient_id").alias("node"),
        F.inline(interval_deltas(into, names, VALUES)),
    )
    sent = edges.filter("is_edge").select(
        "tenant_id", F.col("account_id").alias("node"),
        F.inline(interval_deltas(out_of, names, VALUES)),
    )
    queries = inbound.select(
        "tenant_id", F.col("recipient_id").alias("node"), F.col("ts_us").alias("at"), "event_id",
        F.coalesce(F.col("prev_strict") >= t - day, F.lit(False)).alias("active_before"),
        F.coalesce(F.col("prev_strict") >= t - lookback, F.lit(False)).alias("known_before"),
    )
    at = running_at(received.unionByName(sent), queries, ["tenant_id", "node"], "at", sums=names,
                    bucket_us=bucket)
    senders = F.col("d_active") + F.when(F.col("active_before"), 0).otherwise(1)
    firsts = F.col("d_first") + F.when(F.col("known_before"), 0).otherwise(1)
    inflow, outflow = F.col("d_in").cast("double"), F.col("d_out").cast("double")
    return at.select(
        "tenant_id", "event_id",
        senders.cast("double").alias("unique_senders_24h"),
        (firsts / senders).alias("first_time_sender_ratio_24h"),
        inflow.alias("inflow_amount_1h"),
        outflow.alias("outflow_amount_1h"),
        F.least(F.lit(1.0), outflow / F.greatest(F.lit(1.0), inflow)).alias("rapid_cashout_ratio_1h"),
        flag(~F.col("known_before")).alias("current_sender_first_time"),
    )


def recipient_features(context: DataFrame) -> dict:
    """Feature expressions over events left-joined with ``recipient_context``."""
    has = F.col("unique_senders_24h").isNotNull()
    return {
        "recipient_sender_diversity_24h": clamp(F.coalesce("unique_senders_24h", F.lit(0.0)) / 12.0),
        "recipient_first_time_sender_ratio_24h": clamp(
            F.coalesce("first_time_sender_ratio_24h", F.lit(0.0))),
        "recipient_inflow_velocity_1h": clamp(
            (F.coalesce("inflow_amount_1h", F.lit(0.0)) + F.col("amount")) / 500_000.0),
        "recipient_rapid_cashout_ratio_1h": clamp(
            F.coalesce("rapid_cashout_ratio_1h", F.lit(0.0))),
        "recipient_network_coverage": flag(has),
    }
