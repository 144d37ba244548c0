"""Agent-terminal features: cross-customer aggregates of attested agent-channel events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import config
from vigil.config import DEFAULTS, Settings
from vigil.functions.scalars import DAY_US, HOUR_US, clamp, flag, haversine_km
from vigil.functions.storage import cut
from vigil.operators.network import MONEY
from vigil.operators.timeline import interval_deltas, neighbours, running_at

VALUES = {"d_customers": "bigint", "d_events": "bigint", "d_failed": "bigint", "d_value": MONEY,
          "d_txns": "bigint"}


def attested(events: DataFrame) -> DataFrame:
    """Attested agent-channel events with their terminal token."""
    assurance = F.col("agent_assurance")
    return events.filter(
        (F.col("channel") == "agent") & F.coalesce(assurance["gateway_attested"], F.lit(False))
    ).select("*", assurance["terminal_token"].alias("terminal"))


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Largest per-recipient count at each query, streaming over rows sorted by group and time.

    Rows are changes of a recipient's count, and queries.  ``size_of[c]`` is the number of recipients
    whose count is c, so the maximum is kept in O(1) per row; only the current group's counts are held.
    """
    group, counts, size_of, top = None, {}, {}, 0
    for batch in batches:
        result = np.zeros(len(batch), dtype="int64")
        keys = zip(batch["tenant_id"], batch["terminal"], batch["bucket"])
        rows = zip(keys, batch["recipient_id"], batch["change"], batch["is_query"], batch["own"])
        for place, (key, recipient, change, is_query, own) in enumerate(rows):
            if key != group:
                group, counts, size_of, top = key, {}, {}, 0
            if is_query:
                result[place] = max(top, counts.get(recipient, 0) + 1) if own else top
                continue
            old = counts.get(recipient, 0)
            new = old + int(change)
            counts[recipient] = new
            size_of[old] = size_of.get(old, 0) - 1
            size_of[new] = size_of.get(new, 0) + 1
            top = max(top, new)
            while top > 0 and size_of.get(top, 0) <= 0:
                top -= 1
        out = batch[["tenant_id", "event_id"]].assign(top_recipient_24h=result)
        yield out[batch["is_query"].to_numpy()]


def top_recipient_counts(agent_events: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(tenant_id, event_id, top_recipient_24h): largest recipient count of the last 24 h, with the
    current transaction included.

    The maximum over recipients is not a sum, so each (terminal, bucket) is swept on its own: it gets
    the changes inside the bucket and one row per recipient with the count carried in.  A group holds
    two bucket widths of rows of one terminal, whatever the terminal's total.
    """
    width = settings.terminal_bucket_hours * HOUR_US
    keys = ["tenant_id", "terminal"]
    day = 24 * HOUR_US
    rows = agent_events.select(
        *keys, "event_id", "recipient_id", F.col("ts_us").alias("at"), _paid().alias("own")
    ).withColumn("bucket", _bucket(F.col("at"), width))
    paid = rows.filter("own").select(
        *keys, "recipient_id", (F.col("at") + 1).alias("start"), (F.col("at") + day + 1).alias("stop")
    )
    changes = paid.select(
        *keys, "recipient_id",
        F.inline(F.array(
            F.struct(F.col("start").alias("at"), F.lit(1).cast("long").alias("change")),
            F.struct(F.col("stop").alias("at"), F.lit(-1).cast("long").alias("change")),
        )),
    ).withColumn("bucket", _bucket(F.col("at"), width))
    # A payment is open at the start of every bucket after the one it starts in, up to the one it
    # stops in.  Counted per recipient before it is spread over those few buckets.
    carried = (
        paid.groupBy(*keys, "recipient_id", _bucket(F.col("start"), width).alias("first"),
                     _bucket(F.col("stop"), width).alias("last"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("last") > F.col("first"))
        .withColumn("bucket", F.explode(F.sequence(F.col("first") + 1, F.col("last"))))
        .groupBy(*keys, "recipient_id", "bucket")
        .agg(F.sum("n").alias("change"))
        .withColumn("at", F.col("bucket") * width - 1)
    )
    asked = rows.select(*keys, "bucket").distinct()
    moves = (
        changes.unionByName(carried.select(*changes.columns))
        .join(asked, [*keys, "bucket"], "left_semi")
        .select(*keys, "bucket", "at", "recipient_id", "change",
                F.lit(None).cast("string").alias("event_id"), F.lit(False).alias("is_query"),
                F.lit(False).alias("own"))
    )
    queries = rows.select(
        *keys, "bucket", "at", "recipient_id", F.lit(0).cast("long").alias("change"), "event_id",
        F.lit(True).alias("is_query"), "own",
    )
    return (
        moves.unionByName(queries)
        .repartition(*keys, "bucket")
        .sortWithinPartitions(*keys, "bucket", "at", "is_query")
        .mapInPandas(_sweep, "tenant_id string, event_id string, top_recipient_24h long")
    )


def _bucket(at, width: int):
    return F.floor(at / F.lit(width)).cast("long")


def _paid():
    return F.col("event_type").isin(config.TRANSACTION_TYPES) & F.col("recipient_id").isNotNull()


def terminal_context(events: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(tenant_id, event_id) and the terminal aggregates of attested agent events."""
    agent = cut(attested(events).select(
        "tenant_id", "terminal", "account_id", "event_id", "ts_us", "event_type", "recipient_id", "amount"), "agent")
    bucket = settings.bucket_hours * HOUR_US
    hour, day = F.lit(HOUR_US), F.lit(24 * HOUR_US)
    near = cut(neighbours(
        agent, ["tenant_id", "terminal", "account_id"], "ts_us", "event_id", F.lit(True), bucket,
    ), "near")
    t, prev, nxt = F.col("ts_us"), F.col("prev_at"), F.col("next_at")
    one, failed = F.lit(1), (F.col("event_type") == "failed_login").cast("long")
    txn = F.col("event_type").isin(config.TRANSACTION_TYPES)
    value = F.when(txn, F.col("amount")).otherwise(0.0).cast(MONEY)
    paid = _paid().cast("long")
    names = list(VALUES)
    deltas = near.select(
        "tenant_id", "terminal",
        F.inline(interval_deltas(
            [
                (t + 1, {"d_customers": F.when(prev >= t - hour, 0).otherwise(1), "d_events": one,
                         "d_failed": failed, "d_value": value, "d_txns": paid}),
                (t + hour + 1, {
                    "d_customers": F.when(nxt.isNull() | (nxt > t + hour), -1).otherwise(0),
                    "d_events": -one, "d_failed": -failed, "d_value": -value}),
                (t + day + 1, {"d_txns": -paid}),
            ], names, VALUES,
        )),
    )
    queries = near.select(
        "tenant_id", "terminal", F.col("ts_us").alias("at"), "event_id", failed.alias("failed"),
        value.alias("value"), paid.alias("paid"),
        F.coalesce(F.col("prev_strict") >= t - hour, F.lit(False)).alias("active_before"),
    )
    at = running_at(deltas, queries, ["tenant_id", "terminal"], "at", sums=names, bucket_us=bucket)

    # The current (account, recipient) pair is first-time when the tenant's last seven days hold no
    # earlier transaction of it.
    pairs = neighbours(
        events.filter(_paid()).select("tenant_id", "account_id", "recipient_id", "event_id", "ts_us"),
        ["tenant_id", "account_id", "recipient_id"], "ts_us", "event_id", F.lit(True), bucket,
    ).select(
        "tenant_id", "event_id",
        (~F.coalesce(F.col("prev_strict") >= t - settings.network_lookback_days * DAY_US,
                     F.lit(False))).alias("pair_is_new"),
    )
    top = top_recipient_counts(agent, settings)
    joined = at.join(top, ["tenant_id", "event_id"]).join(pairs, ["tenant_id", "event_id"], "left")
    events_1h = F.col("d_events") + 1
    txns = F.greatest(F.lit(1), F.col("d_txns") + F.col("paid"))
    return joined.select(
        "tenant_id", "event_id",
        (F.col("d_customers") + F.when(F.col("active_before"), 0).otherwise(1)).cast("double")
        .alias("customer_diversity_1h"),
        (F.col("top_recipient_24h") / txns).alias("recipient_concentration_24h"),
        (flag(F.col("pair_is_new")) / txns).alias("first_time_recipient_ratio_24h"),
        ((F.col("d_failed") + F.col("failed")) / events_1h).alias("failed_auth_ratio_1h"),
        (F.col("d_value") + F.col("value")).cast("double").alias("value_velocity_1h"),
    )


def terminal_features() -> dict:
    """Feature expressions over events left-joined with ``terminal_context``."""
    a = F.col("agent_assurance")
    on = (F.col("channel") == "agent") & F.coalesce(a["gateway_attested"], F.lit(False))

    def ctx(name):
        return F.coalesce(F.col(name), F.lit(0.0))

    distance = haversine_km(
        a["registered_latitude"], a["registered_longitude"], F.col("latitude"), F.col("longitude"))
    hour, start, end = F.hour("occurred_at"), a["shift_start_hour"], a["shift_end_hour"]
    inside = F.when(start < end, (start <= hour) & (hour < end)).otherwise(
        (hour >= start) | (hour < end))
    optional = ["registered_latitude", "registered_longitude", "shift_start_hour", "shift_end_hour",
                "terminal_age_days"]
    given = sum((a[n].isNotNull().cast("int") for n in optional), F.lit(3))
    zero = F.lit(0.0)
    return {
        "agent_customer_diversity_1h": clamp(ctx("customer_diversity_1h") / 12.0),
        "agent_recipient_concentration_24h": clamp(ctx("recipient_concentration_24h")),
        "agent_first_time_recipient_ratio_24h": clamp(ctx("first_time_recipient_ratio_24h")),
        "agent_failed_auth_ratio_1h": clamp(ctx("failed_auth_ratio_1h")),
        "agent_value_velocity_1h": clamp(ctx("value_velocity_1h") / 1_000_000.0),
        "agent_location_mismatch": F.when(
            on & distance.isNotNull(), clamp((distance - 10.0) / 90.0)).otherwise(zero),
        "agent_after_hours": flag(on & start.isNotNull() & end.isNotNull() & ~inside),
        "agent_terminal_novelty": F.when(
            on & a["terminal_age_days"].isNotNull(), clamp(1.0 - a["terminal_age_days"] / 30.0)
        ).otherwise(zero),
        "agent_evidence_coverage": F.when(on, given / 8.0).otherwise(zero),
    }
