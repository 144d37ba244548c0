"""Structured Streaming forms of the point-in-time operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil import config
from vigil.functions.scalars import HOUR_US

VELOCITY_OUT = (
    "tenant_id string, account_id string, event_id string, ts_us long, txn_5m long, txn_1h long,"
    " failed_24h long"
)
VELOCITY_STATE = "times array<long>, kinds array<int>"
DAY = 24 * HOUR_US


def deduplicated(events: DataFrame, delay: str = "15 minutes") -> DataFrame:
    """Each event id once, with state bounded by the watermark."""
    return events.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(
        ["tenant_id", "event_id"])


def velocity_counts(events: DataFrame, delay: str = "15 minutes") -> DataFrame:
    """Transactions, failed logins and value per account in sliding hours."""
    txn = F.col("event_type").isin(config.TRANSACTION_TYPES)
    return (
        events.withWatermark("occurred_at", delay)
        .groupBy("tenant_id", "account_id", F.window("occurred_at", "1 hour", "15 minutes"))
        .agg(F.count_if(txn).alias("txns"),
             F.count_if(F.col("event_type") == "failed_login").alias("failed_logins"),
             F.sum(F.when(txn, F.col("amount")).otherwise(0.0)).alias("value"))
        .select("tenant_id", "account_id", F.col("window.start").alias("window_start"), "txns",
                "failed_logins", "value")
    )


def _velocity(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Exact trailing counts; the state keeps the last day of relevant times of one account."""
    old_times, old_kinds = state.get if state.exists else ([], [])
    rows = pd.concat(list(frames)).sort_values(["ts_us", "event_id"])
    now = rows["ts_us"].to_numpy("int64")
    times = np.concatenate([np.array(old_times, dtype="int64"), now])
    kinds = np.concatenate([np.array(old_kinds, dtype="int64"), rows["kind"].to_numpy("int64")])

    def within(kind: int, window: int) -> np.ndarray:
        at = np.sort(times[kinds == kind])
        return np.searchsorted(at, now) - np.searchsorted(at, now - window)

    keep = (kinds > 0) & (times >= times.max() - DAY)
    state.update((times[keep].tolist(), kinds[keep].tolist()))
    yield pd.DataFrame({
        "tenant_id": key[0], "account_id": key[1], "event_id": rows["event_id"].to_numpy(), "ts_us": now,
        "txn_5m": within(1, HOUR_US // 12), "txn_1h": within(1, HOUR_US), "failed_24h": within(2, DAY),
    })


def velocity_features(events: DataFrame) -> DataFrame:
    """Exact per-event velocity with keyed state; equals the batch features for in-order input."""
    kind = F.when(F.col("event_type").isin(config.TRANSACTION_TYPES), 1).when(
        F.col("event_type") == "failed_login", 2).otherwise(0)
    narrow = events.select("tenant_id", "account_id", "event_id", "ts_us", kind.alias("kind"))
    return narrow.groupBy("tenant_id", "account_id").applyInPandasWithState(
        _velocity, VELOCITY_OUT, VELOCITY_STATE, "append", "NoTimeout")


def score_batches(
    stream: DataFrame, history: Callable[[], DataFrame], score: Callable[[DataFrame], DataFrame],
    sink: Callable[[DataFrame], None], checkpoint: str,
):
    """Score each micro-batch with the batch expressions over stored history plus the batch.

    ``score`` gets history and new events together, so a live decision equals the batch one; only new
    events are written.
    """

    def run(batch: DataFrame, _: int) -> None:
        # The caller's ``history`` should prune to the look-back of the batch.
        past = history().join(batch.select("tenant_id", "event_id"), ["tenant_id", "event_id"], "left_anti")
        decided = score(past.unionByName(batch))
        sink(decided.join(batch.select("tenant_id", "event_id"), ["tenant_id", "event_id"], "left_semi"))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
