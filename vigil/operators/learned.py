"""Point-in-time quantities that an account has learned: one sweep over its events in time order.

Medians, deviations, favourite hours and counts by value are kept as state that events enter and leave, so an event costs the
logarithm of the look-back and no event collects it.  An event of history r counts as

* a *transaction* for the times (r.ts, r.ts + look-back];
* *learned* for the part of this in which it is trusted: by default all of it, if the event is profile-eligible; with
  ``learned`` from the time that its quarantine ends until it is revoked.

Accounts are cut into slices of time two look-backs wide (``time_slices``), and a slice is one sorted stream that passes through a
task: its state holds the values of one look-back, not the rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil import config
from vigil.config import DEFAULTS, Settings
from vigil.functions.ranked import Ranked
from vigil.functions.scalars import DAY_US, HOUR_US
from vigil.operators.timeline import time_slices

KEYS = ["tenant_id", "account_id", "_slice"]
#: Quantities with median, deviation and count; the first per account, the others per channel.
RANKED = ["h_amount", "h_speed", "h_typing", "h_tilt"]
COUNTS = ["h_recipient", "h_device", "h_sim", "h_ip", "h_navigation", "h_channel", "h_input", "h_pasted", "h_txns", "h_recipient_total", "h_device_total"]
#: Output columns after tenant_id, account_id, event_id.
FIELDS = (
    [(f"{r}_{s}", t) for r in RANKED for s, t in (("median", "double"), ("mad", "double"), ("n", "long"))]
    + [(c, "long") for c in COUNTS]
    + [("h_common_hours", "array<int>"), ("h_months", "int"), ("h_nearest_day", "int"), ("h_similar_months", "int"), ("h_enrolled_24h", "boolean"),
       ("h_location", "struct<exp:bigint,at:bigint,latitude:double,longitude:double>")]
)
HOURS_KEPT = 5
DAYS_NEAR, AMOUNT_NEAR = 3, 0.20


class Tally(defaultdict):
    """Counts by value; values without a count are forgotten."""

    def __init__(self):
        super().__init__(int)

    def move(self, value, by: int) -> None:
        self[value] += by
        if not self[value]:
            del self[value]


class State:
    """What one account has learned at a point in time."""

    def __init__(self, lookback: int):
        self.lookback = lookback
        self.due: list[tuple] = []
        self.serial = 0
        self.ranked = defaultdict(Ranked)
        self.counts = Tally()
        self.hours = defaultdict(Ranked)
        self.places = Ranked()
        self.months, self.days, self.pairs = Tally(), Tally(), Tally()
        self.paid: dict = defaultdict(lambda: defaultdict(list))

    def schedule(self, at: int, move, row: dict, by: int) -> None:
        """Do ``move`` before the first event later than ``at``."""
        self.serial += 1
        heappush(self.due, (at, self.serial, move, row, by))

    def advance(self, t: int) -> None:
        while self.due and self.due[0][0] < t:
            _, _, move, row, by = heappop(self.due)
            move(row, by)

    def enter(self, row: dict) -> None:
        """Schedule when an event begins and ends to count."""
        t = row["ts_us"]
        old = t + self.lookback
        if row["txn"]:
            self.schedule(t, self.transaction, row, 1)
            self.schedule(old, self.transaction, row, -1)
        if row["auth"]:
            self.schedule(t, self.signed_in, row, 1)
            self.schedule(t + 24 * HOUR_US, self.signed_in, row, -1)
        if row["learn_us"] is not None:
            begin, end = max(t, row["learn_us"]), old if row["forget_us"] is None else min(old, row["forget_us"])
            if begin < end:
                self.schedule(begin, self.learn, row, 1)
                self.schedule(end, self.learn, row, -1)

    def signed_in(self, row: dict, by: int) -> None:
        self.pairs.move((row["channel"], row["device_id"]), by)

    def transaction(self, row: dict, by: int) -> None:
        self.months.move(row["month"], by)
        self.days.move(row["day"], by)
        if row["recipient_id"] is not None and row["amount"] > 0:
            dates = self.paid[row["recipient_id"]]
            paid = dates[row["month"], row["day"]]
            if by > 0:
                insort(paid, row["amount"])
            else:
                del paid[bisect_left(paid, row["amount"])]
                if not paid:
                    del dates[row["month"], row["day"]]
                if not dates:
                    del self.paid[row["recipient_id"]]

    def learn(self, row: dict, by: int) -> None:
        def rank(key, value):
            if value is not None:
                own = self.ranked[key]
                own.add(value) if by > 0 else own.remove(value)
                if not own:
                    del self.ranked[key]

        channel, count = row["channel"], self.counts.move
        for name, column in (("h_device", "device_id"), ("h_sim", "sim_id"), ("h_ip", "ip_prefix")):
            if row[column] is not None:
                count((name, row[column]), by)
        count(("h_channel", channel), by)
        if row["navigation_signature"] is not None:
            count(("h_navigation", channel, row["navigation_signature"]), by)
        if row["input_method"] is not None and row["input_method"] != "unknown":
            count(("h_input", channel), by)
            if row["input_method"] in ("pasted", "mixed"):
                count(("h_pasted", channel), by)
        if row["device_id"] is not None:
            count("h_device_total", by)
        rank(("h_speed", channel), row["speed"])
        rank(("h_typing", channel), row["keystroke_interval_ms"])
        rank(("h_tilt", channel), row["device_tilt_variance"])
        if row["latitude"] is not None and row["longitude"] is not None:
            place = (row["ts_us"], row["event_id"], row["latitude"], row["longitude"])
            self.places.add(place) if by > 0 else self.places.remove(place)
        if row["txn"]:
            count("h_txns", by)
            if row["recipient_id"] is not None:
                count("h_recipient_total", by)
                count(("h_recipient", row["recipient_id"]), by)
            if row["amount"] > 0:
                rank("h_amount", row["amount"])
            hour = self.hours[row["hour"]]
            hour.add(row["ts_us"]) if by > 0 else hour.remove(row["ts_us"])
            if not hour:
                del self.hours[row["hour"]]

    def similar_months(self, row: dict) -> int:
        """Months with a payment to the same recipient, of a similar amount on a near day."""
        amount, months = row["amount"], set()
        for (month, day), paid in self.paid.get(row["recipient_id"], {}).items():
            if abs(day - row["day"]) <= DAYS_NEAR and month not in months:
                at = bisect_left(paid, amount)
                if any(abs(p - amount) / max(amount, 1.0) <= AMOUNT_NEAR for p in paid[max(0, at - 1) : at + 1]):
                    months.add(month)
        return len(months)

    def enrolled(self, row: dict) -> bool:
        """Signed in within a day on another channel, which or whose device is hardly known."""
        return any(
            channel != row["channel"]
            and (self.counts.get(("h_channel", channel), 0) <= 1 or (device is not None and self.counts.get(("h_device", device), 0) <= 1))
            for channel, device in self.pairs)

    def answer(self, row: dict) -> tuple:
        channel, out = row["channel"], []
        for name in RANKED:
            own = self.ranked.get(name if name == "h_amount" else (name, channel))
            if own:
                median = own.median()
                out += [median, own.spread(median), own.size]
            else:
                out += [None, 0.0, 0]
        get = self.counts.get
        out += [get(k, 0) for k in (
            ("h_recipient", row["recipient_id"]), ("h_device", row["device_id"]), ("h_sim", row["sim_id"]), ("h_ip", row["ip_prefix"]),
            ("h_navigation", channel, row["navigation_signature"]), ("h_channel", channel), ("h_input", channel), ("h_pasted", channel),
            "h_txns", "h_recipient_total", "h_device_total")]
        hours = sorted([(-times.size, times.first(), hour) for hour, times in self.hours.items()])[:HOURS_KEPT]
        place = self.places[len(self.places) - 1] if self.places else None
        return (*out, [hour for _, _, hour in hours], len(self.months), min((abs(d - row["day"]) for d in self.days), default=None),
                self.similar_months(row), row["txn"] and self.enrolled(row),
                place and {"exp": place[0] + self.lookback, "at": place[0], "latitude": place[2], "longitude": place[3]})


def learned_history(events: DataFrame, is_trusted: Column, is_txn: Column, settings: Settings = DEFAULTS, learned: DataFrame | None = None,
                    until: int | None = None) -> DataFrame:
    """(tenant_id, account_id, event_id) with ``FIELDS`` for each event.

    ``learned`` (tenant_id, event_id, from_us, to_us) names the times from and until which an event's own profile evidence is
    trusted (to_us null: for good); events without a row are never learned from.  Without it, ``is_trusted`` decides for good.
    ``until`` is the time of the latest event, when it is known (``time_slices``).
    """
    lookback = settings.lookback_days * DAY_US
    if learned is None:
        rows = events.select("*", F.when(is_trusted, F.col("ts_us")).alias("learn_us"), F.lit(None).cast("long").alias("forget_us"))
    else:
        # Counted for the times from from_us on, and no more from to_us on.
        times = learned.select("tenant_id", "event_id", (F.col("from_us") - 1).alias("learn_us"), (F.col("to_us") - 1).alias("forget_us"))
        rows = events.join(times, ["tenant_id", "event_id"], "left").withColumn("learn_us", F.when(is_trusted, F.col("learn_us")))
    narrow = rows.select(
        "tenant_id", "account_id", "event_id", "ts_us", "learn_us", "forget_us", F.coalesce(is_txn, F.lit(False)).alias("txn"),
        F.coalesce(F.col("event_type").isin(config.AUTH_TYPES), F.lit(False)).alias("auth"),
        "channel", F.col("amount").cast("double").alias("amount"), "recipient_id", "device_id", "sim_id", "ip_prefix", "navigation_signature", "input_method",
        F.when((F.col("interaction_ms") > 0) & (F.col("menu_depth") > 0), F.col("interaction_ms") / F.col("menu_depth")).alias("speed"),
        F.col("keystroke_interval_ms").cast("double").alias("keystroke_interval_ms"), F.col("device_tilt_variance").cast("double").alias("device_tilt_variance"),
        "latitude", "longitude", F.hour("occurred_at").alias("hour"), F.dayofmonth("occurred_at").alias("day"),
        (F.year("occurred_at") * 12 + F.month("occurred_at")).alias("month"),
    )
    sliced = time_slices(narrow, "ts_us", lookback, until).repartition(*KEYS).sortWithinPartitions(*KEYS, "ts_us", "event_id")
    names = sliced.columns
    schema = ", ".join(["tenant_id string", "account_id string", "event_id string", *(f"{c} {t}" for c, t in FIELDS)])
    kinds = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    place = pa.struct([("exp", pa.int64()), ("at", pa.int64()), ("latitude", pa.float64()), ("longitude", pa.float64())])
    types = [pa.string()] * 3 + [kinds.get(t, place) for _, t in FIELDS]
    columns = ["tenant_id", "account_id", "event_id", *(c for c, _ in FIELDS)]

    def sweep(batches):
        own, state, waiting = None, None, []
        for batch in batches:
            out = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                row = dict(zip(names, values))
                key = (row["tenant_id"], row["account_id"], row["_slice"])
                if key != own:
                    own, state, waiting = key, State(lookback), []
                if not row["_home"]:
                    # Seen by later rows alone: it enters when one of them asks, if the slice has one.
                    waiting.append(row)
                    continue
                for earlier in waiting:
                    state.enter(earlier)
                waiting.clear()
                state.advance(row["ts_us"])
                out.append((row["tenant_id"], row["account_id"], row["event_id"], *state.answer(row)))
                state.enter(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=columns)

    return sliced.mapInArrow(sweep, schema)
