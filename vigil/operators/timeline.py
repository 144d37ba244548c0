"""Keyed timelines that stay parallel when one key holds a large share of all rows.

Three building blocks replace plain per-key windows over unbounded groups:

* ``running_at``  - running sums and maxima at query times, in two levels: totals per
  (key, time bucket), a short scan over the buckets of a key, then a window inside one bucket.
  No task ever sees more than one bucket of one key.
* ``neighbours`` / ``positions`` - previous / next time and exact row position, same two levels.
* ``time_slices`` - cuts every timeline into slices of time that overlap by one look-back.

A look-back window [t-L, t) becomes interval deltas: a row at s counts for queries in (s, s+L], so it
adds at s+1us and is taken back at s+L+1us.  Distinct counts are deltas of merged intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.scalars import HOUR_US
from vigil.functions.storage import cut

UNB = Window.unboundedPreceding


def _bucket(at: str, width: int) -> Column:
    return F.floor(F.col(at) / F.lit(width)).cast("long")


def running_at(
    data: DataFrame,
    queries: DataFrame,
    keys: list[str],
    at: str,
    sums: list[str] | None = None,
    maxs: list[str] | None = None,
    bucket_us: int = HOUR_US,
) -> DataFrame:
    """Every query row with the sum / maximum of the data rows of its key up to its time.

    Both inputs have ``keys`` and the long column ``at``; a data row counts for queries with
    ``query.at >= data.at``.  Absent sums are 0, absent maxima null.
    """
    sums, maxs = sums or [], maxs or []
    values = sums + maxs
    payload = [c for c in queries.columns if c not in keys and c != at]
    types = dict(data.dtypes)
    asked = queries.select(
        *keys, at, *[F.lit(None).cast(types[c]).alias(c) for c in values],
        F.struct(F.lit(True).alias("_is_query"), *payload).alias("_q"),
    )
    rows = data.select(*keys, at, *values).unionByName(asked, allowMissingColumns=True)
    # Stored once as a narrow table: totals and rows both read it, and nothing upstream is computed twice.
    rows = cut(rows.withColumn("_b", _bucket(at, bucket_us)), "deltas")

    totals = rows.groupBy(*keys, "_b").agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxs]
    )
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(UNB, -1)
    carry = totals.select(
        *keys, "_b",
        *[F.sum(c).over(earlier).alias(f"_c_{c}") for c in sums],
        *[F.max(c).over(earlier).alias(f"_c_{c}") for c in maxs],
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(at).rangeBetween(UNB, 0)
    done = rows.join(carry, [*keys, "_b"]).select(
        *keys, at, "_q",
        *[
            (F.coalesce(F.col(f"_c_{c}"), F.lit(0)) + F.coalesce(F.sum(c).over(inside), F.lit(0)))
            .alias(c)
            for c in sums
        ],
        *[F.greatest(F.col(f"_c_{c}"), F.max(c).over(inside)).alias(c) for c in maxs],
    )
    return done.filter("_q._is_query").select(
        *keys, at, *[F.col(f"_q.{c}").alias(c) for c in payload], *values
    )


def neighbours(
    df: DataFrame, keys: list[str], at: str, tie: str, is_data: Column, bucket_us: int = HOUR_US
) -> DataFrame:
    """Adds the neighbouring data times of each row: ``prev_strict`` (strictly earlier),
    ``prev_at`` and ``next_at`` (in (at, tie) order)."""
    rows = df.withColumn("_b", _bucket(at, bucket_us)).withColumn(
        "_d", F.when(is_data, F.col(at))
    )
    edges = rows.groupBy(*keys, "_b").agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    up = Window.partitionBy(*keys).orderBy("_b").rowsBetween(UNB, -1)
    down = Window.partitionBy(*keys).orderBy(F.col("_b").desc()).rowsBetween(UNB, -1)
    edges = edges.select(
        *keys, "_b", F.max("_hi").over(up).alias("_before"), F.min("_lo").over(down).alias("_after")
    )
    part = Window.partitionBy(*keys, "_b")
    asc = part.orderBy(at, tie)
    strict = part.orderBy(at).rangeBetween(UNB, -1)
    desc = part.orderBy(F.col(at).desc(), F.col(tie).desc()).rowsBetween(UNB, -1)
    return (
        rows.join(edges, [*keys, "_b"])
        .withColumn("prev_strict", F.coalesce(F.max("_d").over(strict), F.col("_before")))
        .withColumn("prev_at", F.coalesce(F.max("_d").over(asc.rowsBetween(UNB, -1)), F.col("_before")))
        .withColumn("next_at", F.coalesce(F.min("_d").over(desc), F.col("_after")))
        .drop("_b", "_d", "_before", "_after")
    )


def positions(
    df: DataFrame, keys: list[str], at: str, tie: list[str], bucket_us: int = 24 * HOUR_US
) -> DataFrame:
    """Adds the exact 1-based ``position`` of each row in (at, tie) order and the key's ``total``."""
    rows = df.withColumn("_b", _bucket(at, bucket_us))
    counts = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(1))
    counts = counts.select(
        *keys, "_b",
        F.coalesce(F.sum("_n").over(by_key.orderBy("_b").rowsBetween(UNB, -1)), F.lit(0))
        .alias("_before"),
        F.sum("_n").over(by_key).alias("total"),
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(at, *tie)
    return (
        rows.join(counts, [*keys, "_b"])
        .withColumn("position", F.col("_before") + F.row_number().over(inside))
        .drop("_b", "_before")
    )


def time_slices(df: DataFrame, at: str, lookback_us: int, until: int | None = None) -> DataFrame:
    """Adds ``_slice`` and ``_home``: every row's slice of time, and a copy in the next slice that still sees it.

    Slices are two look-backs wide.  A row at s serves the times (s, s + look-back], so the home rows of a slice
    find all rows that they may look back to in it, whatever the size of the key; no key is counted first.
    With ``until``, the latest time of all rows, none is copied into a slice that begins later and so has no home rows.
    """
    width = F.lit(2 * lookback_us)
    own = F.floor(F.col(at) / width).cast("long")
    end = F.col(at) + F.lit(lookback_us)
    if until is not None:
        end = F.when(end > F.lit(until), F.lit(until)).otherwise(end)
    last = F.floor(end / width).cast("long")
    return (
        df.withColumn("_own", own)
        .withColumn("_slice", F.explode(F.array_distinct(F.array(own, last))))
        .withColumn("_home", F.col("_slice") == F.col("_own"))
        .drop("_own")
    )


def interval_deltas(adds: list[tuple[Column, dict[str, Column]]], values: list[str], types: dict[str, str]) -> Column:
    """Array of (at, value...) structs for explode; unnamed values are 0, null times are dropped."""
    rows = [
        F.struct(
            at.cast("long").alias("at"),
            *[part.get(v, F.lit(0)).cast(types[v]).alias(v) for v in values],
        )
        for at, part in adds
    ]
    return F.filter(F.array(*rows), lambda r: r["at"].isNotNull())
