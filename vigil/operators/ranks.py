"""Rows at exact ranks of large groups, without sorting the groups.

A histogram between the smallest and the largest value tells which bucket holds a rank; the bucket takes the place of the group,
until it has at most ``most`` rows or one value only.  Only the rows of such buckets are sorted, so a task never holds a group.
Where all groups are small from the start, they are sorted at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.storage import cut, small

#: Rows that one task may sort, and groups whose bounds are broadcast.
MOST = 100_000
GROUPS = 100_000


def rows_at(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], tie: str | None = None, most: int = MOST) -> DataFrame:
    """keys, name, total, value and (with ``tie``) tie of the row at each named rank of each group.

    ``ranks`` gives the place from 0, in order of (value, tie), from the column of the group's size; places outside the group have no
    row.  Null values do not count.  ``rows`` is read once a round, so its columns are stored first.
    """
    columns = [*keys, value, *([tie] if tie else [])]
    # Doubles only choose buckets; bounds and order are the values' own.
    held = cut(rows.where(F.col(value).isNotNull()).select(*columns), "ranked")
    key = [F.col(k) for k in keys]

    def named(n: Column) -> Column:
        return F.array(*[F.struct(F.lit(name).alias("name"), at(n).cast("long").alias("rank")) for name, at in ranks.items()])

    if (held.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= most:
        own = Window.partitionBy(*key) if keys else Window.partitionBy(F.lit(0))
        placed = held.select("*", (F.row_number().over(own.orderBy(value, *([tie] if tie else []))).cast("long") - 1).alias("_place"), F.count(F.lit(1)).over(own).alias("total"))
        hit = F.filter(named(F.col("total")), lambda x: x["rank"] == F.col("_place"))
        return placed.select(*columns, "total", F.inline(hit)).select(*keys, "name", "total", value, *([tie] if tie else []))
    whole = held.groupBy(*key).agg(F.count(F.lit(1)).alias("total"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    open_ = whole.select(*keys, "total", "lo", "hi", F.col("total").alias("n"), F.inline(named(F.col("total")))).where("rank >= 0 and rank < total")
    open_ = cut(open_, "ranks")
    while True:
        wide = open_.where((F.col("n") > most) & (F.col("lo") < F.col("hi")))
        cells, _ = small(cut(wide.select(*keys, "lo", "hi", "n").distinct(), "cells"), GROUPS)
        if not cells.limit(1).count():
            break
        parts = F.least(F.lit(65_536), F.ceil(4 * F.col("n") / most)).cast("double")
        low, high, own = F.col("lo").cast("double"), F.col("hi").cast("double"), F.col(value).cast("double")
        bucket = F.least(parts - 1, F.floor((own - low) / (high - low) * parts)).cast("long")
        inside = _joined(held, cells, keys).where((F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi")))
        counted = inside.groupBy(*keys, "lo", "hi", bucket.alias("bucket")).agg(
            F.count(F.lit(1)).alias("c"), F.min(value).alias("new_lo"), F.max(value).alias("new_hi"))
        before = Window.partitionBy(*keys, "lo", "hi").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
        found = wide.join(counted, [*keys, "lo", "hi"]).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("c")))
        done = open_.where((F.col("n") <= most) | (F.col("lo") == F.col("hi")))
        open_ = cut(done.select(*keys, "total", "lo", "hi", "n", "name", "rank").unionByName(found.select(
            *keys, "total", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), F.col("c").alias("n"), "name", (F.col("rank") - F.col("before")).alias("rank"))), "ranks")
    # Where a bucket holds one value and no tie has to be broken, the bound is the answer.
    plain = F.lit(tie is None) & (F.col("lo") == F.col("hi"))
    cells, _ = small(cut(open_.where(~plain).select(*keys, "lo", "hi").distinct(), "cells"), GROUPS)
    order = Window.partitionBy(*keys, "lo", "hi").orderBy(value, *([tie] if tie else []))
    placed = _joined(held, cells, keys).where((F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi"))).withColumn("rank", F.row_number().over(order).cast("long") - 1)
    answers = open_.where(~plain).join(placed, [*keys, "lo", "hi", "rank"]).select(*keys, "name", "total", value, *([tie] if tie else []))
    if tie is not None:
        return answers
    return answers.unionByName(open_.where(plain).select(*keys, "name", "total", F.col("lo").alias(value)))


def _joined(rows: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    if keys:
        return rows.join(cells, keys)
    one = F.lit(0).alias("_one")
    return rows.select("*", one).join(F.broadcast(cells.select("*", one)), "_one").drop("_one")


def medians(rows: DataFrame, keys: list[str], value: str, most: int = MOST) -> DataFrame:
    """keys, median (mean of the two middle values), mad (median distance from it) and samples of each group."""
    held = cut(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("value")), "values")
    middles = {"a": lambda n: F.floor((n - 1) / 2), "b": lambda n: F.floor(n / 2)}

    def middle(values: DataFrame, name: str) -> DataFrame:
        return rows_at(values, keys, "value", middles, most=most).groupBy(*keys).agg(
            (F.sum(F.when(F.col("name") == "a", F.col("value"))) + F.sum(F.when(F.col("name") == "b", F.col("value")))).alias("both"),
            F.max("total").alias("samples")).select(*keys, (F.col("both") / 2).alias(name), "samples")

    centre = cut(middle(held, "median"), "medians")
    near, _ = small(centre, GROUPS)
    far = held.join(near, keys).select(*keys, F.abs(F.col("value") - F.col("median")).alias("value"))
    return centre.join(middle(far, "mad").drop("samples"), keys)
