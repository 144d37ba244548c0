"""The state of a keyed change log at event time, by interval joins.

A change log (keys, time, values) says what holds for a key from a time on, so its rows are intervals [from, to).  The
intervals of a key hang in a tree whose nodes have at most ``FAN`` children; a node spans its children.  A lookup goes down by
one equi-join on (keys, node) a level, with the interval as the condition: an event meets at most ``FAN`` rows a level, however
many changes a key has and however they crowd in time, and the depth is the logarithm of the fullest key's changes.

Only the change log is ever ordered.  Events pass through joins alone, which the optimizer turns into broadcasts where a level
is small (each upper level has a ``FAN``-th of the rows below it) and which the adaptive skew join splits where it is not and
one key holds a large share of the events.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.storage import cut
from vigil.operators.timeline import positions

#: Children of a node: the most rows that one event is compared with on a level.
FAN = 64


def _level(rows: DataFrame, keys: list[str], payload: list[str], fan: int) -> DataFrame:
    """Rows (keys, _i, _from, payload) with their parent ``_node`` and the end of their interval among its children.

    The last child of a node is open: the node's own interval ends it.
    """
    siblings = Window.partitionBy(*keys, "_node").orderBy("_i")
    return (
        rows.withColumn("_node", F.floor(F.col("_i") / fan).cast("long"))
        .withColumn("_to", F.lead("_from").over(siblings))
        .select(*keys, "_node", "_i", "_from", "_to", *payload)
    )


def interval_tree(changes: DataFrame, keys: list[str], at: str, values: list[str], fan: int = FAN) -> list[DataFrame]:
    """Levels of intervals from the root to the leaves; ``changes`` has one row for each (keys, at).

    Rows without a key or time hold for nobody and are left out.  The leaves alone carry ``values``.
    """
    known = changes.select(*keys, at, *values).dropna(subset=[*keys, at])
    placed = cut(positions(known, keys, at, []), "changes")
    fullest = placed.agg(F.max("total")).first()[0] or 0
    leaves = placed.select(*keys, (F.col("position") - 1).alias("_i"), F.col(at).alias("_from"), *values)
    levels = [cut(_level(leaves, keys, values, fan), "leaves")]
    while fullest > fan:
        fullest = -(-fullest // fan)
        nodes = levels[0].groupBy(*keys, F.col("_node").alias("_i")).agg(F.min("_from").alias("_from"))
        levels.insert(0, cut(_level(nodes, keys, [], fan), "nodes"))
    return levels


def as_of(
    queries: DataFrame, changes: DataFrame, keys: list[str], at: str, values: list[str], fan: int = FAN
) -> DataFrame:
    """Every query row with the ``values`` of its key's latest change at or before its time; null where there is none.

    Both inputs have ``keys`` and the long column ``at``.  Repeated queries stay apart; queries without a key or time find
    nothing.
    """
    found = queries.withColumn("_at_node", F.lit(0).cast("long"))
    levels = interval_tree(changes, keys, at, values, fan)
    for depth, level in enumerate(levels):
        last = depth == len(levels) - 1
        named = level.select(
            *[F.col(c).alias(f"_k_{c}") for c in keys], "_node", "_i", "_from", "_to",
            *([F.col(v).alias(f"_v_{v}") for v in values] if last else []),
        )
        same = [F.col(c) == F.col(f"_k_{c}") for c in keys] + [F.col("_at_node") == F.col("_node")]
        inside = (F.col(at) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(at) < F.col("_to")))
        found = found.join(named, reduce(and_, same) & inside, "left")
        if last:
            return found.select(*queries.columns, *[F.col(f"_v_{v}").alias(v) for v in values])
        found = found.select(*queries.columns, F.col("_i").alias("_at_node"))
