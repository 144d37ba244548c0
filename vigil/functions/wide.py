"""Wide rows that pass through many projections: columns that none of them reads travel as one value."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def names_in(*texts: str) -> set[str]:
    """Every name that rule texts could read as a column."""
    return set(re.findall(r"[a-z_]\w*", " ".join(texts)))


def packed(df: DataFrame, read: Iterable[str], name: str = "_rest") -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``df`` with the columns outside ``read`` in one struct, and the function that lays them out again.

    A projection writes every column of a row anew, so a column of a row of 200 costs its copy in each step that does not need it;
    a struct is copied as one run of bytes.  The columns come back in their places, behind those of ``first`` (the keys of a join, as
    it moves them), new ones after them.  A step that reads a column which is not in ``read`` is refused by Spark's analysis.
    With fewer than two columns outside, ``df`` stays as it is.
    """
    read, columns = set(read), df.columns
    rest = [c for c in columns if c not in read]
    if len(rest) < 2 or len(set(columns)) < len(columns):
        return df, lambda done, first=(): done.select(*first, *(c for c in done.columns if c not in first)) if first else done
    kept = [c for c in columns if c in read]

    def whole(done: DataFrame, first: Sequence[str] = ()) -> DataFrame:
        order = [*first, *(c for c in columns if c not in first and (c not in read or c in done.columns))]
        new = [c for c in done.columns if c not in columns and c != name]
        return done.select(*[F.col(c) if c in read else F.col(name)[c].alias(c) for c in order], *new)

    return df.select(*kept, F.struct(*rest).alias(name)), whole
