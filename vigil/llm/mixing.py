"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, target / size of the source.  The running sum of expected
copies plus one offset of the source crosses integers; a document is taken once for each integer that its own step
crosses.  Documents stand in order of size, so the words taken stay close to the target.  Ranks come from
three levels of counts (source and size, hash bucket, row), so a source with a third of all rows is never in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.storage import cut, small

#: Hex digits of the hash that name a bucket.
BUCKET_DIGITS = 3
SOURCE_ROWS = 200_000


def word_count(text: str) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")


def _offset(key: Column, seed: int) -> Column:
    """The one offset of a source in [0, 1)."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """key, source_size, target, rate, offset of each row of ``sizes`` (key, source_size).

    Sources in the order of their keys weigh ``weights``, repeating, and share the total.  A target stops at
    ``most`` times the source's size; what is over is shared again by weight, which settles at
    least(cap, level * weight) for one level.  Sources are few, so one task orders them.
    """
    ranked = sizes.withColumn("i", F.row_number().over(Window.orderBy("key")) - 1)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("i") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * most).withColumn("full_at", F.col("cap") / F.col("w"))
    by = Window.orderBy("full_at", "i")
    levels = capped.select(
        "*", F.row_number().over(by).alias("k"),
        ((F.sum("source_size").over(Window.partitionBy()) - F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, 0)) + F.col("cap"))
         / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))).alias("level"))
    chosen = levels.agg(F.min_by("level", F.when(F.col("level") <= F.col("full_at"), F.col("k"))).alias("level"))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("w"))
    out = capped.crossJoin(F.broadcast(chosen)).select("key", "source_size", target.alias("target"))  # one row
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return out.select("key", "source_size", "target", rate.alias("rate"), _offset(F.col("key"), seed).alias("offset"))


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None,
        weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """Columns ``keep`` (default: the id) of every document, with __size, __source_size, __target and __copies (long).

    Sizes count words `[^\\x20\\x09-\\x0D]+`; null is empty.  A null source is a source of its own, the last.  A source
    without words has the target 0.  Rows that repeat an id are documents of their own; of rows alike in source,
    size and id any may be the one taken.  The same rows and seed give the same mix again.
    """
    keep = [id] if keep is None else keep
    hashed = F.coalesce(F.md5(F.col(id).cast("string")), F.lit(""))
    rows = cut(docs.select(
        *keep, F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source))).alias("__key"),
        word_count(text).alias("__size"), hashed.alias("__hash"), F.substring(hashed, 1, BUCKET_DIGITS).alias("__bucket")), "sized")

    cells = cut(rows.groupBy("__key", "__size", "__bucket").agg(F.count(F.lit(1)).alias("n")), "cells")
    by_size = cells.groupBy("__key", "__size").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("__key").orderBy("__size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.select("__key", "__size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("sizes_before"))
    inside = Window.partitionBy("__key", "__size").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("__key", "__size", "__bucket", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("cells_before"))
    ranks = cells.join(by_size, ["__key", "__size"]).select("__key", "__size", "__bucket", (F.col("sizes_before") + F.col("cells_before")).alias("before"))

    shares = targets(rows.groupBy(F.col("__key").alias("key")).agg(F.sum("__size").alias("source_size")), weights, most, seed)
    shares, _ = small(cut(shares.withColumnRenamed("key", "__key"), "targets"), SOURCE_ROWS)

    order = Window.partitionBy("__key", "__size", "__bucket").orderBy(F.col("__hash"), F.col(id))
    ranked = rows.withColumn("__row", F.row_number().over(order)).join(ranks, ["__key", "__size", "__bucket"]).join(shares, "__key")
    rank = (F.col("before") + F.col("__row")).cast("double")
    copies = (F.floor(F.col("rate") * rank + F.col("offset")) - F.floor(F.col("rate") * (rank - 1) + F.col("offset"))).cast("long")
    return ranked.select(*keep, "__size", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), copies.alias("__copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The rows of a mix as often as they are taken, without its own columns."""
    rows = mixed.where(F.col("__copies") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return rows.drop("__size", "__source_size", "__target", "__copies", "__copy")


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                        F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY key) - 1 AS i FROM d GROUP BY key),
c AS (SELECT *, 1 + i % 3 AS w, source_size * 3 AS cap, (source_size * 3) / (1 + i % 3) AS full_at FROM s),
l AS (
  SELECT *, row_number() OVER (ORDER BY full_at, i) AS k,
    CAST(sum(source_size) OVER () - sum(cap) OVER (ORDER BY full_at, i ROWS UNBOUNDED PRECEDING) + cap AS BIGINT)
      / CAST(sum(w) OVER (ORDER BY full_at, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
  FROM c),
v AS (SELECT coalesce(min_by(level, k), 0.0) AS level FROM l WHERE level <= full_at),
t AS (
  SELECT key, source_size, least(CAST(cap AS DOUBLE), v.level * w) AS target,
    CAST(('0x' || substr(sha256('0:' || key), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM c, v),
r AS (
  SELECT d.*, t.source_size, t.target, u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(row_number() OVER (PARTITION BY key ORDER BY size, coalesce(md5(CAST(doc_id AS VARCHAR)), ''), doc_id) AS DOUBLE) AS n
  FROM d JOIN t USING (key))
SELECT doc_id, size, source_size, target,
  CAST(floor(rate * n + u) - floor(rate * (n - 1) + u) AS BIGINT) * size AS taken
FROM r
"""
