"""Stored intermediates in the cluster's shared folder, and shipping of the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one machine, may get a folder of its own; a cluster
    without the setting is refused, as its executors would write where nobody else can read.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(context, "_vigil_folder", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        # Kept with the context: the setting itself cannot be changed once a session runs.
        folder = context._vigil_folder = f"{tempfile.gettempdir()}/checkpoints/{context.applicationId}"
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str = "vigil") -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "vigil") -> DataFrame:
    """Write a reused intermediate once as a table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and later readers still prune columns.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, keys: list[str], name: str = "vigil", spread: bool = False) -> DataFrame:
    """``cut`` as a table in buckets of ``keys``: later joins on exactly these keys move the other side alone.

    ``spread`` deals the rows to their buckets first; without it, ``df`` should come from joins on such a table.
    """
    spark = df.sparkSession
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, name)
    table = f"{name}_{path[-32:]}"
    rows = df.repartition(number, *keys) if spread else df
    rows.write.bucketBy(number, *keys).option("path", path).saveAsTable(table, format="parquet")
    return spark.table(table)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete one stored intermediate that ``new_path`` named."""
    if not path.startswith(shared_folder(spark) + "/"):
        raise ValueError(f"{path} is not below the shared folder")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Intermediates of one operator: ``cut`` stores them, ``last`` stores the result and deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame, name: str = "vigil") -> DataFrame:
        path = new_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def last(self, df: DataFrame, name: str = "vigil") -> DataFrame:
        out = cut(df, name)
        for path in self.paths:
            drop_path(self.spark, path)
        self.paths = []
        return out


def small(df: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    """Hint a broadcast only when the stored table is counted and has at most ``rows`` rows."""
    fits = df.limit(rows + 1).count() <= rows
    return (F.broadcast(df) if fits else df), fits


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that workers elsewhere can import it."""
    context = spark.sparkContext
    if getattr(context, "_vigil_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="vigil-package-"), "vigil_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(archive)
    context._vigil_shipped = True
