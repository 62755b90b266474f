"""Helpers shared by the training-data operators.

Intermediate tables are Parquet in the shared folder named by
``spark.checkpoint.dir``: every executor can read them after another one is
lost, they are compressed and column-pruned, and they cut the lineage.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: words of the contracts: runs of anything but ASCII white space
WORD_RE = r"[^\x20\x09-\x0D]+"


def show_package(spark: SparkSession) -> None:
    """Name this package's folder to the Python workers of a local run.

    On a cluster the package comes with ``--py-files`` or the image, and a folder
    that does not exist there does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    show_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where the setting is absent (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = "file://" + tempfile.mkdtemp(prefix="shroud-shared-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


class Scratch:
    """Named tables of one operator run under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        show_package(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/shroud-{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back with the same schema (also when empty)."""
        schema = df.schema
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Remove a table that a later one has replaced, and let Spark free finished shuffles."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let the context cleaner drop the shuffle files of plans no longer referenced."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()


def project(df: DataFrame, **cols: str | Column) -> DataFrame:
    """Only the named columns, renamed first, so that extra columns never clash."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in cols.items()])


def text_bytes(col: str | Column) -> Column:
    return F.encode(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")), "UTF-8")
