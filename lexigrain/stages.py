"""Tables written between the steps of a plan, in the folder that driver and executors share.

Spark inlines a named step wherever it is used, so a step that many others build on would be computed again for each;
written once, it is read by all, and a lost executor takes nothing with it.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset, on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("lexigrain.tmp.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,\d+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexigrain-")
        spark.conf.set("lexigrain.tmp.dir", found)
    return found.rstrip("/")


#: Spark then removes the files of a plan's shuffles as soon as the plan has run.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lexigrain/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def write(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again; the files go when the process ends.

    As nothing reads the shuffles behind it any more, their files go as soon as it is written.
    """
    spark = df.sparkSession
    path = _new_path(spark, name)
    with _cleaning(spark):
        # The plan is made anew, for the setting to hold for it.
        df.select("*").write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, by: str, order: list[str]) -> str:
    """``df`` written as a table of buckets by a column, each a sorted file; its name.

    Windows, groups and joins over keys that hold this column then read the table without a shuffle.
    """
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"lexigrain_{name}_{uuid.uuid4().hex}"
    with _cleaning(spark):
        rows = df.repartition(n, by).write.bucketBy(n, by).sortBy(*order)
        rows.option("path", _new_path(spark, name)).option("compression", "zstd").saveAsTable(table, format="parquet")
    return table


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the JVM may be gone at exit; the folder is then the cluster's to clean
        pass
