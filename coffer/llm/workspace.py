"""Where the operators keep tables between their jobs, and joins that a hot key can't break."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship as ship

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; an own one only where that is unset and
    driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    kept = context._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get().rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="coffer-"))


def keep(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: what follows doesn't depend on executors
    that may be lost. What is kept goes when the application ends, as results may still read it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a path when the driver ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HEAVY = 1000


def join_unique(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "left", shuffled: bool = False) -> DataFrame:
    """left join right on key, where right has a key once and weight says how many rows of left
    (at most) have it. Keys with more than a thousandth of total, so at most a thousand of them,
    are broadcast; the rest have no hot key left and are joined by a shuffle, or as Spark sees fit,
    which may broadcast more than the driver holds; shuffled rules that out."""
    at_least = max(total // HEAVY, 1)
    heavy = F.broadcast(right.where(F.col(weight) > at_least).limit(HEAVY + 1))
    light = right.where(F.col(weight) <= at_least)
    if shuffled:
        light = light.hint("merge")
    hot = left.join(heavy, key)
    rest = left.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, how)
    return hot.unionByName(rest)
