"""Reading tables and cutting lineage, shared by every operator."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder the cluster names in spark.checkpoint.dir; set one only where there is none, and only on one machine.

    The folder made for a local session goes when Python ends. On a cluster a folder of one machine would be of no use to
    the others, so there it is an error to name none. Checkpoints go with their tables if the cluster sets
    spark.cleaner.referenceTracking.cleanCheckpoints.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder all executors share, with their lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder's address within the checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    address = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stored-{uuid.uuid4().hex}"
    return re.sub("^file:/*", "file:///", address)


def remove_folder(spark: SparkSession, address: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(address)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """A table as it is read, in at least as many partitions as there are cores, for work that is dear per row.

    Tables of enough files are left alone, so that only small ones are shuffled. For plain scans: counting the
    partitions of a plan with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def hot_keys(df: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """The keys that more than one in ``share`` of df's rows hold: fewer than ``share``, whatever the size of df."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return counts.where(F.col("__n") * share > df.count()).select(key)


def looked_up(df: DataFrame, key: str, unique: DataFrame, share: int = 1000, hot: DataFrame | None = None) -> DataFrame:
    """df left-joined by ``key`` to a table with one row a key, whatever part of df's rows one key holds.

    The rows that the unique table has for hot keys are broadcast; the others are joined by a shuffle that no hot key can
    unbalance. hot: what ``hot_keys`` found before, as it is sought anew otherwise. df is read more than once, so it should be
    a table or cut. Null keys stay, without a match.
    """
    hot = hot_keys(df, key, share) if hot is None else hot
    known = F.broadcast(hot.join(unique, key, "left"))
    cold = df.join(F.broadcast(hot), key, "left_anti").join(unique, key, "left")
    return df.join(known, key).unionByName(cold)
