"""Helpers about the Spark session that every operator shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``; a temporary folder only where none is set (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lattica-checkpoint-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, for files that one job writes and another reads."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so that a lost executor costs no long recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame, *spent: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and go on from there; then remove the files of ``spent``, earlier results of this function.

    Like ``cut``, but Spark knows the true size of what was written. A checkpoint keeps the size that was guessed for it, and
    guesses multiply with every join, so loops that join their own results need this. Nothing may be left to be worked out
    from ``spent``.
    """
    spark = df.sparkSession
    path = shared_path(spark, "settled")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    for old in spent:
        remove(old)
    return out


def remove(df: DataFrame) -> None:
    """Remove the files of a result of ``settled``, once; anything else is left alone."""
    path = getattr(df, "_settled_at", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(conf).delete(folder, True)
        df._settled_at = None


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
