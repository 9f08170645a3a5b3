"""Intermediate results that several branches of a plan read, written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A path not used before under spark.checkpoint.dir, which all executors share; in local mode without that setting, in a
    temporary folder."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir", None)
    if not top:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = getattr(spark, "_loomtext_written", None) or "file://" + tempfile.mkdtemp(prefix="loomtext-")
        spark._loomtext_written = top
    return f"{top.rstrip('/')}/loomtext/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet files in a new folder. What reads it doesn't compute it again, nor depend on the executors that did."""
    spark, path, schema = df.sparkSession, new_folder(df.sparkSession), df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._loomtext_path = path
    return out


def removed(df: DataFrame) -> None:
    """Delete the files of a ``written`` frame that nothing reads any more."""
    path = getattr(df, "_loomtext_path", None)
    if path:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
