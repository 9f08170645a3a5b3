"""What the operators share: tables, written intermediate results, exact prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode, where the driver is the executor."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    known = getattr(spark, "_loomtext_dir", None)
    if known is None:
        known = spark._loomtext_dir = "file://" + tempfile.mkdtemp(prefix="loomtext-")
    return known


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends at files every executor sees."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomtext/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._loomtext_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized frame that nothing reads any more."""
    path = getattr(df, "_loomtext_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sums(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, str], spread: Column, slots: int = 1024) -> DataFrame:
    """Add exact exclusive prefix sums within each group, in an order whose first key is a slot of ``spread``.

    ``sums`` maps a new column to the long column it sums. The order is (slot of ``spread``, then ``order``):
    ``spread`` is a 64-bit hash, so a group that holds a third of all rows is still cut into ``slots`` even runs.
    Partial sums per (group, slot) are summed first (map-side combined), then prefixed over at most ``slots`` rows a
    group, then joined back; no task meets a whole group. Rows equal in slot and all of ``order`` are interchangeable.
    """
    d = df.withColumn("_slot", F.pmod(spread, F.lit(slots)).cast("int"))
    keys = [*group, "_slot"]
    parts = d.groupBy(*keys).agg(*[F.sum(c).alias(f"_p_{n}") for n, c in sums.items()])
    w = Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.coalesce(F.sum(f"_p_{n}").over(w), F.lit(0)).cast("long").alias(f"_b_{n}") for n in sums])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    v = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("*", *[F.coalesce(F.sum(c).over(v), F.lit(0)).cast("long").alias(f"_w_{n}") for n, c in sums.items()])
    d = d.join(parts, cond, "left")
    return d.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"_w_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])
