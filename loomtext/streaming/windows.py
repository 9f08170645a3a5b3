"""Streams: event-time windows, sessions, deduplication, span pairing. All run on batch frames too."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators.written import new_folder

LATE = "10 minutes"


def stream_of(spark: SparkSession, path: str, schema, per_trigger: int = 1000, file_name: str = "*.parquet") -> DataFrame:
    """The files under ``path``, a folder or a pattern; a pattern may also match a file itself."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", file_name).parquet(path)


def tumbling(df: DataFrame, ts: str, size: str, *keys: str, late: str = LATE) -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(df: DataFrame, ts: str, size: str, step: str, *keys: str, late: str = LATE) -> DataFrame:
    return df.withWatermark(ts, late).groupBy(F.window(ts, size, step).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(df: DataFrame, ts: str, gap: str, key: str, late: str = LATE) -> DataFrame:
    g = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(df: DataFrame, ts: str, keys: list[str], late: str = LATE) -> DataFrame:
    """Each key once within the watermark, its late repeats left out; on a batch, once."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def paired(df: DataFrame, key: str, kind: str, ts: str, start: str, end: str, timeout_ms: int = 3_600_000) -> DataFrame:
    """(key, started, ended) as a stateful operator: a start waits for its end; once the watermark reaches the timeout it goes out without one.

    Rows without a time take no part. Of a key's rows of one instant those whose kind sorts first come first.
    """

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (opened,) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "started": [pd.Timestamp(opened, unit="us")], "ended": [pd.NaT]})
            return
        rows = pd.concat(list(batches)).sort_values([ts, kind])
        opened = state.get[0] if state.exists else None
        out = []
        for kd, t in zip(rows[kind], rows[ts]):
            if kd == start and opened is None:
                opened = int(t.value // 1000)
            elif kd == end and opened is not None:
                out.append((k[0], pd.Timestamp(opened, unit="us"), t))
                opened = None
        if opened is None:
            if state.exists:
                state.remove()
        else:
            state.update((opened,))
            # Spark times out what lies before the watermark, not at it.
            state.setTimeoutTimestamp(max(opened // 1000 + timeout_ms - 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=[key, "started", "ended"])

    kt = df.schema[key].dataType.simpleString()
    g = df.where(F.col(ts).isNotNull()).withWatermark(ts, LATE).where(F.col(kind).isin(start, end)).select(key, kind, ts).groupBy(key)
    return g.applyInPandasWithState(step, f"{key} {kt}, started timestamp, ended timestamp", "opened long", "append", "EventTimeTimeout")


def run_to_files(df: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over all that is there and return what it wrote, as Parquet files; nothing passes through the driver.

    ``append`` goes through the file sink, whose log makes a repeated batch count once. ``complete`` writes each batch's whole
    result to a folder named by the batch, so that a repeated batch overwrites itself, and returns the last one. A later run
    with the same ``folder`` goes on from the offsets, state and watermark of the one before; ``append`` only.
    """
    if folder and mode != "append":
        raise ValueError("only an appending stream goes on in a folder")
    spark, schema = df.sparkSession, df.schema
    folder = folder or new_folder(spark)
    out = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        out.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
        return spark.read.schema(schema).parquet(f"{folder}/out")
    last = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{number}")
        last[:] = [number]

    out.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out/{last[0]}") if last else spark.createDataFrame([], schema)
