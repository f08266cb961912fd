"""The event log as a stream: windowed counts with late events, sessions, and a limiter that keeps state per key."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from basinweave.session import ensure_checkpoint_dir


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream over the events table, whether it is one file or a folder of files."""
    path = os.path.join(sf_dir, "events.parquet")
    schema = spark.read.parquet(path).schema
    if os.path.isdir(path):
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def window_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their sum per window and type; events later than ``late`` are not waited for."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per session of each user: runs without a pause of ``gap``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def limit_rate(events: DataFrame, limit: int = 3, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(user_id, event_id, allowed) with at most ``limit`` allowed events in any ``seconds`` of event time.

    The state of a key is the last ``limit`` allowed times; it goes once the watermark is ``seconds`` past the last of them, when it
    can deny nothing any more. Events are taken in order of time within a micro-batch; events later than ``late`` are left out.
    """
    span = seconds * 1_000_000

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = list(state.get[0]) if state.exists else []
        for pdf in batches:
            pdf = pdf.sort_values(["us", "event_id"])
            out = []
            for us in pdf["us"]:
                ok = len(seen) < limit or us - seen[0] >= span
                if ok:
                    seen = [*seen, int(us)][-limit:]
                out.append(ok)
            yield pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "allowed": out})
        state.update((seen,))
        if seen:
            state.setTimeoutTimestamp(max(seen[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).where("user_id is not null and ts is not null").withWatermark("ts", late)
    rows = rows.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").applyInPandasWithState(fold, "user_id long, event_id long, allowed boolean", "seen array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, folder_name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there now and gives its result as a table written to the shared checkpoint folder."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/{folder_name}-{os.urandom(6).hex()}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out")
