"""Windows over event streams; the same plans run on tables and on streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.plans.lineage import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors can write."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def tumbling(events: DataFrame, length: str, late: str | None = None) -> DataFrame:
    """(win_start, event_type, n, total) for windows side by side; ``late`` bounds the state of a stream."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("win_start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str, step: str, late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("win_start"), "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, win_start, win_end, n): events of a user no further apart than the gap."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end"), "n")


def latest_of_stream(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a streaming aggregate over all that is there now; the result is a table in the shared folder.

    State and result lie in the shared folder, so that a lost executor or a
    restart continues where the query was.
    """
    spark = stream.sparkSession
    out, state = shared_folder(spark, "stream-out"), shared_folder(spark, "stream-state")

    def write(batch: DataFrame, _id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.parquet(out)


def ingest_articles(stream: DataFrame, folder: str, state: str, key: str = "art_id", order: str = "art_datetime"):
    """Appends new articles to a table, each batch without those it holds already and the last of each key in the batch.

    A batch that is run again after a failure writes to the same part of the table.
    """
    from pressmill.operators.frames import keep_last

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = keep_last(batch.where(F.col(key).isNotNull()), [key], [order])
        try:
            old = spark.read.parquet(folder).where(F.col("batch") != batch_id).select(key)
            new = new.join(old, key, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
        new.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(upsert).start()
