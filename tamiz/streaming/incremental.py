"""Incremental and streaming work: resumable batches, windows with late data, sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def resumable(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, state: str) -> StreamingQuery:
    """Processes each file of a folder once and appends the results; run again, it takes only what is new."""

    def step(batch: DataFrame, _: int) -> None:
        work(batch).write.mode("append").parquet(out)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start()


def isolated(items: DataFrame, work: Callable[[dict], dict], schema: str, key: str = "id") -> DataFrame:
    """Rows of ``work`` for each item; an item that fails gives a row with its key and ``error``, and nothing stops."""
    names = [p.strip().split()[0] for p in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                try:
                    out.append({**work(r), key: r[key], "error": None})
                except Exception as e:  # noqa: BLE001 - any failure of one item is data
                    out.append({key: r[key], "error": str(e)})
            yield pd.DataFrame(out, columns=[*names, "error"]).astype(object)

    return items.mapInPandas(run, schema + ", error string")


def _marked(events: DataFrame, late: str | None) -> DataFrame:
    """Events with a watermark, for which time needs a zone; none where an operator before has set it (``late`` null)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events


def event_windows(events: DataFrame, size: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window and type; events later than the watermark are left out of a running stream."""
    return _marked(events, late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """Sessions of each user: begin, end, events."""
    return _marked(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, key: str = "event_id", late: str | None = "1 hour") -> DataFrame:
    """First delivery of every event within the watermark."""
    return _marked(events, late).dropDuplicatesWithinWatermark([key])
