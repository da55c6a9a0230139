"""The event table as a stream: watermarked windows, run to the end of what is available, resumable by checkpoint."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files matching a path."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def windowed(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped by the engine, and closed windows leave its state."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_available(spark: SparkSession, sf_dir: str, width: str = "1 day") -> DataFrame:
    """Process all files that exist now and return the windows as they stood last.

    Batches write the windows that they changed (update mode), each to a folder of its own, so that a batch
    that is run again replaces itself; the open windows at the end are part of the result.
    """
    where = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    found = windowed(read(spark, f"{sf_dir}/events.parquet*"), width)
    flat = found.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/out/batch={number}")

    flat.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    last = F.max_by(F.struct("n", "total"), "batch").alias("last")
    return spark.read.schema(flat.schema.add("batch", "long")).parquet(f"{where}/out").groupBy("start", "event_type").agg(last).select("start", "event_type", "last.n", "last.total")
