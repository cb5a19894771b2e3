"""Structured Streaming forms of the incremental counts: molecules arriving as events (cell, umi, category, time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def molecule_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """Events of a folder of Parquet files as they arrive, as molecules."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)
    return raw.select(F.concat(F.lit("c"), "user_id").alias("cell"), F.concat(F.lit("u"), "event_id").alias("umi"), F.col("event_type").alias("category"), F.col("ts").cast("timestamp").alias("time"))


def distinct_molecules(molecules: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each (cell, umi) once within the time that events may be late; the state is bounded by the watermark."""
    return molecules.withWatermark("time", late).dropDuplicatesWithinWatermark(["cell", "umi"])


def cell_counts(molecules: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Molecules per cell and category in tumbling windows; windows close when the watermark passes them."""
    w = F.window("time", width)
    return molecules.withWatermark("time", late).groupBy(w.alias("w"), "cell", "category").agg(F.count("*").alias("molecules")).select(F.col("w.start").alias("start"), "cell", "category", "molecules")


def run_available(counts: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Processes what is there and stops; the newest count of each window, cell and category.

    In update mode a batch holds the changed windows alone and state ends with the watermark. Each batch overwrites the
    folder of its own number, so a retried batch changes nothing and no batch rewrites what others wrote.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    changes = counts.sparkSession.read.parquet(path)
    return changes.groupBy("start", "cell", "category").agg(F.max_by("molecules", "batch").alias("molecules"))
