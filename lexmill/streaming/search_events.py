"""Search analytics as a stream: the log's events by query, kept up to date as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import EVENT


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(path)


def stats(events: DataFrame) -> DataFrame:
    """Counts by query over all time, as the batch form has them, but for the set of sources."""
    return events.groupBy("query").agg(
        F.count("*").alias("searches"),
        F.sum(F.when(F.col("found") > 0, 1).otherwise(0)).alias("successes"),
        F.sum("found").alias("total_results"),
        F.min("at").alias("first_seen"),
        F.max("at").alias("last_seen"),
    )


def windowed(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts by query and time window; later events than ``late`` are left out."""
    return events.withWatermark("at", late).groupBy(F.window("at", width), "query").agg(F.count("*").alias("searches"))


def keep_table(d: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the current statistics over ``path`` after every batch."""
    return d.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start()
