"""Search analytics over a log of search events (query, corrected_from, found, at)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def query_stats(events: DataFrame) -> DataFrame:
    g = events.groupBy("query").agg(
        F.count("*").alias("searches"),
        F.sum(F.when(F.col("found") > 0, 1).otherwise(0)).cast("long").alias("successes"),
        F.sum("found").cast("long").alias("total_results"),
        F.min("at").alias("first_seen"),
        F.max("at").alias("last_seen"),
        F.sort_array(F.collect_set("corrected_from")).alias("corrected_from"),
    )
    return g.withColumn("success_rate", F.col("successes") / F.col("searches")).withColumn("avg_results", F.col("total_results") / F.col("searches"))


def totals(stats: DataFrame, learned: DataFrame) -> DataFrame:
    s = stats.agg(
        F.count("*").alias("unique_queries"),
        F.coalesce(F.sum("searches"), F.lit(0)).alias("total_searches"),
        F.sum(F.when(F.col("success_rate") > 0.5, 1).otherwise(0)).cast("long").alias("successful_queries"),
        F.coalesce(F.try_divide(F.sum("successes"), F.sum("searches")), F.lit(0.0)).alias("success_rate"),
    )
    return s.crossJoin(learned.agg(F.count("*").alias("learned_corrections")))  # two single rows


def learned_corrections(events: DataFrame, stats: DataFrame, rate: float = 0.7, first_word: bool = False) -> DataFrame:
    """(original, correction): the last successful query a text was corrected to. ``first_word`` keys by its first word."""
    good = stats.filter(F.col("success_rate") > rate).select("query")
    e = events.filter("corrected_from is not null and corrected_from <> query and found > 0").join(good, "query", "left_semi")
    key = F.split("corrected_from", " ")[0] if first_word else F.col("corrected_from")
    return e.groupBy(key.alias("original")).agg(F.max_by("query", F.struct("at", "query")).alias("correction"))
