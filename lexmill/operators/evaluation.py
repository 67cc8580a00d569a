"""Measures of ranking quality from judgements (query_id, position, relevance, …)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(judged: DataFrame, tie: str = "position") -> DataFrame:
    """Judgements with their rank by position (``tie`` orders equal ones) and the ideal rank by relevance."""
    by = Window.partitionBy("query_id")
    d = judged.withColumn("rn", F.row_number().over(by.orderBy("position", tie)))
    d = d.withColumn("ideal", F.row_number().over(by.orderBy(F.desc("relevance"), "rn"))).withColumn("n", F.count("*").over(by))
    return d.withColumn("hit", F.when(F.col("relevance") > 0, 1).otherwise(0)).withColumn("hits", F.sum("hit").over(by.orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)))


def metrics(judged: DataFrame, tie: str = "position") -> DataFrame:
    """One row per query: precision at 1, 5 and 10, average precision, NDCG, reciprocal rank and counts."""
    d = ranked(judged, tie)
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    dcg = lambda r: F.sum(gain / F.log2(F.col(r) + 1))
    at = lambda k: (F.sum(F.when(F.col("rn") <= k, F.col("hit")).otherwise(0)) / F.least(F.lit(k), F.max("n"))).alias(f"p_at_{k}")
    g = d.groupBy("query_id").agg(
        at(1), at(5), at(10),
        F.coalesce(F.try_divide(F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rn"))), F.sum("hit")), F.lit(0.0)).alias("average_precision"),
        F.coalesce(F.try_divide(dcg("rn"), dcg("ideal")), F.lit(0.0)).alias("ndcg"),
        F.coalesce(F.try_divide(F.lit(1.0), F.min(F.when(F.col("hit") == 1, F.col("rn")))), F.lit(0.0)).alias("reciprocal_rank"),
        F.sum("hit").cast("long").alias("relevant_count"),
        F.count("*").alias("total_count"),
    )
    return g


def overall(m: DataFrame) -> DataFrame:
    mean = lambda c, n: F.coalesce(F.avg(c), F.lit(0.0)).alias(n)
    return m.agg(
        F.count("*").alias("total_queries"), mean("average_precision", "map"), mean("ndcg", "mean_ndcg"), mean("reciprocal_rank", "mrr"),
        mean("p_at_1", "mean_p_at_1"), mean("p_at_5", "mean_p_at_5"), mean("p_at_10", "mean_p_at_10"),
        F.coalesce(F.sum("total_count"), F.lit(0)).alias("documents_evaluated"), F.coalesce(F.sum("relevant_count"), F.lit(0)).alias("relevant_documents"),
        F.coalesce(F.try_divide(F.sum("relevant_count"), F.sum("total_count")), F.lit(0.0)).alias("overall_precision"),
    )


def relevance_histogram(judged: DataFrame) -> DataFrame:
    bins = judged.sparkSession.createDataFrame([(0,), (1,), (2,)], "relevance int")
    return bins.join(judged.groupBy(F.col("relevance").cast("int").alias("relevance")).count(), "relevance", "left").select("relevance", F.coalesce("count", F.lit(0)).alias("n"))


def position_stats(judged: DataFrame) -> DataFrame:
    return judged.groupBy("position").agg(F.sum(F.when(F.col("relevance") > 0, 1).otherwise(0)).cast("long").alias("relevant"), F.count("*").alias("n")).orderBy("position")


def basic_stats(judged: DataFrame) -> DataFrame:
    return judged.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("documents"), F.coalesce(F.sum(F.when(F.col("relevance") > 0, 1).otherwise(0)), F.lit(0)).cast("long").alias("relevant"))


def quality_band(c):
    """0 excellent (0.8 or more), 1 good (0.6), 2 fair (0.4), 3 poor."""
    return F.when(c >= 0.8, 0).when(c >= 0.6, 1).when(c >= 0.4, 2).otherwise(3)


def levels(total: DataFrame) -> DataFrame:
    """Bands of MAP, P@1 and NDCG, the level of their mean with MRR, and whether advice is due."""
    mean = (F.col("map") + F.col("mean_ndcg") + F.col("mrr") + F.col("mean_p_at_1")) / 4
    return total.select(
        quality_band(F.col("map")).alias("map_band"), quality_band(F.col("mean_p_at_1")).alias("p1_band"), quality_band(F.col("mean_ndcg")).alias("ndcg_band"),
        quality_band(mean).alias("level"), ((F.col("map") < 0.6) | (F.col("mean_p_at_1") < 0.6)).alias("needs_advice"),
    )


def upsert(stored: DataFrame, new: DataFrame, key: str = "query_id") -> DataFrame:
    """Stored rows whose key isn't renewed, and the new rows."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(stored: DataFrame, ids: list[str], key: str = "query_id") -> DataFrame:
    return stored.filter(~F.col(key).isin(ids))


BANDS = ["excellent", "good", "fair", "poor"]


def report(judged: DataFrame, names: DataFrame | None = None) -> str:
    """The full report as text: totals, means, bands, histogram, positions and a line per query.

    Only aggregates come to the driver; the table of queries is what the report is for.
    """
    m = metrics(judged).persist()
    o = overall(m).first()
    b = levels(overall(m)).first()
    out = ["SEARCH QUALITY", f"queries: {o.total_queries}  documents: {o.documents_evaluated}  relevant: {o.relevant_documents} ({o.overall_precision:.1%})"]
    out += [f"MAP {o.map:.3f} ({BANDS[b.map_band]})", f"NDCG {o.mean_ndcg:.3f} ({BANDS[b.ndcg_band]})", f"MRR {o.mrr:.3f}", f"P@1 {o.mean_p_at_1:.3f} ({BANDS[b.p1_band]})  P@5 {o.mean_p_at_5:.3f}  P@10 {o.mean_p_at_10:.3f}", f"level: {BANDS[b.level]}"]
    if b.needs_advice:
        out += ["ADVICE"]
        out += ["- improve the ranking of the first result"] * (o.mean_p_at_1 < 0.6) + ["- tune the weights of title, content, author and category"] * (o.map < 0.6)
        out += ["- improve synonyms and query expansion"] * (o.mean_ndcg < 0.6) + ["- look at the queries with low figures"]
    out += ["RELEVANCE"] + [f"{r.relevance}: {r.n}" for r in relevance_histogram(judged).orderBy("relevance").collect()]
    out += ["POSITIONS"] + [f"{r.position}: {r.relevant}/{r.n}" for r in position_stats(judged).limit(10).collect()]
    rows = m if names is None else m.join(names, "query_id")
    label = "query_id" if names is None else "query_text"
    out += ["QUERIES"] + [f"{r[label]}: AP {r.average_precision:.3f} NDCG {r.ndcg:.3f} RR {r.reciprocal_rank:.3f} P@1 {r.p_at_1:.2f} P@5 {r.p_at_5:.2f} P@10 {r.p_at_10:.2f}" for r in rows.orderBy("query_id").toLocalIterator()]
    return "\n".join(out) + "\n"
