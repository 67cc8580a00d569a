"""A search from the typed line to the hits: parse, correct, expand, search, order anew, and the event for the log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import search as S
from . import spell as SP
from . import synonyms as Y
from . import training as TR

#: Queries shorter than this are not corrected; characters of a hit's text that the reranker sees.
LEAST, SNIPPET = 3, 700


@dataclass
class Answer:
    parsed: S.ParsedQuery
    corrected: str
    confidence: float
    steps: list
    expanded: str
    hits: DataFrame  # as of ``search``; with ``rerank_score`` and ``rerank`` if there is a model
    event: DataFrame  # (query, corrected_from, found, at): a row for the search log


def correct(spark, text: str, chain: SP.Chain | None, learned: DataFrame | None = None, stats: DataFrame | None = None) -> tuple[str, float, list]:
    """The chain's correction of one text, its confidence and steps; then what the search log has learned about it."""
    if chain is None or len(text) < LEAST:
        return text, 1.0, []
    q = chain.correct(spark.createDataFrame([(text,)], "query string"))
    row = q.first()
    after, sure, steps = row["corrected"], row["confidence"], list(row["steps"])
    if learned is not None and stats is not None:
        past = SP.analytics_correct(spark.createDataFrame([(after,)], "query string"), learned, stats).first()["corrected"]
        if past.lower() != after.lower():
            sure *= chain.decay
            steps.append(("analytics", after, past, sure))
            after = past
    return after, sure, steps


def answer(
    index: S.Index, line: str, chain: SP.Chain | None = None, edges: DataFrame | None = None, confidences: DataFrame | None = None,
    learned: DataFrame | None = None, stats: DataFrame | None = None, model: PipelineModel | None = None, fuzzy: bool = True, stop: list[str] | None = None,
) -> Answer | None:
    """One typed line (words and tags) over a stored index; None for a line without words.

    The texts are one line's, so they pass through the driver; hits stay a table. Without edges nothing is expanded.
    Without a model the order is the search's. The event's ``corrected_from`` is the line's first word without ``=``
    if the words searched for differ from it.
    """
    spark = index.docs.sparkSession
    p = S.parse_query(line, stop)
    if not p.text:
        return None
    text, sure, steps = correct(spark, p.text, chain, learned, stats)
    expanded = text
    if edges is not None:
        e = edges if confidences is None else Y.confident(edges, confidences, p.synmin or 0.0)
        expanded = Y.expand_query(spark.createDataFrame([("q", text)], "query_id string, query string"), e).first()["expanded"]
    hits = S.search(index, S.query_terms(spark, {"q": expanded}), size=p.size, category=p.category, author=p.author, fuzzy=fuzzy)
    if model is not None:
        hits = TR.rerank(
            hits.select(
                F.lit("q").alias("queryId"), F.lit(text).alias("queryText"), F.col("id").alias("documentId"), "title", T.snippet(F.col("content"), SNIPPET).alias("contentSnippet"),
                "category", "author", F.col("score").alias("elasticScore"), F.col("rank").alias("position"), "total",
            ),
            model,
        )
    first = next((w for w in line.split() if "=" not in w), text)
    found = hits.agg(F.coalesce(F.max("total"), F.lit(0)).cast("long").alias("found"))
    before = F.lit(first if first.lower() != expanded.lower() else None).cast("string")
    event = found.select(F.lit(expanded).alias("query"), before.alias("corrected_from"), "found", F.current_timestamp().alias("at"))
    return Answer(p, text, sure, steps, expanded, hits, event)
