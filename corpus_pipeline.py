"""The corpus pipeline: toxic documents go, repeated lines go, one of each group of near copies stays,
sources are mixed to their weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``; ``n_chars`` follows the text.
Rows alike in id and text are one document and share its fate in the near-duplicate stage. Texts that
line dedup empties stay as empty texts. The mix passes on as many tokens as it gets, so what a large
source loses, small ones make up for with a second epoch; rows of a second epoch repeat.

Null texts are empty, null ids stay (in the near-duplicate stage where their group has no other id), very long texts
are taken whole, ties end as the operators say. Columns beside those of ``documents`` travel as far as the mix,
whatever their names. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import line_dedup, minhash_dedup, mixing, sentencepiece_codec, toxicity
from lexmill.llm.common import Scratch, empty_text, fresh, table


def toxic_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("score < 0.7").select(*docs.columns)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(docs, minhash_dedup.Setting(words=4))  # as op10 does
    own, id_, th = fresh(), fresh(), fresh()
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(id_), F.col("th").alias(th)).distinct()
    d = docs.withColumn(own, F.xxhash64(empty_text()))
    d = d.join(stay.hint("merge"), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(th)), "left_semi")
    return d.select(*docs.columns)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, mixing.Mix(), {"domain": mixing.domain()}).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    codec = sentencepiece_codec.load()
    out = sentencepiece_codec.round_trip(docs.select("doc_id", "lang", "source", empty_text().alias("text")), codec)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("toxicity", toxic_go),
    ("line_dedup", lines_once),
    ("near_dedup", one_of_each),
    ("mixing", to_weights),
    ("sentencepiece", encoded),
]

#: Training a label model and verifying similar texts have no SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = scratch.write(docs)
    return docs
