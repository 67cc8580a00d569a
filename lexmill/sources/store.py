"""Readers and writers of articles, evaluations, samples, synonyms, analytics, indexes and backups."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas as S
from ..functions import text as T

ARTICLE_COLUMNS = dict(zip(S.ARTICLE_JSON.names, S.ARTICLE.names, strict=True))


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _move(spark: SparkSession, path: str, to: str) -> None:
    p, fs = _path(spark, path)
    if not fs.rename(p, _path(spark, to)[0]):
        raise OSError(f"{path} can't be moved to {to}")


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Removes an index or table; nothing happens if there is none."""
    p, fs = _path(spark, path)
    fs.delete(p, True)


def count(spark: SparkSession, path: str) -> int:
    """Rows of a stored table; 0 if there is none."""
    return spark.read.parquet(path).count() if exists(spark, path) else 0


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A report as one UTF-8 file, by the file system of the path."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_articles(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """An array of articles; names without regard to case. Missing or broken files give no rows unless ``strict``."""
    if not exists(spark, path):
        if strict:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], S.ARTICLE)
    d = spark.read.schema(S.ARTICLE_JSON).option("multiLine", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    blank = {c: F.coalesce(c, F.lit("")) for c in ("Title", "Url", "Content", "Category", "Author", "ImageUrl")}
    return d.withColumns(blank).withColumn("PublishDate", T.parse_date(F.col("PublishDate"))).toDF(*S.ARTICLE.names)


def write_articles(articles: DataFrame, path: str) -> None:
    d = articles.withColumn("publish_date", T.format_date(F.col("publish_date"))).toDF(*S.ARTICLE_JSON.names)
    d.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def documents(articles: DataFrame) -> DataFrame:
    """Articles as documents of the index: with an id, their texts normalised."""
    norm = {c: T.normalize(F.col(c)) for c in ("title", "content", "category", "author")}
    return articles.withColumns(norm).withColumn("id", T.article_id(F.col("url")))


def last_by_id(docs: DataFrame, order: str | None = None) -> DataFrame:
    """One row per id: the last by ``order``, else by the order of the input's partitions."""
    o = F.col(order) if order else F.monotonically_increasing_id()
    w = Window.partitionBy("id").orderBy(F.desc("_o"))
    return docs.withColumn("_o", o).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_o", "_r")


def upsert(spark: SparkSession, docs: DataFrame, path: str, order: str | None = None) -> int:
    """Writes documents by id over those stored; returns how many rows were given.

    The stored table is moved aside until the new one is in its place; a call after a crash between takes it up again.
    """
    if not exists(spark, path) and exists(spark, f"{path}.old"):
        _move(spark, f"{path}.old", path)
    new = last_by_id(docs, order)
    if exists(spark, path):
        new = spark.read.parquet(path).join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)
    new.write.mode("overwrite").parquet(f"{path}.new")
    if exists(spark, path):
        remove(spark, f"{path}.old")
        _move(spark, path, f"{path}.old")
    _move(spark, f"{path}.new", path)
    remove(spark, f"{path}.old")
    return docs.count()


def rebuild(spark: SparkSession, articles_path: str, index_path: str) -> int:
    """The index anew from a file of articles; returns the documents it holds."""
    from ..operators.search import build_index, save_index

    save_index(build_index(last_by_id(documents(read_articles(spark, articles_path)))), index_path)
    return count(spark, f"{index_path}/docs")


def clear(spark: SparkSession, path: str, copy: str | None = None) -> int:
    """Removes a stored table, after a copy to ``copy`` if named; returns the rows it held."""
    n = count(spark, path)
    if copy and exists(spark, path):
        spark.read.parquet(path).write.mode("overwrite").parquet(copy)
    remove(spark, path)
    return n


def lookup(ids: DataFrame, docs: DataFrame) -> DataFrame:
    return docs.join(ids.select("id").distinct(), "id")


def read_evaluations(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], S.EVALUATION)
    return spark.read.schema(S.EVALUATION).option("multiLine", True).json(path)


def judgements(evaluations: DataFrame) -> DataFrame:
    """A row per judged document."""
    e = evaluations.select("queryId", "queryText", "timestamp", "totalFound", F.posexplode("results").alias("input_order", "r"))
    return e.select(
        F.col("queryId").alias("query_id"), F.col("queryText").alias("query_text"), F.col("timestamp").alias("at"), F.col("totalFound").alias("total_found"), "input_order",
        F.col("r.position").alias("position"), F.col("r.documentId").alias("document_id"), F.col("r.title").alias("title"), F.col("r.url").alias("url"), F.col("r.category").alias("category"),
        F.col("r.author").alias("author"), F.col("r.relevanceScore").alias("relevance"), F.col("r.comment").alias("comment"), F.col("r.aiRelevanceScore").alias("ai_relevance"),
        F.col("r.aiConfidence").alias("ai_confidence"), F.col("r.aiReason").alias("ai_reason"),
    )


def csv_rows(j: DataFrame) -> DataFrame:
    """Judgements as the fourteen columns of the CSV export, all text."""
    return j.select(
        F.col("query_id").alias("QueryId"), F.col("query_text").alias("QueryText"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), F.col("position").cast("string").alias("Position"),
        F.col("document_id").alias("DocumentId"), F.col("title").alias("Title"), F.col("url").alias("Url"), F.coalesce("category", F.lit("")).alias("Category"), F.coalesce("author", F.lit("")).alias("Author"),
        F.col("relevance").cast("string").alias("RelevanceScore"), F.coalesce("comment", F.lit("")).alias("Comment"), F.coalesce(F.col("ai_relevance").cast("string"), F.lit("")).alias("AiRelevanceScore"),
        F.when(F.col("ai_confidence").isNull(), F.lit("")).otherwise(F.format_string("%.3f", F.col("ai_confidence").cast("double"))).alias("AiConfidence"), F.coalesce("ai_reason", F.lit("")).alias("AiReason"),
    )


def write_csv(j: DataFrame, path: str) -> None:
    csv_rows(j).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema=S.SAMPLE) -> DataFrame:
    """Rows of a file of JSON lines; blank and broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def read_synonyms(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges (word, synonym) and confidences, normalised and clamped."""
    from ..operators.synonyms import clean_edges

    d = spark.read.schema(S.SYNONYMS).option("multiLine", True).json(path)
    e = d.select(F.explode("synonyms").alias("word", "s")).select("word", F.explode("s").alias("synonym"))
    c = d.select(F.explode("confidenceScores").alias("word", "confidence")).select(T.normalize(F.col("word")).alias("word"), T.clamp(F.col("confidence"), 0.0, 1.0).alias("confidence"))
    return clean_edges(e), c


def write_synonyms(edges: DataFrame, confidence: DataFrame, stats: DataFrame, path: str) -> None:
    """One JSON object: the dictionary is one row by its format, of as many words as were kept."""
    m = edges.groupBy("word").agg(F.sort_array(F.collect_set("synonym")).alias("s")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "s")))).alias("synonyms"), F.count("*").cast("int").alias("totalGroups"))
    c = confidence.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "confidence")))).alias("confidenceScores"))
    s = stats.select(F.struct(F.col("total_words").cast("int").alias("totalWords"), F.col("total_pairs").cast("int").alias("totalPairs"), F.col("min_similarity").alias("minSimilarity"), F.col("avg_similarity").alias("avgSimilarity"), F.col("max_similarity").alias("maxSimilarity"), F.col("articles_analyzed").cast("int").alias("articlesAnalyzed")).alias("statistics"))
    m.crossJoin(c).crossJoin(s).withColumn("lastUpdated", F.current_timestamp()).write.mode("overwrite").json(path)  # three single rows


def read_analytics(spark: SparkSession, path: str) -> DataFrame:
    """Stored statistics by query, with the derived rates."""
    if not exists(spark, path):
        text = spark.createDataFrame([], "value string")
    else:
        text = spark.read.text(path, wholetext=True)
    d = text.select(F.explode(F.from_json("value", f"map<string,{S.QUERY_STATS}>")).alias("query", "s")).select("query", "s.*")
    return d.withColumn("SuccessRate", F.try_divide("SuccessfulSearches", "SearchCount")).withColumn("AvgResults", F.try_divide("TotalResults", "SearchCount"))


def write_analytics(stats: DataFrame, path: str) -> None:
    s = stats.select("query", F.struct(F.col("query").alias("Query"), F.col("searches").alias("SearchCount"), F.col("successes").alias("SuccessfulSearches"), F.col("total_results").alias("TotalResults"), F.col("first_seen").alias("FirstSeen"), F.col("last_seen").alias("LastSeen"), F.col("corrected_from").alias("CorrectedFrom")).alias("s"))
    s.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("query", "s")))).alias("value")).write.mode("overwrite").text(path)


MAPPING = {"mappings": {"properties": {"id": {"type": "keyword"}, "title": {"type": "text"}, "content": {"type": "text"}, "url": {"type": "keyword"}, "publishDate": {"type": "date"}, "category": {"type": "keyword"}, "author": {"type": "keyword"}, "commentCount": {"type": "integer"}, "imageUrl": {"type": "keyword"}}}}


def backup(spark: SparkSession, tables: dict[str, str], path: str, stamp: str) -> DataFrame:
    """All documents of the given tables (name to path) as JSON, with mapping, settings and counts; returns the counts."""
    remove(spark, path)
    infos = []
    for name, src in tables.items():
        spark.read.parquet(src).write.json(f"{path}/{name}_data.json")
        write_text(spark, json.dumps(MAPPING), f"{path}/{name}_mapping.json")
        write_text(spark, json.dumps({"settings": {"number_of_shards": 1, "number_of_replicas": 0}}), f"{path}/{name}_settings.json")
        n, m = count(spark, src), spark.read.text(f"{path}/{name}_data.json").count()
        infos.append({"Name": name, "DocumentCount": n, "ActualDocumentCount": m, "MappingFile": f"{name}_mapping.json", "SettingsFile": f"{name}_settings.json", "DataFile": f"{name}_data.json"})
    write_text(spark, json.dumps({"Timestamp": stamp, "IndicesCount": len(infos), "Indices": infos}), f"{path}/backup_metadata.json")
    return spark.createDataFrame([(x["Name"], x["DocumentCount"], x["ActualDocumentCount"]) for x in infos], "name string, document_count bigint, actual_count bigint")


def restore(spark: SparkSession, path: str, names: list[str], to: str, schema, force: bool = False, skip_existing: bool = False) -> DataFrame:
    """The tables of a backup again; one that exists is an error unless ``force`` or ``skip_existing``. Returns counts."""
    out = []
    for name in names:
        if exists(spark, f"{to}/{name}") and not force:
            if skip_existing:
                continue
            raise FileExistsError(f"{to}/{name}")
        d = spark.read.schema(schema).json(f"{path}/{name}_data.json")
        d.write.mode("overwrite").parquet(f"{to}/{name}")
        out.append((name, count(spark, f"{to}/{name}")))
    return spark.createDataFrame(out, "name string, restored bigint")
