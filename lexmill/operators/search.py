"""Full-text index as tables, BM25 over several fields, fuzzy terms, filters and pages.

Tables: postings(field, term, id, tf), doc_len(field, id, len), field_stats(field, n_docs, avg_len) and
vocab(field, term, df). A query becomes a few rows that are joined to the postings by term, so only
the lists of its terms are read when the table is laid out by term.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import text as T
from ..functions import values as V
from .components import shared_dir

#: The parameters of the ranking and the fields with their boosts.
K1, B = 1.2, 0.75
BOOSTS = {"title": 3.0, "content": 1.0, "author": 1.0, "category": 1.0}
TEXT_FIELDS, WHOLE_FIELDS = ("title", "content"), ("author", "category")


def analyze(c: Column, stop: list[str] | None = None) -> Column:
    """The index analyzer: words of letters, digits and marks, lowered, without (English) stop words."""
    t = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{M}\p{Nd}\p{Pc}]+"), lambda x: x != "")
    stop = V.ENGLISH_STOP_WORDS if stop is None else stop
    return F.filter(t, lambda x: ~x.isin(stop)) if stop else t


@dataclass
class Index:
    docs: DataFrame
    postings: DataFrame
    doc_len: DataFrame
    field_stats: DataFrame
    vocab: DataFrame
    #: (field, id, terms, len) of an index that is not stored: its postings are counted for the terms asked for only
    fields: DataFrame | None = None


def build_index(docs: DataFrame, stop: list[str] | None = None) -> Index:
    """``docs`` (id, title, content, author, category, …) as index tables; whole fields are one term each."""
    fields = [F.struct(F.lit(f).alias("field"), analyze(F.col(f), stop).alias("terms")) for f in TEXT_FIELDS]
    fields += [F.struct(F.lit(f).alias("field"), F.array_remove(F.array(T.normalize(F.col(f))), "").alias("terms")) for f in WHOLE_FIELDS]
    each = docs.select("id", F.explode(F.array(*fields)).alias("f")).select("id", "f.field", "f.terms").filter(F.size("terms") > 0)
    length = each.select("field", "id", F.size("terms").cast("long").alias("len"))
    postings = each.select("field", "id", F.explode("terms").alias("term")).groupBy("field", "term", "id").agg(F.count("*").alias("tf"))
    vocab = each.select("field", F.explode(F.array_distinct("terms")).alias("term")).groupBy("field", "term").agg(F.count("*").alias("df"))
    return Index(docs, postings, length, _field_stats(length), vocab, each.withColumn("len", F.size("terms").cast("long")))


def postings_of(index: Index, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(field, term, id, tf, df, len) of ``terms`` (field, term), and the statistics of fields.

    The texts of an index that is not stored are read once: what they have of the terms, and their lengths, is kept in the shared folder.
    """
    if index.fields is None:
        asked = F.broadcast(terms.select("field", "term").distinct())  # a query's terms
        p = index.postings.join(asked, ["field", "term"], "left_semi").join(F.broadcast(index.vocab.join(asked, ["field", "term"], "left_semi")), ["field", "term"])
        return p.join(index.doc_len, ["field", "id"]), index.field_stats
    spark, path = index.docs.sparkSession, f"{shared_dir(index.docs.sparkSession)}/hits-{uuid.uuid4().hex}"
    asked = F.broadcast(terms.groupBy("field").agg(F.collect_set("term").alias("asked")))  # a row per field
    found = F.coalesce(F.filter("terms", lambda x: F.array_contains("asked", x)), F.array().cast("array<string>"))
    hit = index.fields.join(asked, "field", "left").select("field", "id", "len", found.alias("hit"))
    hit.write.parquet(path)
    hit = spark.read.schema(hit.schema).parquet(path)
    p = hit.select("field", "id", "len", F.explode("hit").alias("term")).groupBy("field", "term", "id").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    df = p.groupBy("field", "term").agg(F.count("*").alias("df"))
    return p.join(F.broadcast(df), ["field", "term"]), _field_stats(hit)  # a query's terms


def _field_stats(length: DataFrame) -> DataFrame:
    return length.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))


def _vocab(postings: DataFrame) -> DataFrame:
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"))


def save_index(index: Index, path: str) -> None:
    """Replaces the index at ``path``; postings are sorted by term, so that a term's list is read by its statistics.

    Texts are analysed once: lengths, statistics and vocabulary come from the written postings. Lists of frequent
    terms are split by id.
    """
    spark = index.docs.sparkSession
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    index.postings.repartitionByRange("field", "term", "id").sortWithinPartitions("field", "term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    postings.groupBy("field", "id").agg(F.sum("tf").alias("len")).write.mode("overwrite").parquet(f"{path}/doc_len")
    _field_stats(spark.read.parquet(f"{path}/doc_len")).write.mode("overwrite").parquet(f"{path}/field_stats")
    _vocab(postings).write.mode("overwrite").parquet(f"{path}/vocab")


def load_index(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{n}") for n in ("docs", "postings", "doc_len", "field_stats", "vocab")])


def osa(a: str, b: str) -> int:
    """Edit distance in which swapping neighbours costs one."""
    d = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(d[i - 1][j] + 1, row[j - 1] + 1, d[i - 1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], d[i - 2][j - 2] + 1)
        d.append(row)
    return d[-1][-1]


@F.pandas_udf(IntegerType())
def osa_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def edits_allowed(c: Column) -> Column:
    return F.when(F.length(c) < 3, 0).when(F.length(c) <= 5, 1).otherwise(2)


def swapped(c: Column) -> Column:
    """(t, n): the text and what it becomes by one or two swaps of neighbours, n of them."""
    i = F.sequence(F.lit(1), F.length(c) - 1)
    swap = lambda x, k: F.concat(F.left(x, k - 1), F.substring(x, k + 1, F.lit(1)), F.substring(x, k, F.lit(1)), F.substring(x, k + 2, F.length(x)))
    form = lambda x, n: F.struct(x.alias("t"), F.lit(n).alias("n"))
    one = F.transform(i, lambda k: form(swap(c, k), 1))
    two = F.flatten(F.transform(i, lambda k: F.transform(i, lambda m: form(swap(swap(c, k), m), 2))))
    same = F.array(form(c, 0))
    return F.when(F.length(c) > 1, F.array_distinct(F.concat(same, one, two))).otherwise(same)


def fuzzy_terms(terms: DataFrame, vocab: DataFrame, most: int = 50, transpositions: bool = True) -> DataFrame:
    """(term, field, match, edits): for each query term at most ``most`` index terms within its allowed edits, the nearest first.

    The length band and a bound leave few rows for the exact distance: without its swaps of neighbours the term has to be near.
    """
    e = edits_allowed(F.col("term"))
    v = vocab.select("field", F.col("term").alias("match"), "df")
    asked = terms.select("term").distinct().select("term", swapped(F.col("term")).alias("forms"))
    within = lambda f: F.levenshtein(f["t"], F.col("match"), 2) <= e - f["n"]
    some = F.exists("forms", lambda f: within(f) & (F.levenshtein(f["t"], F.col("match"), 2) >= 0)) if transpositions else F.lit(True)
    near = v.join(F.broadcast(asked), (F.abs(F.length("match") - F.length("term")) <= e) & some).drop("forms")  # a query's terms
    if transpositions:
        near = near.withColumn("edits", osa_udf("term", "match"))
    else:
        near = near.withColumn("edits", F.levenshtein("term", "match"))
    near = near.filter(F.col("edits") <= e)
    from pyspark.sql.window import Window

    w = Window.partitionBy("term", "field").orderBy("edits", F.desc("df"), "match")
    return near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).drop("r", "df")


def bm25(index: Index, terms: DataFrame, boosts: dict[str, float] = BOOSTS) -> DataFrame:
    """(query_id, id, score) for ``terms`` (query_id, field, match): per field a sum over terms, then the best field."""
    boost = F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv])
    t = terms.select("query_id", "field", F.col("match").alias("term")).distinct()
    p, stats = postings_of(index, t)
    p = p.join(F.broadcast(t), ["field", "term"]).join(F.broadcast(stats), "field")  # a query's terms, a row per field
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    by_field = p.groupBy("query_id", "id", "field").agg((F.try_element_at(boost, F.first("field")) * F.sum(idf * tf)).alias("s"))
    return by_field.groupBy("query_id", "id").agg(F.max("s").alias("score"))


def query_terms(spark: SparkSession, queries: dict[str, str], stop: list[str] | None = None) -> DataFrame:
    """(query_id, field, term): words for text fields, the whole normalised query for the others."""
    q = spark.createDataFrame(list(queries.items()), "query_id string, q string")
    words = F.transform(F.array_distinct(analyze(F.col("q"), stop)), lambda x: x)
    text = q.select("query_id", F.explode(F.array(*map(F.lit, TEXT_FIELDS))).alias("field"), words.alias("w")).select("query_id", "field", F.explode("w").alias("term"))
    whole = q.select("query_id", F.explode(F.array(*map(F.lit, WHOLE_FIELDS))).alias("field"), T.normalize(F.col("q")).alias("term"))
    return text.unionByName(whole)


def search(index: Index, terms: DataFrame, start: int = 0, size: int = 10, category: str | None = None, author: str | None = None, fuzzy: bool = False) -> DataFrame:
    """Hits with ``score``, ``rank`` (start + 1, …) and the constant ``total`` of each query; filters don't score."""
    from pyspark.sql.window import Window

    if fuzzy:
        spark, path = index.docs.sparkSession, f"{shared_dir(index.docs.sparkSession)}/near-{uuid.uuid4().hex}"
        near = fuzzy_terms(terms, index.vocab)
        near.write.parquet(path)  # at most 50 for each term, asked for more than once
        terms = terms.join(spark.read.schema(near.schema).parquet(path), ["field", "term"])
    else:
        terms = terms.withColumn("match", F.col("term"))
    docs = index.docs
    for name, value in (("category", category), ("author", author)):
        if value:
            docs = docs.filter(F.lower(name) == value.strip().lower())
    hits = bm25(index, terms)
    if category or author:
        hits = hits.join(docs.select("id"), "id", "left_semi")
    total = hits.groupBy("query_id").agg(F.count("*").alias("total"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = hits.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") > start) & (F.col("rank") <= start + size))
    return F.broadcast(top.join(total, "query_id")).join(docs, "id")  # a page of hits


def rendered(hits: DataFrame, n: int = 200) -> DataFrame:
    """Hits with the beginning of their content, as there are no highlights."""
    return hits.withColumn("preview", T.snippet(F.col("content"), n))


@dataclass
class ParsedQuery:
    text: str
    category: str | None = None
    author: str | None = None
    size: int = 10
    synmin: float | None = None


TAGS = {"category": "category", "author": "author", "size": "size", "synmin": "synmin", "synconf": "synmin", "synconfidence": "synmin", "synonymconfidence": "synmin"}


def parse_query(line: str, stop: list[str] | None = None) -> ParsedQuery:
    """Words and tags: ``k=v``, ``k:v``, ``--k v`` and ``[k=v]``; stop words go, words are lowered."""
    out, words, waiting = ParsedQuery(""), [], None

    def put(tag: str, value: str) -> None:
        if tag == "size":
            out.size = int(value) if value.isdigit() and int(value) > 0 else out.size
        elif tag == "synmin":
            try:
                out.synmin = min(max(float(value.replace(",", ".")), 0.0), 1.0)
            except ValueError:
                pass
        else:
            setattr(out, tag, value.lower())

    for raw in line.split():
        token = raw[1:-1] if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "\"'" else raw
        if not token:
            continue
        if waiting:
            put(waiting, token.strip("[]"))
            waiting = None
            continue
        bare = token.lstrip("[").rstrip("]")
        name, sep, value = next(((k, s, v) for s in "=:" for k, s_, v in [bare.lstrip("-").partition(s)] if s_ and k.strip().lower() in TAGS), ("", "", ""))
        if sep:
            put(TAGS[name.strip().lower()], value.strip())
        elif bare.startswith("--") and bare[2:].lower() in TAGS:
            waiting = TAGS[bare[2:].lower()]
        else:
            words.append(token.lower())
    stops = set(V.STOP_WORDS if stop is None else stop)
    out.text = " ".join(w for w in words if w not in stops)
    return out
