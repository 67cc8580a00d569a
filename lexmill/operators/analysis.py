"""Tokens, frequencies, inverted index, case statistics and query candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def article_tokens(alphabet: str = T.CYRILLIC, stop: list[str] | None = None, content: bool = True, least: int = 3, most: int = 50) -> Column:
    """Distinct tokens of title, then content."""
    t = T.tokenize(F.col("title"), alphabet, stop, least, most)
    return F.array_union(t, T.tokenize(F.col("content"), alphabet, stop, least, most)) if content else t


def doc_words(articles: DataFrame, key: str = "id", **kw) -> DataFrame:
    """(key, words): the distinct words of an article."""
    return articles.select(key, article_tokens(**kw).alias("words"))


def doc_tokens(articles: DataFrame, key: str = "id", **kw) -> DataFrame:
    """(key, word): each word of an article once."""
    return articles.select(key, F.explode(article_tokens(**kw)).alias("word"))


def word_frequencies(tokens: DataFrame) -> DataFrame:
    """Document frequency: each article counts once."""
    return tokens.groupBy("word").agg(F.count("*").alias("df"))


def filter_by_frequency(freq: DataFrame, least: int = 2, most: int | None = None) -> DataFrame:
    out = freq.filter(F.col("df") >= least)
    return out if most is None else out.filter(F.col("df") <= most)


def inverted_index(tokens: DataFrame, least: int = 2, most: int | None = None, excluded: list[str] | None = None, key: str = "id") -> DataFrame:
    """(word, key) within the band of document frequency: the postings stay rows, so no word needs one task."""
    keep = filter_by_frequency(word_frequencies(tokens), least, most)
    out = tokens.join(keep, "word")
    return out.filter(~F.col("word").isin([w.lower() for w in excluded])) if excluded else out


def posting_lists(index: DataFrame, key: str = "id") -> DataFrame:
    return index.groupBy("word").agg(F.sort_array(F.collect_set(key)).alias("ids"))


def case_stats(articles: DataFrame, alphabet: str = T.CYRILLIC) -> DataFrame:
    """Of every word all occurrences, capitalised and not, with the share of capitals."""
    w = F.explode(F.concat(T.raw_words(F.col("title"), alphabet), T.raw_words(F.col("content"), alphabet)))
    up = F.when(F.col("w").rlike(r"^\p{Lu}"), 1).otherwise(0)
    g = articles.select(w.alias("w")).groupBy(F.lower("w").alias("word")).agg(F.sum(up).cast("long").alias("capitalised"), F.sum(1 - up).cast("long").alias("lower_case"))
    return g.withColumn("ratio", F.col("capitalised") / (F.col("capitalised") + F.col("lower_case")))


def proper_nouns(stats: DataFrame, least: int = 2, ratio: float = 0.8) -> DataFrame:
    return stats.filter((F.col("capitalised") >= least) & (F.col("ratio") >= ratio))


def query_candidates(articles: DataFrame, key: str = "id", **kw) -> DataFrame:
    """(key, pos, query) of each article: title, its first words, tokens with and without category, author parts."""
    title = T.normalize(F.col("title"))
    words = F.slice(F.filter(F.split(title, " "), lambda x: F.length(x) > 2), 1, 5)
    d = articles.select(key, title.alias("t"), words.alias("w"), article_tokens(**kw).alias("tok"), T.normalize_or_null(F.col("category")).alias("c"), F.get(F.filter(F.split(T.normalize(F.col("author")), " "), lambda x: x != ""), F.lit(0)).alias("a"))
    first = lambda n: F.when(F.size("w") >= n, F.array_join(F.slice("w", 1, n), " "))
    per = F.flatten(F.transform(F.slice("tok", 1, 6), lambda x: F.array(x, F.concat_ws(" ", F.col("c"), x))))
    per = F.when(F.col("c").isNull(), F.slice("tok", 1, 6)).otherwise(per)
    cand = F.concat(F.array(F.nullif("t", F.lit("")), first(2), first(3)), per, F.array(F.col("a"), F.when(F.size("tok") > 0, F.concat_ws(" ", F.col("a"), F.get("tok", F.lit(0)))).otherwise(F.lit(None))))
    cand = F.when(F.col("a").isNull(), F.slice(cand, 1, F.size(cand) - 2)).otherwise(cand)
    return d.select(key, F.posexplode(F.array_compact(cand)).alias("pos", "query"))


def fallback_queries(freq: DataFrame, least: int = 3, top: int = 3000) -> DataFrame:
    """The ``top`` most frequent words and each with its successor."""
    best = filter_by_frequency(freq, least).orderBy(F.desc("df"), "word").limit(top)
    w = Window.orderBy(F.desc("df"), "word")  # over at most ``top`` rows
    d = best.select("word", F.row_number().over(w).alias("rank"), F.lead("word").over(w).alias("next"))
    return d.select("rank", F.explode(F.array_compact(F.array("word", F.when(F.col("next").isNotNull(), F.concat_ws(" ", "word", "next"))))).alias("query"))


def generate_queries(candidates: DataFrame, n: int, seed: int = 7, key: str = "id") -> DataFrame:
    """``n`` distinct queries: articles in seeded order, the first use of a text wins whatever its case."""
    order = F.struct(F.xxhash64(F.col(key), F.lit(seed)).alias("h"), F.col(key), "pos")
    first = candidates.groupBy(F.lower("query").alias("q")).agg(F.min(F.struct(order.alias("o"), "query")).alias("m"))
    return first.select("m.query", "m.o").orderBy("o").limit(n).select("query")
