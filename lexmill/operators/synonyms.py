"""Mining synonyms from words that share articles, validating, grouping and using them."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import values as V
from . import analysis as A
from .components import components
from .cooccurrence import counted_pairs


#: Words of an article that are counted in one run, with 128 others each; wider articles take several.
WIDE = 4096
#: Bits that say which hashes of pairs are asked for, as a power of 2.
MOST_BITS = 29


@dataclass(frozen=True)
class Options:
    min_similarity: float = 0.25
    min_co_occurrences: int = 2
    min_word_length: int = 3
    max_word_length: int = 30
    use_titles: bool = True
    use_content: bool = True
    title_weight: float = 2.0
    max_synonyms: int = 15
    min_frequency: int = 2
    max_frequency: int | None = None
    excluded: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()
    exclude_proper_nouns: bool = True
    min_proper_noun: int = 2
    proper_noun_ratio: float = 0.8
    exclude_compounds: bool = True
    min_compound: int = 3
    morphological: float = 0.78
    alphabet: str = T.CYRILLIC
    stop: tuple[str, ...] | None = field(default=None)


def word_pairs(tokens: DataFrame, o: Options = Options(), key: str = "id", top: bool = True) -> DataFrame:
    """Pairs word1 < word2 that share articles: co, df1, df2, jaccard, cosine, and the best of each word1.

    ``tokens`` has a row for each word of an article (word) or for each article (words). Words are counted in blocks (``cooccurrence``):
    at the similarities asked here a prefix filter on the sets of articles would keep most of their articles. Words whose frequencies
    alone rule the similarity out don't meet.
    """
    t = o.min_similarity
    banned = [w.lower() for w in (*o.excluded, *o.forbidden)]
    lists = tokens if "words" in tokens.columns else tokens.groupBy(key).agg(F.sort_array(F.collect_set("word")).alias("words")).sortWithinPartitions(key)
    found, vocab = counted_pairs(lists, max(o.min_frequency, o.min_co_occurrences), o.max_frequency, banned, t, o.min_co_occurrences, 128 * WIDE)
    for i in ("1", "2"):
        found = found.join(vocab.select(F.col("r").alias(f"r{i}"), F.struct("word", "df").alias(f"w{i}")), f"r{i}")
    found = found.select(F.least("w1", "w2").alias("x"), F.greatest("w1", "w2").alias("y"), F.col("co").cast("long").alias("co"))
    p = found.select(F.col("x.word").alias("word1"), F.col("y.word").alias("word2"), F.col("x.df").alias("df1"), F.col("y.df").alias("df2"), "co")
    p = p.withColumn("jaccard", F.col("co") / (F.col("df1") + F.col("df2") - F.col("co"))).withColumn("cosine", F.col("co") / F.sqrt(F.col("df1") * F.col("df2")))
    return top_pairs(p, o.max_synonyms) if top else p


def top_pairs(pairs: DataFrame, n: int = 15) -> DataFrame:
    w = Window.partitionBy("word1").orderBy(F.desc("jaccard"), "word2")
    return pairs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).drop("r")


def morphological(a: Column, b: Column, threshold: float = 0.78) -> Column:
    """Equal words, or words of 3 letters or more with a long common beginning or ending or a small distance."""
    least = F.least(F.length(a), F.length(b))
    k = F.least(F.lit(4), least - 1)
    near = 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)) >= threshold
    return (a == b) | ((least >= 3) & ((F.left(a, k) == F.left(b, k)) | ((least >= 4) & (F.right(a, F.lit(4)) == F.right(b, F.lit(4)))) | near))


def pair_bits(pairs: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each hash of a pair, at most 64 MB, and how many leading bits of a hash count."""
    bits = min(MOST_BITS, max(20, (64 * pairs.count()).bit_length()))
    part = bits - 8

    def run(rows):
        held = {}
        for r in rows:
            b = r.column(0).to_numpy()
            for k in np.unique(b >> part).tolist():
                held.setdefault(k, np.zeros(1 << part, bool))[b[b >> part == k] & ((1 << part) - 1)] = True
        for k, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())], ["part", "bits"])

    h = pairs.select(F.shiftrightunsigned(pair_hash(F.col("word1"), F.col("word2")), 64 - bits).alias("b")).repartition(F.shiftright("b", part))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in h.mapInArrow(run, "part bigint, bits binary").collect():  # 256 rows
        x = np.frombuffer(r["bits"], np.uint8)
        out[r["part"] * len(x) : (r["part"] + 1) * len(x)] = x
    return out, bits


def pair_hash(a: Column, b: Column) -> Column:
    return F.xxhash64(F.least(a, b), F.greatest(a, b))


def collocations(articles: DataFrame, pairs: DataFrame, alphabet: str = T.CYRILLIC) -> DataFrame:
    """How often the words of a pair stand next to each other, in either order, over titles and contents.

    Neighbours are counted if the hash of a pair has their bit, so those of no pair are not dealt out; a bit too many changes no count.
    """
    bits, lead = pair_bits(pairs)
    shared = articles.sparkSession.sparkContext.broadcast(bits)

    def asked(rows):
        has = shared.value
        for r in rows:
            at = r.column(2).to_numpy().view(np.uint64) >> np.uint64(64 - lead)
            yield r.select(["x", "y"]).filter(pa.array((has[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1))

    words = F.explode(F.array("title", "content")).alias("t")
    seq = articles.select(words).select(F.split(F.lower("t"), " ").alias("w"))
    grams = seq.select(F.explode(F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("x"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("y"))).alias("g"))
    # phrases are matched without word boundaries: the first word may end, the second begin, a longer one
    g = grams.select(F.regexp_extract("g.x", rf"([{alphabet}]+)\z", 1).alias("x"), F.regexp_extract("g.y", f"^([{alphabet}]+)", 1).alias("y")).filter("x <> '' and y <> ''")
    g = g.select("x", "y", pair_hash(F.col("x"), F.col("y")).alias("h")).mapInArrow(asked, "x string, y string").groupBy("x", "y").agg(F.count("*").alias("n"))
    j = pairs.select("word1", "word2").distinct()
    one = j.join(g, (F.col("word1") == F.col("x")) & (F.col("word2") == F.col("y"))).select("word1", "word2", "n")
    two = j.join(g, (F.col("word2") == F.col("x")) & (F.col("word1") == F.col("y"))).select("word1", "word2", "n")
    return one.unionByName(two).groupBy("word1", "word2").agg(F.sum("n").alias("n"))


def validate(pairs: DataFrame, articles: DataFrame, o: Options = Options()) -> DataFrame:
    """Pairs without proper nouns, forbidden words, variants of one word and fixed phrases."""
    ok = lambda c: (F.length(c) >= o.min_word_length) & (F.length(c) <= o.max_word_length)
    p = pairs.filter(ok("word1") & ok("word2") & (F.col("df1") >= o.min_frequency) & (F.col("df2") >= o.min_frequency))
    p = p.filter(~morphological(F.col("word1"), F.col("word2"), o.morphological))
    near = p
    if o.exclude_proper_nouns:
        names = A.proper_nouns(A.case_stats(articles, o.alphabet), o.min_proper_noun, o.proper_noun_ratio).select("word")
        for k in ("word1", "word2"):
            p = p.join(names.withColumnRenamed("word", k), k, "left_anti")
    if o.exclude_compounds:
        strong = collocations(articles, near, o.alphabet).filter(F.col("n") >= o.min_compound)
        p = p.join(strong, ["word1", "word2"], "left_anti")
    return p


def groups(pairs: DataFrame) -> DataFrame:
    """(word, label): the groups that pairs make."""
    return components(pairs.select(F.col("word1").alias("a"), F.col("word2").alias("b"))).withColumnRenamed("node", "word")


def predefined(spark: SparkSession) -> DataFrame:
    rows = [x for k in V.SPORT_KINDS for x in ((V.SPORT, k), (k, V.SPORT))]
    return spark.createDataFrame(rows, "word string, synonym string")


def edges(pairs: DataFrame, spark: SparkSession, add_predefined: bool = True) -> DataFrame:
    """(word, synonym) both ways, with the predefined ones."""
    both = pairs.select(F.col("word1").alias("word"), F.col("word2").alias("synonym"))
    both = both.unionByName(pairs.select(F.col("word2").alias("word"), F.col("word1").alias("synonym")))
    return (both.unionByName(predefined(spark)) if add_predefined else both).distinct()


def confidences(pairs: DataFrame, valid: DataFrame) -> DataFrame:
    """(word, confidence) of the words in kept pairs that come first in a pair: the mean similarity of their kept pairs, 0.5 if they are second in all of these."""
    j = pairs.select(F.col("word1").alias("word"), "word2", "jaccard").join(valid.select(F.col("word1").alias("word"), "word2", F.lit(1).alias("k")), ["word", "word2"], "left")
    mean = j.groupBy("word").agg(F.avg(F.when(F.col("k") == 1, F.col("jaccard"))).alias("m"))
    kept = valid.select(F.explode(F.array("word1", "word2")).alias("word")).distinct()
    return mean.join(kept, "word", "left_semi").select("word", F.when(F.col("m").isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.col("m"))).alias("confidence"))


def mining_stats(pairs: DataFrame, articles: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """Similarities of the kept pairs (none given: all), how many words come first in a pair, and the articles."""
    words = pairs.agg(F.countDistinct("word1").alias("total_words"))
    p = pairs if valid is None else valid
    of = lambda f: F.coalesce(f("jaccard"), F.lit(0.0))
    s = p.agg(F.count("*").alias("total_pairs"), of(F.min).alias("min_similarity"), of(F.avg).alias("avg_similarity"), of(F.max).alias("max_similarity"))
    return s.crossJoin(words).crossJoin(articles.agg(F.count("*").alias("articles_analyzed")))  # three single rows


def mine(articles: DataFrame, o: Options = Options()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, confidences and statistics of ``articles`` (id, title, content)."""
    a = articles if o.use_titles else articles.withColumn("title", F.lit(""))
    tok = A.doc_words(a, alphabet=o.alphabet, stop=None if o.stop is None else list(o.stop), content=o.use_content, least=o.min_word_length)
    pairs = word_pairs(tok, o).persist()
    valid = validate(pairs, articles, o).persist()
    return edges(valid, articles.sparkSession), confidences(pairs, valid), mining_stats(pairs, articles, valid)


def clean_edges(raw: DataFrame) -> DataFrame:
    """Stored synonyms normalised, without words that are their own."""
    e = raw.select(T.normalize(F.col("word")).alias("word"), T.normalize(F.col("synonym")).alias("synonym"))
    return e.filter("word <> '' and synonym <> '' and word <> synonym").distinct()


def confident(e: DataFrame, conf: DataFrame, least: float, column: str = "synonym") -> DataFrame:
    """Edges whose ``column`` passes; words without a score pass."""
    if least <= 0:
        return e
    c = conf.select(F.col("word").alias("_w"), T.clamp(F.col("confidence"), 0.0, 1.0).alias("_c"))
    return e.join(c, F.col(column) == F.col("_w"), "left").filter(F.coalesce(F.col("_c") >= least, F.lit(True))).drop("_w", "_c")


def expand_query(queries: DataFrame, e: DataFrame) -> DataFrame:
    """(query_id, expanded): each word, then its synonyms in order, each text once."""
    w = queries.select("query_id", F.posexplode(F.split(T.normalize(F.col("query")), r"\s+")).alias("p", "word"))
    syn = w.join(e, "word").select("query_id", "p", F.lit(1).alias("o"), F.col("synonym").alias("t"))
    allw = w.select("query_id", "p", F.lit(0).alias("o"), F.col("word").alias("t")).unionByName(syn)
    g = allw.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("p", "o", "t"))).alias("x"))
    return g.select("query_id", F.array_join(F.array_distinct(F.transform("x", lambda z: z["t"])), " ").alias("expanded"))


def add_group(e: DataFrame, words: list[str]) -> DataFrame:
    """Edges between all words of a given group."""
    ws = sorted({w.strip().lower() for w in words if w.strip()})
    rows = [(a, b) for a in ws for b in ws if a != b]
    return e.unionByName(e.sparkSession.createDataFrame(rows, "word string, synonym string")).distinct() if rows else e


def synonym_groups(e: DataFrame, conf: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """(word, label); words of low confidence connect their group but are not in it."""
    g = components(e, "word", "synonym").withColumnRenamed("node", "word")
    return g if conf is None else confident(g, conf, least, "word")


def synonym_rules(g: DataFrame) -> DataFrame:
    """One rule per group of two or more: words in order without regard to case, joined by a comma."""
    s = g.groupBy("label").agg(F.collect_set(T.normalize(F.col("word"))).alias("w")).filter(F.size("w") >= 2)
    # upper-case order puts the letter U+0401 before the alphabet
    return s.select(F.array_join(F.transform(F.array_sort(F.transform("w", lambda x: F.struct(F.upper(x).alias("u"), x.alias("w")))), lambda z: z["w"]), ", ").alias("rule")).distinct()


def word_similarity(tokens: DataFrame, a: str, b: str, key: str = "id") -> DataFrame:
    """Jaccard of the articles of two words."""
    t = tokens.filter(F.col("word").isin(a.lower(), b.lower())).groupBy(key).agg(F.countDistinct("word").alias("n"))
    return t.agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("n") == 2, 1).otherwise(0)), F.count("*")), F.lit(0.0)).alias("jaccard"))
