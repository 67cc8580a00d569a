"""Quality rules with adaptive thresholds (operator 8), in DataFrame functions only.

Each document gets rates (symbols, repeated windows of words, repeated lines, capitals, mean word
length). A mergeable quantile sketch of every rate is kept for each language and source: counts in
buckets of geometrically growing width, so that two sketches merge by adding counts and a quantile
has a bounded relative error, whatever the order of the rows. Fences are taken from the sketch of
language and source where it holds enough documents, else from the merged sketch of the language,
else from that of all documents; the thresholds are then joined to the documents.

Nulls: a null text has no words; null ``lang`` or ``source`` form groups of their own. Rows that are
alike get the same verdict each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_CLASS, Scratch, empty_text, table, words_of

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rules:
    """``fences``: for each rate, the least width of the fence above and below (None: no fence there)."""

    reach: float = 3.0
    gamma: float = 1.02
    least_docs: int = 50
    fences: dict = field(
        default_factory=lambda: {
            "symbol_rate": (0.1, None),
            "repeat_rate": (0.25, None),
            "dup_line_rate": (0.4, None),
            "capital_rate": (0.15, None),
            "mean_chars": (1.5, 1.5),
        }
    )


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` with the counts of each text."""
    d = docs.select(*keep, empty_text().alias("_t"))
    d = d.select(
        *keep,
        words_of(F.col("_t")).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]")).alias("_l"),
        (F.length("_t") - F.length(F.translate("_t", " \t\n\x0b\x0c\r", ""))).alias("_space"),
        F.length("_t").alias("_len"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(F.translate("_t", CAPITALS, ""))).cast("long").alias("n_capitals"),
    )
    m = F.greatest(F.size("_w") - 2, F.lit(0))
    d = d.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        (F.col("_len") - F.col("_space")).cast("long").alias("word_chars"),
        "n_symbols",
        "n_capitals",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform(
            F.arrays_zip(F.slice("_w", 1, m).alias("a"), F.slice("_w", 2, m).alias("b"), F.slice("_w", 3, m).alias("c")),
            lambda z, i: F.struct(F.xxhash64(z["a"], z["b"], z["c"]).alias("h"), i.alias("p")),
        ).alias("_win"),
    )
    d = d.withColumn("_win", F.sort_array("_win"))
    k = F.greatest(F.size("_win") - 1, F.lit(0))
    same = F.zip_with(
        F.slice("_win", 1, k), F.slice("_win", 2, k), lambda x, y: F.when(x["h"] == y["h"], F.array(x["p"], y["p"]))
    )
    d = d.withColumn("_pos", F.sort_array(F.array_distinct(F.flatten(F.array_compact(same))))).drop("_win")
    c = F.greatest(F.size("_pos") - 1, F.lit(0))
    gaps = F.zip_with(F.slice("_pos", 1, c), F.slice("_pos", 2, c), lambda x, y: F.least(F.lit(3), y - x))
    covered = F.aggregate(gaps, F.lit(0), lambda a, x: a + x) + F.when(F.size("_pos") > 0, 3).otherwise(0)
    return d.withColumn("n_repeat_words", covered.cast("long")).drop("_pos")


def _rate(top: str, base: str) -> Column:
    return F.when(F.col(base) > 0, F.col(top) / F.col(base)).otherwise(F.lit(0.0))


def rates(measured: DataFrame) -> DataFrame:
    return (
        measured.withColumn("symbol_rate", _rate("n_symbols", "n_words"))
        .withColumn("repeat_rate", _rate("n_repeat_words", "n_words"))
        .withColumn("dup_line_rate", _rate("n_dup_lines", "n_lines"))
        .withColumn("capital_rate", _rate("n_capitals", "word_chars"))
        .withColumn("mean_chars", _rate("word_chars", "n_words"))
    )


def bucket(x: Column, gamma: float) -> Column:
    """The sketch's bucket of a value; values of 1e-6 or less share one."""
    return F.when(x <= 1e-6, F.lit(-100000)).otherwise(F.ceil(F.log(x) / F.log(F.lit(gamma))).cast("int"))


def sketches(rated: DataFrame, rules: Rules) -> DataFrame:
    """One row per language, source, rate and bucket with its count: the sketches, which merge by adding."""
    each = F.explode(
        F.array(*[F.struct(F.lit(k).alias("rate"), bucket(F.col(k), rules.gamma).alias("b")) for k in rules.fences])
    )
    return (
        rated.filter("n_words > 0").select("lang", "source", each.alias("s"))
        .groupBy("lang", "source", F.col("s.rate").alias("rate"), F.col("s.b").alias("b"))
        .agg(F.count("*").alias("n"))
    )


def quantiles(sketch: DataFrame, keys: list[str], rules: Rules) -> DataFrame:
    """The quartiles of each merged sketch: keys, rate, n, q1, q3."""
    merged = sketch.groupBy(*keys, "rate", "b").agg(F.sum("n").alias("n"))
    part = Window.partitionBy(*keys, "rate")
    run = merged.withColumn("upto", F.sum("n").over(part.orderBy("b"))).withColumn("all", F.sum("n").over(part))
    value = F.when(F.col("b") == -100000, F.lit(0.0)).otherwise(
        F.lit(2.0) * F.pow(F.lit(rules.gamma), F.col("b")) / F.lit(rules.gamma + 1)
    )
    at = lambda q: F.min(F.when(F.col("upto") >= F.lit(q) * F.col("all"), value))
    return run.groupBy(*keys, "rate").agg(F.max("all").alias("n"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def thresholds(rated: DataFrame, rules: Rules, scratch: Scratch) -> DataFrame:
    """One row per language and source: ``lo_<rate>`` and ``hi_<rate>``."""
    s = scratch.write(sketches(rated, rules))
    own = quantiles(s, ["lang", "source"], rules)
    lang = quantiles(s, ["lang"], rules).select(F.col("lang").alias("l2"), F.col("rate").alias("r2"), F.struct("n", "q1", "q3").alias("by_lang"))
    whole = quantiles(s, [], rules).select(F.col("rate").alias("r3"), F.struct("n", "q1", "q3").alias("by_all"))
    j = (
        own.join(lang, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("rate") == F.col("r2")), "left")
        .join(F.broadcast(whole), F.col("rate") == F.col("r3"), "left")  # a row for each rate: five
    )
    least = F.lit(rules.least_docs)
    j = j.withColumn(
        "q",
        F.when(F.col("n") >= least, F.struct("n", "q1", "q3"))
        .when(F.col("by_lang.n") >= least, F.col("by_lang"))
        .otherwise(F.col("by_all")),
    )
    aggs = []
    for k, (above, below) in rules.fences.items():
        q1, q3 = F.col("q.q1"), F.col("q.q3")
        wide = F.lit(rules.reach) * (q3 - q1)
        one = lambda v, k=k: F.max(F.when(F.col("rate") == k, v))
        if above is not None:
            aggs.append(one(q3 + F.greatest(wide, F.lit(float(above)))).alias(f"hi_{k}"))
        if below is not None:
            aggs.append(one(q1 - F.greatest(wide, F.lit(float(below)))).alias(f"lo_{k}"))
    return j.groupBy("lang", "source").agg(*aggs)


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, lang, source, the counts and rates, the fences, ``base_failed`` and ``kept`` of every row."""
    scratch = Scratch(docs.sparkSession, "quality")
    rated = rates(scratch.write(measures(docs, ["doc_id", "lang", "source"])))
    t = thresholds(rated, rules, scratch).withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source")
    j = rated.join(t, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    failed = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    inside = F.lit(True)
    for k, (above, below) in rules.fences.items():
        if above is not None:
            inside = inside & (F.col(k) <= F.col(f"hi_{k}"))
        if below is not None:
            inside = inside & (F.col(k) >= F.col(f"lo_{k}"))
    return (
        j.withColumn("base_failed", failed)
        .withColumn("kept", F.when(failed, F.lit(False)).otherwise(F.coalesce(inside, F.lit(False))))
        .drop("_lang", "_source")
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql() -> str:
    r = Rules()
    rate = {
        "symbol_rate": "case when n_words>0 then n_symbols::double/n_words else 0.0 end",
        "repeat_rate": "case when n_words>0 then n_repeat_words::double/n_words else 0.0 end",
        "dup_line_rate": "case when n_lines>0 then n_dup_lines::double/n_lines else 0.0 end",
        "capital_rate": "case when word_chars>0 then n_capitals::double/word_chars else 0.0 end",
        "mean_chars": "case when n_words>0 then word_chars::double/n_words else 0.0 end",
    }
    value = f"case when b=-100000 then 0.0 else 2.0*pow({r.gamma},b)/{r.gamma + 1} end"
    levels = {"own": "lang,source,", "bl": "lang,", "ba": ""}
    q = ""
    for name, keys in levels.items():
        q += f"""
, {name}0 as (select {keys}rate,b,sum(n) n from sk group by all)
, {name}1 as (select *,sum(n) over (partition by {keys}rate order by b) upto,sum(n) over (partition by {keys}rate) total from {name}0)
, {name} as (select {keys}rate,max(total) n,min(case when upto>=0.25*total then {value} end) q1,min(case when upto>=0.75*total then {value} end) q3 from {name}1 group by all)"""
    cond = []
    for k, (above, below) in r.fences.items():
        if above is not None:
            cond.append(f"m.{k} <= max(case when rate='{k}' then q3+greatest({r.reach}*(q3-q1),{above}) end)")
        if below is not None:
            cond.append(f"m.{k} >= max(case when rate='{k}' then q1-greatest({r.reach}*(q3-q1),{below}) end)")
    cols = ",".join(f"m.{k}" for k in rate)
    return rf"""
with d as (select row_number() over () rid,doc_id,lang,source,coalesce(text,'') t from documents)
, w as (select rid,list_filter(regexp_split_to_array(t,'[\x20\x09-\x0D]+'),lambda x: x<>'') w,
  list_filter(string_split(t,chr(10)),lambda x: regexp_matches(x,'[^\x20\x09-\x0D]')) l from d)
, g as (select rid,i,w[i]||' '||w[i+1]||' '||w[i+2] g from (select rid,w,unnest(range(1,len(w)-1)) i from w))
, gp as (select rid,i from (select *,count(*) over (partition by rid,g) c from g) where c>1)
, rp as (select rid,sum(coalesce(least(3,nx-i),3)) n from (select rid,i,lead(i) over (partition by rid order by i) nx from gp) group by rid)
, m0 as (select d.doc_id,lang,source,len(w.w) n_words,len(regexp_replace(t,'[\x20\x09-\x0D]','','g')) word_chars,
  len(regexp_replace(t,'[^#*$%&|<>]','','g')) n_symbols,len(regexp_replace(t,'[^A-Z]','','g')) n_capitals,len(l) n_lines,
  len(l)-len(list_distinct(l)) n_dup_lines,coalesce(rp.n,0) n_repeat_words from d join w using(rid) left join rp using(rid))
, m as (select *,{",".join(f"{v} {k}" for k, v in rate.items())} from m0)
, sk as (select lang,source,rate,case when x<=1e-6 then -100000 else ceil(ln(x)/ln({r.gamma}))::int end b,count(*) n from
  (unpivot (select lang,source,{",".join(rate)} from m where n_words>0) on {",".join(rate)} into name rate value x) group by all)
{q}
, th as (select own.lang,own.source,own.rate,
  case when own.n>={r.least_docs} then own.q1 when bl.n>={r.least_docs} then bl.q1 else ba.q1 end q1,
  case when own.n>={r.least_docs} then own.q3 when bl.n>={r.least_docs} then bl.q3 else ba.q3 end q3
  from own join bl on own.lang is not distinct from bl.lang and own.rate=bl.rate join ba on own.rate=ba.rate)
, ok as (select rid0,{" and ".join(cond)} inside from (select row_number() over () rid0,* from m) m join th on m.lang is not distinct from th.lang and m.source is not distinct from th.source
  group by rid0,{cols})
select doc_id,n_words::bigint n_words,word_chars::bigint word_chars,n_symbols::bigint n_symbols,n_dup_lines::bigint n_dup_lines,n_repeat_words::bigint n_repeat_words,
 (n_words<50 or 100*n_repeat_words>50*n_words) base_failed,
 case when n_words<50 or 100*n_repeat_words>50*n_words then false else coalesce(inside,false) end kept
from (select row_number() over () rid0,* from m) m left join ok using(rid0)"""


ORACLE = _sql()
