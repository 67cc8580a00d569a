"""Removing repeated passages of lines (operator 6).

Lines are compared without the white space at their ends; blank lines are neither compared nor
removed. Each three consecutive lines of a text form a window; windows overlap. A window that occurs
more than once in the corpus is kept where it comes first, by doc_id and then by position, and every
later occurrence covers its three lines; covered lines are removed, each once, however many windows
cover it. Windows are keyed by 128 bits of hash, counted with partial sums before the shuffle, and
only positions travel to the documents again.

Nulls: a null text has no lines and comes back as an empty text; null ids are one id of their own.
Texts with fewer than three lines never change. Rows alike in doc_id and text share their fate and all
stay; rows of one doc_id with different texts are kept apart. Very long texts are cut whole, within their row. Other
columns pass through unchanged, whatever their names; ``n_lines`` and ``n_removed`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, empty_text, fresh, table

EDGE = " \t\x0b\x0c\r"


def _windows(docs: DataFrame) -> DataFrame:
    """A row per window: the document's key, the window's number and hash, and its three line numbers."""
    lines = F.filter(
        F.transform(F.split("_t", "\n"), lambda x, i: F.struct(F.btrim(x, F.lit(EDGE)).alias("s"), i.alias("p"))),
        lambda x: x["s"] != "",
    )
    d = docs.select("doc_id", empty_text().alias("_t")).select("doc_id", F.xxhash64("_t").alias("_h"), lines.alias("_l"))
    m = F.greatest(F.size("_l") - 2, F.lit(0))
    three = F.arrays_zip(F.slice("_l", 1, m).alias("a"), F.slice("_l", 2, m).alias("b"), F.slice("_l", 3, m).alias("c"))
    window = F.transform(
        three,
        lambda z, i: F.struct(
            i.alias("w"),
            F.xxhash64(z["a"]["s"], z["b"]["s"], z["c"]["s"]).alias("h1"),
            F.xxhash64(F.lit("|"), z["c"]["s"], z["a"]["s"], z["b"]["s"]).alias("h2"),
            F.array(z["a"]["p"], z["b"]["p"], z["c"]["p"]).alias("p"),
        ),
    )
    return d.select("doc_id", "_h", F.explode(window).alias("x")).select("doc_id", "_h", "x.*")


def covered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """For each document with lines to go: its key and the line numbers ``gone``."""
    win = scratch.write(_windows(docs))
    place = F.struct("doc_id", "_h", "w")
    first = win.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    # merged at every size, as neither side has a bound; Spark splits the partitions of hot windows
    later = win.join(first.drop("n").hint("merge"), ["h1", "h2"]).filter(place > F.col("first"))
    return later.select("doc_id", "_h", F.explode("p").alias("p")).groupBy("doc_id", "_h").agg(F.collect_set("p").alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with cleaned ``text``, and ``n_lines`` and ``n_removed`` beside its columns."""
    scratch = Scratch(docs.sparkSession, "lines")
    own, key, id_, gone, lines, stay = (fresh() for _ in range(6))  # columns of ``docs`` may have any name
    away = scratch.write(covered(docs, scratch)).select(F.col("doc_id").alias(id_), F.col("_h").alias(key), F.col("gone").alias(gone)).hint("merge")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    d = docs.select(*names).withColumn("text", empty_text()).withColumn(own, F.xxhash64("text"))
    d = d.join(away, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(key)), "left")
    d = d.withColumn(lines, F.split("text", "\n"))
    d = d.withColumn(stay, F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n"))
    return d.select(
        *[text.alias("text") if c == "text" else c for c in names],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def sql(source: str = "documents") -> str:
    """CTEs that end in ``deduped``: the rows of ``source`` with n_lines, n_removed and the cleaned text."""
    return rf"""l0 as (select row_number() over () rid,* replace (coalesce(text,'') as text) from {source})
, l1 as (select rid,doc_id,text,unnest(range(len(string_split(text,chr(10))))) p from l0)
, l2 as (select rid,doc_id,text tx,p,string_split(text,chr(10))[p+1] raw from l1)
, l3 as (select *,trim(raw,' '||chr(9)||chr(11)||chr(12)||chr(13)) s from l2)
, l4 as (select *,row_number() over (partition by rid order by p)-1 w,lead(s,1) over (partition by rid order by p) s2,lead(s,2) over (partition by rid order by p) s3,
   lead(p,1) over (partition by rid order by p) p2,lead(p,2) over (partition by rid order by p) p3 from l3 where s<>'')
, l5 as (select *,count(*) over (partition by s,s2,s3) n,min(doc_id) over (partition by s,s2,s3) fd from l4 where s3 is not null)
, l6 as (select *,min(case when doc_id=fd then w end) over (partition by s,s2,s3) fw from l5 where n>1)
, l7 as (select * from l6 where doc_id>fd or w>fw)
, l8 as (select rid,p from l7 union select rid,p2 from l7 union select rid,p3 from l7)
, l9 as (select rid,count(*) n_lines,count(l8.p) n_removed,coalesce(string_agg(raw,chr(10) order by p) filter (where l8.p is null),'') kept from l2 left join l8 using(rid,p) group by rid)
, deduped as (select l0.* exclude(rid,text),l9.kept as text,l9.n_lines::bigint n_lines,l9.n_removed::bigint n_removed from l0 join l9 using(rid))"""


ORACLE = f"with {sql()} select doc_id,n_lines,n_removed,text from deduped"
