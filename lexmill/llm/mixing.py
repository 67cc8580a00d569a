"""Mixing sources to target weights by hierarchical budgets (operator 2).

The sources form a tree, domain - language - source by default. A budget of tokens is passed down
from the root: the children of a node share its budget by their weights, none gets more than it can
give (its tokens times ``max_epochs``), and what one cannot give is shared among its siblings by
their weights as long as they can give it. As a node's limit is the sum of its children's, only what
no sibling can take reaches the ancestors. Shares come from sorting the siblings by the ratio of
limit and weight, without iteration.

A leaf with budget A and T tokens gets A // T whole epochs and a prefix of one more, whose documents
stand in an order seeded by (seed, epoch): all documents before the first that starts at or past the
rest of the budget. The end of the prefix is found from sums over 4096 ranges of the order, then over
4096 parts of the one range that holds the end, so no task sees a whole leaf. It becomes a key, and
documents are selected by comparing keys with it: texts are never shuffled.

Nulls: a null level is a branch of its own, a null text has no tokens, null ids share one place in the
order. Rows of one id in one leaf stand at one place and are taken together; texts without tokens
take part and cost nothing, very long ones cost all their tokens; an empty table gives an empty mix. Columns are
passed on as they are, whatever their names; only a column ``epoch`` is replaced by the epoch that took the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, empty_text, fresh, table, words_of


@dataclass(frozen=True)
class Mix:
    """``budget`` is a share of all tokens. Weights of siblings: ``weights`` by (level, value), else tokens ** ``power``."""

    budget: float = 1.0
    power: float = 0.7
    max_epochs: int = 2
    seed: int = 17
    levels: tuple[str, ...] = ("domain", "lang", "source")
    weights: tuple[tuple[str, str, float], ...] = ()


def _same(keys: list[str], suffix: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{k}{suffix}"))
    return out


def _given(mix: Mix, level: str) -> Column:
    out = F.pow(F.col("tokens").cast("double"), F.lit(mix.power))
    for lv, value, w in mix.weights:
        if lv == level:
            out = F.when(F.col(level) == value, F.lit(float(w))).otherwise(out)
    return out


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``leaves`` (the levels and ``tokens``, a row each) with the tokens that each is to give: ``budget``."""
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    up = total.select((F.col("tokens") * F.lit(mix.budget)).alias("budget"))
    for depth in range(len(mix.levels)):
        keys, above, level = list(mix.levels[: depth + 1]), list(mix.levels[:depth]), mix.levels[depth]
        n = leaves.groupBy(*keys).agg(F.sum("tokens").alias("tokens")).withColumn("cap", F.col("tokens") * F.lit(float(mix.max_epochs)))
        n = n.withColumn("w", _given(mix, level))
        parent = up.select(*[F.col(k).alias(f"{k}_up") for k in above], F.col("budget").alias("whole"))
        n = n.join(parent, _same(above, "_up")) if above else n.join(F.broadcast(parent))  # the root is one row
        n = n.drop(*[f"{k}_up" for k in above])
        # of the siblings in order of cap / w, those up to k are full when the rest can't reach the ratio of k
        part = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        ratio = F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf")))
        n = n.withColumn("ratio", ratio)
        run = part.orderBy("ratio", level).rowsBetween(Window.unboundedPreceding, -1)
        n = n.withColumn("full", F.coalesce(F.sum("cap").over(run), F.lit(0.0)))
        n = n.withColumn("rest", F.sum("w").over(part) - F.coalesce(F.sum("w").over(run), F.lit(0.0)))
        n = n.withColumn("level", F.when(F.col("rest") > 0, (F.col("whole") - F.col("full")) / F.col("rest")))
        open_ = F.when((F.col("w") > 0) & (F.col("level") < F.col("ratio")), F.col("level"))
        n = n.withColumn("water", F.max(open_).over(part))
        n = n.withColumn("budget", F.when(F.col("w") <= 0, 0.0).when(F.col("water").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("water") * F.col("w"))))
        up = n.select(*keys, "tokens", "budget")
    return up.withColumn("budget", F.floor(F.round("budget", 3)).cast("long"))


def order_key(seed: int, epoch: Column, doc_id: str = "doc_id") -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def _end(items: DataFrame, leaf: list[str], mark: str) -> DataFrame:
    """Of each leaf's items in order of ``mark``, the last that starts before ``rest``; ``rest`` then counts from its start."""
    sums = items.groupBy(*leaf, mark).agg(F.sum("n").alias("n"), F.max("rest").alias("rest"))
    w = Window.partitionBy(*leaf).orderBy(mark).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return sums.filter("before < rest").groupBy(*leaf).agg(F.max_by(F.struct(mark, (F.col("rest") - F.col("before")).alias("rest")), mark).alias("e")).select(*leaf, "e.*")


def cuts(items: DataFrame, mix: Mix, scratch: Scratch) -> DataFrame:
    """For each leaf and epoch from 0 the last order key that is in: the levels, ``epoch``, ``cut``.

    ``items`` has a row per document: the levels, doc_id and n (its tokens).
    """
    leaf = list(mix.levels)
    plan = budgets(items.groupBy(*leaf).agg(F.sum("n").alias("tokens")), mix)
    empty = F.col("tokens") == 0
    whole = F.when(empty, F.lit(1)).otherwise(F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).cast("int")
    rest = F.when(empty, F.lit(0)).otherwise(F.col("budget") % F.greatest("tokens", F.lit(1)))
    plan = scratch.write(plan.withColumn("whole", whole).withColumn("rest", rest))
    part = plan.filter("rest > 0").select(*[F.col(k).alias(f"{k}_p") for k in leaf], "whole", "rest")
    keyed = items.join(part, _same(leaf, "_p")).drop(*[f"{k}_p" for k in leaf])
    keyed = scratch.write(keyed.select(*leaf, "n", "rest", order_key(mix.seed, F.col("whole")).alias("key")))
    found = keyed.drop("rest")
    # two steps of 4096 ranges each, then single documents in what is one part in 16 million of a leaf
    ends = _end(keyed.withColumn("m", F.substring("key", 1, 3)), leaf, "m")
    for width in (6, None):
        ends = ends.select(*[F.col(k).alias(f"{k}_p") for k in leaf], F.col("m").alias("m_p"), "rest")
        inside = found.join(ends, _same(leaf, "_p") & F.col("key").startswith(F.col("m_p"))).drop("m_p", *[f"{k}_p" for k in leaf])
        ends = _end(inside.withColumn("m", F.substring("key", 1, width) if width else F.col("key")), leaf, "m")
    full = plan.filter("whole > 0").select(*leaf, F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"), F.lit("g").alias("cut"))
    last = plan.select(*[F.col(k).alias(f"{k}_p") for k in leaf], "whole")
    last = ends.join(last, _same(leaf, "_p")).select(*leaf, F.col("whole").alias("epoch"), F.col("m").alias("cut"))
    return scratch.write(full.unionByName(last))


def mixed(docs: DataFrame, mix: Mix = Mix(), extra: dict[str, Column] | None = None) -> DataFrame:
    """The rows of ``docs`` that each epoch takes, with ``epoch``; ``extra``: levels that ``docs`` lacks, as columns."""
    scratch = Scratch(docs.sparkSession, "mixing")
    leaf, extra = list(mix.levels), extra or {}
    level = lambda k: (extra[k] if k in extra else F.col(k)).cast("string")
    items = docs.select(*[level(k).alias(k) for k in leaf], "doc_id", F.size(words_of(empty_text())).cast("long").alias("n"))
    x = fresh()  # columns of ``docs`` may have any name
    c = cuts(scratch.write(items), mix, scratch).select(*[F.col(k).alias(f"{x}_{k}") for k in leaf], F.col("epoch").alias(f"{x}epoch"), F.col("cut").alias(f"{x}cut"))
    on = order_key(mix.seed, F.col(f"{x}epoch")) <= F.col(f"{x}cut")
    for k in leaf:
        on = on & level(k).eqNullSafe(F.col(f"{x}_{k}"))
    return docs.drop("epoch").join(c, on).drop(f"{x}cut", *[f"{x}_{k}" for k in leaf]).withColumnRenamed(f"{x}epoch", "epoch")


def domain() -> Column:
    """The tables name no domain, so sources are dealt to four by the checksum of their name."""
    return F.concat(F.lit("domain"), (F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")) % 4).cast("string"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixed(docs, Mix(), {"domain": domain()}).select("doc_id", domain().alias("domain"), "lang", "source", "epoch")


def _same_sql(keys: list[str], a: str, b: str) -> str:
    return " and ".join(f"{a}.{k} is not distinct from {b}.{k}" for k in keys) or "true"


def sql(mix: Mix = Mix(), source: str = "documents", domain_sql: str | None = None) -> str:
    """CTEs that end in ``mixed``: the rows of ``source`` that each epoch takes, for weights by ``power`` alone.

    DuckDB has no crc32, so the names of the domains are given for the sources src0 to src19.
    """
    import zlib

    names = ",".join(f"'src{i}': 'domain{zlib.crc32(f'src{i}'.encode()) % 4}'" for i in range(20))
    dom = domain_sql or f"(map {{{names}}})[source]"
    out = rf"""x0 as (select row_number() over () rid,*,{dom} as "domain" from {source})
, xi as (select *,len(list_filter(regexp_split_to_array(coalesce(text,''),'[\x20\x09-\x0D]+'),lambda v: v<>'')) n from x0)
, u0 as (select sum(n)*{mix.budget} budget from xi)"""
    for i, level in enumerate(mix.levels, 1):
        keys, above = list(mix.levels[:i]), list(mix.levels[: i - 1])
        over = f"partition by {','.join(above)}" if above else ""
        run = f"over ({over} order by ratio,{level} nulls first rows between unbounded preceding and 1 preceding)"
        out += f"""
, a{i} as (select {",".join(keys)},sum(n) tokens,sum(n)*{float(mix.max_epochs)} cap,pow(sum(n)::double,{mix.power}) w from xi group by all)
, b{i} as (select a{i}.*,u{i - 1}.budget as whole,case when w>0 then cap/w else 'inf'::double end ratio from a{i} join u{i - 1} on {_same_sql(above, f"a{i}", f"u{i - 1}")})
, c{i} as (select *,coalesce(sum(cap) {run},0) as filled,sum(w) over ({over})-coalesce(sum(w) {run},0) remaining from b{i})
, d{i} as (select *,case when remaining>0 then (whole-filled)/remaining end lev from c{i})
, e{i} as (select *,max(case when w>0 and lev<ratio then lev end) over ({over}) water from d{i})
, u{i} as (select {",".join(keys)},tokens,case when w<=0 then 0 when water is null then cap else least(cap,water*w) end budget from e{i})"""
    leaf, last = list(mix.levels), len(mix.levels)
    return out + f"""
, p as (select * exclude(budget),case when tokens=0 then 1 else floor(floor(round(budget,3))/greatest(tokens,1)) end::int as entire,
   case when tokens=0 then 0 else floor(round(budget,3))::bigint % greatest(tokens,1)::bigint end as rest from u{last})
, f as (select rid,unnest(range(entire)) epoch from xi join p on {_same_sql(leaf, "xi", "p")} where entire>0)
, k as (select rid,xi.domain,xi.lang,xi.source,n,entire,rest,md5('{mix.seed}-'||entire||'-'||coalesce(doc_id::varchar,'')) k from xi join p on {_same_sql(leaf, "xi", "p")} where rest>0)
, kk as (select *,coalesce(sum(n) over (partition by domain,lang,source order by k),0)-sum(n) over (partition by domain,lang,source,k) before from k)
, sel as (select rid,epoch from f union all select rid,entire from kk where before<rest)
, mixed as (select x0.*,sel.epoch::int epoch from x0 join sel using(rid))"""


ORACLE = f"with {sql()} select doc_id,domain,lang,source,epoch from mixed"
