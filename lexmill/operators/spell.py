"""Spelling correction: a chain of checkers, each a function from a query column to a column.

A checker turns a query into its correction (the query itself if there is none). The chain feeds each
checker with what the one before returned and records the steps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

Checker = Callable[[Column], Column]


def _per_word(c: Column, fix: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), fix), " ")


def nearest_word(word: Column, words: list[str], most: int = 2) -> Column:
    """The word at the least distance from 1 to ``most``; then the longer, then the earlier one; null if there is none."""
    cand = F.array(*[F.struct(F.levenshtein(word, F.lit(w)).alias("d"), F.lit(-len(w)).alias("l"), F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(words)])
    return F.array_min(F.filter(cand, lambda x: x["d"].between(1, most)))["w"]


def levenshtein_checker(misspellings: dict[str, list[str]] | None = None, valid: list[str] | None = None) -> Checker:
    mis = V.MISSPELLINGS if misspellings is None else misspellings
    words = [*mis, *(V.VALID_WORDS if valid is None else valid)]
    listed = F.create_map(*[F.lit(x) for w, bad in mis.items() for b in bad for x in (b, w)]) if mis else None

    def fix(w: Column) -> Column:
        out = F.when(w.isin(words), w)
        if listed is not None:
            out = F.coalesce(out, F.try_element_at(listed, w))
        return F.coalesce(out, nearest_word(w, words), w)

    return lambda c: _per_word(F.lower(c), fix)


def layout_checker(cyrillic: list[str] | None = None, latin: list[str] | None = None) -> Checker:
    """Words typed on the other keyboard layout, if the switched word is a known one."""
    ru, en = V.LAYOUT_CYRILLIC if cyrillic is None else cyrillic, V.LAYOUT_LATIN if latin is None else latin

    def fix(w: Column) -> Column:
        to_ru, to_en = T.switch_layout(w), T.switch_layout(w, False)
        return F.when(w.rlike("^[A-Za-z]+$") & F.lower(to_ru).isin(ru), to_ru).when(w.rlike("[а-яёА-ЯЁ]") & F.lower(to_en).isin(en), to_en).otherwise(w)

    return lambda c: _per_word(c, fix)


def _sound(word: str) -> str:
    table = dict(zip(V.SOUND_LETTERS, V.SOUND_CODES, strict=False))
    raw = "".join(table.get(ch, "" if ch in "ьъ" else ch) for ch in word)
    run = "".join(ch for i, ch in enumerate(raw) if i == 0 or raw[i - 1] != ch)
    return word[0] + run[1:].ljust(4, "0")[:4]


def phonetic_checker(groups: list[list[str]] | None = None, compat: bool = False) -> Checker:
    """Words that sound like the head of a group become the head; ``compat`` returns the first other member instead."""
    gs = V.PHONETIC_GROUPS if groups is None else groups
    by = {}
    for g in gs:
        by.setdefault(_sound(g[0]), g)

    def fix(w: Column) -> Column:
        out = w
        for code, g in by.items():
            best = F.when(w == g[0], F.lit(g[1] if compat and len(g) > 1 else g[0])).otherwise(F.lit(g[0]))
            out = F.when(T.sound_code(w) == code, best).otherwise(out)
        return out

    return lambda c: _per_word(F.lower(c), fix)


@dataclass
class Chain:
    """Checkers by priority; every correction multiplies the confidence by ``decay``."""

    checkers: list[tuple[int, str, Checker]] = field(default_factory=lambda: [(1, "levenshtein", levenshtein_checker()), (2, "layout", layout_checker()), (3, "phonetic", phonetic_checker())])
    decay: float = 0.8

    def add(self, priority: int, name: str, checker: Checker) -> "Chain":
        return Chain([*self.checkers, (priority, name, checker)], self.decay)

    def correct(self, queries: DataFrame, column: str = "query") -> DataFrame:
        """``queries`` with corrected, has_correction, confidence and steps."""
        d = queries.withColumn("corrected", F.col(column)).withColumn("steps", F.array().cast("array<struct<method:string,before:string,after:string,confidence:double>>"))
        d = d.withColumn("confidence", F.lit(1.0))
        for _, name, check in sorted(self.checkers, key=lambda x: x[0]):
            d = d.withColumn("_after", check(F.col("corrected")))
            hit = F.lower("_after") != F.lower("corrected")
            d = d.withColumn("confidence", F.when(hit, F.col("confidence") * self.decay).otherwise(F.col("confidence")))
            step = F.struct(F.lit(name).alias("method"), F.col("corrected").alias("before"), F.col("_after").alias("after"), F.col("confidence").alias("confidence"))
            d = d.withColumn("steps", F.when(hit, F.concat("steps", F.array(step))).otherwise(F.col("steps")))
            d = d.withColumn("corrected", F.when(hit, F.col("_after")).otherwise(F.col("corrected"))).drop("_after")
        return d.withColumn("has_correction", F.size("steps") > 0)


def _without(c: Column, n: int) -> Column:
    """All texts that ``c`` becomes without ``n`` characters."""
    if n == 0:
        return F.array(c)
    each = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.left(c, i - 1), F.substring(c, i + 1, F.length(c))))
    each = F.when(F.length(c) > 0, each).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(each if n == 1 else F.flatten(F.transform(each, lambda x: _without(x, n - 1))))


def _one_edit(c: Column, longer: str, shorter: str) -> Column:
    """Keys of which a text shares one with each text at distance 1, and else only with itself."""
    swap = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(i.cast("string"), F.lit(":"), F.left(c, i - 1), F.substring(c, i + 1, F.length(c))))
    swap = F.when(F.length(c) > 0, swap).otherwise(F.array().cast("array<string>"))
    return F.concat(swap, F.transform(_without(c, 1), lambda x: F.concat(F.lit(longer), x)), F.array(F.concat(F.lit(shorter), c)))


def nearest_past(queries: DataFrame, past: DataFrame) -> DataFrame:
    """(_q, _n): for each text the first of the nearest ``past`` texts at distance 1 or 2; no text may be a past one itself.

    Texts at distance 1 share a key and a key's first past text will do, so neither side meets the other's rows. Texts at distance 2
    are looked for only where there is none at distance 1: they share what is left without up to two characters.
    """
    first = past.select("past", F.explode(_one_edit(F.col("past"), "b", "a")).alias("k")).groupBy("k").agg(F.min("past").alias("past"))
    one = queries.select("_q", F.explode(_one_edit(F.col("_q"), "a", "b")).alias("k")).join(first, "k").groupBy("_q").agg(F.min("past").alias("_n"))
    keys = lambda c: F.explode(F.transform(F.concat(*[_without(F.col(c), n) for n in (0, 1, 2)]), lambda x: F.hash(x)))
    # equal hashes of other texts only add pairs that the distance leaves out
    two = queries.join(one, "_q", "left_anti").select("_q", keys("_q").alias("k")).join(past.select("past", keys("past").alias("k")), "k")
    two = two.filter(F.levenshtein("_q", "past", 2) == 2).groupBy("_q").agg(F.min("past").alias("_n"))
    return one.unionByName(two)


def analytics_correct(queries: DataFrame, learned: DataFrame, stats: DataFrame, column: str = "query") -> DataFrame:
    """Learned corrections; else, for a query that has found nothing, the nearest successful past query (distance 1 or 2)."""
    q = queries.withColumn("_q", T.normalize(F.col(column)))
    learned = learned.select(F.col("original").alias("_q"), F.col("correction").alias("_l"))
    good = stats.filter((F.col("searches") >= 2) & (F.col("success_rate") > 0.7)).select(F.col("query").alias("past")).filter("past is not null")
    own = stats.select(F.col("query").alias("_q"), F.col("successes").alias("_s"))
    # those that take the nearest one; a successful query has found something
    left = q.select("_q").distinct().join(learned.filter("_l is not null"), "_q", "left_anti").join(own.filter("_s <> 0"), "_q", "left_anti")
    near = nearest_past(left.join(good.select(F.col("past").alias("_q")), "_q", "left_anti"), good.distinct())
    j = q.join(learned, "_q", "left").join(near, "_q", "left").join(own, "_q", "left")
    out = F.coalesce("_l", F.when(F.coalesce("_s", F.lit(0)) == 0, F.col("_n")), F.col(column))
    return j.withColumn("corrected", out).drop("_q", "_l", "_n", "_s")
