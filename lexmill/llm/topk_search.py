"""Exact top-k search by BM25 over an inverted index in shards, with block-max pruning (operator 4).

Documents are dealt to shards of about ``shard_chars`` characters by a hash of id and text. A shard's index is one
row: its terms (hashes of lowered words, white space between), postings by document, and the documents' lengths,
packed. Within a shard documents lie by which of its most frequent terms they hold, so that a block of ``block``
documents is alike, and the greatest part of a score that a term has in a block says much about the block.
Document counts and term frequencies are global, so scores don't depend on the shards and the shards' best rows
merge exactly.

A query's block maxima sum to a bound of each block. Neighbouring blocks are read in runs, those with the greatest
bounds first; once no block of a run can reach the k-th score so far, its postings are skipped unread. (The usual
form goes by document with a cursor a term; here the pivot is a block, so that all steps are arrays.) Like queries
read together: a term that many of a batch's queries and many places hold is a column of a product of matrices, other
terms are added posting by posting. Those sums are of 24 bits, which bounds and thresholds allow for; what may be
among the best k is scored again in full. Queries travel in groups of ``group``, packed, and meet a shard where it is
read, so neither side of a task grows with the corpus and neither is shuffled for the other.

Nulls and empty texts match nothing. Equal scores (to six decimals) are ordered by doc_id, null first. Repeated rows
are found each. A query with no known term has no rows. Very long texts are indexed and asked whole. An empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, Scratch, empty_text, flat, hash_spans, pack, pieces, table, unpack, word_bounds


@dataclass(frozen=True)
class Setting:
    k: int = 10
    k1: float = 1.2
    b: float = 0.75
    shard_chars: int = 32_000_000
    block: int = 32
    first: int = 64  # neighbouring blocks that are read together
    group: int = 4096  # queries that travel together
    batch: int = 2048  # queries that read together
    dense: float = 0.002  # share of pairs of a query and a place from which a term goes as a matrix


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of the distinct terms of each row, and the rows' lengths."""
    buf, off = flat(texts)
    buf = LOWER[buf]
    s, e, rows = word_bounds(buf, off)
    h = hash_spans(buf, s, e)
    o = np.argsort(h)
    o = o[np.argsort(rows[o].astype(np.uint16 if len(off) <= 1 << 16 else np.int64), kind="stable")]
    r, h = rows[o], h[o]
    new = np.ones(len(h), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return r[at], h[at], np.diff(np.append(at, len(h))), np.bincount(rows, minlength=len(off) - 1)


def _layout(row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
    """The place of each document: by which of the 62 most frequent terms (numbered from 0) it holds, the most frequent first."""
    n = np.bincount(term)
    code = np.full(len(n), -1)
    code[np.argsort(-n, kind="stable")[:62]] = np.arange(min(62, len(n)))
    bit, key = code[term], np.zeros(rows, np.int64)
    np.bitwise_or.at(key, row[bit >= 0], np.int64(1) << (61 - bit[bit >= 0]))
    place = np.empty(rows, np.int64)
    place[np.argsort(key, kind="stable")] = np.arange(rows)
    return place


def _index(docs: DataFrame, s: Setting) -> DataFrame:
    """A row per shard: doc_ids as they lie, their order and lengths, terms, and the postings' documents and counts."""

    def build(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t["doc_id"], null_placement="at_start"))
        row, term, tf, length, base = [], [], [], [], 0
        for b in pieces(t.select(["text"]).to_batches()):
            r, h, n, size = _terms(b.column(0))
            row.append((r + base).astype(np.int32)), term.append(h), tf.append(n.astype(np.uint32)), length.append(size)
            base += b.num_rows
        row, term, tf, length = (np.concatenate(x) for x in (row, term, tf, length))
        u, term, n = np.unique(term, return_inverse=True, return_counts=True)
        words, t = int(length.sum()), t.drop_columns("text")
        place = _layout(row, term, base)
        by = np.argsort(place)
        row = place[row].astype(np.int32)
        o = np.argsort(term * base + row)  # a document holds a term once
        row, tf = row[o], tf[o]
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.table(
            {"shard": t["shard"][:1], "doc_ids": one(t["doc_id"].combine_chunks().take(pa.array(by))), "by_id": pa.array([pack(by.astype(np.int32))]), "len": pa.array([pack(length[by].astype(np.int64))]), "words": pa.array([words]), "terms": one(pa.array(u.view(np.int64))), "df": one(pa.array(n)), "docs": pa.array([pack(np.diff(row, prepend=np.int32(0)))]), "tf": pa.array([pack(tf)])}
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.groupBy("shard").applyInArrow(build, f"shard long, doc_ids array<{kind}>, by_id binary, len binary, words long, terms array<long>, df array<long>, docs binary, tf binary")


def _spans(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The numbers from each ``a`` to before its ``z``, one after the other."""
    n = z - a
    return np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())


def _add(out: np.ndarray, q: np.ndarray, t: np.ndarray, w: np.ndarray, at: np.ndarray, place: np.ndarray, value: np.ndarray, s: Setting) -> None:
    """Add to ``out`` (queries by places) the weight of each query's term times the values of the term's postings.

    The postings of term i are those from ``at[i]`` to before ``at[i + 1]``. Terms that many queries and many places share go as a product of
    matrices, the others posting by posting.
    """
    n, (rows, width) = np.diff(at), out.shape
    dense = np.bincount(t, minlength=len(n)) * n >= s.dense * rows * width
    at_dense, of = np.flatnonzero(dense), np.cumsum(dense) - 1
    m = dense[t]
    for i in range(0, len(at_dense), 2048):
        own = at_dense[i : i + 2048]
        x = m & (t >= own[0]) & (t <= own[-1]) if len(at_dense) > 2048 else m
        left, right = np.zeros((rows, len(own)), np.float32), np.zeros((len(own), width), np.float32)
        left[q[x], of[t[x]] - i] = w[x]
        p = _spans(at[own], at[own + 1])
        right[np.repeat(np.arange(len(own)), n[own]), place[p]] = value[p]
        out += left @ right
    q, t, w = q[~m], t[~m], w[~m]
    size = np.cumsum(n[t])
    i, flat_ = 0, out.reshape(-1)
    while i < len(t):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + (1 << 17), side="right")))
        a, many = at[t[i:j]], n[t[i:j]]
        p = _spans(a, a + many)
        np.add.at(flat_, np.repeat(q[i:j] * width, many) + place[p], np.repeat(w[i:j], many) * value[p])
        i = j


class Shard:
    """The index of a shard, ready for queries; ``read`` and ``skipped`` count blocks that hold a query's terms."""

    def __init__(self, t: pa.Table, mean: float, s: Setting):
        self.s, x = s, {c: t[c].combine_chunks()[0] for c in t.column_names}
        self.ids, self.by_id = x["doc_ids"].values, unpack(x["by_id"].as_py(), np.int32)
        self.terms = x["terms"].values.to_numpy(zero_copy_only=False).view(np.uint64)
        n = x["df"].values.to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(n)])
        docs = np.cumsum(unpack(x["docs"].as_py(), np.int32), dtype=np.int32)
        tf = unpack(x["tf"].as_py(), np.uint32)
        norm = s.k1 * (1 - s.b + s.b * unpack(x["len"].as_py(), np.int64) / mean)
        parts = tf * (s.k1 + 1) / (tf + norm[docs])
        del tf
        block = docs // s.block
        new = np.zeros(len(block) + 1, bool)
        new[1:-1] = block[1:] != block[:-1]
        new[at] = True  # the first posting of a term starts a block of it
        starts = np.flatnonzero(new)
        self.block = block[starts[:-1]]
        self.most = np.maximum.reduceat(parts, starts[:-1]).astype(np.float32) if len(block) else np.zeros(0, np.float32)
        self.at = np.searchsorted(starts, at)
        del block, new, starts
        term = np.repeat(np.arange(len(n), dtype=np.int32), n)
        # the postings again by document, for exact scores
        small = np.uint16 if len(self.ids) <= 1 << 16 else np.int32
        o = np.argsort(docs.astype(small), kind="stable")
        self.term, self.part, self.doc_at = term[o], parts[o], np.concatenate([[0], np.cumsum(np.bincount(docs, minlength=len(self.ids)))])
        del o
        # and by runs of neighbouring blocks: their terms, where the postings of each start, documents, parts
        wide, parts = s.block * s.first, parts.astype(np.float32)
        run = (docs // wide).astype(small)
        o = np.argsort(run, kind="stable").astype(np.int32)
        edge = np.searchsorted(run[o], np.arange(-(-len(self.ids) // wide) + 1))
        self.runs = []
        for i, (a, z) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            own = o[a:z]
            x = term[own]
            first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
            self.runs.append((i * wide, min(len(self.ids), (i + 1) * wide), x[first], np.append(first, len(x)), docs[own] - np.int32(i * wide), parts[own]))
        self.read = self.skipped = 0

    def search(self, terms: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the best k documents."""
        _, rows, score = self.search_many(np.zeros(len(terms), np.int64), np.arange(len(terms)), terms, idf, 1)
        return rows, score

    def search_many(self, q: np.ndarray, t: np.ndarray, terms: np.ndarray, idf: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and score of the best k documents of queries 0 to ``many`` - 1; (q, t): the places of their terms in ``terms`` and ``idf``."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not len(self.terms) or not len(q):
            return none
        found = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        ok = (self.terms[found] == terms)[t]
        q, t, idf = q[ok], found[t[ok]], idf[t[ok]]
        # like queries next to each other
        place = _layout(q, t, many)
        o = np.argsort(place[q], kind="stable")
        q, t, idf = place[q][o], t[o], idf[o]
        edge = np.searchsorted(q, np.arange(0, many + self.s.batch, self.s.batch))
        found = [none]
        for i, (a, z) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            base = i * self.s.batch
            x, rows, score = self._batch(q[a:z] - base, t[a:z], idf[a:z], min(self.s.batch, many - base))
            found.append((x + base, rows, score))
        x, rows, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return np.argsort(place)[x], rows, score

    def _batch(self, q: np.ndarray, t: np.ndarray, idf: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k, w, s = self.s.k, idf.astype(np.float32), self.s
        bound = np.zeros((many, -(-len(self.ids) // s.block)), np.float32)
        _add(bound, q, t, w, self.at, self.block, self.most, s)
        # sums of n positive floats of 24 bits are off by less than this share; scores are compared at six decimals
        slack = 1 - 4 * (np.bincount(q, minlength=many) + 8) * 2.0**-23
        best, theta = np.full((many, k), -np.inf, np.float32), np.full(many, -np.inf, np.float32)
        where, chosen = np.full(len(self.terms), -1), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        tops = np.maximum.reduceat(bound, np.arange(0, bound.shape[1], s.first), axis=1)
        held = np.add.reduceat(bound > 0, np.arange(0, bound.shape[1], s.first), axis=1, dtype=np.int64)
        for r in np.argsort(-tops.sum(axis=0), kind="stable"):
            lo, hi, own, at, docs, parts = self.runs[r]
            asks = (tops[:, r] > 0) & (tops[:, r] >= theta)
            self.read += int(held[asks, r].sum())
            self.skipped += int(held[~asks, r].sum())
            rows = np.flatnonzero(asks)
            if not len(rows):
                continue
            to = np.full(many, -1)
            to[rows] = np.arange(len(rows))
            where[own] = np.arange(len(own))
            e = np.flatnonzero((where[t] >= 0) & asks[q])
            score = np.zeros((len(rows), hi - lo), np.float32)
            _add(score, to[q[e]], where[t[e]], w[e], at, docs, parts, s)
            where[own] = -1
            # the k-th of the blocks' best is no more than the k-th of the documents
            top = np.maximum.reduceat(score, np.arange(0, hi - lo, s.block), axis=1)
            top[top <= 0] = -np.inf
            best[rows] = np.partition(np.concatenate([best[rows], top], axis=1), -k, axis=1)[:, -k:]
            theta = (best.min(axis=1) * slack - 2e-6).astype(np.float32)
            x, y = np.nonzero(score >= np.maximum(theta[rows], np.finfo(np.float32).tiny)[:, None])
            chosen.append((rows[x], y + lo, score[x, y]))
        x, doc, near = (np.concatenate(c) for c in zip(*chosen, strict=True))
        o = np.lexsort((-near, x))
        x, doc, near = x[o], doc[o], near[o].astype(float)
        edge = np.searchsorted(x, np.arange(many + 1))
        kth = np.where(np.diff(edge) >= k, near[np.minimum(edge[:-1] + k - 1, max(len(near) - 1, 0))] if len(near) else 0, 0)
        keep = near >= (kth * slack - 2e-6)[x]
        x, doc = x[keep], doc[keep]
        return self._exact(x, doc, q, t, idf, many)

    def _exact(self, x: np.ndarray, doc: np.ndarray, q: np.ndarray, t: np.ndarray, idf: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best k of the chosen documents (query ``x``, ``doc``) by their scores in full."""
        weight, out = np.zeros(len(self.terms)), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        edge, own = np.searchsorted(x, np.arange(many + 1)), np.searchsorted(q, np.arange(many + 1))
        for i in np.flatnonzero(np.diff(edge)):
            d, mine = doc[edge[i] : edge[i + 1]], slice(own[i], own[i + 1])
            weight[t[mine]] = idf[mine]
            a, z = self.doc_at[d], self.doc_at[d + 1]
            p = _spans(a, z)
            score = np.add.reduceat(weight[self.term[p]] * self.part[p], np.cumsum(z - a) - (z - a))
            weight[t[mine]] = 0
            o = np.lexsort((self.by_id[d], -np.round(score, 6)))[: self.s.k]
            out.append((np.full(len(o), i), d[o], score[o]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def search(docs: DataFrame, queries: DataFrame, s: Setting = Setting()) -> DataFrame:
    """(query_id, doc_id, score, rank): the best ``k`` rows of ``docs`` for each row of ``queries`` (query_id, text)."""
    scratch = Scratch(docs.sparkSession, "topk")
    d = docs.select("doc_id", empty_text().alias("text"))
    facts = d.select(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c"), F.count("*").alias("n")).first()
    rows, shards = facts["n"], max(1, -(-int(facts["c"]) // s.shard_chars))
    index = scratch.write(_index(d.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("long")), s))
    mean = max(index.agg(F.sum("words")).first()[0] or 0, 1) / max(rows, 1)
    df = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))

    def split(batches):
        for b in pieces(batches):
            row, term, _, _ = _terms(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(term.view(np.int64))], names=["query_id", "term"])

    qkind = queries.schema["query_id"].dataType.simpleString()
    q = queries.select("query_id", empty_text().alias("text")).mapInArrow(split, f"query_id {qkind}, term long").distinct()
    q = scratch.write(q.join(df, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", "df")).alias("t")))
    groups = max(1, -(-q.count() // s.group))

    def packed(t: pa.Table) -> pa.Table:
        x = t["t"].combine_chunks()
        size = pc.list_value_length(x).to_numpy(zero_copy_only=False)
        term, df = (x.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("term", "df"))
        term, first, place = np.unique(term, return_index=True, return_inverse=True)
        one = {"size": size.astype(np.int32), "place": place.astype(np.int32), "term": term, "n": df[first]}
        return pa.table({"query_ids": pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), t["query_id"].combine_chunks())} | {k: pa.array([pack(v)]) for k, v in one.items()})

    asked = q.withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(groups))).groupBy("g")
    asked = scratch.write(asked.applyInArrow(packed, f"query_ids array<{qkind}>, size binary, place binary, term binary, n binary"))
    dkind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        shard, at = None, None
        for b in batches:
            for i in range(b.num_rows):
                x = pa.Table.from_batches([b.slice(i, 1)])
                if at != x["shard"][0].as_py():
                    shard, at = None, x["shard"][0].as_py()
                    shard = Shard(x.select(["doc_ids", "by_id", "len", "terms", "df", "docs", "tf"]), mean, s)
                size, place, term, n = (unpack(x[c][0].as_py(), kind) for c, kind in (("size", np.int32), ("place", np.int32), ("term", np.uint64), ("n", np.int64)))
                of, cand, score = shard.search_many(np.repeat(np.arange(len(size)), size), place, term, np.log(1 + (rows - n + 0.5) / (n + 0.5)), len(size))
                ids = x["query_ids"].combine_chunks()[0].values
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), shard.ids.take(pa.array(cand)), pa.array(score), pa.array(np.round(score, 6))], names=["query_id", "doc_id", "score", "by"])

    # no shuffle: each part of the index meets each group of queries where it is read
    found = index.crossJoin(asked).mapInArrow(run, f"query_id {qkind}, doc_id {dkind}, score double, by double")
    w = Window.partitionBy("query_id").orderBy(F.desc("by"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= s.k).drop("by")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    queries = docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search(docs, queries).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


ORACLE = r"""with t as (select doc_id,unnest(list_filter(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[\x20\x09-\x0D]+'),lambda x: x<>'')) w from documents)
, dl as (select doc_id,count(*) len from t group by doc_id), st as (select (select count(*) from documents) n,(select count(*) from t)/(select count(*) from documents) mean)
, tf as (select doc_id,w,count(*) tf from t group by all), df as (select w,count(*) df from tf group by w)
, sc as (select q.doc_id query_id,tf.doc_id,sum(ln(1+(n-df+0.5)/(df+0.5))*tf.tf*2.2/(tf.tf+1.2*(0.25+0.75*len/mean))) score from tf q join tf on q.w=tf.w join df on df.w=tf.w join dl on dl.doc_id=tf.doc_id, st where q.doc_id%100=0 group by all)
select query_id,doc_id,round(score,4) score,rn::int "rank" from (select *,row_number() over (partition by query_id order by round(score,6) desc,doc_id) rn from sc) where rn<=10"""
