"""Removing long repeated byte strings with run-length compressed suffix indexes (operator 5).

A byte goes if a string of ``length`` bytes over it also starts anywhere else, in the same text or another;
matches stay within texts, and overlaps count.

1. Anchors: of each ``length - k + 1`` consecutive windows of k bytes the one with the least hash (the first of
   equal ones) is an anchor, so two equal strings of ``length`` bytes choose the same anchor at the same place,
   and each string chooses one. The context of an anchor is the bytes of the strings that chose it; it travels
   as 64 bits of hash, and no text is shuffled yet.
2. Contexts are counted. One that occurs more than once is a repeat in full. Of an anchor with several contexts
   the bytes of one occurrence of each are cut from their texts, as others may repeat a part of them.
3. Index: contexts are dealt to blocks of about ``block`` bytes; an anchor with more has several blocks, and small
   anchors share one. Blocks stream through their tasks, so neither a row nor a task holds more than one. The
   contexts of an anchor get their suffix order, from it the Burrows-Wheeler transform as runs, with the text
   positions at the ends of runs and the length of what the suffixes on either side of a run's border share.
4. Matching statistics: inside a run all suffixes are preceded by one symbol, so a match that can't be extended to the
   left stands at a border of runs, where its length is sampled. A text position matches as far as the sample before
   it does, less the bytes between; streamed over the contexts this gives every position's longest match elsewhere.
   Matches of ``length`` and more are marked.
5. The strings of ``length`` bytes of an anchor with several blocks are also counted by 128 bits of hash over
   the blocks, and marked if another block has them. That is exact, and no task sees the whole anchor.
6. Marks go back to the texts, are merged, and cut out.

Nulls are empty texts. Texts shorter than ``length`` never change. Rows are told apart by doc_id and text: rows alike in both
count as repetitions of each other (both lose what they share) and null ids are one id. Very long texts are taken
whole. Which occurrence lends its bytes to the index (the least) changes no result. An empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, empty_text, flat, hash_spans, mix, pieces, table


@dataclass(frozen=True)
class Setting:
    length: int = 400
    k: int = 200
    block: int = 1 << 19


BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.multiply.accumulate(np.full(max(n - 1, 0), base, np.uint64), out=out[1:])
    return out


def _sums(buf: np.ndarray) -> np.ndarray:
    """Sums from which any span's hash follows."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(buf)), out=total[1:])
    return total


def window_hashes(total: np.ndarray, k: int) -> np.ndarray:
    """A mixed hash of each window of k bytes, from _sums."""
    n = len(total) - 1
    if n < k:
        return np.zeros(0, np.uint64)
    h = total[k:] - total[:-k]
    h *= _powers(INVERSE, n)[: n - k + 1]
    return mix(h)


def _span_hashes(total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of each span, its length included."""
    h = (total[hi] - total[lo]) * _powers(INVERSE, len(total))[lo]
    return mix(h ^ mix((hi - lo).astype(np.uint64) * BASE))


def anchors(buf: np.ndarray, offsets: np.ndarray, s: Setting) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the anchors of all texts in ``buf``: hashes, hashes of their contexts, and where these start and end."""
    n, w = len(buf), s.length - s.k + 1
    total = _sums(buf)
    h = window_hashes(total, s.k)
    m = len(h)
    none = np.zeros(0, np.int64)
    if m < w:
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    bits = np.uint64(max(int(m).bit_length(), 1))
    key = ((h >> bits) << bits) | np.arange(m, dtype=np.uint64)
    # windows over the end of a text never win
    bad = np.zeros(m + 1, np.int32)
    ends = offsets[1:-1]
    np.add.at(bad, np.clip(ends - s.k + 1, 0, m), 1)
    np.add.at(bad, np.clip(ends, 0, m), -1)
    key[np.cumsum(bad[:-1]) > 0] = np.uint64(0xFFFFFFFFFFFFFFFF)
    # sliding minimum over w: suffix minima and prefix minima of blocks of w
    full = -(-m // w) * w
    blocks = np.full(full, np.uint64(0xFFFFFFFFFFFFFFFF))
    blocks[:m] = key
    blocks = blocks.reshape(-1, w)
    fwd = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(back[: m - w + 1], fwd[w - 1 : m])
    # only starts of whole strings within a text choose
    start_ok = np.zeros(n + 1, np.int32)
    size = np.diff(offsets)
    long_ = np.flatnonzero(size >= s.length)
    np.add.at(start_ok, offsets[:-1][long_], 1)
    np.add.at(start_ok, offsets[1:][long_] - s.length + 1, -1)
    ok = np.cumsum(start_ok)[: len(least)] > 0
    starts = np.flatnonzero(ok)
    if not len(starts):
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    chosen = least[starts]
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    final = np.append(first[1:], len(starts)) - 1
    at = (chosen[first] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    lo, hi = starts[first], starts[final] + s.length
    return h[at], _span_hashes(total, lo, hi), lo, hi


def _anchor_rows(docs: DataFrame, s: Setting) -> DataFrame:
    """(doc_id, th, f, ch, lo, hi): the anchors of every text with the hash and the range of their contexts."""

    def run(batches):
        for b in pieces(batches, 4 << 20):
            buf, off = flat(b.column(2))
            f, ch, lo, hi = anchors(buf, off, s)
            row = np.searchsorted(off, lo, side="right") - 1
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(f.view(np.int64)), pa.array(ch.view(np.int64)), pa.array(lo - off[row]), pa.array(hi - off[row])], names=["doc_id", "th", "f", "ch", "lo", "hi"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "th", "text").mapInArrow(run, f"doc_id {kind}, th long, f long, ch long, lo long, hi long")


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, th, f, lo, hi, blk, wide, once) with the bytes of each range: ``body``."""
    own = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("f", "lo", "hi", "blk", "wide", "once")).alias("a"))
    j = docs.select("doc_id", "th", "text").join(own.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("doc_id", "th", "text", "a")

    def run(batches):
        for b in pieces(batches, 4 << 20):
            buf, off = flat(b.column(2))
            lists = b.column(3)
            row = np.repeat(np.arange(b.num_rows), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            x = lists.flatten()
            lo, hi = (x.field(c).to_numpy(zero_copy_only=False) + off[row] for c in ("lo", "hi"))
            body = pa.array([buf[i:j].tobytes() for i, j in zip(lo, hi, strict=True)], pa.binary())
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), *[x.field(c) for c in ("f", "lo", "blk", "wide", "once")], body], names=["doc_id", "th", "f", "lo", "blk", "wide", "once", "body"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return j.mapInArrow(run, f"doc_id {kind}, th long, f long, lo long, blk long, wide boolean, once boolean, body binary")


# --- the index of a block ------------------------------------------------------------------------


def suffix_array(text: np.ndarray, last: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their bytes up to the end of their context (``last``, exclusive) or ``depth`` bytes; equal ones by place."""
    n = len(text)
    left = last - np.arange(n)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text.astype(np.uint64) + np.uint64(1)
    key = np.zeros(n, np.uint64)
    for i in range(7):  # nine bits a byte: 0 is the end of a context
        key = key * np.uint64(512) + np.where(left > i, padded[i : n + i], 0)
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    step = 7
    while step < depth and not new.all():
        group = rank[order]
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        sub = order[tied]
        nxt = sub + step
        second = np.where(left[sub] > step, rank[np.minimum(nxt, n - 1)] + 1, 0)
        o = np.lexsort((second, group[tied]))
        order[tied] = sub[o]
        g, sec = group[tied], second[o]
        differ = np.ones(len(tied), bool)
        differ[1:] = (g[1:] != g[:-1]) | (sec[1:] != sec[:-1])
        new = new.copy()
        new[tied] = differ
        rank[order] = np.cumsum(new) - 1
        step *= 2
    return order


@dataclass
class RunIndex:
    """A run-length compressed transform: text positions at the ends of runs, and what the suffixes at each border share."""

    first: np.ndarray
    final: np.ndarray
    shared: np.ndarray


def lce(text: np.ndarray, last: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bytes that suffixes a and b share, within their contexts."""
    padded = np.zeros(len(text) + 8, np.uint8)
    padded[: len(text)] = text
    lanes = np.ndarray((len(text) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    most = np.minimum(last[a] - a, last[b] - b)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        x = lanes[a[live] + out[live]] ^ lanes[b[live] + out[live]]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.floor(np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64) // 8)
        out[live] = np.minimum(out[live] + same, most[live])
        live = live[(x == 0) & (out[live] < most[live])]
    return out


def run_index(text: np.ndarray, starts: np.ndarray, last: np.ndarray, depth: int) -> RunIndex:
    order = suffix_array(text, last, depth)
    before = np.where(np.isin(order, starts), -1 - order, text[order - 1].astype(np.int64))  # each context's start has a symbol of its own
    border = np.flatnonzero(before[1:] != before[:-1]) + 1
    start = np.concatenate([[0], border])
    final = np.concatenate([border - 1, [len(order) - 1]])
    shared = lce(text, last, order[border - 1], order[border])
    return RunIndex(order[start], order[final], shared)


def matching_statistics(index: RunIndex, n: int) -> np.ndarray:
    """How far each text position matches elsewhere, from the samples at the borders of runs."""
    reach = np.zeros(n, np.int64)
    np.maximum.at(reach, index.first[1:], index.first[1:] + index.shared)
    np.maximum.at(reach, index.final[:-1], index.final[:-1] + index.shared)
    return np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0)


def marked(bodies: list[bytes], s: Setting) -> list[np.ndarray]:
    """For each context the starts of its strings of ``length`` bytes that occur elsewhere."""
    size = np.array([len(b) for b in bodies])
    text = np.frombuffer(b"".join(bodies), np.uint8)
    ends = np.cumsum(size)
    starts = ends - size
    reach = matching_statistics(run_index(text, starts, np.repeat(ends, size), int(size.max())), len(text))
    return [np.flatnonzero(reach[a : z - s.length + 1] >= s.length) for a, z in zip(starts, ends, strict=True)]


def _spans(at: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Starts of strings as the ranges they cover."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    first, final = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(at) - 1]])
    return [(int(at[i]), int(at[j]) + length) for i, j in zip(first, final, strict=True)]


SPAN = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))


def _mark(bodies: DataFrame, s: Setting, tasks: int) -> DataFrame:
    """(doc_id, th, a, z, h1, h2): ranges of bytes that repeat, and for anchors with several blocks their other strings by hash.

    A string without a range to mark (of a context that is marked in full) has null for ``a``.
    """
    kind = bodies.schema["doc_id"].dataType.simpleString()

    def mark(own: list[tuple], ids: pa.DataType):
        out: dict[str, list] = {k: [] for k in ("doc_id", "th", "a", "z", "h1", "h2")}
        if len(own) > 1 or own[0][4]:
            got = marked([x[6] for x in own], s)
            for (doc, th, _, lo, wide, once, body), g in zip(own, got, strict=True):
                spans = _spans(g, s.length) if once else []
                n = len(spans)
                out["doc_id"] += [doc] * n
                out["th"] += [th] * n
                out["a"] += [lo + a for a, _ in spans]
                out["z"] += [lo + z for _, z in spans]
                out["h1"] += [None] * n
                out["h2"] += [None] * n
                if wide:
                    p = np.arange(len(body) - s.length + 1)
                    buf = np.frombuffer(body, np.uint8)
                    free = np.full(len(p), once)
                    free[g] = False
                    out["doc_id"] += [doc] * len(p)
                    out["th"] += [th] * len(p)
                    out["a"] += [lo + i if ok else None for i, ok in enumerate(free.tolist())]
                    out["z"] += [lo + i + s.length if ok else None for i, ok in enumerate(free.tolist())]
                    for c, seed in (("h1", 11), ("h2", 12)):
                        out[c] += hash_spans(buf, p, p + s.length, seed).view(np.int64).tolist()
        if out["th"]:
            kinds = (ids, *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    def run(batches):
        now, own, ids = None, [], None
        for b in batches:
            ids = b.schema.field(0).type
            for x in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if own and x[:2] == own[-1][:2] and x[2:4] == own[-1][2:4] and x[4] == now[0]:
                    continue  # a row alike in id and text
                if (x[4], x[2]) != now:
                    if own:
                        yield from mark(own, ids)
                    now, own = (x[4], x[2]), []
                own.append((x[0], x[1], x[2], x[3], x[5], x[6], x[7]))
        if own:
            yield from mark(own, ids)

    dealt = bodies.repartition(tasks, "blk").sortWithinPartitions("blk", "f", "doc_id", "th", "lo")
    return dealt.mapInArrow(run, f"doc_id {kind}, th long, a long, z long, h1 long, h2 long")


def repeated_spans(docs: DataFrame, s: Setting, scratch: Scratch) -> DataFrame:
    """(doc_id, th, spans): the ranges of bytes to remove; ``docs``: doc_id, th and text."""
    found = scratch.write(_anchor_rows(docs, s))
    place = F.struct("doc_id", "th", "lo", "hi")
    kinds = scratch.write(found.groupBy("f", "ch").agg(F.count("*").alias("many"), F.min(place).alias("at")))
    size = F.col("at.hi") - F.col("at.lo")
    of = kinds.groupBy("f").agg(F.count("*").alias("kinds"), F.sum(size).alias("bytes")).filter("kinds > 1")
    # contexts that repeat are marked where they are
    full = found.join(kinds.filter("many > 1").select("f", "ch").hint("merge"), ["f", "ch"]).select("doc_id", "th", F.col("lo").alias("a"), F.col("hi").alias("z"))
    # of anchors with several contexts one occurrence of each; large anchors are dealt over blocks, small ones share
    parts = F.ceil(F.col("bytes") / F.lit(s.block))
    j = kinds.join(of.hint("merge"), "f").withColumn("wide", parts > 1)
    total = j.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // s.block))
    salt = F.pmod(F.xxhash64("ch"), parts)
    blk = F.when(F.col("wide"), F.xxhash64("f", salt)).otherwise(F.pmod(F.xxhash64("f"), F.lit(blocks)))
    wanted = j.select("at.*", "f", blk.alias("blk"), "wide", (F.col("many") == 1).alias("once"))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // 4)
    marks = scratch.write(_mark(_bodies(docs, wanted), s, tasks))
    loose = marks.filter("h1 is not null")
    again = loose.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    more = loose.filter("a is not null").join(again.hint("merge"), ["h1", "h2"]).select("doc_id", "th", "a", "z")
    all_ = full.unionByName(marks.filter("h1 is null").select("doc_id", "th", "a", "z")).unionByName(more)
    return all_.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("a", "z"))).alias("spans"))


def merge(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in spans:
        if out and x["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["z"])
        else:
            out.append([x["a"], x["z"]])
    return [(a, z) for a, z in out]


def dedup(docs: DataFrame, s: Setting = Setting()) -> DataFrame:
    """doc_id, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (merged), ``kept_sha256`` and ``kept`` (bytes) of every row."""
    scratch = Scratch(docs.sparkSession, "suffix")
    base = docs.select("doc_id", empty_text().alias("text"))
    d = base.withColumn("th", F.xxhash64("text"))
    spans = scratch.write(repeated_spans(d, s, scratch)).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "spans")
    j = d.join(spans.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").select("doc_id", "text", "spans")

    def run(batches):
        for b in pieces(batches):
            buf, off = flat(b.column(1))
            rows = {k: [] for k in ("n", "r", "c", "s", "h", "k")}
            for i in range(b.num_rows):
                body = buf[off[i] : off[i + 1]].tobytes()
                x = b.column(2)[i].as_py()
                got = merge(x) if x else []
                kept, at = [], 0
                for a, z in got:
                    kept.append(body[at:a])
                    at = z
                kept = b"".join([*kept, body[at:]])
                for k, v in zip(rows, (len(body), len(body) - len(kept), len(got), [{"a": a, "z": z} for a, z in got], hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    rows[k].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), SPAN, pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return j.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<a:long,z:long>>, kept_sha256 string, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
