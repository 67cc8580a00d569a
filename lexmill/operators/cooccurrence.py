"""Counting how many articles two words share, for all pairs that can be similar, in memory that doesn't grow with the pairs.

Words are numbered by document frequency, so the words that a word can be similar to are a range of numbers. Ranges of words
(blocks) are counted apart: a block gets, of each article with one of its words, the numbers in reach, packed; it counts word by
word in arrays and lets go of what is not similar. No pair is a row before it is known to be similar.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import shared_dir

#: Words of articles in a batch and articles in it; blocks aimed at; counters of a block, words of articles of a block without
#: counters and those read before counting.
BATCH, MOST_DOCS = 1 << 20, 1 << 16
BLOCKS, COUNTERS, WITHOUT, READ = 64, 48 << 20, 1 << 18, 8 << 20


@dataclass(frozen=True)
class Block:
    """Words ``start`` to ``end``; those that they can be similar to end at ``reach``; ``kept``: counters stay from read to read."""

    start: int
    end: int
    reach: int
    kept: bool


def reach(dfs: np.ndarray, t: float) -> np.ndarray:
    """For each of the rising frequencies, the first that is too high for a similarity of ``t``."""
    if t <= 0:
        return np.full(len(dfs), len(dfs))
    return np.searchsorted(dfs * (t * (1 - 1e-12)), dfs, side="right")


def blocks(dfs: np.ndarray, words: np.ndarray, t: float) -> list[Block]:
    """Blocks of about equal work, for ``words`` words of each of the rising frequencies ``dfs``."""
    first = np.concatenate([[0], np.cumsum(words)])
    held = np.concatenate([[0], np.cumsum(words * dfs)])
    far = reach(dfs, t)
    cost = dfs * (1.0 + (held[far] - held[np.arange(len(dfs))]) / max(dfs[-1], 1))
    aim = max(float((cost * words).sum()) / BLOCKS, 1.0)
    out, g, used = [], 0, 0
    while g < len(dfs):
        start, n, work, rows, kept = int(first[g]) + used, 0, 0.0, 0, True
        while g < len(dfs) and work < aim:
            here = int(words[g]) - used
            wide = int(first[far[g]]) - start
            take = min(here, max(int((aim - work) / cost[g]), 1))
            counted, few = COUNTERS // wide - n, (WITHOUT - rows) // int(dfs[g])
            room = max(counted if kept else 0, few)
            if room < 1 and n:
                break
            take = max(min(take, room), 1)
            kept = kept and take <= max(counted, 0)
            n, work, rows, end = n + take, work + take * cost[g], rows + take * int(dfs[g]), int(first[far[g]])
            used = used + take if take < here else 0
            g += take == here
        out.append(Block(start, start + n, end, kept))
    return out


def _packed(x: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(len(x), 4).T
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    planes = np.frombuffer(pa.decompress(x[8:], 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).reshape(-1).view("<u4")


def _batches(rows):
    """(word, batch, n, docs): the articles of a batch that have the word, as numbers of two bytes."""
    top, seq = TaskContext.get().partitionId() << 32, 0
    held, docs, size = [], 0, 0

    def put():
        words = pa.concat_arrays([x.flatten().cast(pa.large_string()) for x in held])
        lens = np.concatenate([x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in held])
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        doc = np.repeat(np.arange(len(lens)), lens).astype("<u2")[order]
        n = np.bincount(codes, minlength=len(coded.dictionary))
        at = np.concatenate([[0], np.cumsum(2 * n)]).astype("<i4")
        packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(doc.tobytes())])
        return pa.RecordBatch.from_arrays(
            [coded.dictionary.cast(pa.string()), pa.array(np.full(len(n), top + seq)), pa.array(n.astype(np.int32)), packed], ["word", "batch", "n", "docs"]
        )

    for b in rows:
        for i in range(0, b.num_rows, 256):
            x = b.column(0).slice(i, 256)
            x = x.filter(x.is_valid())  # a slice's own words
            held.append(x)
            docs, size = docs + len(x), size + len(x.flatten())
            if size >= BATCH or docs + 256 > MOST_DOCS:
                yield put()
                seq, held, docs, size = seq + 1, [], 0, 0
    if size:
        yield put()


def _dealt(plan: list[Block], most: int):
    """(block, lens, words): of each batch's articles with a word of the block, the numbers of the words in reach, from the block's first."""

    def deal(held):
        n = np.concatenate([x[0] for x in held])
        rank = np.repeat(np.concatenate([x[1] for x in held]), n).astype(np.int64)
        doc = np.frombuffer(b"".join(y for x in held for y in x[2]), "<u2").astype(np.int64)
        key = doc * most + rank
        key.sort()
        rank = (key % most).astype(np.int32)
        row = np.arange(int(doc.max()) + 1) * most
        for k, b in enumerate(plan):
            lo, mid = np.searchsorted(key, row + b.start), np.searchsorted(key, row + b.end)
            use = np.flatnonzero(mid > lo)
            lo = lo[use]
            hi = np.searchsorted(key, row[use] + b.reach)
            two = hi - lo > 1
            lo, lens = lo[two], (hi - lo)[two]
            if not len(lens):
                continue
            at = np.cumsum(lens) - lens
            x = rank[np.repeat(lo - at, lens) + np.arange(int(lens.sum()))] - b.start
            step = np.diff(x, prepend=0)
            step[at] = x[at]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed(lens)], pa.binary()), pa.array([_packed(step)], pa.binary())], ["block", "lens", "words"])

    def run(rows):
        held, last = [], None
        for b in rows:
            batch = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(batch[1:] != batch[:-1]) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if held and batch[i] != last:
                    yield from deal(held)
                    held = []
                last, part = batch[i], b.slice(i, j - i)
                held.append((part.column(2).to_numpy(), part.column(1).to_numpy(), part.column(3).to_pylist()))
        if held:
            yield from deal(held)

    return run


def _meetings(x: np.ndarray, lens: np.ndarray, n: int, win: int, at_once: int):
    """(first, last, keys) for runs of the block's first ``n`` words: a key (word - first) * win + other for each article that both share."""
    ends = np.repeat(np.cumsum(lens), lens)
    own = np.flatnonzero(x < n)
    own = own[np.argsort(x[own], kind="stable")]
    word, many = x[own], ends[own] - own - 1
    first = np.searchsorted(word, np.arange(n + 1))
    upto = np.concatenate([[0], np.cumsum(many)])[first]
    w = 0
    while w < n:
        w2 = max(w + 1, int(np.searchsorted(upto, upto[w] + at_once, side="right")) - 1)
        m = many[first[w] : first[w2]]
        total = int(upto[w2] - upto[w])
        if total:
            q = own[first[w] : first[w2]] + 1 - (np.cumsum(m) - m)
            k = x[np.repeat(q, m) + np.arange(total)]
            if w2 - w > 1:
                k = np.repeat((word[first[w] : first[w2]] - w) * win, m) + k
            yield w, w2, k
        w = w2


def _counted(plan: list[Block], dfs: np.ndarray, words: np.ndarray, t: float, least: int, at_once: int):
    """(r1, r2, co) of the similar pairs of each block."""
    starts = np.concatenate([[0], np.cumsum(words)])

    def similar(b, df, key, co):
        r1, r2 = key // (b.reach - b.start), key % (b.reach - b.start)
        ok = co / (df[r1] + df[r2] - co) >= t
        cols = (r1[ok] + b.start, r2[ok] + b.start, co[ok])
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in cols], ["r1", "r2", "co"])

    def block(b, chunks):
        n, win = b.end - b.start, b.reach - b.start
        df = dfs[np.searchsorted(starts, np.arange(b.start, b.reach), side="right") - 1]
        acc, chunk = None, next(chunks)
        while chunk is not None:
            (x, lens), more = chunk, next(chunks, None)
            if acc is None and more is not None:
                acc = np.zeros((n, win), np.int32)
            for w, w2, k in _meetings(x, lens, n, win, at_once):
                size = (w2 - w) * win
                if acc is not None:
                    if size <= 8 * len(k):
                        acc[w:w2] += np.bincount(k, minlength=size).reshape(w2 - w, win).astype(np.int32)
                    else:
                        np.add.at(acc[w:w2].reshape(-1), k, 1)
                    continue
                if size <= 8 * len(k):
                    co = np.bincount(k, minlength=size)
                    key = np.flatnonzero(co >= least)
                    co = co[key]
                else:
                    k.sort()
                    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                    co, key = np.diff(np.append(new, len(k))), k[new]
                    key, co = key[co >= least], co[co >= least]
                yield similar(b, df, key + w * win, co)
            chunk = more
        if acc is not None:
            step = max((1 << 22) // win, 1)
            for w in range(0, n, step):
                part = acc[w : w + step].reshape(-1)
                key = np.flatnonzero(part >= least)
                yield similar(b, df, key + w * win, part[key].astype(np.int64))

    def joined(held):
        lens = np.concatenate([_unpacked(x) for x, _ in held]).astype(np.int64)
        x = np.concatenate([_unpacked(y) for _, y in held]).astype(np.int64)
        sums, at = np.cumsum(x), np.cumsum(lens) - lens
        return sums - np.repeat(sums[at] - x[at], lens), lens

    def run(rows):
        flat = ((k, x, y) for r in rows for k, x, y in zip(*[c.to_pylist() for c in r.columns], strict=True))
        row = next(flat, None)
        while row is not None:
            b = plan[row[0]]

            def chunks(k=row[0], kept=b.kept):
                nonlocal row
                held, size = [], 0
                while row is not None and row[0] == k:
                    held.append(row[1:])
                    size += int.from_bytes(row[2][:8], "little")
                    row = next(flat, None)
                    if kept and size >= READ:
                        yield joined(held)
                        held, size = [], 0
                if held:
                    yield joined(held)

            yield from block(b, chunks())

    return run


def counted_pairs(lists: DataFrame, least_df: int, most_df: int | None, banned: list[str], t: float, least: int, at_once: int) -> tuple[DataFrame, DataFrame]:
    """(r1, r2, co) of the pairs of words at a similarity of ``t`` that share ``least`` articles, and (r, word, df) of the words.

    ``lists`` has the distinct words of an article as ``words``; its rows come in one order however often they are made.
    About ``at_once`` meetings of words are counted together.
    """
    spark = lists.sparkSession
    top = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{top}/{name}")
        return spark.read.schema(df.schema).parquet(f"{top}/{name}")

    posts = kept(lists.select("words").mapInArrow(_batches, "word string, batch bigint, n int, docs binary"), "posts")
    freq = posts.groupBy("word").agg(F.sum("n").alias("df")).filter(F.col("df") >= least_df)
    freq = freq if most_df is None else freq.filter(F.col("df") <= most_df)
    freq = freq.filter(~F.col("word").isin(banned)) if banned else freq
    order = kept(freq.repartitionByRange("df", "word").sortWithinPartitions("df", "word").withColumn("m", F.monotonically_increasing_id()), "words")
    part, place = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in order.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row per task
    before = np.concatenate([[0], np.cumsum([sizes.get(p, 0) for p in range(max(sizes, default=0) + 1)])]).tolist()
    vocab = order.select((F.element_at(F.array(*map(F.lit, before)), part.cast("int") + 1) + place).cast("int").alias("r"), "word", "df")
    seen = sorted((r["df"], r["n"]) for r in order.groupBy("df").agg(F.count("*").alias("n")).collect())  # distinct frequencies: few
    none = spark.createDataFrame([], "r1 int, r2 int, co int")
    if not seen:
        return none, vocab
    dfs, words = np.array([x for x, _ in seen], np.int64), np.array([n for _, n in seen], np.int64)
    plan = blocks(dfs, words, t)
    rows = posts.join(vocab.select("r", "word"), "word").select("batch", "r", "n", "docs")
    dealt = rows.repartition("batch").sortWithinPartitions("batch").mapInArrow(_dealt(plan, int(words.sum())), "block int, lens binary, words binary")
    found = dealt.repartition(3 * len(plan), "block").sortWithinPartitions("block").mapInArrow(_counted(plan, dfs, words, t, least, at_once), none.schema)
    return kept(found, "pairs"), vocab
