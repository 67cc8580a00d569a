"""Scoring texts with prediction by partial matching (operator 7).

A text is one stream of bytes: its words, with A-Z lowered, a space after each, and a line feed as its end.
Every byte is coded from the ``order`` bytes before it, across words; before the first byte stand line feeds.
Method D estimates escapes (a context of T occurrences and q distinct successors gives (n - 1/2) / T and
escapes with q / 2T), and what a longer context could have coded is excluded from the shorter ones.
Counts are of all occurrences in all training rows, exact; no context or successor is dropped.

A byte's chance depends on it and the ``order`` bytes before it alone, a gram. Blocks of about 4 MB of text
send their distinct grams, packed, to shards by the last three bytes of the context, so a shard has all
contexts of three bytes and more that its grams need; the shorter ones (bounded by the alphabet) are shared.
Each shard counts, then answers the blocks, which look their grams' chances up. The number of shards grows
with the grams. Words are counted and answered alike, by 64 bits of hash. A block is coded some 100000 words at a time, so that a task holds its distinct grams and little else.

Nulls and empty texts hold the end alone; very long texts are blocks of their own. Null ids count as the empty text in the split. Rows alike
get the same scores. Without training rows every byte is equally likely. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, M1, Scratch, crc_mod, empty_text, flat, hash_spans, mix, pieces, table, word_bounds
from .common import pack as _pack
from .common import unpack as _unpack


@dataclass(frozen=True)
class Setting:
    order: int = 6  # at most 7: a gram is one number of 64 bits
    contexts: int = 1 << 21  # grams sent to one shard, about; none is dropped
    words: int = 100_000  # of a block, coded at a time
    rounds: int = 4  # shares of the shards that answer, and of the blocks that are scored, one after the other
    block: int = 4 << 20


def _blocks(docs: DataFrame, held: Column, size_of_block: int = Setting.block) -> DataFrame:
    """A row per block: its distinct words with training counts, its rows, and the words' numbers in order."""

    def run(batches):
        for b in pieces(batches, size_of_block):
            buf, offsets = flat(b.column(1))
            buf = LOWER[buf]
            s, e, rows = word_bounds(buf, offsets)
            size = e - s
            inside = np.zeros(len(buf) + 1, np.int8)
            inside[s] += 1
            np.subtract.at(inside, e, 1)
            text = buf[np.cumsum(inside[:-1]).astype(bool)]
            bounds = np.concatenate([[0], np.cumsum(size)])
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(bounds), pa.py_buffer(text)]).dictionary_encode()
            code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            out = b.column(2).to_numpy(zero_copy_only=False)
            n = np.bincount(code, minlength=len(words.dictionary))
            by = np.argsort(-n, kind="stable")
            rank = np.empty_like(by)
            rank[by] = np.arange(len(by))
            code = rank[code]
            train = np.bincount(code[~out[rows]], minlength=len(by))
            small = np.minimum(code, 65535).astype(np.uint16)
            name = hashlib.md5(text.tobytes() + offsets.tobytes() + str(b.column(0).to_pylist()).encode()).digest()
            toks = words.dictionary.take(pa.array(by)).cast(pa.binary())
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), one(toks), one(pa.array(train)), one(b.column(0)), one(b.column(2)), one(pa.array(np.bincount(rows, minlength=b.num_rows))), pa.array([small.tobytes()]), pa.array([code[code >= 65535].astype(np.uint32).tobytes()])],
                names=["block", "toks", "train", "doc_id", "held", "n", "codes", "large"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", empty_text().alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    return d.mapInArrow(run, f"block binary, toks array<binary>, train array<long>, doc_id array<{kind}>, held array<boolean>, n array<long>, codes binary, large binary")


# --- grams and their chances ---------------------------------------------------------------------

U8 = np.uint64(8)
LOW = 2  #: contexts of so many bytes or fewer are shared by all shards


def _mask(k: int) -> np.uint64:
    return np.uint64((1 << 8 * (k + 1)) - 1)


def grams(words: pa.Array, code: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each byte of the texts, ``order`` bytes and it, and the text's number; ``n``: words a text."""
    buf, off = flat(words.take(pa.array(code)))
    size = np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    width = np.bincount(row, size + 1, len(n)).astype(np.int64) + 1 + order
    stream = np.full(8 + width.sum(), 32, np.uint8)
    top = 8 + np.concatenate([[0], np.cumsum(width)])
    pad = (top[:-1, None] + np.arange(order)).ravel()
    stream[pad] = stream[top[1:] - 1] = 10
    at = top[0] + np.cumsum(size + 1) - (size + 1) + row * (order + 1) + order
    stream[np.repeat(at - off[:-1], size) + np.arange(len(buf))] = buf
    coded = np.ones(len(stream), bool)
    coded[:8] = coded[pad] = False
    end = np.flatnonzero(coded)
    lanes = np.ndarray((len(stream) - 7,), dtype=">u8", buffer=stream.data, strides=(1,))
    return lanes[end - 7].astype(np.uint64) & _mask(order), np.repeat(np.arange(len(n)), width - order)


def _sum(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams with their sums."""
    if not len(g):
        return g, n
    o = np.argsort(g)
    g, n = g[o], n[o]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[first], np.add.reduceat(n, first)


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


@dataclass
class Level:
    """Contexts of one order, sorted: T, q, and what their successors sum to one order down; pairs by gram."""

    ctx: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    less: np.ndarray
    pair: np.ndarray
    n: np.ndarray


def level(g: np.ndarray, n: np.ndarray, k: int, below: "Level | None") -> Level:
    """Order k of sorted grams or longer ones; ``below``: the next shorter order, which has all their contexts."""
    pair, n = _sum(g & _mask(k), n)
    ctx, first = np.unique(pair >> U8, return_index=True)
    sums = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
    less = np.zeros(len(ctx)) if below is None else sums(below.n[_find(below.pair, pair & _mask(k - 1))[0]] if len(pair) else n)
    return Level(ctx, sums(n), np.diff(np.append(first, len(pair))), less, pair, n)


def levels_of(g: np.ndarray, n: np.ndarray, orders: range, low: list[Level]) -> list[Level]:
    out = list(low)
    for k in orders:
        out.append(level(g, n, k, out[-1] if out else None))
    return out


def chances(g: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 of the chance of each gram's last byte after the bytes before it."""
    m = len(g)
    log, live = np.zeros(m), np.arange(m)
    less, fewer = np.zeros(m), np.zeros(m)
    for k in range(len(levels) - 1, -1, -1):
        lv = levels[k]
        at, ok = _find(lv.pair, g[live] & _mask(k))
        ca, seen = _find(lv.ctx, (g[live] & _mask(k)) >> U8)
        t, q = (lv.total[ca] - less[live], lv.distinct[ca] - fewer[live]) if len(lv.ctx) else (np.zeros(len(live)),) * 2
        hit = live[ok]
        log[hit] += np.log10((lv.n[at[ok]] - 0.5) / t[ok])
        out = seen & ~ok & (q > 0)  # otherwise all successors are excluded, and the escape is certain
        log[live[out]] += np.log10(q[out] / 2 / t[out])
        out = seen & ~ok
        less[live[out]], fewer[live[out]] = lv.less[ca[out]], lv.distinct[ca[out]]
        live = live[~ok]
    log[live] -= np.log10(np.maximum(256 - fewer[live], 1))
    return log


def fit(vocab: DataFrame, symbols: int, s: Setting) -> list[Level]:
    """The model of single words (tok), each a text of its own; for small lists."""
    words = vocab.filter(F.col("tok") != F.lit(b"\n")).select("tok").toArrow()["tok"].combine_chunks()
    g, _ = grams(words, np.arange(len(words)), np.ones(len(words), np.int64), s.order)
    return levels_of(*_sum(g, np.ones(len(g), np.int64)), range(s.order + 1), [])


def code_length(words: pa.Array, levels: list[Level], order: int) -> np.ndarray:
    """log10 of each word's chance as the first of a text, its space included; the word ``\n`` is the end of a text."""
    end = np.array([w == b"\n" for w in words.to_pylist()])
    g, row = grams(words, np.flatnonzero(~end), (~end).astype(np.int64), order)
    last = np.append(row[1:] != row[:-1], True)
    g, row = g[~last | end[row]], row[~last | end[row]]
    return np.bincount(row, chances(g, levels), len(words))


def _numbers(codes: bytes, large: bytes) -> np.ndarray:
    code = np.frombuffer(codes, np.uint16).astype(np.int64)
    code[code == 65535] = np.frombuffer(large, np.uint32)
    return code


def _shards(g: np.ndarray, order: int, n: int) -> np.ndarray:
    """By the last three bytes of the context."""
    return (mix((g >> U8 & _mask(min(LOW, order - 1))) * M1) % np.uint64(n)).astype(np.int64)


def _parts(code: np.ndarray, toks: pa.Array, n: np.ndarray, order: int, size: int):
    """Of the texts of a block, about ``size`` words at a time: the first text and the one past the last, grams and texts."""
    ends = np.cumsum(n)
    at, word = 0, 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, word + size, side="right")))
        g, row = grams(toks, code[word : ends[to - 1]], n[at:to], order)
        yield at, to, g, row
        at, word = to, int(ends[to - 1])


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values in sorted ``x`` start."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def _types(code: np.ndarray, toks: pa.Array, n: np.ndarray, held: np.ndarray, s: "Setting", shards: int):
    """The distinct grams of a block by shard and value, their counts in training texts, and the shards."""
    seen, count = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, _, g, row in _parts(code, toks, n, s.order, s.words):
        out = held[at + row]
        for part, one in ((g[~out], 1), (g[out], 0)):
            if len(part):
                part = np.sort(part)
                first = _firsts(part)
                seen.append(part[first]), count.append(one * np.diff(first, append=len(part)))
    seen, count = _sum(np.concatenate(seen), np.concatenate(count))
    shard = _shards(seen, s.order, shards)
    by = np.argsort(shard, kind="stable")
    return seen[by], count[by], shard[by]


def _pack_grams(g: np.ndarray) -> bytes:
    return _pack(np.diff(g, prepend=np.uint64(0)))


def _pack_values(x: np.ndarray) -> bytes:
    """Few distinct values: these, and which of them each is."""
    u, code = np.unique(x, return_inverse=True)
    u, code = _pack(u), _pack(code.astype(np.uint32))
    return len(u).to_bytes(8, "little") + u + code


def _unpack_values(x: bytes, kind) -> np.ndarray:
    z = 8 + int.from_bytes(x[:8], "little")
    return _unpack(x[8:z], kind)[_unpack(x[z:], np.uint32)]


def _by_shard(x: pa.Array, name: str, kind) -> np.ndarray:
    """The values that a block was sent, in the order of shards; blocks alike share them."""
    at = np.unique(pc.struct_field(x, "shard").to_numpy(), return_index=True)[1]
    return np.concatenate([_unpack_values(v, kind) for v in pc.struct_field(x, name).take(pa.array(at)).to_pylist()])


def _unpack_grams(x: bytes) -> np.ndarray:
    return np.cumsum(_unpack(x, np.uint64), dtype=np.uint64)


def _sent(blocks: DataFrame, s: Setting, shards: int) -> DataFrame:
    """(shard, block, grams, counts): what blocks have of each shard; shard -1: sums of their short contexts."""
    low = min(LOW, s.order)

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                held, n = b.column(4)[r].values.to_numpy(zero_copy_only=False), b.column(5)[r].values.to_numpy()
                types, count, shard = _types(_numbers(b.column(1)[r].as_py(), b.column(2)[r].as_py()), b.column(3)[r].values, n, held, s, shards)
                lg, ln = _sum(types[count > 0] & _mask(low), count[count > 0])
                cut = np.flatnonzero(np.diff(shard, prepend=-1, append=shards))
                at = [(int(shard[i]), types[i:j], count[i:j]) for i, j in zip(cut[:-1], cut[1:])] + [(-1, lg, ln)]
                name = b.column(0)[r].as_py()
                for i in range(0, len(at), 64):
                    some = at[i : i + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int32()), pa.array([name] * len(some), pa.binary()), pa.array([_pack_grams(x[1]) for x in some], pa.binary()), pa.array([_pack(x[2].astype(np.uint32)) for x in some], pa.binary())], names=["shard", "block", "grams", "counts"])

    return blocks.select("block", "codes", "large", "toks", "held", "n").mapInArrow(run, "shard int, block binary, grams binary, counts binary")


class Counted:
    """Sums of packed grams, merged whenever as many have come as there are."""

    def __init__(self):
        self.g, self.n, self.new, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, g: bytes, n: bytes) -> None:
        g, n = _unpack_grams(g), _unpack(n, np.uint32)
        self.new.append((g[n > 0], n[n > 0]))
        self.size += len(g)
        if self.size > max(1 << 20, len(self.g)):
            self.done()

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        if self.new:
            self.g, self.n = _sum(np.concatenate([self.g, *[x[0] for x in self.new]]), np.concatenate([self.n, *[x[1] for x in self.new]]))
            self.new, self.size = [], 0
        return self.g, self.n


def _short(sent: DataFrame, order: int) -> list[Level]:
    """The contexts of at most LOW bytes, at the driver."""

    def run(batches):
        c = Counted()
        for b in batches:
            for r in range(b.num_rows):
                c.add(b.column(0)[r].as_py(), b.column(1)[r].as_py())
        g, n = c.done()
        yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], names=["g", "n"])

    got = sent.filter("shard = -1").select("grams", "counts").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    g, n = _sum(got["g"].to_numpy().view(np.uint64), got["n"].to_numpy())
    return levels_of(g, n, range(min(LOW, order) + 1), [])


def _answers(sent: DataFrame, low, order: int, tasks: int) -> DataFrame:
    """(block, shard, lp): the chances of what each block has in each shard, in its order."""

    def answered(shard, c, asks):
        levels = levels_of(*c.done(), range(min(LOW, order) + 1, order + 1), low.value)
        best = chances(levels[-1].pair, levels)
        for i in range(0, len(asks), 64):
            out = []
            for block, packed in asks[i : i + 64]:
                g = _unpack_grams(packed)
                at, ok = _find(levels[-1].pair, g)
                lp = np.zeros(len(g), np.float32)
                lp[ok] = best[at[ok]]
                lp[~ok] = chances(g[~ok], levels)
                out.append((block, shard, _pack_values(lp)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["block", "shard", "lp"])

    def run(batches):
        now, c, asks = None, Counted(), []
        for b in batches:
            for r in range(b.num_rows):
                shard = b.column(0)[r].as_py()
                if shard != now:
                    if asks:
                        yield from answered(now, c, asks)
                    now, c, asks = shard, Counted(), []
                g = b.column(2)[r].as_py()
                c.add(g, b.column(3)[r].as_py())
                asks.append((b.column(1)[r].as_py(), g))  # packed: a shard is about Setting.contexts grams
        if asks:
            yield from answered(now, c, asks)

    return sent.filter("shard >= 0").repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(run, "block binary, shard int, lp binary")


def _word_hashes(toks: pa.Array, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words by shard and value, their shards, and which word each is."""
    buf, off = flat(toks)
    h = hash_spans(buf, off[:-1], off[1:], 3)
    shard = (mix(h.copy()) % np.uint64(shards)).astype(np.int64)
    by = np.lexsort((h, shard))
    return h[by], shard[by], by


def _words_sent(blocks: DataFrame, shards: int) -> DataFrame:
    """(shard, block, words, counts): the distinct words of blocks as hashes, and how often they stand in training rows."""

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                h, shard, by = _word_hashes(b.column(1)[r].values, shards)
                n = b.column(2)[r].values.to_numpy()[by]
                cut = np.flatnonzero(np.diff(shard, prepend=-1, append=shards))
                at = list(zip(cut[:-1], cut[1:]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(shard[i]) for i, _ in at], pa.int32()), pa.array([b.column(0)[r].as_py()] * len(at), pa.binary()), pa.array([_pack_grams(h[i:j]) for i, j in at], pa.binary()), pa.array([_pack(n[i:j].astype(np.uint32)) for i, j in at], pa.binary())],
                    names=["shard", "block", "words", "counts"],
                )

    return blocks.select("block", "toks", "train").mapInArrow(run, "shard int, block binary, words binary, counts binary")


def _words_told(sent: DataFrame, tasks: int) -> DataFrame:
    """(block, shard, c, total, distinct): the counts of each block's words; the sums of a shard stand in one row without a block."""

    def told(shard, c, asks):
        h, n = c.done()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([shard], pa.int32()), pa.array([None], pa.binary()), pa.array([int(n.sum())], pa.int64()), pa.array([len(h)], pa.int64())], names=["block", "shard", "c", "total", "distinct"])
        for i in range(0, len(asks), 64):
            some, out = asks[i : i + 64], []
            for _, packed in some:
                at, ok = _find(h, _unpack_grams(packed))
                out.append(_pack_values(np.where(ok, n[at], 0) if len(h) else np.zeros(len(at), np.int64)))
            none = pa.array([0] * len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.binary()), pa.array([shard] * len(some), pa.int32()), pa.array(out, pa.binary()), none, none], names=["block", "shard", "c", "total", "distinct"])

    def run(batches):
        now, c, asks = None, Counted(), []
        for b in batches:
            for shard, block, words, counts in zip(*[x.to_pylist() for x in b.columns], strict=True):
                if shard != now:
                    if asks:
                        yield from told(now, c, asks)
                    now, c, asks = shard, Counted(), []
                c.add(words, counts)
                asks.append((block, words))
        if asks:
            yield from told(now, c, asks)

    return sent.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(run, "block binary, shard int, c binary, total long, distinct long")


def scores(docs: DataFrame, held: Column, s: Setting = Setting()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; ``held``: rows not to learn from."""
    scratch = Scratch(docs.sparkSession, "ppm")
    blocks = scratch.write(_blocks(docs, held, s.block))
    symbols = blocks.agg(F.coalesce(F.sum(F.length("codes")), F.lit(0))).first()[0] // 2 * 6  # bytes of text, about
    order, shards = s.order, max(8, -(-symbols // (4 * s.contexts)))  # about a byte in four is new to its block
    few = shards
    told = scratch.write(_words_told(_words_sent(blocks, few), few))
    facts = told.filter("block is null").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    end = blocks.select(F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + F.when(x, 0).otherwise(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, distinct = int(facts[0]) + end, int(facts[1]) + (end > 0)
    sent = scratch.write(_sent(blocks, s, shards))
    low = docs.sparkSession.sparkContext.broadcast(_short(sent, order))  # bounded by the alphabet
    heard_of = []
    for i in range(s.rounds):  # a share of the shards at a time, for the same reason as below
        heard_of.append(scratch.write(_answers(sent.filter(F.pmod("shard", F.lit(s.rounds)) == i), low, order, -(-shards // s.rounds))))
        scratch.drop()
    answers = reduce(DataFrame.unionByName, heard_of)
    scratch.drop(sent)
    told = told.filter("block is not null")
    add = np.log10(total + 0.5 * (distinct + 1))

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                code = _numbers(b.column(4)[r].as_py(), b.column(5)[r].as_py())
                n = b.column(3)[r].values.to_numpy()
                a = b.column(7)[r].values
                c = np.zeros(len(b.column(6)[r].values))
                if len(c):
                    c[_word_hashes(b.column(6)[r].values, few)[2]] = _by_shard(a, "c", np.int64)
                row = np.repeat(np.arange(len(n)), n)
                by = lambda w: np.bincount(row, w[code], len(n))
                base = by(np.log10(c + 0.5) - add) + np.log10(end + 0.5) - add
                lp = _by_shard(b.column(8)[r].values, "lp", np.float32)
                toks, held_ = b.column(6)[r].values, b.column(2)[r].values.to_numpy(zero_copy_only=False)
                types, _, _ = _types(code, toks, n, held_, s, shards)
                by_value = np.argsort(types)
                types, lp = types[by_value], lp[by_value]
                score = []
                for at, to, g, text in _parts(code, toks, n, order, s.words):
                    o = np.argsort(g)
                    first = _firsts(g[o])
                    each = np.repeat(lp[np.searchsorted(types, g[o[first]])], np.diff(first, append=len(g)))
                    score.append(np.bincount(text[o], each, to - at))
                score = np.concatenate(score)
                yield pa.RecordBatch.from_arrays(
                    [b.column(1)[r].values, b.column(2)[r].values, pa.array(n + 1), pa.array((by((c > 0).astype(float)) + (end > 0)).astype(np.int64)), pa.array(np.full(len(n), total)), pa.array(base), pa.array(score)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = []
    for i in range(s.rounds):  # a share of the blocks at a time, so that not all of them and their answers lie in shuffles at once
        own = F.pmod(F.xxhash64("block"), F.lit(s.rounds)) == i
        words = told.filter(own).groupBy("block").agg(F.collect_list(F.struct("shard", "c")).alias("a"))
        heard = answers.filter(own).groupBy("block").agg(F.collect_list(F.struct("shard", "lp")).alias("lp"))
        j = blocks.filter(own).select("block", "doc_id", "held", "n", "codes", "large", "toks").join(words.hint("merge"), "block", "left").join(heard.hint("merge"), "block")
        out.append(scratch.write(j.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")))
        del j, words, heard
        scratch.drop()
    scratch.drop(blocks, *heard_of)
    return reduce(DataFrame.unionByName, out)


def op7_ppm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 1)
