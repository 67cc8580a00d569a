"""SentencePiece encoding and decoding (operator 1).

The pieces of a model file stand in a double-array trie over bytes. A text is prefixed by one space
and spaces become the marker U+2581. As no piece holds a marker after another character, the best
segmentation of a text is that of its units, a run of markers and what follows up to the next marker.
Each batch of texts is cut into units, every distinct unit is segmented once by Viterbi over the sum of
the pieces' log scores, and the ids are put together by unit. All units of a batch walk the trie side by
side in numpy arrays. A character that no piece covers costs ten more than the least score and is written as its
bytes (byte fallback). Among equal sums the segmentation with the longer last piece wins.

Decoding joins the pieces, turns byte pieces to bytes and markers to spaces, and drops the first space;
bytes that are not UTF-8 become U+FFFD. A marker character in a text is read as a space, so it comes back as one.
Nulls and empty texts have no ids and decode to the empty text; rows are independent of each other, so
repeated rows get equal ids; other columns pass through unchanged except those named ``ids``,
``n_tokens`` and ``decoded``, which are replaced.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import empty_text, flat, pieces, table

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Bytes of text, and units, that are worked on at once.
PIECE, UNITS = 3 << 20, 20_000
DEFAULT_MODEL = os.environ.get("LEXMILL_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


@dataclass
class Codec:
    """The trie (``base``, ``check``, ``value``), the scores, and the bytes of each id."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown: int
    text: np.ndarray
    text_at: np.ndarray

    # --- building ---

    @staticmethod
    def build(pieces_: list[tuple[str, float, str]]) -> "Codec":
        """``pieces_``: (piece, log score, kind) by id; kind: normal, byte, unknown or control."""
        byte_ids, unknown, words = np.full(256, -1, np.int64), 0, []
        for i, (p, _, kind) in enumerate(pieces_):
            if kind == "byte":
                byte_ids[int(p[3:5], 16)] = i
            elif kind == "unknown":
                unknown = i
            elif kind == "normal":
                words.append((p.replace(MARK, " ").encode(), i))
        base, check, value = _double_array(sorted(words))
        shown = [p.replace(MARK, " ").encode() if k == "normal" else bytes([int(p[3:5], 16)]) if k == "byte" else b" \xe2\x81\x87 " if k == "unknown" else b"" for p, _, k in pieces_]
        at = np.concatenate([[0], np.cumsum([len(x) for x in shown])])
        scores = np.array([s for _, s, _ in pieces_])
        return Codec(base, check, value, scores, byte_ids, unknown, np.frombuffer(b"".join(shown), np.uint8), at)

    @property
    def least(self) -> float:
        return float(self.scores[self.value[self.value >= 0]].min())

    # --- encoding ---

    def segment(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units in ``buf`` in order, and the n + 1 offsets of each unit's ids."""
        n, units = len(buf), len(offsets) - 1
        end_of = np.repeat(offsets[1:], np.diff(offsets))
        first_of = np.repeat(offsets[:-1], np.diff(offsets))
        starts = np.flatnonzero((buf & 0xC0) != 0x80)
        char_end = np.append(starts[1:], n)
        char_end = np.minimum(char_end, end_of[starts]) if n else char_end
        # all starts walk the trie together, a byte a step
        a, at, state = starts, starts, np.zeros(len(starts), np.int64)
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        limit = end_of[starts] if n else starts
        while len(at):
            to = self.base[state] + buf[at]
            ok = self.check[to] == state
            a, at, state, limit = a[ok], at[ok] + 1, to[ok], limit[ok]
            v = self.value[state]
            hit = v >= 0
            got.append((a[hit], at[hit], v[hit]))
            more = at < limit
            a, at, state, limit = a[more], at[more], state[more], limit[more]
        s, e, v = (np.concatenate(x) if got else np.zeros(0, np.int64) for x in (zip(*got) if got else ((), (), ())))
        single = np.zeros(n + 1, bool)
        ends = np.zeros(n + 1, np.int64)
        ends[starts] = char_end
        single[s[ends[s] == e]] = True
        lone = starts[~single[starts]]
        s, e = np.concatenate([s, lone]), np.concatenate([e, ends[lone]])
        score = np.concatenate([self.scores[v], np.full(len(lone), self.least - UNKNOWN_PENALTY)])
        v = np.concatenate([v, np.full(len(lone), -1)])
        # Viterbi: edges by their start's place in the unit; within a place no two edges share an end
        place = s - first_of[s] if n else s
        order = np.argsort(place, kind="stable")
        s, e, v, score, place = s[order], e[order], v[order], score[order], place[order]
        # position p of unit u is p + u, so that the end of a unit is not the start of the next
        unit_of = np.repeat(np.arange(units), np.diff(offsets))
        u = unit_of[s] if n else s
        sn, en = s + u, e + u
        best, back = np.full(n + units, -np.inf), np.full(n + units, -1)
        best[offsets[:-1] + np.arange(units)] = 0
        cuts = np.flatnonzero(np.diff(place)) + 1
        for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(place)]]), strict=True):
            if lo == hi:
                continue
            cand, to = best[sn[lo:hi]] + score[lo:hi], en[lo:hi]
            up = cand > best[to]
            best[to[up]] = cand[up]
            back[to[up]] = np.flatnonzero(up) + lo
        # back from the ends, all units together
        live = np.arange(units)
        at, stop = offsets[1:] + live, offsets[:-1] + live
        keep = at > stop
        live, at, stop = live[keep], at[keep], stop[keep]
        rev = []
        while len(live):
            edge = back[at]
            rev.append((live, edge))
            at = sn[edge]
            keep = at > stop
            live, at, stop = live[keep], at[keep], stop[keep]
        if not rev:
            return np.zeros(0, np.int32), np.zeros(units + 1, np.int64)
        owner = np.concatenate([x for x, _ in rev[::-1]])
        edge = np.concatenate([x for _, x in rev[::-1]])
        o = np.argsort(owner, kind="stable")
        owner, edge = owner[o], edge[o]
        ids, width = v[edge], np.ones(len(edge), np.int64)
        raw = ids < 0
        if raw.any() and (self.byte_ids >= 0).all():
            width[raw] = e[edge[raw]] - s[edge[raw]]
        at = np.repeat(np.arange(len(edge)), width)
        inner = np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width)
        out = ids[at]
        as_byte = out < 0
        if as_byte.any():
            out[as_byte] = self.byte_ids[buf[s[edge[at[as_byte]]] + inner[as_byte]]] if (self.byte_ids >= 0).all() else self.unknown
        counts = np.bincount(owner, width, units).astype(np.int64)
        return out.astype(np.int32), np.concatenate([[0], np.cumsum(counts)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order and the n + 1 offsets of each text's ids."""
        buf, offsets = flat(pc.replace_substring(texts, MARK, " ") if pc.any(pc.match_substring(texts, MARK)).as_py() else texts)
        rows = len(offsets) - 1
        full = np.flatnonzero(np.diff(offsets) > 0)
        stream = np.empty(len(buf) + len(full), np.uint8)
        lead = offsets[full] + np.arange(len(full))  # where each text's own space stands
        put = np.ones(len(stream), bool)
        put[lead] = False
        stream[put], stream[lead] = buf, 32
        space = stream == 32
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[lead] = True
        at = np.flatnonzero(cut)
        bounds = np.append(at, len(stream)).astype(np.int64)
        arr = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(stream)])
        enc = arr.dictionary_encode()
        ubuf, uoff = flat(enc.dictionary)
        parts, counts_ = [np.zeros(0, np.int32)], []
        for i in range(0, len(uoff) - 1, UNITS):  # bounds the memory for edges
            o = uoff[i : i + UNITS + 1]
            got, off = self.segment(ubuf[o[0] : o[-1]], o - o[0])
            parts.append(got)
            counts_.append(np.diff(off))
        ids = np.concatenate(parts)
        ioff = np.concatenate([[0], np.cumsum(np.concatenate(counts_))]) if counts_ else np.zeros(1, np.int64)
        code = enc.indices.to_numpy(zero_copy_only=False)
        counts = np.diff(ioff)[code]
        total = np.concatenate([[0], np.cumsum(counts)])
        flat_at = np.repeat(ioff[:-1][code] - total[:-1], counts) + np.arange(total[-1])
        unit_edge = np.searchsorted(at, lead)  # the first unit of each full text
        per_row = np.zeros(rows + 1, np.int64)
        per_row[full + 1] = np.diff(np.append(total[unit_edge], total[-1]))
        return ids[flat_at] if len(flat_at) else np.zeros(0, np.int32), np.cumsum(per_row)

    # --- decoding ---

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of rows of ids."""
        size = np.diff(self.text_at)[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        src = np.repeat(self.text_at[:-1][ids] - ends[:-1], size) + np.arange(ends[-1])
        out = self.text[src] if len(src) else np.zeros(0, np.uint8)
        bounds = ends[offsets]
        drop = bounds[:-1][np.diff(bounds) > 0]
        drop = drop[out[drop] == 32]
        if len(drop):
            keep = np.ones(len(out), bool)
            keep[drop] = False
            out = out[keep]
            bounds = bounds - np.searchsorted(drop, bounds)
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out))])
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())


def _double_array(words: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base``, ``check`` and ``value`` of the trie of sorted byte strings; the root is state 0."""
    size = 1 << max(12, int(sum(len(w) for w, _ in words) * 2 + 1024).bit_length())
    base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    used = bytearray(size)
    used[0] = 1
    free, ahead, most = 1, 1, 0
    todo = [(0, 0, len(words), 0)]  # state, range of words, depth
    while todo:
        state, lo, hi, depth = todo.pop()
        if lo < hi and len(words[lo][0]) == depth:
            value[state] = words[lo][1]
            lo += 1
        kids = []
        i = lo
        while i < hi:
            c, j = words[i][0][depth], i
            while j < hi and words[j][0][depth] == c:
                j += 1
            kids.append((c, i, j))
            i = j
        if not kids:
            continue
        codes = [k[0] for k in kids]
        if len(codes) == 1:  # one child fills the first hole
            free = used.index(0, free)
            slot = free
            while slot <= codes[0]:
                slot = used.index(0, slot + 1)
            at = slot - codes[0]
        else:
            at, tries = ahead, 0
            while any(used[at + c] for c in codes):
                at, tries = at + 1, tries + 1
                if tries > 100:
                    ahead, tries = at, 0
        base[state] = at
        for c, i, j in kids:
            used[at + c] = 1
            check[at + c] = state
            todo.append((at + c, i, j, depth + 1))
        most = max(most, at + 256)
    # a leaf's base 0 would lead to states near the root whose check is another state, so it never matches; 256 more keep lookups inside
    return base[: most + 257], check[: most + 257], value[: most + 257]


@lru_cache(maxsize=4)
def load(path: str = DEFAULT_MODEL) -> Codec:
    """The codec of a model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if sp.is_byte(i) else "unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) or sp.is_unused(i) else "normal"
    return Codec.build([(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())])


def encode(docs: DataFrame, codec: Codec) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids``."""
    names = [c for c in docs.columns if c not in ("n_tokens", "ids")]
    schema = docs.select(*names).schema.add("n_tokens", "long").add("ids", ArrayType(IntegerType()))
    shared = docs.sparkSession.sparkContext.broadcast(codec)  # some MB: bounded by the model file

    def run(batches):
        for b in pieces(batches, PIECE):
            ids, off = shared.value.encode(b.column(b.schema.get_field_index("text")))
            got = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.diff(off)), got], names=[*names, "n_tokens", "ids"])

    return docs.select(*names).mapInArrow(run, schema)


def decode(coded: DataFrame, codec: Codec) -> DataFrame:
    """``coded`` with the ``decoded`` texts of its ``ids``; null ids decode to the empty text."""
    names = [c for c in coded.columns if c != "decoded"]
    schema = coded.select(*names).schema.add("decoded", "string")
    shared = coded.sparkSession.sparkContext.broadcast(codec)

    def run(batches):
        for b in pieces(batches, PIECE):
            col = b.column(b.schema.get_field_index("ids"))
            off = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))])
            ids = pc.list_flatten(col).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns, shared.value.decode(ids, off)], names=[*names, "decoded"])

    return coded.select(*names).mapInArrow(run, schema)


def round_trip(docs: DataFrame, codec: Codec) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` and ``decoded`` in one pass, which needs one Python worker a task, not two."""
    names = [c for c in docs.columns if c not in ("n_tokens", "ids", "decoded")]
    schema = docs.select(*names).schema.add("n_tokens", "long").add("ids", ArrayType(IntegerType())).add("decoded", "string")
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches):
        for b in pieces(batches, PIECE):
            ids, off = shared.value.encode(b.column(b.schema.get_field_index("text")))
            got = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.diff(off)), got, shared.value.decode(ids, off)], names=[*names, "n_tokens", "ids", "decoded"])

    return docs.select(*names).mapInArrow(run, schema)


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model: str = DEFAULT_MODEL) -> DataFrame:
    out = round_trip(table(spark, sf_dir, "documents").select("doc_id", empty_text().alias("text")), load(model))
    return out.select("doc_id", "n_tokens", "ids", "decoded", (F.col("decoded") == F.col("text")).alias("round_trip"))
