"""Toxicity by weak supervision (operator 9).

1. Items: words and word beginnings (3 to 7 characters) that occur in toxic labelled rows and hardly
   in others. They are mined by the executors from at most ``sample_rows`` labelled training rows; near copies of a row
   count once, so that the words of a much copied text don't look like evidence. No text reaches the driver.
2. Voters: the items are dealt to ``lexicons`` word voters and ``patterns`` pattern voters. A voter votes
   toxic where one of its items occurs. The votes of all training rows are counted by pattern, at most
   2 ** voters rows.
3. Generative label model: a latent class model fitted to these counts by expectation maximisation,
   without labels. Voters that agree more than their accuracies explain are joined to cliques with a
   joint table each, and the model is fitted again: accuracies and correlations.
4. Linear classifier: logistic regression on the presence of items, trained on the posterior labels of
   the sample's rows. It scores every row.

Labels are read of training rows only; lang, source and doc_id are never inputs of a score. Nulls and
empty texts have no item and get the score of the bias; a null label or id is left out of training.
Without any toxic label every score is 0. Rows alike get the same score, very long texts are scored whole; an id that
repeats is learnt from by its least text. Ties between items go to words, then to longer beginnings, then by text.
Other columns pass through; a column ``score`` is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Scratch, crc_mod, empty_text, flat, hash_spans, pieces, table


@dataclass(frozen=True)
class Setting:
    """``sample_rows`` bounds the labelled rows that items and the classifier are learnt from, one text for each id.

    ``most_items``: the items with the most rows that are taken; a linear model of so many weights.
    """

    sample_rows: int = 8000
    lexicons: int = 6
    patterns: int = 6
    least_rows: int = 6
    purity: float = 0.95
    most_items: int = 400
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7)
    rounds: int = 200
    correlated: float = 0.2
    l2: float = 1e-3


# --- items of a text: hashes of its words and word beginnings ----------------------------------

LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = LETTER[128:] = True


def _starts(buf: np.ndarray, offsets: np.ndarray):
    """Runs of letters (bytes past ASCII count as letters): starts, ends and rows."""
    n = len(buf)
    in_ = np.zeros(n + 2, dtype=bool)
    in_[1:-1] = LETTER[buf]
    start, end = in_[1:-1] & ~in_[:-2], in_[1:-1] & ~in_[2:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    start[inner] = in_[1:-1][inner]
    end[inner - 1] = in_[1:-1][inner - 1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(offsets, s, side="right") - 1


def items_of(texts: pa.Array, prefixes: tuple[int, ...]):
    """Hashes of items and their rows: whole words with seed 0, beginnings of n characters with seed n."""
    buf, offsets = flat(texts)
    buf = LOWER[buf]
    s, e, rows = _starts(buf, offsets)
    yield 0, hash_spans(buf, s, e, 0), rows, (buf, s, e)
    lead = np.zeros(len(buf) + 1, np.int32)  # characters before each byte
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    place = np.append(np.flatnonzero((buf & 0xC0) != 0x80).astype(np.int32), np.int32(len(buf)))
    for n in prefixes:
        ok = lead[e] - lead[s] > n
        a = s[ok]
        z = place[np.minimum(lead[a] + n, len(place) - 1)]
        yield n, hash_spans(buf, a, z, n), rows[ok], (buf, a, z)


def _sketch(words: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """One minimum of hashed pairs of words per row; near copies mostly share it."""
    out = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    pair = rows[1:] == rows[:-1] if len(rows) else np.zeros(0, bool)
    h = (words[:-1] * np.uint64(3) ^ words[1:]) * np.uint64(0x9E3779B97F4A7C15)
    np.minimum.at(out, rows[:-1][pair], h[pair])
    return out


def _sample(docs: DataFrame, labels: DataFrame, s: Setting, scratch: Scratch) -> DataFrame:
    """(mark, foul, toxic, text) of the labelled training rows, one text for each id; rows alike in ``mark`` are near copies.

    A mark with a toxic row is ``foul``.
    """
    own = labels.filter(crc_mod("doc_id", 3) != 1).filter("doc_id is not null and toxic is not null")
    own = own.groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample_rows)
    text = docs.select("doc_id", empty_text().alias("text")).join(F.broadcast(own), "doc_id")  # at most sample_rows rows of two numbers
    one = text.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("toxic", "text")

    def run(batches):
        for b in pieces(batches):
            _, h, rows, _ = next(items_of(b.column(1), ()))
            yield pa.RecordBatch.from_arrays([pa.array(_sketch(h, rows, b.num_rows).view(np.int64)), *b.columns], names=["mark", "toxic", "text"])

    rows = scratch.write(one.mapInArrow(run, "mark long, toxic boolean, text string"))
    foul = rows.groupBy("mark").agg(F.max("toxic").alias("foul"))
    return scratch.write(rows.join(foul.hint("merge"), "mark").select("mark", "foul", "toxic", "text"))


def _pairs(code: np.ndarray, mark: np.ndarray) -> np.ndarray:
    return np.unique(np.stack([code, mark]), axis=1) if len(code) else np.zeros((2, 0), np.int64)


def mine(sample: DataFrame, s: Setting) -> list[tuple[int, str]]:
    """(kind, item) by decreasing rows: kind 0 is a word, n a beginning of n characters.

    Candidates come from the toxic rows; the other rows are only asked for these. Rows of one mark count once: they
    meet in one task. Only items and numbers reach the driver.
    """
    dealt = sample.repartition(max(1, s.sample_rows // 250), "mark")

    def up(batches):
        shown, met = {}, defaultdict(list)
        for b in pieces(batches, 1 << 20):
            mark = b.column(0).to_numpy()
            for kind, h, rows, (buf, a, z) in items_of(b.column(1), s.prefixes):
                u, at, code = np.unique(h, return_index=True, return_inverse=True)
                for x, i in zip(u.tolist(), at.tolist(), strict=True):
                    if (kind, x) not in shown:
                        shown[kind, x] = bytes(buf[a[i] : z[i]]).decode("utf-8", "replace")
                met[kind].append(_pairs(h.view(np.int64), mark[rows]))
        for kind, parts in met.items():
            u, n = np.unique(_pairs(*np.concatenate(parts, axis=1))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u), pa.array([shown[kind, x] for x in u.view(np.uint64).tolist()], pa.string()), pa.array(n)], names=["kind", "h", "item", "up"])

    facts = sample.agg(F.count("*"), F.count(F.when(F.col("toxic"), 1))).first()
    if not facts[1]:
        return []
    share = max(facts[1] / facts[0], 1e-6)
    seen = dealt.filter("toxic").select("mark", "text").mapInArrow(up, "kind int, h long, item string, up long")
    seen = seen.groupBy("kind", "h").agg(F.sum("up").alias("up"), F.min("item").alias("item"))
    total = {r[0]: r[1] for r in seen.groupBy("kind").count().collect()}
    got = seen.filter(F.col("up") >= s.least_rows).toArrow().sort_by([("kind", "ascending"), ("h", "ascending")])
    kinds, h, ups, shown = got["kind"].to_numpy(), got["h"].to_numpy(), got["up"].to_numpy(), got["item"].to_pylist()
    # and more rows than chance gives at the share of toxic rows
    sure = ups * np.log(1 / share) > np.log(np.maximum([total[k] for k in kinds.tolist()], 2)) + 3
    kinds, h, ups, shown = kinds[sure], h[sure], ups[sure], [x for x, ok in zip(shown, sure, strict=True) if ok]
    wanted = {int(k): (h[kinds == k], np.flatnonzero(kinds == k)) for k in np.unique(kinds)}

    def down(batches):
        met = []
        for b in pieces(batches, 1 << 20):
            mark = b.column(0).to_numpy()
            for kind, x, rows, _ in items_of(b.column(1), s.prefixes):
                if kind in wanted:
                    u, ids = wanted[kind]
                    x = x.view(np.int64)
                    at = np.minimum(np.searchsorted(u, x), len(u) - 1)
                    ok = u[at] == x
                    met.append(_pairs(ids[at[ok]], mark[rows[ok]]))
        if met:
            u, n = np.unique(_pairs(*np.concatenate(met, axis=1))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], names=["i", "down"])

    against = np.zeros(len(ups))
    if wanted:
        told = dealt.filter("not foul").select("mark", "text").mapInArrow(down, "i long, down long").groupBy("i").agg(F.sum("down").alias("down")).toArrow()
        against[told["i"].to_numpy()] = told["down"].to_numpy()
    found = [(int(ups[i]), int(kinds[i]), shown[i]) for i in np.flatnonzero(ups / (ups + against + 0.1) >= s.purity)]
    found.sort(key=lambda x: (-x[0], x[1] != 0, -x[1], x[2]))
    return [(k, t) for _, k, t in found[: s.most_items]]


# --- voters and the label model ------------------------------------------------------------------


def voters_of(items: list[tuple[int, str]], s: Setting) -> np.ndarray:
    """The voter of each item: words and patterns are dealt in turn, so that each voter gets frequent ones."""
    seen: dict[bool, int] = defaultdict(int)
    out = []
    for kind, _ in items:
        w = kind == 0
        out.append(seen[w] % s.lexicons if w else s.lexicons + seen[w] % s.patterns)
        seen[w] += 1
    return np.array(out, dtype=np.int64)


@dataclass
class LabelModel:
    """P(toxic | votes): each clique of voters has a joint table of its votes for both classes."""

    cliques: list[list[int]]
    prior: float = 0.1
    tables: list[np.ndarray] = field(default_factory=list)

    def _states(self, votes: np.ndarray) -> list[np.ndarray]:
        return [sum((((votes >> v) & 1) << i) for i, v in enumerate(c)) for c in self.cliques]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for st, t in zip(self._states(votes), self.tables, strict=True):
            # a voter without a hit abstains: it speaks only where all are silent
            log += np.where((st > 0) | (votes == 0), np.log(t[1, st]) - np.log(t[0, st]), 0)
        return 1 / (1 + np.exp(-np.clip(log, -50, 50)))

    def fit(self, votes: np.ndarray, n: np.ndarray, rounds: int) -> "LabelModel":
        states = self._states(votes)
        p = np.where(votes > 0, 0.9, 0.02)  # a row with a vote is first held to be toxic: that orients the classes
        for _ in range(rounds):
            was = p
            self.prior = float(np.clip((n * p).sum() / n.sum(), 1e-4, 0.5))
            self.tables = []
            for st, c in zip(states, self.cliques, strict=True):
                t = np.stack([np.bincount(st, n * q, 2 ** len(c)) for q in (1 - p, p)]) + 0.01
                self.tables.append(t / t.sum(1, keepdims=True))
            p = self.posterior(votes)
            if np.abs(p - was).max() < 1e-6:
                break
        return self

    def correlations(self, votes: np.ndarray, n: np.ndarray, voters: int) -> np.ndarray:
        """What voters agree beyond their accuracies: the mean within both classes of their covariance, as a correlation."""
        p = self.posterior(votes)
        x = ((votes[:, None] >> np.arange(voters)) & 1).astype(float)
        cov = np.zeros((voters, voters))
        for q in (p, 1 - p):
            w = n * q
            mean = (w[:, None] * x).sum(0) / max(w.sum(), 1e-9)
            cov += ((w[:, None] * (x - mean)).T @ (x - mean)) / n.sum()
        d = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        return cov / d[:, None] / d[None, :]


def fit_labels(votes: np.ndarray, n: np.ndarray, voters: int, s: Setting) -> LabelModel:
    model = LabelModel([[v] for v in range(voters)]).fit(votes, n, s.rounds)
    corr = np.abs(model.correlations(votes, n, voters))
    cliques: list[list[int]] = []
    for v in range(voters):  # a voter joins the first clique with a correlated member; four at most share a table
        home = next((c for c in cliques if len(c) < 4 and max(corr[v, u] for u in c) > s.correlated), None)
        if home is None:
            cliques.append([v])
        else:
            home.append(v)
    return LabelModel(cliques).fit(votes, n, s.rounds)


def fit_linear(hits: np.ndarray, rows: np.ndarray, y: np.ndarray, items: int, s: Setting) -> tuple[np.ndarray, float]:
    """Logistic regression on the presence of items for soft labels: weights and bias, by gradient descent."""
    w, b, n = np.zeros(items), 0.0, len(y)
    size = np.maximum(np.bincount(hits, minlength=items) / n, 1e-4)
    for _ in range(300):
        z = b + np.bincount(rows, w[hits], n)
        g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        w -= 0.5 * (np.bincount(hits, g[rows], items) / n / size + s.l2 * w)
        b -= 2.0 * g.mean()
    return w, float(b)


def _matcher(items: list[tuple[int, str]], s: Setting):
    """A function from texts to the distinct (row, item) pairs that occur."""
    by: dict[int, list[int]] = defaultdict(list)
    for i, (k, _) in enumerate(items):
        by[k].append(i)
    keys = {}
    for k, ids in by.items():
        raw = [items[i][1].encode() for i in ids]
        ends = np.cumsum([len(x) for x in raw])
        h = hash_spans(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], ends[:-1]]), ends, k)
        o = np.argsort(h)
        keys[k] = h[o], np.array(ids)[o]
    lengths = tuple(n for n in s.prefixes if n in keys)

    def match(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        out = [np.zeros(0, np.int64)]
        for k, h, rows, _ in items_of(texts, lengths):
            if k in keys:
                hs, ids = keys[k]
                at = np.minimum(np.searchsorted(hs, h), len(hs) - 1)
                ok = hs[at] == h
                out.append(rows[ok] * len(items) + ids[at[ok]])
        pairs = np.unique(np.concatenate(out))
        return pairs // max(len(items), 1), pairs % max(len(items), 1)

    return match


def _votes(rows: np.ndarray, hits: np.ndarray, n: int, voter: np.ndarray) -> np.ndarray:
    v = np.zeros(n, np.int64)
    np.bitwise_or.at(v, rows, np.left_shift(np.int64(1), voter[hits]))
    return v


@dataclass
class Model:
    items: list[tuple[int, str]]
    weights: np.ndarray
    bias: float
    labels: LabelModel | None
    setting: Setting


def train(docs: DataFrame, labels: DataFrame, s: Setting = Setting()) -> Model:
    """Learns from the rows of ``docs`` whose remainder isn't 1, and only their labels."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = _sample(docs, labels, s, scratch)
    items = mine(sample, s)
    if not items:
        return Model([], np.zeros(0), -40.0, None, s)
    voter = voters_of(items, s)

    def count(batches):
        for b in pieces(batches):
            rows, hits = _matcher(items, s)(b.column(0))
            v, n = np.unique(_votes(rows, hits, b.num_rows, voter), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(n)], names=["votes", "n"])

    training = docs.filter(crc_mod("doc_id", 3) != 1).select(empty_text().alias("text"))
    seen = training.mapInArrow(count, "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n")).toArrow().sort_by("votes")
    model = fit_labels(seen["votes"].to_numpy(), seen["n"].to_numpy().astype(float), s.lexicons + s.patterns, s)

    def met(batches):
        match = _matcher(items, s)
        for b in pieces(batches):
            rows, hits = match(b.column(0))
            off = np.searchsorted(rows, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(_votes(rows, hits, b.num_rows, voter)), pa.ListArray.from_arrays(pa.array(off), pa.array(hits))], names=["votes", "hits"])

    got = sorted(((r.votes, tuple(r.hits)) for r in sample.select("text").mapInArrow(met, "votes long, hits array<long>").collect()))
    y = model.posterior(np.array([v for v, _ in got], np.int64))
    rows, hits = np.repeat(np.arange(len(got)), [len(x) for _, x in got]), np.array([i for _, x in got for i in x], np.int64)
    w, b = fit_linear(hits, rows, y, len(items), s)
    return Model(items, w, b, model, s)


def score(docs: DataFrame, m: Model) -> DataFrame:
    """``docs`` with ``score`` from 0 to 1; texts stay in their rows and nothing is shuffled."""
    names = [c for c in docs.columns if c != "score"]
    schema = docs.select(*names).schema.add("score", "double")

    def run(batches):
        match = _matcher(m.items, m.setting) if m.items else None
        for b in pieces(batches):
            z = np.full(b.num_rows, m.bias)
            if match:
                rows, hits = match(b.column(b.schema.get_field_index("text")))
                z += np.bincount(rows, m.weights[hits], b.num_rows)
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*names, "score"])

    return docs.select(*names).mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    m = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), m).select(
        "doc_id",
        (crc_mod("doc_id", 3) == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"),
    )
