"""Near duplicates by MinHash with sequential Bayesian verification (operator 10).

A document's set holds the hashes of its runs of ``words`` words (the whole sequence if it is shorter).
Documents with equal sets form one class, named by 128 bits of hash, and everything after works on classes.

1. Candidates: minima of ``bands * rows`` hash functions; classes that agree in all rows of a band share a
   bucket. At a similarity of 0.8 a pair misses all 36 bands of 6 rows with a chance of 2e-5.
2. Stars: in each bucket every class is compared with the bucket's lead, the class with the largest buckets,
   so that the buckets of a group of copies mostly have one lead, at its centre.
3. Sequential Bayesian verification: signatures, a byte a minimum, are compared in batches of 24. A pair
   goes as soon as the posterior chance of the wanted similarity falls under ``miss``.
4. Survivors are verified exactly on the full sets, made anew from the texts.
5. Links make components (least label with pointer jumping, tables in the shared folder).
6. Buckets that still hold several components: every class of such a bucket is written as its differences from the
   lead's set. How many differences two classes must share follows from their sizes (see _met), so a join on the
   rarest differences of each gives all pairs that can be linked, exactly, without meeting all pairs of a
   group. These are pruned and verified as before; their links join the components of step 5.

Nulls and empty texts have empty sets and are linked with nothing. Very long texts are sets like others. Rows that
repeat a doc_id share its component; the component's id is the least doc_id in it, and null only if no row has one.
In the query, a row without an id is kept where its component has no id. Ties of leads go to the greater class
name and change no result. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, M1, Scratch, empty_text, flat, hash_spans, mix, pieces, table, word_bounds


@dataclass(frozen=True)
class Setting:
    """Similarity of at least ``least`` per cent; ``miss``: the posterior chance at which a pair is given up."""

    words: int = 5
    least: int = 80
    bands: int = 36
    rows: int = 6
    batch: int = 24
    miss: float = 1e-6
    seed: int = 7


ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5]


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf, offsets = flat(texts)
    buf = LOWER[buf]
    starts, ends, rows = word_bounds(buf, offsets)
    h = hash_spans(buf, starts, ends)
    at = np.searchsorted(rows, np.arange(len(offsets)))
    k = max(len(h) - words + 1, 0)
    run = np.zeros(k, np.uint64)
    for i in range(words):
        run = mix((run ^ h[i : i + k]) * np.uint64(ODD[i % 4]) + np.uint64(i + 1)) if k else run
    out = []
    for a, z in zip(at[:-1], at[1:], strict=True):
        if z - a >= words:
            out.append(np.unique(run[a : z - words + 1]))
        elif z > a:
            one = np.zeros(1, np.uint64)
            for x in h[a:z]:
                one = mix((one ^ x) * M1 + np.uint64(77))
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _functions(s: Setting) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(s.seed)
    n = s.bands * s.rows
    return r.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, n, dtype=np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    least = np.full(len(a), np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 4096):
        np.minimum(least, (a[:, None] * x[None, i : i + 4096] + b[:, None]).min(1), out=least)
    return least


def _sets(docs: DataFrame, s: Setting) -> DataFrame:
    """doc_id, text hash, class (null: empty set), size, band keys and byte signature of every row."""
    a, b = _functions(s)
    salt = mix(np.arange(1, s.bands + 1, dtype=np.uint64) * M1)

    def run(batches):
        for batch in pieces(batches):
            n, sid, keys, sig = [], [], [], []
            for u in shingle_sets(batch.column(2), s.words):
                n.append(len(u))
                if not len(u):
                    sid.append(None), keys.append(None), sig.append(None)
                    continue
                h1, h2 = int(u.sum(dtype=np.uint64)), int(mix(u * np.uint64(ODD[1])).sum(dtype=np.uint64))
                sid.append(h1.to_bytes(8, "big") + h2.to_bytes(8, "big"))
                m = signature(u, a, b)
                k = salt.copy()
                for col in m.reshape(s.bands, s.rows).T:
                    k = mix((k ^ col) * M1)
                keys.append(k.view(np.int64))
                sig.append((m & np.uint32(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sid, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                names=["doc_id", "th", "sid", "n", "keys", "sig"],
            )

    d = docs.select("doc_id", F.xxhash64(empty_text()).alias("th"), empty_text().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, th long, sid binary, n long, keys array<long>, sig binary")


def enough(s: Setting) -> list[tuple[int, int]]:
    """(compared, least matches): with fewer, the posterior chance of the similarity is under ``miss``.

    Under a uniform prior that chance is P(Binomial(n + 1, p) <= matches), where p is the chance that two
    bytes agree at the similarity.
    """
    p = s.least / 100 + (1 - s.least / 100) / 256
    out = []
    for n in range(s.batch, s.bands * s.rows + 1, s.batch):
        total, m = 0.0, -1
        while total < s.miss:
            m += 1
            total += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        out.append((n, m))
    return out


def survive(x: np.ndarray, y: np.ndarray, s: Setting) -> np.ndarray:
    """Which rows of byte signatures survive all batches."""
    live, same, was = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    for n, least in enough(s):
        same[live] += (x[live, was:n] == y[live, was:n]).sum(1)
        live, was = live[same[live] >= least], n
        if not len(live):
            break
    return live


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _prune(pairs: DataFrame, classes: DataFrame, s: Setting) -> DataFrame:
    """Of the pairs (a, b) of classes those that survive."""
    width = s.bands * s.rows
    c = classes.select("sid", "n", "sig")
    j = pairs.join(c.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    j = j.join(c.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
    j = j.filter(F.lit(100) * F.least("na", "nb") >= F.lit(s.least) * F.greatest("na", "nb")).select("a", "b", "sa", "sb")

    def run(batches):
        for t in batches:
            if t.num_rows:
                keep = survive(_matrix(t.column(2), width), _matrix(t.column(3), width), s)
                yield t.select(["a", "b"]).take(pa.array(keep))

    return j.mapInArrow(run, "a binary, b binary")


def _texts(classes: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """One text of each of ``classes``: sid, text."""
    one = sets.filter("n > 0").groupBy("sid").agg(F.min(F.struct("doc_id", "th")).alias("r"))
    one = one.join(classes.select("sid").hint("merge"), "sid").select(F.col("r.doc_id").alias("_id"), F.col("r.th").alias("_th"), "sid")
    d = docs.select("doc_id", empty_text().alias("text")).withColumn("th", F.xxhash64("text"))
    d = d.join(one.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    return d.groupBy("sid").agg(F.first("text").alias("text"))  # ids and texts may repeat in docs


def _verify(pairs: DataFrame, texts: DataFrame, s: Setting) -> DataFrame:
    """Of the pairs those whose full sets are similar enough."""
    j = pairs.join(texts.select(F.col("sid").alias("b"), F.col("text").alias("tb")), "b")
    j = j.join(texts.select(F.col("sid").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    least = s.least

    def run(batches):
        for t in pieces(batches):
            x, y = shingle_sets(t.column(2), s.words), shingle_sets(t.column(3), s.words)
            keep = []
            for i, (p, q) in enumerate(zip(x, y, strict=True)):
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= least * (len(p) + len(q) - both):
                    keep.append(i)
            yield t.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return j.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of all nodes in ``links`` (a, b): the label is the least node of the component."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.write(both.filter("a <> b").distinct())
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        at = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        near = both.join(at.hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("lb").alias("near"))
        step = labels.join(near.hint("merge"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = step.join(up.hint("merge"), "label", "left").select("node", "was", F.least("label", "up").alias("label"))
        new = scratch.write(step)
        changed = new.filter("was <> label").limit(1).count()
        scratch.drop(labels)
        labels = new.select("node", "label")
        labels._scratch_path = new._scratch_path
        if not changed:
            return labels


def _typical(members: DataFrame) -> DataFrame:
    """(key, lead): the class of each bucket whose buckets are the largest in sum; buckets of a group mostly share it."""
    size = members.groupBy("key").agg(F.count("*").alias("m"))
    typical = members.join(size.hint("merge"), "key").groupBy("sid").agg(F.sum("m").alias("m"))
    return members.join(typical.hint("merge"), "sid").groupBy("key").agg(F.max(F.struct("m", "sid"))["sid"].alias("lead"))


def _groups(members: DataFrame, leads: DataFrame, labels: DataFrame) -> DataFrame:
    """(lead, sid, label, alone): the buckets of three or more that still hold several components, by lead.

    ``alone``: not in the lead's component. Buckets with one lead are one group.
    """
    m = members.join(labels.select(F.col("node").alias("sid"), "label").hint("merge"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    mixed = m.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).filter("lo <> hi and m > 2")
    own = labels.select(F.col("node").alias("lead"), F.col("label").alias("ll"))
    at = mixed.join(leads.hint("merge"), "key").join(own.hint("merge"), "lead", "left").select("key", "lead", F.coalesce("ll", "lead").alias("ll"))
    m = m.join(at.hint("merge"), "key").groupBy("lead", "sid").agg(F.first("label").alias("label"), F.first("ll").alias("ll"))
    return m.select("lead", "sid", "label", (F.col("label") != F.col("ll")).alias("alone"))


def _differences(groups: DataFrame, texts: DataFrame, s: Setting) -> DataFrame:
    """(lead, sid, label, alone, cost, least, marks): what each class's set lacks of its lead's and adds to it, as hashes.

    ``cost``: see _met; ``least``: the cost of the lead, under which no class of the group is.
    """
    j = groups.join(texts.select("sid", F.col("text").alias("tb")).hint("merge"), "sid")
    j = j.join(texts.select(F.col("sid").alias("lead"), F.col("text").alias("ta")).hint("merge"), "lead").select("lead", "sid", "label", "alone", "ta", "tb")
    part = s.least

    def run(batches):
        for t in pieces(batches):
            x, y = shingle_sets(t.column(4), s.words), shingle_sets(t.column(5), s.words)
            lists, cost, lowest = [], [], []
            for p, q in zip(x, y, strict=True):
                marks = np.setxor1d(p, q, assume_unique=True)
                lacks = (len(marks) + len(p) - len(q)) // 2
                lowest.append((part - 100) * len(p))
                cost.append(200 * lacks + 2 * part * (len(marks) - lacks) + lowest[-1])
                lists.append(marks.view(np.int64))
            off = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            marks = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([*lists, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*t.columns[:4], pa.array(cost, pa.int64()), pa.array(lowest, pa.int64()), marks], names=["lead", "sid", "label", "alone", "cost", "least", "marks"])

    return j.mapInArrow(run, "lead binary, sid binary, label binary, alone boolean, cost long, least long, marks array<long>")


def _met(diff: DataFrame, s: Setting) -> DataFrame:
    """Pairs (a, b) of different components that may be similar enough by what they share of their differences.

    With a lead of b shingles, of which x lacks r(x), and a(x) that x adds, the sets of x and y share
    b - r(x) - r(y) and the differences that both have. So with p = ``least`` per cent and
    cost(x) = 200 r(x) + 2 p a(x) - (100 - p) b they are similar enough if and only if
    (200 + 2 p) * shared >= cost(x) + cost(y). Where that sum isn't positive, both are linked to the lead already.
    All others must share t >= 1 differences, so one among the rarest but t - 1 of each; a difference with
    i rarer ones of m after it can only meet classes of a cost up to a bound, and that bound is part of the join.
    """
    scale = 200 + 2 * s.least
    posts = diff.select("lead", "sid", "label", "alone", "cost", "least", F.explode("marks").alias("mark"))
    often = posts.groupBy("lead", "mark").agg(F.count("*").alias("n"), F.max("alone").alias("any")).filter("n > 1 and any").drop("any")
    seen = posts.join(often.hint("merge"), ["lead", "mark"]).groupBy("lead", "sid").agg(F.sort_array(F.collect_list(F.struct("n", "mark"))).alias("o"), *[F.first(c).alias(c) for c in ("label", "alone", "cost", "least")])
    # differences that no class out of the lead's component shares come first, and lead to none
    rank = seen.select("lead", "sid", "label", "alone", "cost", "least", F.size("o").alias("m"), F.posexplode("o").alias("i", "x"))
    rank = rank.select("lead", "sid", "label", "alone", "cost", "least", F.col("x.mark").alias("mark"), (F.lit(scale).cast("long") * (F.col("m") - F.col("i")) - F.col("cost")).alias("most"))
    rank = rank.filter("most >= least")
    x = rank.filter("alone").select("lead", "mark", *[F.col(c).alias(f"{c}_x") for c in ("sid", "label", "cost", "most")])
    y = rank.select("lead", "mark", *[F.col(c).alias(f"{c}_y") for c in ("sid", "label", "alone", "cost", "most")])
    j = x.join(y.hint("merge"), ["lead", "mark"])
    j = j.filter("label_x <> label_y and cost_y <= most_x and cost_x <= most_y and (not alone_y or sid_x < sid_y)")
    return j.select(F.least("sid_x", "sid_y").alias("a"), F.greatest("sid_x", "sid_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, s: Setting = Setting()) -> DataFrame:
    """doc_id, th (the hash of the text), n_shingles and component_id of every row."""
    scratch = Scratch(docs.sparkSession, "minhash")
    sets = scratch.write(_sets(docs, s))
    full = sets.filter("n > 0")
    classes = full.groupBy("sid").agg(F.first("n").alias("n"), F.first("sig").alias("sig"))
    keyed = full.select(F.explode("keys").alias("key"), "sid")
    shared = keyed.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).filter("lo <> hi").select("key")
    members = scratch.write(keyed.join(shared.hint("merge"), "key").groupBy("key", "sid").agg(F.lit(1).alias("_")).drop("_"))
    leads = scratch.write(_typical(members))
    stars = members.join(leads.hint("merge"), "key").filter("sid <> lead").select(F.col("lead").alias("a"), F.col("sid").alias("b")).distinct()
    classes = scratch.write(classes.join(members.select("sid").distinct().hint("merge"), "sid", "left_semi"))
    texts = scratch.write(_texts(classes, docs, sets))
    links = scratch.write(_verify(_prune(stars, classes, s), texts, s))
    labels = components(links, scratch)
    groups = scratch.write(_groups(members, leads, labels))
    diff = scratch.write(_differences(groups, texts, s))
    more = scratch.write(_verify(_prune(_met(diff, s), classes, s), texts, s))
    if more.limit(1).count():  # these links join components, which are few against all classes
        of = labels.select(F.col("node").alias("sid"), "label")
        ends = more
        for c in ("a", "b"):
            ends = ends.join(of.select(F.col("sid").alias(c), F.col("label").alias(f"l{c}")).hint("merge"), c, "left").withColumn(f"l{c}", F.coalesce(f"l{c}", c))
        up = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")), scratch)
        known = labels.unionByName(up.join(of.select(F.col("sid").alias("node")), "node", "left_anti").select("node", F.col("node").alias("label")))
        labels = known.join(up.select(F.col("node").alias("label"), F.col("label").alias("to")).hint("merge"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    least = full.groupBy("sid").agg(F.min("doc_id").alias("d"))
    least = least.join(labels.withColumnRenamed("node", "sid").hint("merge"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    by = least.groupBy("label").agg(F.min("d").alias("component_id"))
    of = least.join(by.hint("merge"), "label").select("sid", "component_id")
    out = full.select("doc_id", "th", "sid", "n").join(of.hint("merge"), "sid").select("doc_id", "th", F.col("n").alias("n_shingles"), "component_id")
    none = sets.filter("n = 0").select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(none)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), Setting(words=4))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
