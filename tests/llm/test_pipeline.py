"""The pipeline against a brute-force version of each of its stages, and on odd tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations
from zlib import crc32

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, cut int, _h int"
LABELS = "doc_id bigint, quality int, toxic int"


def words(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", t.translate({i: i + 32 for i in range(65, 91)})) if w]


def write(spark, top, rows, labels):
    spark.createDataFrame(rows, DOCS).coalesce(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, LABELS).coalesce(1).write.parquet(f"{top}/labels.parquet")
    return top


def lines_once(rows):
    """Lines of three-line windows that came before go; rows are (id, text, ...), ids differ."""
    seen, out = set(), []
    for r in sorted(rows):
        raw = r[1].split("\n")
        at = [i for i, x in enumerate(raw) if x.strip(" \t\x0b\x0c\r")]
        gone = set()
        for w in range(len(at) - 2):
            key = tuple(raw[i].strip(" \t\x0b\x0c\r") for i in at[w : w + 3])
            gone |= set(at[w : w + 3]) if key in seen else set()
            seen.add(key)
        out.append((r[0], "\n".join(x for i, x in enumerate(raw) if i not in gone), *r[2:]))
    return out


def one_of_each(rows):
    sets = []
    for r in rows:
        w = words(r[1])
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    return [r for i, r in enumerate(rows) if top(i) == i]  # rows stand by id


def shared_out(children, budget):
    """Budgets of (tokens, weight) siblings: none over twice its tokens, the rest by weight."""
    left, got = dict(enumerate(children)), {}
    while left:
        level = budget / sum(w for _, w in left.values())
        full = [i for i, (t, w) in left.items() if 2 * t <= level * w * (1 + 1e-12)]
        if not full:
            return got | {i: level * w for i, (_, w) in left.items()}
        for i in full:
            got[i] = 2 * left.pop(i)[0]
            budget -= got[i]
    return got


def to_weights(rows):
    leaf = lambda r: (f"domain{crc32(r[3].encode()) % 4}", r[2], r[3])
    tokens = Counter()
    for r in rows:
        tokens[leaf(r)] += len(words(r[1]))

    def down(prefix, budget):
        depth = len(prefix)
        if depth == 3:
            return {prefix: int(round(budget, 3))}
        kids = sorted({k[: depth + 1] for k in tokens if k[:depth] == prefix})
        size = [sum(n for k, n in tokens.items() if k[: depth + 1] == c) for c in kids]
        parts = shared_out([(n, n**0.7) for n in size], budget)
        return {k: v for i, c in enumerate(kids) for k, v in down(c, parts[i]).items()}

    budget, by, out = down((), sum(tokens.values())), defaultdict(list), []
    for r in rows:
        by[leaf(r)].append(r)
    for k, own in by.items():
        whole, rest = divmod(budget[k], tokens[k])
        out += own * whole
        order = sorted(own, key=lambda r: hashlib.md5(f"17-{whole}-{r[0]}".encode()).hexdigest())
        start = 0
        for r in order:
            if start < rest:
                out.append(r)
            start += len(words(r[1]))
    return out


def test_against_brute_force(spark, tmp_path):
    r = random.Random(11)
    plain = ["".join(r.choice("abcdefghijk") for _ in range(5)) for _ in range(600)]
    bad = ["vequana", "vequelo", "scum"]
    text = lambda n=40: "\n".join(" ".join(r.choices(plain, k=8)) for _ in range(n // 8))
    foot = text(32)
    texts = []
    for i in range(360):
        t = text(r.choice([24, 40, 80]))
        if i % 6 == 0:
            t += " " + " ".join(r.choices(bad, k=3))
        if i % 7 == 0:
            t += "\n" + foot
        texts.append(t)
    base = " ".join(r.choices(plain, k=120))
    for _ in range(25):
        w = base.split(" ")
        w[r.randrange(120)] = f"x{r.randrange(9**9)}"
        texts.append(" ".join(w))
    texts += [texts[1]] * 6
    rows = [(i, t, "en" if i % 3 else "fr", f"src{min(i % 9, 4)}", len(t), 0, 0) for i, t in enumerate(texts)]
    toxic = lambda t: any(w in bad for w in words(t))
    top = write(spark, f"file://{tmp_path}/in", rows, [(i, 1, int(toxic(t))) for i, t in enumerate(texts)])
    clean = [x for x in rows if not toxic(x[1])]
    want = to_weights(one_of_each(lines_once(clean)))
    got = corpus_pipeline.run(spark, top).collect()
    assert len(clean) == len(texts) - 60 and Counter(x.doc_id for x in got) == Counter(x[0] for x in want)
    assert len({x[0] for x in want}) < len(clean) - 25 and all(x.round_trip for x in got)
    text_of = {x[0]: x[1] for x in want}
    from lexmill.llm import sentencepiece_codec

    d = spark.createDataFrame(sorted(text_of.items()), "doc_id bigint, text string")
    ids = {x.doc_id: x.ids for x in sentencepiece_codec.round_trip(d, sentencepiece_codec.load()).collect()}
    assert all(x.ids == ids[x.doc_id] and x.n_tokens == len(x.ids) for x in got)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_and_empty_tables(spark, tmp_path, empty):
    rows = [(None, None, None, None, None, 1, 1), (1, "", "en", "a", 0, 1, 1), (2, "a b c d e", "en", "a", 9, 1, 1), (2, "a b c d e", "en", "a", 9, 1, 1), (None, "f g h i j", "en", None, 9, 1, 1)]
    top = write(spark, f"file://{tmp_path}/in", [] if empty else rows, [] if empty else [(2, 1, 0), (None, None, 1)])
    got = corpus_pipeline.run(spark, top)
    assert sorted(str(x.doc_id) for x in got.select("doc_id").distinct().collect()) == ([] if empty else ["2", "None"])  # 1 has no words and stands behind the end of its leaf's prefix
    assert got.filter(~F.col("round_trip")).count() == 0
