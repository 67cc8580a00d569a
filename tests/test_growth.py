"""Steps that make no more rows than input and result ask for, and whose results stay those of brute force."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from lexmill.operators import search as S
from lexmill.operators import spell as SP
from lexmill.operators import synonyms as Y
from tests.test_whole import edits


def most_rows(df):
    """The result, and the most rows that any step of its run made."""
    out, seen = df.collect(), []

    def walk(p):
        kind = p.getClass().getSimpleName()
        inner = p.executedPlan() if kind == "AdaptiveSparkPlanExec" else p.plan() if kind.endswith("QueryStageExec") else None
        if inner is not None:
            return walk(inner)
        n = p.metrics().get("numOutputRows")
        seen.append(n.get().value() if n.isDefined() else 0)
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out, max(seen)


def shuffled(spark, make):
    """The result, and the rows that all jobs of ``make`` wrote to shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    stages = lambda: {x.stageId(): x.shuffleWriteRecords() for x in map(store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList()).apply, range(store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList()).size()))}
    before = set(stages())
    out = make().collect()
    return out, sum(n for k, n in stages().items() if k not in before)


def test_nearest_past_queries(spark):
    r = random.Random(5)
    text = lambda n, of: "".join(r.choice(of) for _ in range(n))
    past = {text(r.randint(0, 4), "abc") for _ in range(60)} | {text(9, "abcdefghij") for _ in range(200)} | {"same", "ключ"}
    asked = {text(r.randint(0, 5), "abcd") for _ in range(120)} | {text(r.randint(7, 11), "abcdefghij") for _ in range(100)} | {x[:3] + "z" + x[5:] + "y" for x in sorted(past)[:150]} | {"same", "клич"}
    stats = spark.createDataFrame([(p, 2, 1.0, 2) for p in past] + [("aaaax", 2, 0.0, 0), ("one", 1, 1.0, 1)], "query string, searches long, success_rate double, successes long")
    learned = spark.createDataFrame([("bbbb", "taught")], "original string, correction string")
    q = spark.createDataFrame([(x,) for x in sorted(asked | {"bbbb", "aaaax", "ones"})], "query string")
    got = {x.query: x.corrected for x in SP.analytics_correct(q, learned, stats).collect()}

    def want(x):
        near = min(((d, p) for p in past if abs(len(x) - len(p)) <= 2 and 1 <= (d := edits(x, p)) <= 2), default=(0, x))
        return "taught" if x == "bbbb" else x if x in past else near[1]

    assert got == {x: want(x) for x in got} and len(got) == q.count()


def test_past_queries_of_one_length_do_not_all_meet(spark, monkeypatch):
    monkeypatch.setattr(SP.F, "levenshtein", lambda *a: SP.F.lit(2))  # so that pairs that are compared are rows
    r = random.Random(6)
    text = lambda: "click " + "".join(r.choice("0123456789") for _ in range(9))
    past = {text() for _ in range(1500)}
    stats = spark.createDataFrame([(p, 2, 1.0, 2) for p in past], "query string, searches long, success_rate double, successes long")
    q = spark.createDataFrame([(p + "0",) for p in past] + [(text(),) for _ in range(1500)], "query string")
    learned = spark.createDataFrame([], "original string, correction string")
    out, n = most_rows(SP.analytics_correct(q, learned, stats).select("query", "corrected"))
    assert len(out) == 3000 and n < 600_000  # 150 keys of a text; all pairs of a length would be over two million


def word_rows(spark, articles):
    return spark.createDataFrame([(i, sorted(ws)) for i, ws in enumerate(articles)], "id int, words array<string>")


def brute(articles, t, least):
    df, co = Counter(w for ws in articles for w in ws), Counter(p for ws in articles for p in combinations(sorted(ws), 2))
    return {(x, y): (n, df[x], df[y]) for (x, y), n in co.items() if n >= least and min(df[x], df[y]) >= least and n / (df[x] + df[y] - n) >= t}


def test_words_that_meet_are_not_rows(spark):
    r = random.Random(7)
    vocab = [f"w{i:03}" for i in range(400)]
    articles = [set(r.sample(vocab, 100)) for _ in range(250)]
    out, n = shuffled(spark, lambda: Y.word_pairs(word_rows(spark, articles), top=False))
    assert {(x.word1, x.word2): (x.co, x.df1, x.df2) for x in out} == brute(articles, 0.25, 2)
    assert n < 25_000  # the words of the articles; nearly all of 79800 pairs meet


@pytest.mark.parametrize("counters, without, read", [(48 << 20, 1 << 18, 8 << 20), (300, 5, 50), (300, 1 << 18, 50), (1, 1, 1)])
@pytest.mark.parametrize("t", [0.25, 0.6, 0.0])
def test_blocks_count_what_brute_force_counts(counters, without, read, t, monkeypatch):
    from lexmill.operators import cooccurrence as K

    r = random.Random(8)
    for name, value in (("COUNTERS", counters), ("WITHOUT", without), ("READ", read), ("BLOCKS", 7)):
        monkeypatch.setattr(K, name, value)
    weights = [1 / (i + 1) for i in range(80)]
    articles = [{f"w{i}" for i in r.choices(range(80), weights, k=r.choice([0, 1, 5, 40]))} for _ in range(120)]
    df = Counter(w for ws in articles for w in ws)
    names = sorted((w for w in df if df[w] >= 2), key=lambda w: (df[w], w))
    seen = Counter(df[w] for w in names)
    dfs = np.array(sorted(seen))
    words = np.array([seen[x] for x in dfs.tolist()])
    plan = K.blocks(dfs, words, t)
    assert [b.start for b in plan] == [0, *(b.end for b in plan[:-1])] and plan[-1].end == len(names)
    at = {w: i for i, w in enumerate(names)}
    batches = []
    for part in (articles[:50], articles[50:]):
        posts = {w: [i for i, ws in enumerate(part) if w in ws] for w in names}
        ws = [w for w in names if posts[w]]
        cols = [[len(batches)] * len(ws), [at[w] for w in ws], [len(posts[w]) for w in ws], [np.array(posts[w], "<u2").tobytes() for w in ws]]
        batches.append(K.pa.RecordBatch.from_arrays([K.pa.array(c) for c in cols], ["batch", "r", "n", "docs"]))
    dealt = sorted((x for b in K._dealt(plan, len(names))(batches) for x in b.to_pylist()), key=lambda x: x["block"])
    rows = [K.pa.RecordBatch.from_pylist(dealt[i : i + 3]) for i in range(0, len(dealt), 3)]
    got = [x for b in K._counted(plan, dfs, words, t, 2, 64)(rows) for x in b.to_pylist()]
    assert len(got) == len({(x["r1"], x["r2"]) for x in got})
    assert {tuple(sorted((names[x["r1"]], names[x["r2"]]))): x["co"] for x in got} == {p: v[0] for p, v in brute(articles, t, 2).items()}


def test_neighbours_that_are_no_pair_are_not_dealt_out(spark, monkeypatch):
    r = random.Random(9)
    names = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    texts = [" ".join(r.choice(names) for _ in range(400)) for _ in range(40)] + ["quartz velvet", "(velvet quartz)", "velvet, quartz"]
    articles = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "id int, title string, content string")
    pairs = spark.createDataFrame([("quartz", "velvet"), ("velvet", "zinc")] + list({tuple(sorted(t.split()[:2])) for t in texts[:40]}), "word1 string, word2 string")
    want = Counter(tuple(sorted(p)) for t in texts[:40] for p in zip(t.split(), t.split()[1:]))
    for bits in (29, 12):
        monkeypatch.setattr(Y, "MOST_BITS", bits)
        out, n = shuffled(spark, lambda: Y.collocations(articles, pairs, "a-z"))
        got = {(x.word1, x.word2): x.n for x in out}
        assert got == {("quartz", "velvet"): 2} | {(x.word1, x.word2): want[x.word1, x.word2] for x in pairs.collect() if (x.word1, x.word2) in want}
        assert n < 2000 or bits < 29  # 15960 neighbours, nearly all of them once


def test_search_deals_out_its_terms_only(spark):
    r = random.Random(10)
    names = ["".join(r.choice("klmnopqrst") for _ in range(9)) for _ in range(4000)]
    rows = [(i, "", " ".join(r.sample(names, 80)) + " quartz quartz" * (i % 3 == 0), "k", "a") for i in range(150)]
    docs = spark.createDataFrame(rows, "id int, title string, content string, category string, author string")
    out, n = shuffled(spark, lambda: S.search(S.build_index(docs), S.query_terms(spark, {"q": "quartz"}), size=5).select("id", "rank", "total"))
    assert [(x.id, x.total) for x in sorted(out, key=lambda x: x["rank"])] == [(i, 50) for i in (0, 3, 6, 9, 12)]
    assert n < 3000  # the articles hold 12000 words


def test_terms_far_off_do_not_reach_the_exact_distance(spark, monkeypatch):
    near, far = ["quartz", "quatrz", "uqatrz", "quart", "quartzes", "uqartz"], ["kwarts", "smooth", "uqatzr", "planet", "quaint"]
    vocab = spark.createDataFrame([("content", w, 1) for w in near + far], "field string, term string, df long")
    asked = spark.createDataFrame([("quartz",)], "term string")
    got = {x.match: x.edits for x in S.fuzzy_terms(asked, vocab).collect()}
    assert got == {w: S.osa("quartz", w) for w in near + far if S.osa("quartz", w) <= 2} and set(near) <= set(got)
    monkeypatch.setattr(S, "osa_udf", lambda a, b: S.F.lit(1))
    assert {x.match for x in S.fuzzy_terms(asked, vocab).collect()} == set(got)
