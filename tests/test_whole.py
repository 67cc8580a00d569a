"""Queries that do the whole job, against brute force on a small table."""

import random
import re
from collections import Counter
from itertools import combinations

import pytest

from lexmill.plans import catalogue as C


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    r = random.Random(3)
    name = lambda: "".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(3))
    vocab = [name() for _ in range(60)]
    texts = [" ".join(["common", *r.sample(vocab, 4)]) for _ in range(250)] + ["quartz or velvet", "velvet or quartz", "velvet or hammer", "hammer or velvet"]
    top = f"file://{tmp_path_factory.mktemp('small')}"
    rows = [(i, t, "en", f"src{i % 3}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{top}/documents.parquet")
    sets = {}
    for i, t in enumerate(texts):
        for w in set(re.findall("[a-z]{3,}", t)):
            sets.setdefault(w, set()).add(i)
    return top, sets


def brute_pairs(sets):
    out = {}
    for x, y in combinations(sorted(w for w in sets if len(sets[w]) >= 2), 2):
        co = len(sets[x] & sets[y])
        if co >= 2 and co / len(sets[x] | sets[y]) >= 0.25:
            out[x, y] = co
    return out


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        row, old = [i], row
        for j, b in enumerate(y, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (a != b)))
    return row[-1]


def alike(x, y):
    n = min(len(x), len(y))
    k = min(4, n - 1)
    return x[:k] == y[:k] or (n >= 4 and x[-4:] == y[-4:]) or 1 - edits(x, y) / max(len(x), len(y)) >= 0.78


def beside(spark, d, x, y):
    texts = [r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    return 2 * sum(f" {a} {b} " in f" {t} " for t in texts for a, b in ((x, y), (y, x)))  # title and content are the same line


def test_all_pairs(spark, small):
    d, sets = small
    want = brute_pairs(sets)
    assert ("quartz", "velvet") in want and ("hammer", "velvet") in want
    got = {(r.word1, r.word2): r.co for r in C.Q["cooccurrence_pairs_all"](spark, d).collect()}
    assert got == want
    assert {(r.word1, r.word2) for r in C.Q["top_synonyms_all"](spark, d).collect()} == set(want)  # no word has over 15
    kept = {p for p in want if not alike(*p) and beside(spark, d, *p) < 3}
    s = C.Q["mining_stats_all"](spark, d).first()
    assert ("quartz", "velvet") in kept and (s.total_pairs, s.total_words) == (len(kept), len({x for x, _ in want}))
    labels = {r.word: r.label for r in C.Q["synonym_groups_all"](spark, d).collect()}
    assert set(labels) == {w for p in want for w in p} and all(labels[x] == labels[y] for x, y in want)
    assert labels["quartz"] == labels["hammer"]  # by pairs of 0.5
    assert {(r.word1, r.word2) for r in C.Q["morph_variant_pairs_all"](spark, d).collect()} <= set(want)
    mined = {(r.word, r.synonym) for r in C.Q["mine_synonyms"](spark, d).collect()}
    assert {("quartz", "velvet"), ("velvet", "hammer")} <= mined
    found = {r.word: r.confidence for r in C.Q["synonym_confidences"](spark, d).collect()}
    assert found["quartz"] == found["hammer"] == 0.5 and "velvet" not in found  # each in one pair of similarity 0.5; velvet is second in both


def test_whole_index(spark, small):
    d, sets = small
    got = Counter((r.word, r.id, r.df) for r in C.Q["inverted_index_all"](spark, d).collect())
    assert len(sets["common"]) > 200
    assert got == Counter((w, i, len(s)) for w, s in sets.items() if len(s) >= 2 for i in s)


def test_reranker_has_rounds_and_leaves_of_the_reference(spark, small, monkeypatch):
    seen = {}

    class Seen(Exception):
        pass

    class Boosting:
        def __init__(self, **kw):
            seen.update(kw)
            raise Seen

    monkeypatch.setattr(C.TR, "GBTRegressor", Boosting)
    monkeypatch.setattr(C, "_labelled", lambda s, d: s.createDataFrame([], "query_id string, query_text string, document_id bigint, position int, label int, confidence double, score double, comment string, at timestamp"))
    with pytest.raises(Seen):
        C.Q["rerank_gbt"](spark, small[0])
    assert (seen["maxIter"], 2 ** seen["maxDepth"], seen["minInstancesPerNode"], seen["stepSize"]) == (200, 64, 20, 0.1)


def test_confidence_of_words_without_kept_pairs(spark):
    pairs = spark.createDataFrame([("a", "b", 0.3), ("a", "c", 0.5), ("b", "c", 0.9), ("c", "d", 0.4), ("e", "f", 0.7)], "word1 string, word2 string, jaccard double")
    valid = pairs.filter("word1 = 'a'")
    got = {r.word: r.confidence for r in C.Y.confidences(pairs, valid).collect()}
    assert got == {"a": 0.4, "b": 0.5, "c": 0.5}  # d and f never come first, e is in no kept pair
    s = C.Y.mining_stats(pairs, pairs, pairs.limit(0)).first()
    assert (s.total_pairs, s.min_similarity, s.total_words) == (0, 0.0, 4)


def test_wide_articles_are_dealt_to_several_keys(spark, small, monkeypatch):
    d, sets = small
    monkeypatch.setattr(C.Y, "WIDE", 2)
    assert {(r.word1, r.word2): r.co for r in C.Q["cooccurrence_pairs_all"](spark, d).collect()} == brute_pairs(sets)


def test_reranker_holds_out_whole_queries(spark):
    rows = [(f"q{q}", f"word{q}", q * 100 + i, f"title {i % 3}", "big text" if i % 2 else "small", "k", "a", 0.0, i, i % 2) for q in range(10) for i in range(20)]
    s = spark.createDataFrame(rows, "queryId string, queryText string, documentId int, title string, contentSnippet string, category string, author string, elasticScore double, position int, label int")
    model, held = C.TR.train_reranker(s, test=0.4, rounds=2, depth=2, buckets=16)
    out = held.select("queryId", "documentId", "label", "position", "rerank_score").collect()
    n = {q: sum(r.queryId == q for r in out) for q in {r.queryId for r in out}}
    assert n and set(n.values()) == {20} and len(n) < 10
    assert min(r.rerank_score for r in out if r.label) > max(r.rerank_score for r in out if not r.label)
    assert C.TR.ranking_quality(held).first().ndcg_3 == 1.0
    bad = held.withColumn("rerank_score", -held["rerank_score"])
    assert C.TR.ranking_quality(bad).first().ndcg_3 == 0.0


def test_readers(spark, tmp_path):
    top = f"file://{tmp_path}"
    (tmp_path / "e.json").write_text('[{"queryId":"1","queryText":"q","totalFound":3,"results":[{"position":1,"documentId":"d","relevanceScore":2},{"position":2,"documentId":"e","relevanceScore":0}]},{"queryId":"2","results":[]}]')
    j = C.store.judgements(C.store.read_evaluations(spark, f"{top}/e.json")).collect()
    assert [(r.query_id, r.position, r.document_id, r.relevance) for r in j] == [("1", 1, "d", 2), ("1", 2, "e", 0)]
    assert C.store.read_evaluations(spark, f"{top}/none").count() == 0
    (tmp_path / "s.json").write_text('{"synonyms":{" Big":["large","BIG"],"fast":[]},"confidenceScores":{"Big":1.7}}')
    e, c = C.store.read_synonyms(spark, f"{top}/s.json")
    assert [tuple(r) for r in e.collect()] == [("big", "large")] and [tuple(r) for r in c.collect()] == [("big", 1.0)]
    (tmp_path / "a.json").write_text('{"cat":{"Query":"cat","SearchCount":4,"SuccessfulSearches":3,"TotalResults":8},"dog":{"Query":"dog","SearchCount":0,"SuccessfulSearches":0,"TotalResults":0}}')
    a = {r["query"]: (r.SuccessRate, r.AvgResults) for r in C.store.read_analytics(spark, f"{top}/a.json").collect()}
    assert a == {"cat": (0.75, 2.0), "dog": (None, None)} and C.store.read_analytics(spark, f"{top}/none").count() == 0


def test_text_beside_the_title(spark):
    site = C.H.Site("https://a.org", "a.org")
    page = "<body><div><h1>Большая новость дня</h1> 03.04.2024, 10:20 <script>x</script></div></body>"
    assert C.H.article("u", page, site)["publish_date"].isoformat() == "2024-04-03T10:20:00"
    assert C.H.article("u", '<body><p data-date="2024-05-06">no day</p></body>', site)["publish_date"] is None
