import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexmill.operators import analysis as A
from lexmill.operators import evaluation as E
from lexmill.operators import html as H
from lexmill.operators import pipeline as PL
from lexmill.operators import search as S
from lexmill.operators import spell as SP
from lexmill.operators import synonyms as Y
from lexmill.operators.components import components
from lexmill.sources import crawl, store


def test_golden_metrics(spark):
    rows = [("1", i + 1, r) for i, r in enumerate([2, 0, 0, 1, 1])] + [("2", i + 1, 0) for i in range(7)]
    m = {r.query_id: r for r in E.metrics(spark.createDataFrame(rows, "query_id string, position int, relevance int")).collect()}
    assert (m["1"].p_at_1, m["1"].p_at_5, m["1"].p_at_10, m["1"].reciprocal_rank) == (1.0, 0.6, 0.6, 1.0)
    assert m["1"].average_precision == pytest.approx(0.7) and m["1"].ndcg == pytest.approx(0.924133208028394)
    assert m["2"].ndcg == m["2"].average_precision == m["2"].reciprocal_rank == 0
    o = E.overall(E.metrics(spark.createDataFrame(rows, "query_id string, position int, relevance int"))).first()
    assert o.map == pytest.approx(0.35) and o.mean_ndcg == pytest.approx(0.462066604014197) and o.mrr == 0.5
    assert "ADVICE" in E.report(spark.createDataFrame(rows, "query_id string, position int, relevance int"))


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "query_id string, position int, relevance int")
    assert E.metrics(none).count() == 0 and E.overall(E.metrics(none)).first().map == 0


def test_components(spark):
    got = {r.node: r.label for r in components(spark.createDataFrame([("d", "c"), ("b", "c"), ("a", "b"), ("x", "y")], "a string, b string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_spelling(spark):
    q = spark.createDataFrame([("путен",), ("масква",), ("ghbdtn",), ("vjcrdf",), ("россия",), ("",)], "query string")
    got = {r.query: r for r in SP.Chain().correct(q).collect()}
    assert got["путен"].corrected == "путин" and got["масква"].corrected == "москва" and got["vjcrdf"].corrected == "москва"
    assert got["россия"].corrected == "россия" and not got["россия"].has_correction and got["путен"].confidence == pytest.approx(0.8)
    compat = q.select("query", SP.phonetic_checker(compat=True)(F.col("query")).alias("x"))
    assert {r.query: r.x for r in compat.collect()}["путен"] == "путин"
    assert spark.range(1).select(SP.phonetic_checker(compat=True)(F.lit("путин")).alias("x")).first().x == "пуьин"


def test_pairs_equal_brute_force(spark):
    docs = [(i, w) for i, ws in enumerate(["a b c", "a b", "a c d", "b d", "a b d", "c d"]) for w in ws.split()]
    o = Y.Options(min_similarity=0.25)
    got = {(r.word1, r.word2): (r.co, round(r.jaccard, 6)) for r in Y.word_pairs(spark.createDataFrame(docs, "id int, word string"), o, top=False).collect()}
    sets = {w: {i for i, x in docs if x == w} for w in "abcd"}
    want = {}
    for x in "abcd":
        for y in "abcd":
            co, u = len(sets[x] & sets[y]), len(sets[x] | sets[y])
            if x < y and co >= 2 and co / u >= 0.25:
                want[x, y] = (co, round(co / u, 6))
    assert got == want


def test_synonym_rules_order(spark):
    e = spark.createDataFrame([("яма", "ёлка"), ("ёлка", "арка")], "word string, synonym string")
    assert Y.synonym_rules(Y.synonym_groups(e)).first().rule == "ёлка, арка, яма"
    c = spark.createDataFrame([("ёлка", 0.1)], "word string, confidence double")
    assert Y.synonym_rules(Y.synonym_groups(e, c, 0.5)).first().rule == "арка, яма"


def test_morphology(spark):
    d = spark.createDataFrame([("книга", "книги"), ("кот", "дом"), ("стол", "стол")], "a string, b string")
    assert [r.m for r in d.select(Y.morphological(F.col("a"), F.col("b")).alias("m")).collect()] == [True, False, True]


def test_query_parser():
    p = S.parse_query("[category=Наука] и Кот --size 5 author:Иван synconf=0.4")
    assert (p.text, p.category, p.author, p.size, p.synmin) == ("кот", "наука", "иван", 5, 0.4)


def test_search_fuzzy_and_pages(spark):
    docs = spark.createDataFrame([(1, "cat dog", "cat sat", "x", "k"), (2, "dog", "the cta", "y", "k"), (3, None, "", None, None)], "id int, title string, content string, author string, category string")
    idx = S.build_index(docs)
    t = S.query_terms(spark, {"q": "cat"})
    assert [r.id for r in S.search(idx, t).orderBy("rank").collect()] == [1]
    assert sorted(r.id for r in S.search(idx, t, fuzzy=True).collect()) == [1, 2]
    assert S.search(idx, t, author="y").count() == 0 and S.osa("cta", "cat") == 1


def test_search_pipeline(spark):
    docs = spark.createDataFrame([(1, "big cat", "sat", "x", "k"), (2, "large cat", "ran", "y", "k"), (3, "huge dog", "ran", "y", "m")], "id int, title string, content string, author string, category string")
    idx = S.build_index(docs)
    chain = SP.Chain([(1, "levenshtein", SP.levenshtein_checker({}, ["large"]))])
    e = spark.createDataFrame([("large", "big"), ("large", "huge")], "word string, synonym string")
    c = spark.createDataFrame([("big", 0.9), ("huge", 0.1)], "word string, confidence double")
    a = PL.answer(idx, "lagre category=K synmin=0.5", chain, e, c, fuzzy=False)
    assert (a.corrected, a.expanded, [s["method"] for s in a.steps]) == ("large", "large big", ["levenshtein"]) and a.confidence == pytest.approx(0.8)
    assert sorted(r.id for r in a.hits.collect()) == [1, 2]
    ev = a.event.first()
    assert (ev["query"], ev["corrected_from"], ev["found"]) == ("large big", "lagre", 2)
    assert PL.answer(idx, "category=k", chain) is None
    b = PL.answer(idx, "xq", chain, fuzzy=False)
    assert b.corrected == "xq" and b.hits.count() == 0 and b.event.first()["found"] == 0 and b.event.first()["corrected_from"] is None
    learned = spark.createDataFrame([("catt", "cat")], "original string, correction string")
    stats = spark.createDataFrame([("cat", 3, 1.0, 3)], "query string, searches long, success_rate double, successes long")
    d = PL.answer(idx, "catt", SP.Chain([]), learned=learned, stats=stats, fuzzy=False)
    assert d.corrected == "cat" and d.steps[0][0] == "analytics" and d.hits.count() == 2


PAGE = """<html><head><title>T | site</title><meta name="author" content="Иван Петров"><meta property="og:image" content="//img.org/a.png">
<script type="application/ld+json">{"@graph":[{"datePublished":"2024-05-06T07:08:09"}]}</script>
<script type="application/ld+json">{"@type":"BreadcrumbList","itemListElement":[{"position":2,"name":"Наука"}]}</script></head>
<body><h1>Большая&nbsp;новость | x</h1><article><p>Один <b>раз.</p><p>Два.</p></article><span>7 комментариев</span>
<a href="/news/один">Заголовок новости длинный</a><a href="/about/news">Заголовок новости длинный</a></body></html>"""


def test_page(spark):
    site = H.Site("https://a.org", "a.org", today=dt.date(2025, 1, 1))
    a = H.article("u", PAGE, site)
    assert a["title"] == "Большая\xa0новость" or a["title"] == "Большая новость"
    assert (a["author"], a["publish_date"], a["category"], a["image_url"], a["comment_count"]) == ("Иван Петров", dt.datetime(2024, 5, 6, 7, 8, 9), "Наука", "https://img.org/a.png", 7)
    assert a["content"] == "Один раз.\n\nДва." and H.links(PAGE, site, 10) == [("https://a.org/news/один", "Заголовок новости длинный")]
    assert H.article("u", "", site)["title"] == "" and H.article("u", None, site)["content"] == ""


def test_crawl(spark):
    site = H.Site("https://a.org", "a.org", today=dt.date(2025, 1, 2))

    def get(url):
        return (200, PAGE) if "01-01-2025" in url or url.endswith("один") else (404, "")

    got = crawl.crawl(spark, site, get, "https://a.org/news", 5, 3).collect()
    assert [r.url for r in got] == ["https://a.org/news/один"] and got[0].author == "Иван Петров"


def test_stores(spark, tmp_path):
    top = f"file://{tmp_path}"
    a = spark.createDataFrame([("T", "u1", "c", "k", "w", "", dt.datetime(2025, 1, 2, 3, 4, 5), 3), ("T2", "u1", "c2", "k", "w", "", None, None)], "title string, url string, content string, category string, author string, image_url string, publish_date timestamp_ntz, comment_count int")
    store.write_articles(a, f"{top}/a.json")
    back = store.read_articles(spark, f"{top}/a.json")
    assert sorted(back.collect(), key=str) == sorted(a.collect(), key=str)
    assert store.read_articles(spark, f"{top}/none").count() == 0 and store.count(spark, f"{top}/none") == 0
    docs = store.documents(back)
    assert store.upsert(spark, docs, f"{top}/docs") == 2 and store.count(spark, f"{top}/docs") == 1
    assert store.upsert(spark, docs, f"{top}/docs") == 2 and store.count(spark, f"{top}/docs") == 1
    (tmp_path / "docs").rename(tmp_path / "docs.old")  # as after a crash
    assert store.upsert(spark, docs.limit(0), f"{top}/docs") == 0 and store.count(spark, f"{top}/docs") == 1
    assert store.clear(spark, f"{top}/docs", f"{top}/copy") == 1 and store.count(spark, f"{top}/docs") == 0 and store.count(spark, f"{top}/copy") == 1
    store.upsert(spark, docs, f"{top}/docs")
    store.backup(spark, {"docs": f"{top}/docs"}, f"{top}/b", "2025-01-01T00:00:00")
    r = store.restore(spark, f"{top}/b", ["docs"], f"{top}/again", docs.schema)
    assert r.first().restored == 1
    with pytest.raises(FileExistsError):
        store.restore(spark, f"{top}/b", ["docs"], f"{top}/again", docs.schema)
    (tmp_path / "s.jsonl").write_text('{"queryId":"1","label":2}\n\n{broken\n{"queryId":"2","label":0}\n')
    assert sorted(x.queryId for x in store.read_jsonl(spark, f"{top}/s.jsonl").filter("queryId is not null").collect()) == ["1", "2"]


def test_case_stats_and_candidates(spark):
    a = spark.createDataFrame([(1, "Кот Мурзик дома", "кот спит. Мурзик ест", "Наука", "Иван Петров")], "id int, title string, content string, category string, author string")
    s = {r.word: (r.capitalised, r.lower_case) for r in A.case_stats(a).collect()}
    assert s["мурзик"] == (2, 0) and s["кот"] == (1, 1)
    q = [r.query for r in A.query_candidates(a).orderBy("pos").collect()]
    assert q[:3] == ["кот мурзик дома", "кот мурзик", "кот мурзик дома"] and "наука кот" in q and q[-2:] == ["иван", "иван кот"]
    assert A.generate_queries(A.query_candidates(a), 3).count() == 3
