from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions import values as V


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("x")).first().x


def test_word_lists():
    assert len(set(V.STOP_WORDS)) == 154 and len(V.MISSPELLINGS) == 17 and len(V.VALID_WORDS) == 21
    assert len(V.KEYS_LATIN) == len(V.KEYS_CYRILLIC)


@pytest.mark.parametrize("word,code", [("путин", "п4290"), ("москва", "м0632"), ("россия", "р0620"), ("президент", "пA262"), ("трамп", "тA081"), ("байден", "б0й42"), ("киев", "к2000"), ("украина", "у3A02"), ("правительство", "пA024")])
def test_sound_code(spark, word, code):
    assert one(spark, word, T.sound_code) == code


def test_normalize_blank_and_null(spark):
    assert one(spark, None, T.normalize) == "" and one(spark, " \t ", T.normalize) == "" and one(spark, "  ЁЖ ", T.normalize) == "ёж"
    assert one(spark, " ", T.normalize_or_null) is None


def test_titles_and_urls(spark):
    assert one(spark, "Рейтинг: 12  Большая   новость | сайт", T.clean_title) == "Большая новость"
    assert one(spark, "5 комментариев Новость", T.clean_title) == "Новость"
    url = lambda c: T.normalize_url(c, "https://a.org/")
    assert [one(spark, x, url) for x in ("//b.org/x", "/x", " http://c ", " ", None)] == ["https://b.org/x", "https://a.org/x", "http://c", None, None]
    ok = lambda c: T.is_article_url(c, "a.org", "https://a.org")
    tries = ["https://a.org/news/x", "https://a.org/news/01-02-2024", "https://a.org/articles/y", "https://a.org/news/x#c", "https://b.org/news/x", "https://a.org/about/news/x", "https://a.org/news?page=2", None]
    assert [one(spark, x, ok) for x in tries] == [True, False, True, False, False, False, False, False]


def test_dates(spark):
    assert one(spark, "2025-11-12|09:00:00", T.parse_date) == datetime(2025, 11, 12, 9) == one(spark, "2025-11-12;09:00:00", T.parse_date)
    assert one(spark, "nonsense", T.parse_date) is None
    today = F.lit(date(2025, 3, 2))
    at = lambda t: one(spark, t, lambda c: T.date_in_text(c, today))
    assert at("было сегодня, 9:05") == datetime(2025, 3, 2, 9, 5) and at("Вчера, 10:30") == datetime(2025, 3, 1, 10, 30)
    assert at("5.1.2024, 7:00") == datetime(2024, 1, 5, 7) and at("от 05.01.2024") == datetime(2024, 1, 5) and at("ничего") is None


def test_tokens(spark):
    assert one(spark, "Путин и Москва, маска2 covid-маска ёлка", lambda c: T.tokenize(c, stop=[])) == ["путин", "москва", "маска", "ёлка"]
    assert one(spark, "который дом Дом", T.tokenize) == ["дом"] and one(spark, None, T.tokenize) == []


def test_fnv(spark):
    assert one(spark, "аb", T.fnv1a) == 1174673079 and one(spark, "ab", T.fnv1a) == 1294271946


def test_layout(spark):
    assert one(spark, "Ghbdtn", T.switch_layout) == "Привет" and one(spark, "руддщ", lambda c: T.switch_layout(c, False)) == "hello"


def test_replies(spark):
    got = one(spark, 'text {"label": 5, "confidence": 2.0, "reason": "r"} more', T.parse_judgement)
    assert (got.label, got.confidence, got.reason) == (2, 1.0, "r")
    got = one(spark, 'label: 1, confidence = 0.25 reason: "so"', T.parse_judgement)
    assert (got.label, got.confidence, got.reason) == (1, 0.25, "so")
    assert one(spark, "no idea", T.parse_judgement) is None and one(spark, None, T.parse_judgement) is None
    assert one(spark, '\n "хорошо" \nдругое', lambda c: T.spelling_reply(c, F.lit("q"))) == "хорошо"


def test_comment_counts(spark):
    assert one(spark, 'TWidgetDiscussion.init({"comments_cnt": 17, ', T.comment_count) == 17
    assert one(spark, '<span class="js-header">3 comments</span>', T.comment_count) == 3
    assert one(spark, "_telegram_post_id = 42; dataset.telegramDiscussion = `abc/x`", lambda c: T.discussion(c, "d")) == ("abc", 42)


def test_authors_and_categories(spark):
    assert [one(spark, x, T.is_author_name) for x in ("Иван Петров", "иван Петров", "Иван", "Иван П2тров", None)] == [True, False, False, False, False]
    assert one(spark, "раздел экономика и Наука", T.category_in_text) == "Наука"
