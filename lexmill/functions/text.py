"""Column functions on text, urls, dates and replies: all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

CYRILLIC = "а-яё"
EDGE = r"(?U)^\s+|\s+$"


def normalize(c: Column) -> Column:
    """Null or blank becomes empty; else trimmed of all Unicode space and lowered."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), EDGE, ""))


def normalize_or_null(c: Column) -> Column:
    return F.nullif(normalize(c), F.lit(""))


def clean_text(c: Column) -> Column:
    """Line ends and tabs to spaces, then trimmed; entities are decoded by the page parser."""
    return F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "\n\r\t", "   "), EDGE, "")


def clean_title(c: Column) -> Column:
    t = F.regexp_replace(F.split(F.coalesce(c, F.lit("")), r"\|")[0], EDGE, "")
    t = F.regexp_replace(t, r"(?iu)^Рейтинг:\s*\d+\s+", "")
    t = F.regexp_replace(t, r"(?iu)^\d+\s+комментари(ев|й|я)\s+", "")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def normalize_url(c: Column, base: str) -> Column:
    t = F.regexp_replace(c, EDGE, "")
    return (
        F.when(c.isNull() | (t == ""), F.lit(None).cast("string"))
        .when(t.startswith("//"), F.concat(F.lit("https:"), t))
        .when(t.startswith("/"), F.concat(F.lit(base.rstrip("/")), t))
        .otherwise(t)
    )


def is_article_url(c: Column, host: str, base: str, news: str = "/news/", articles: str = "/articles/", excluded=tuple(V.EXCLUDED_PATHS)) -> Column:
    dated = c.rlike(f"{news}\\d{{2}}-\\d{{2}}-\\d{{4}}$")
    bad = F.lit(False)
    for p in excluded:
        bad = bad | F.contains(F.lower(c), F.lit(p))
    paged = F.contains(c, F.lit(news.rstrip("/") + "?page="))
    ok = F.contains(c, F.lit(host)) & ~F.contains(c, F.lit("#")) & (c != base) & (c != base + "/") & ~dated & ~bad
    return F.coalesce(ok & (F.contains(c, F.lit(articles)) | (F.contains(c, F.lit(news)) & ~paged)), F.lit(False))


def date_url(url: Column, day: Column) -> Column:
    return F.concat_ws("/", url, F.date_format(day, "dd-MM-yyyy"))


def article_id(url: Column) -> Column:
    """Base64url of the url's SHA-256, without padding."""
    return F.regexp_replace(F.translate(F.base64(F.unhex(F.sha2(url, 256))), "/+", "_-"), "=+$", "")


def parse_date(c: Column) -> Column:
    """``yyyy-MM-dd|HH:mm:ss``; ``;`` also separates; null if it doesn't parse."""
    return F.try_to_timestamp(F.translate(c, "|;", "TT")).cast("timestamp_ntz")


def format_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'|'HH:mm:ss")


def date_in_text(c: Column, today: Column) -> Column:
    """``today/yesterday/D.M.YYYY, H:MM``, else ``D.M.YYYY``; ``today`` is the day of the crawl."""
    day = r"\d{1,2}[.\s]+\d{1,2}[.\s]+\d{4}"
    full = rf"(?iu)(сегодня|вчера|{day}),\s*(\d{{1,2}}):(\d{{2}})"
    part = lambda i: F.regexp_extract(c, full, i)

    def from_day(x: Column) -> Column:
        g = lambda i: F.regexp_extract(x, r"(\d{1,2})[.\s]+(\d{1,2})[.\s]+(\d{4})", i)
        return F.try_to_timestamp(F.concat_ws("-", g(3), F.lpad(g(2), 2, "0"), F.lpad(g(1), 2, "0")), F.lit("yyyy-MM-dd"))

    base = F.when(F.lower(part(1)) == "сегодня", today.cast("timestamp")).when(F.lower(part(1)) == "вчера", F.date_sub(today, 1).cast("timestamp")).otherwise(from_day(part(1)))
    clock = base + F.make_interval(hours=part(2).try_cast("int"), mins=part(3).try_cast("int"))
    only = from_day(F.regexp_extract(c, f"({day})", 1))
    return F.when(part(1) != "", clock).otherwise(only).cast("timestamp_ntz")


def is_author_name(c: Column) -> Column:
    w = F.array_remove(F.split(F.coalesce(c, F.lit("")), " "), "")
    return F.size(w).between(2, 3) & F.forall(w, lambda x: (F.length(x) >= 2) & x.rlike(r"^\p{Lu}") & ~x.rlike(r"\d"))


def category_in_text(c: Column, categories=tuple(V.CATEGORIES)) -> Column:
    """The first category that is one of the text's words, else the first that stands anywhere in it."""
    low = F.lower(F.coalesce(c, F.lit("")))
    words = F.split(low, r"[\n\r ]+")
    return F.coalesce(
        *[F.when(F.array_contains(words, F.lit(k.lower())), F.lit(k)) for k in categories],
        *[F.when(F.contains(low, F.lit(k.lower())), F.lit(k)) for k in categories],
    )


def tokenize(c: Column, alphabet: str = CYRILLIC, stop: list[str] | None = None, least: int = 3, most: int = 50) -> Column:
    """Distinct lowered words of the alphabet in order of first occurrence, without stop words."""
    t = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(rf"(?U)\b[{alphabet}]{{{least},}}\b"), F.lit(0))
    t = F.filter(t, lambda x: F.length(x) <= most)
    if stop is None or stop:
        t = F.array_except(t, F.array(*[F.lit(w) for w in (V.STOP_WORDS if stop is None else stop)]))
    return F.array_distinct(t)


def raw_words(c: Column, alphabet: str = CYRILLIC, least: int = 3) -> Column:
    """All words of the alphabet with their case."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?iU)\b[{alphabet}]{{{least},}}\b"), F.lit(0))


def occurrences(text: Column, phrase: Column) -> Column:
    """Occurrences of a phrase that don't overlap, case folded, at any place."""
    t = F.lower(text)
    return F.when(F.length(phrase) > 0, ((F.length(t) - F.length(F.replace(t, F.lower(phrase), F.lit("")))) / F.length(phrase)).cast("long")).otherwise(0)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def fnv1a(c: Column) -> Column:
    """FNV-1a of 32 bits over the characters of the lowered text; 0 becomes 1."""
    codes = F.transform(F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), ""), ""), lambda x: F.ascii(x).cast("long"))
    h = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda a, x: (a.bitwiseXOR(x) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))
    return F.when(h == 0, F.lit(1).cast("long")).otherwise(h)


def snippet(c: Column, n: int = 700, empty: str = "") -> Column:
    t = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "\r\n", "  "), EDGE, "")
    return F.when(t == "", F.lit(empty)).otherwise(F.left(t, F.lit(n)))


def csv_quote(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""'))


def switch_layout(c: Column, to_cyrillic: bool = True) -> Column:
    a, b = (V.KEYS_LATIN, V.KEYS_CYRILLIC) if to_cyrillic else (V.KEYS_CYRILLIC, V.KEYS_LATIN)
    upper = [(x.upper(), y.upper()) for x, y in zip(a, b, strict=True) if x.upper() != x and x.upper() not in a]
    return F.translate(c, a + "".join(x for x, _ in upper), b + "".join(y for _, y in upper))


def sound_code(c: Column) -> Column:
    """The first letter and four codes of how the rest sounds."""
    w = F.lower(c)
    t = F.translate(w, V.SOUND_LETTERS, V.SOUND_CODES)
    t = F.regexp_replace(t, r"(.)\1+", "$1")
    return F.concat(F.left(w, F.lit(1)), F.rpad(F.substring(t, 2, 1000), 4, "0"))


def clamp(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def _by_label(label: Column, table: dict, other) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(label == k, F.lit(v)).otherwise(out)
    return out


def label_text(label: Column) -> Column:
    return _by_label(label, V.LABEL_TEXT, V.LABEL_TEXT[0])


def label_confidence(label: Column) -> Column:
    return _by_label(label, V.LABEL_CONFIDENCE, 0.5)


def label_reason(label: Column, comment: Column) -> Column:
    return F.coalesce(F.when(F.trim(comment) != "", comment), _by_label(label, V.LABEL_REASON, "Неизвестная оценка"))


def judge_prompt(query: Column, title: Column, category: Column, author: Column, url: Column, content: Column) -> Column:
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit("")))
    given = lambda name, c: F.when(F.trim(c) != "", line(name, c))
    return F.concat(
        F.concat_ws(
            "\n", F.lit(V.JUDGE_PROMPT), line("Запрос", query), F.lit("Документ:"), line("Заголовок", title),
            given("Категория", category), given("Автор", author), line("Ссылка", url),
            line("Фрагмент", snippet(content, 600, "[нет текста]")),
        ),
        F.lit("\n"),
    )


def parse_judgement(reply: Column) -> Column:
    """label, confidence and reason of a model's reply: its outermost JSON, else loose patterns; null if it has no label."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    j = F.from_json(body, "label int, confidence double, reason string", {"mode": "PERMISSIVE"})
    one = F.translate(reply, "\r\n", "  ")
    label = F.coalesce(j["label"], F.nullif(F.regexp_extract(one, r"(?i)label\s*[:=]\s*(\d)", 1), F.lit("")).cast("int"))
    strict = j["label"].isNotNull()
    loose = F.nullif(F.regexp_extract(one, r"(?i)confidence\s*[:=]\s*([0-9]*\.?[0-9]+)", 1), F.lit("")).cast("double")
    conf = F.coalesce(F.when(strict, j["confidence"]).otherwise(loose), F.lit(0.5))
    reason = F.when(strict, F.coalesce(j["reason"], F.lit(""))).otherwise(F.trim(F.regexp_extract(one, r'(?i)reason\s*[:=]\s*"([^"]*)"', 1)))
    return F.when(label.isNotNull(), F.struct(clamp(label, 0, 2).alias("label"), clamp(conf, 0.0, 1.0).cast("float").alias("confidence"), reason.alias("reason")))


def spelling_reply(reply: Column, query: Column) -> Column:
    """The first line of a reply that isn't empty, without quotes; else the query."""
    line = F.regexp_extract(F.coalesce(reply, F.lit("")), r"^\s*([^\n\r]*\S)", 1)
    return F.coalesce(F.nullif(F.regexp_replace(line, "^[\"'`\\s]+|[\"'`\\s]+$", ""), F.lit("")), query)


def discussion(html: Column, default_channel: str) -> Column:
    """Channel and post number of a page's discussion; null without a number."""
    post = F.regexp_extract(html, r"(?i)_telegram_post_id\s*=\s*(\d+)", 1).try_cast("int")
    channel = F.trim(F.regexp_extract(html, r"(?i)dataset\.telegramDiscussion\s*=\s*`([^/`]+)", 1))
    return F.when(post.isNotNull(), F.struct(F.coalesce(F.nullif(channel, F.lit("")), F.lit(default_channel)).alias("channel"), post.alias("post_id")))


def comment_count(embed: Column, html: Column | None = None) -> Column:
    """From the discussion's page: its script, then its header; else from the article's own page."""
    found = [
        F.regexp_extract(embed, r'(?i)TWidgetDiscussion\.init\(\{\s*"comments_cnt"\s*:\s*(\d+)', 1).try_cast("int"),
        F.regexp_extract(embed, r'(?i)<span class="js-header">(\d+)\s+comments?</span>', 1).try_cast("int"),
    ]
    if html is not None:
        found.append(F.regexp_extract(html, r"(?iu)(\d+)\s*(комментари|comment)", 1).try_cast("int"))
    return F.coalesce(*found)
