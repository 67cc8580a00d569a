"""Articles and links from web pages: one pass per page with the standard library's parser, Arrow in and out.

A page becomes a small tree of elements; the fields are then filled in a fixed order, each only if it is
still empty unless said otherwise. ``today`` is a parameter, so that a page gives the same article any day.
"""

from __future__ import annotations

import datetime as dt
import html as H
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import values as V
from ..schemas import ARTICLE, ddl

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    kids: list = field(default_factory=list)
    parent: "Node | None" = None

    def walk(self) -> Iterator["Node"]:
        for k in self.kids:
            if isinstance(k, Node):
                yield k
                yield from k.walk()

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids if isinstance(k, str) or k.tag not in ("script", "style"))

    def raw(self) -> str:
        return "".join(k if isinstance(k, str) else k.raw() for k in self.kids)

    def all(self, *tags: str, **has: str) -> list["Node"]:
        """Descendants with one of the tags (none: any); ``cls`` must be part of the class, other values equal."""
        out = []
        for n in self.walk():
            if tags and n.tag not in tags:
                continue
            if all(v in n.attrs.get("class", "") if k == "cls" else k.replace("_", "-") in n.attrs if v == "*" else n.attrs.get(k.replace("_", "-")) == v for k, v in has.items()):
                out.append(n)
        return out

    def one(self, *tags: str, **has: str) -> "Node | None":
        return next(iter(self.all(*tags, **has)), None)

    def after(self) -> list["Node"]:
        """Element siblings that follow."""
        own = self.parent.kids if self.parent else []
        at = next((i for i, k in enumerate(own) if k is self), len(own))
        return [k for k in own[at + 1 :] if isinstance(k, Node)]


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        if tag == "p" and self.at.tag == "p":
            self.at = self.at.parent
        n = Node(tag, {k: v or "" for k, v in attrs}, [], self.at)
        self.at.kids.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, [], self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(page: str) -> Node:
    p = _Tree()
    p.feed(page or "")
    p.close()
    return p.root


@dataclass(frozen=True)
class Site:
    """What is known of a site: ``root`` for relative urls, the agency's own name (no author), fallback day."""

    root: str = "https://example.org"
    host: str = "example.org"
    agency: str = ""
    today: dt.date = dt.date(2025, 1, 1)
    news: str = "/news/"
    articles: str = "/articles/"
    categories: tuple[str, ...] = tuple(V.CATEGORIES)


def clean(t: str | None) -> str:
    return re.sub(r"[\n\r\t]", " ", H.unescape(t or "")).strip()


def clean_title(t: str) -> str:
    t = t.split("|")[0].strip() if "|" in t else t
    t = re.sub(r"^Рейтинг:\s*\d+\s+", "", t, flags=re.I)
    t = re.sub(r"^\d+\s+комментари(ев|й|я)\s+", "", t, flags=re.I)
    return re.sub(r"\s+", " ", t).strip()


def full_url(root: str, url: str | None) -> str | None:
    url = (url or "").strip()
    return None if not url else "https:" + url if url.startswith("//") else root.rstrip("/") + url if url.startswith("/") else url


DAY = re.compile(r"(\d{1,2})[.\s]+(\d{1,2})[.\s]+(\d{4})")


def _day(m: re.Match | None) -> dt.datetime | None:
    try:
        return dt.datetime(int(m[3]), int(m[2]), int(m[1])) if m else None
    except ValueError:
        return None


def any_date(t: str | None) -> dt.datetime | None:
    t = (t or "").strip()
    for f in (dt.datetime.fromisoformat, lambda x: dt.datetime.strptime(x, "%d.%m.%Y"), lambda x: dt.datetime.strptime(x, "%d.%m.%Y %H:%M")):
        try:
            return f(t.replace("|", "T")).replace(tzinfo=None)
        except ValueError:
            continue
    return None


def date_in_text(t: str, today: dt.date) -> dt.datetime | None:
    m = re.search(r"(сегодня|вчера|\d{1,2}[.\s]+\d{1,2}[.\s]+\d{4}),\s*(\d{1,2}):(\d{2})", t, re.I)
    if not m:
        return _day(DAY.search(t))
    word = m[1].lower()
    back = {"сегодня": 0, "вчера": 1}.get(word)
    base = _day(DAY.search(word)) if back is None else dt.datetime.combine(today - dt.timedelta(back), dt.time())
    return base and base + dt.timedelta(hours=int(m[2]), minutes=int(m[3]))


def is_author(t: str) -> bool:
    w = t.split(" ")
    w = [x for x in w if x]
    return 2 <= len(w) <= 3 and all(len(x) >= 2 and x[0].isupper() and not any(c.isdigit() for c in x) for x in w)


def author_in_text(t: str, categories: tuple[str, ...]) -> str | None:
    low = {c.lower() for c in categories}
    for line in (clean(x) for x in re.split(r"[\n\r]+", t)):
        if not line or "сегодня" in line or "вчера" in line or re.search(r"\d{1,2}:\d{2}", line) or line.lower() in low or len(line) > 100:
            continue
        if is_author(line):
            return line
    for m in re.finditer(r"\b([А-ЯЁ][а-яё]{2,}\s+[А-ЯЁ][а-яё]{2,}(?:\s+[А-ЯЁ][а-яё]{2,})?)\b", t):
        a = clean(m[1])
        if a.lower() not in low and len(a) >= 5 and is_author(a):
            return a
    return None


def category_in_text(t: str, categories: tuple[str, ...]) -> str | None:
    words = {x.lower() for x in re.split(r"[\n\r ]+", t)}
    return next((c for c in categories if c.lower() in words), None) or next((c for c in categories if c.lower() in t.lower()), None)


def _json_blocks(root: Node) -> Iterator[dict]:
    for n in root.all("script", type="application/ld+json"):
        try:
            x = json.loads(n.raw())
        except ValueError:
            continue
        if isinstance(x, dict):
            yield x


def _meta(root: Node, *names: tuple[str, str]) -> str | None:
    for key, value in names:
        n = root.one("meta", **{key: value})
        if n is not None:
            return n.attrs.get("content")
    return None


def _content(root: Node) -> str:
    def paras(ns: list[Node]) -> list[Node]:
        return [p for n in ns for p in n.all("p")]

    boxes = [d for d in root.all("div") if any(k in d.attrs.get("class", "") for k in ("content", "article", "post", "text"))]
    for ns in (root.all("article"), boxes, root.all("main")):
        got = [clean(p.text()) for p in {id(p): p for p in paras(ns)}.values()]
        got = [x for x in got if x]
        if got:
            return "\n\n".join(got)
    for tag in ("article", "main"):
        n = root.one(tag)
        if n is not None and len(clean(n.text())) > 100:
            return clean(n.text())
    return ""


def _after_title(h1: Node | None) -> str:
    """Text of the later children of the title's parent, bare text too, then of ten siblings more: much is gathered twice."""
    if h1 is None or h1.parent is None:
        return ""
    own = h1.parent.kids
    sib = own[next(i for i, k in enumerate(own) if k is h1) + 1 :]
    got = [clean(k if isinstance(k, str) else k.text()) for k in [*sib, *sib[:10]]]
    return " ".join(t for t in got if t)


def _published(root: Node, page: str, today: dt.date) -> dt.datetime | None:
    for x in _json_blocks(root):
        for y in [x, *(g for g in x.get("@graph", []) if isinstance(g, dict))] if isinstance(x.get("@graph", []), list) else [x]:
            d = any_date(y.get("datePublished")) if isinstance(y.get("datePublished"), str) else None
            if d:
                return d
    tries = [lambda: root.all("time", datetime="*"), lambda: root.all("time"), lambda: root.all("span", cls="date"), lambda: root.all("div", cls="date"),
             lambda: root.all(cls="published"), lambda: root.all(cls="time"), lambda: root.all(data_date="*"), lambda: root.all(data_published="*")]
    nodes: list[Node] = next((ns for ns in (t() for t in tries) if ns), [])
    for n in nodes:
        d = any_date(n.attrs.get("datetime"))  # the attributes of the other selectors find the node, but are not read
        if d:
            return d
        t = clean(n.text())
        for word, back in (("сегодня", 0), ("вчера", 1)):
            if word in t.lower():
                return dt.datetime.combine(today - dt.timedelta(back), dt.time())
        d = any_date(t) or _day(DAY.search(t))
        if d:
            return d
    return date_in_text(page, today)


def article(url: str, page: str, site: Site, comments: int | None = None, title: str = "") -> dict:
    """The article of a page; ``title`` is what is known of it from the link."""
    page = page or ""
    root = parse(page)
    h1 = root.one("h1")
    if not title:
        n = h1 or root.one("title")
        title = clean(n.text()) if n is not None else ""
    out = {"title": clean_title(title), "url": url, "content": _content(root), "category": "", "author": "", "image_url": "", "publish_date": None, "comment_count": comments}
    a = _meta(root, ("property", "article:author"), ("name", "author"))
    if a and a.strip() and a.lower() != site.agency.lower():
        out["author"] = clean(a)
    dates = [("property", "article:published_time"), ("property", "og:published_time"), ("name", "publish-date"), ("name", "date"), ("itemprop", "datePublished"), ("name", "DC.date"), ("name", "PublicationDate")]
    out["publish_date"] = any_date(_meta(root, *dates))
    rest = _after_title(h1)
    out["publish_date"] = out["publish_date"] or date_in_text(rest, site.today)
    out["author"] = out["author"] or author_in_text(rest, site.categories) or ""
    out["category"] = category_in_text(rest, site.categories) or ""
    out["publish_date"] = out["publish_date"] or _published(root, page, site.today)
    near = " ".join(clean(n.text()) for n in (h1.after()[:5] if h1 is not None else []))
    if not out["author"]:
        n = next((ns[0] for ns in (root.all(t, cls="author") for t in ("span", "div", "a")) if ns), None)
        out["author"] = author_in_text(near, site.categories) or (clean(n.text()) if n is not None else "")
    if not out["category"]:
        n = root.one("a", cls="badge")
        out["category"] = clean(n.text()) if n is not None else ""
    hero = root.one(data_bg_image_webp="*") or root.one(data_bg_image_jpeg="*")
    if hero is not None:
        out["image_url"] = full_url(site.root, hero.attrs.get("data-bg-image-webp") or hero.attrs.get("data-bg-image-jpeg")) or ""
    img = root.one("img", cls="article") or next((i for n in root.all("article") for i in n.all("img")), None)
    if img is not None:
        out["image_url"] = full_url(site.root, img.attrs.get("src")) or out["image_url"]
    if not out["image_url"]:
        out["image_url"] = full_url(site.root, _meta(root, ("property", "og:image"), ("property", "vk:image"), ("name", "twitter:image"), ("itemprop", "image"))) or ""
    if not out["category"]:
        n = next((x for x in (root.one(t, cls="category") for t in ("a", "span", "div")) if x is not None), None)
        out["category"] = category_in_text(near, site.categories) or (clean(n.text()) if n is not None else "")
    if not out["category"]:
        for x in _json_blocks(root):
            if str(x.get("@type", "")).lower() == "breadcrumblist" and isinstance(x.get("itemListElement"), list):
                name = next((i["name"] for i in x["itemListElement"] if isinstance(i, dict) and i.get("position") == 2 and isinstance(i.get("name"), str) and i["name"].strip()), None)
                if name:
                    out["category"] = clean(name)
                    break
    if out["comment_count"] is None:
        m = re.search(r"(\d+)\s*(комментари|comment)", page or "", re.I)
        out["comment_count"] = int(m[1]) if m and int(m[1]) < 2**31 else None
    return out


def is_article_url(url: str, site: Site) -> bool:
    low = url.lower()
    dated = re.search(rf"{site.news}\d{{2}}-\d{{2}}-\d{{4}}$", url)
    if site.host not in url or "#" in url or url in (site.root, site.root + "/") or dated or any(p in low for p in V.EXCLUDED_PATHS):
        return False
    return site.articles in url or (site.news in url and f"{site.news.rstrip('/')}?page=" not in url)


def links(page: str, site: Site, most: int) -> list[tuple[str, str]]:
    """(url, title) of a day's page: at most ``most`` links that look like articles, then each url once."""
    out: list[tuple[str, str]] = []
    for a in parse(page).all("a", href="*"):
        href = a.attrs["href"].strip()
        if href.startswith("//"):
            continue
        url = full_url(site.root, href)
        if not url or not url.startswith("http") or not is_article_url(url, site):
            continue
        t = a.text().strip() or a.attrs.get("title", "").strip()
        if not t:
            n = a.one("span") or a.one("strong")
            t = n.text().strip() if n is not None else ""
        t = clean_title(clean(t))
        if 10 < len(t) < 500:
            out.append((url, t))
        if len(out) >= most:
            break
    return list({u: (u, t) for u, t in reversed(out)}.values())[::-1]


def articles(pages: DataFrame, site: Site) -> DataFrame:
    """Pages (url, html) as articles."""

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            rows = [article(u, p, site) for u, p in zip(b["url"], b["html"], strict=True)]
            yield pd.DataFrame(rows, columns=ARTICLE.names).astype({"publish_date": "datetime64[us]", "comment_count": "Int32"})

    return pages.select("url", "html").mapInPandas(run, ARTICLE)


def page_links(pages: DataFrame, site: Site, most: int = 1000) -> DataFrame:
    """(page_id, pos, url, title)."""

    def run(batches: Iterator[pd.DataFrame]):
        for b in batches:
            rows = [(i, k, u, t) for i, p in zip(b["page_id"], b["html"], strict=True) for k, (u, t) in enumerate(links(p, site, most))]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "url", "title"])

    return pages.select("page_id", "html").mapInPandas(run, ddl("page_id bigint, pos int, url string, title string"))
