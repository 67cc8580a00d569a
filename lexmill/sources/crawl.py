"""The plan of a crawl over tables: day urls, links, new articles. Fetching is an injected function."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import html as H


def day_urls(spark: SparkSession, base: str, today: str, days: int) -> DataFrame:
    """(back, url) from today backwards."""
    return spark.range(days).select(F.col("id").alias("back"), T.date_url(F.lit(base), F.date_sub(F.lit(today).cast("date"), F.col("id").cast("int"))).alias("url"))


def first_links(found: DataFrame, n: int, known: DataFrame | None = None) -> DataFrame:
    """The first ``n`` new urls by day and place; ``found``: back, pos, url, title."""
    w = Window.partitionBy("url").orderBy("back", "pos")
    d = found.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
    if known is not None:
        d = d.join(known.select("url"), "url", "left_anti")
    return d.orderBy("back", "pos").limit(n)


def fetch(urls: DataFrame, get: Callable[[str], tuple[int, str]], tries: int = 3, pause: float = 1.0) -> DataFrame:
    """(url, html) by ``get`` (url to status and body): a refusal (4xx) isn't tried again, other failures wait a little longer each time."""

    def one(url: str) -> str | None:
        for k in range(1, tries + 1):
            try:
                status, body = get(url)
            except Exception:
                status, body = 599, ""
            if status < 400:
                return body
            if status < 500 or k == tries:
                return None
            time.sleep(pause * k)
        return None

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"url": b["url"], "html": [one(u) for u in b["url"]]})

    return urls.select("url").mapInPandas(run, "url string, html string").filter("html is not null")


def crawl(spark: SparkSession, site: H.Site, get: Callable[[str], tuple[int, str]], base: str, n: int, days: int, per_day: int = 1000) -> DataFrame:
    """Articles of up to ``n`` links of the last ``days`` days."""
    u = day_urls(spark, base, site.today.isoformat(), days)
    p = fetch(u, get).join(u, "url").select(F.col("back").alias("page_id"), "html")
    found = H.page_links(p, site, per_day).withColumnRenamed("page_id", "back")
    return H.articles(fetch(first_links(found, n), get), site)
