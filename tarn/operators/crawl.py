"""Breadth-first crawl over a table of pages.

Pages of a level are fetched (joined) and parsed in Spark; links are admitted on the driver, in the order in which a
first-in-first-out crawler would meet them, because a page's quota counts only links that no earlier page brought. The frontier
is bounded by ``max_pages`` and the link quota.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
import urllib.robotparser
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.html import parsed
from tarn.functions.text import crawl_segments
from tarn.functions.urls import allowed_host, normalise_url
from tarn.functions.words import RETRIABLE
from tarn.tables import materialise


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, title, text, links, token_segments and tokens of pages (page_id, url, html), each parsed once."""
    rows = pages.select("page_id", "url", F.length("html").alias("content_length"), parsed(F.col("html"), F.col("url")).alias("p")).select("page_id", "url", "content_length", "p.*")
    rows = rows.withColumn("token_segments", crawl_segments(F.col("text")))
    return rows.withColumn("tokens", F.flatten("token_segments"))


def link_graph(pages: DataFrame) -> DataFrame:
    """(src, dst, link_ord): normalised absolute links of each page in order; links that are none are left out."""
    rows = parse_pages(pages).select(normalise_url(F.col("url")).alias("src"), F.posexplode("links").alias("link_ord", "link"))
    return rows.select("src", normalise_url(F.col("link")).alias("dst"), "link_ord").where("src is not null and dst is not null")


class Frontier:
    """Queue and visited set of normalised URLs, on the driver."""

    def __init__(self, spark: SparkSession, hosts: list[str] | None = None):
        self.spark, self.hosts, self.visited = spark, hosts, {}

    def normalise(self, urls: list[str]) -> list[str | None]:
        """Canonical form of each, null where it is none or its host isn't allowed; one small job for a level's links."""
        if not urls:
            return []
        rows = self.spark.createDataFrame(list(enumerate(urls)), "i long, url string").withColumn("n", normalise_url(F.col("url")))
        found = {r.i: r.n for r in rows.where(allowed_host(F.col("n"), self.hosts)).select("i", "n").collect()}
        return [found.get(i) for i in range(len(urls))]

    def add(self, url: str | None, depth: int) -> bool:
        if url is None or url in self.visited:
            return False
        self.visited[url] = depth
        return True


Source = Callable[[DataFrame], DataFrame]


def from_table(pages: DataFrame) -> Source:
    """A source that answers from a table of pages (page_id, url, html); of pages with one normalised URL the one with the least page_id."""
    named = pages.where("html is not null").withColumn("__normal", normalise_url(F.col("url"))).where("__normal is not null")
    first = materialise(named.groupBy(F.col("__normal").alias("__url")).agg(F.min("page_id").alias("__page")), "crawl-urls")

    def get(asked: DataFrame) -> DataFrame:
        wanted = first.join(F.broadcast(asked.select(F.col("url").alias("__url"))), "__url")
        found = named.join(F.broadcast(wanted), (F.col("page_id") == F.col("__page")) & (F.col("__normal") == F.col("__url")))  # a level
        return found.select("page_id", F.col("__url").alias("url"), "html")

    return get


def from_web(**options) -> Source:
    """A source that fetches over HTTP; options are those of ``fetch``."""
    return lambda asked: fetch(asked.select("url"), **options).where("html is not null").select(F.lit(None).cast("long").alias("page_id"), "url", "html")


def crawl_from(spark: SparkSession, source: Source, seeds: list[str], max_pages: int = 100, max_depth: int | None = None, max_links: int | None = None, hosts: list[str] | None = None, start_seq: int = 1) -> DataFrame:
    """Documents (doc_id, url, title, text, tokens, token_segments, depth, content_length) in crawl order. ``source`` gives pages (page_id, url, html) for
    the URLs of a level; each page is got and parsed once, and kept in the shared folder."""
    frontier, stored, levels = Frontier(spark, hosts), [], []
    queue = [u for u in frontier.normalise(seeds) if frontier.add(u, 0)]
    while queue and len(stored) < max_pages:
        asked = spark.createDataFrame(list(enumerate(queue)), "ord long, url string")
        levels.append(materialise(parse_pages(source(asked)).join(F.broadcast(asked), "url"), "crawl-level"))  # at most max_pages times the link quota
        got = levels[-1].select("ord", "url", "links").orderBy("ord").limit(max_pages - len(stored)).collect()
        flat = frontier.normalise([link for r in got for link in r.links])
        queue, at = [], 0
        for r in got:
            stored.append((start_seq + len(stored), r.url, frontier.visited[r.url]))
            links, at = flat[at : at + len(r.links)], at + len(r.links)
            if max_depth is not None and frontier.visited[r.url] >= max_depth:
                continue
            added = 0
            for link in links:
                if max_links is not None and added >= max_links:
                    break
                if frontier.add(link, frontier.visited[r.url] + 1):
                    queue.append(link)
                    added += 1
    order = spark.createDataFrame(stored, "seq long, url string, depth int")
    if not levels:
        levels = [parse_pages(spark.createDataFrame([], "page_id long, url string, html string"))]
    found = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), levels).join(F.broadcast(order), "url")
    return found.select(F.format_string("%06d", "seq").alias("doc_id"), "url", "title", "text", "tokens", "token_segments", "depth", "content_length")


def crawl(pages: DataFrame, seeds: list[str], *limits, **named) -> DataFrame:
    """``crawl_from`` over a table of pages (page_id, url, html)."""
    return crawl_from(pages.sparkSession, from_table(pages), seeds, *limits, **named)


def reachable(pages: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(url, depth) of all pages that links lead to from the seeds (url), with the least number of links; no quota, nothing on the driver."""
    there = pages.where("html is not null").select(normalise_url(F.col("url")).alias("url")).where("url is not null").distinct()
    edges = materialise(link_graph(pages).select("src", "dst").distinct().join(there.select(F.col("url").alias("dst")), "dst", "left_semi"), "reach-edges")
    level = seeds.select(normalise_url(F.col("url")).alias("url")).distinct().join(there, "url", "left_semi").withColumn("depth", F.lit(0))
    found = level = materialise(level, "reach-level")
    depth = 0
    while not level.isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        fresh = edges.join(level.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        level = materialise(fresh.join(found.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)), "reach-level")
        found = found.unionByName(level)
    return found


def is_retriable(status: int) -> bool:
    return status in RETRIABLE


def fetch(urls: DataFrame, agent: str = "tarn", wait: float = 1.0, timeout: float = 10.0, tries: int = 3, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> DataFrame:
    """(url, html) over HTTP, null where it failed. URLs are dealt by host, so that a host is asked by one task, no faster
    than every ``wait`` seconds and as its robots.txt allows (an unreadable one allows all)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        robots: dict[str, urllib.robotparser.RobotFileParser | None] = {}

        def get(url: str) -> str | None:
            for attempt in range(1, tries + 1):
                try:
                    with opener(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as answer:
                        return answer.read().decode("utf-8", "replace")
                except urllib.error.HTTPError as e:
                    if not is_retriable(e.code):
                        return None
                except (OSError, ValueError):
                    pass
                if attempt < tries:
                    sleep(wait * attempt)
            return None

        def allowed(url: str) -> bool:
            origin = "{0.scheme}://{0.netloc}".format(urlsplit(url))
            if origin not in robots:
                text = get(f"{origin}/robots.txt")
                robots[origin] = None
                if text is not None:
                    robots[origin] = urllib.robotparser.RobotFileParser()
                    robots[origin].parse(text.splitlines())
            return robots[origin] is None or robots[origin].can_fetch(agent, url)

        for batch in batches:
            out = []
            for url in batch["url"]:
                host = urlsplit(url).netloc
                if not allowed(url):
                    out.append(None)
                    continue
                if (pause := last.get(host, -1e9) + wait - time.monotonic()) > 0:
                    sleep(pause)
                out.append(get(url))
                last[host] = time.monotonic()
            yield pd.DataFrame({"url": batch["url"], "html": out})

    return urls.select("url", F.regexp_extract("url", "^[^:/?#]+://([^/?#]*)", 1).alias("host")).repartition("host").select("url").mapInPandas(run, "url string, html string")
