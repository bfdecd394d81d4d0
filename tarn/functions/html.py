"""Pages to title, visible text and links: the standard library's HTML parser, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import BLOCK_TAGS, HIDDEN_TAGS, SECTION_BREAK

_BLOCKS, _HIDDEN = frozenset(BLOCK_TAGS), frozenset(HIDDEN_TAGS)
#: Elements that have no content and so no end tag.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Page(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.links, self.titles = base, [], [], []
        self.hidden: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (href := dict(attrs).get("href")):
            try:
                self.links.append(urljoin(self.base, href))
            except ValueError:  # a link that is no URL
                pass
        if tag == "title":
            self.in_title, self.titles = True, [*self.titles, ""]
        if tag in _HIDDEN:
            self.hidden.append(tag)
        elif tag == "body":
            self.hidden.clear()  # an unclosed head ends here
        if tag in _BLOCKS and not self.hidden:
            self.out.append(SECTION_BREAK)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        elif tag in _BLOCKS and not self.hidden:
            self.out.append(SECTION_BREAK)

    def handle_data(self, data):
        if self.in_title:
            self.titles[-1] += data
        elif not self.hidden:
            self.out.append(data)


def collapse(raw: str) -> str:
    """One break for a run of white space with a break in it, one space for any other."""
    joined = re.sub(r"[\s\x00]*\x00[\s\x00]*", SECTION_BREAK, raw)
    return re.sub(r"\s+", " ", joined).strip(" \x00")


def parse_page(html: str | None, base: str | None) -> tuple[str, str, list[str]]:
    """Title, text with section breaks and absolute links; nothing of an empty page."""
    if not html:
        return "", "", []
    page = _Page(base or "")
    page.feed(html)
    page.close()
    title = re.sub(r"\s+", " ", page.titles[0]).strip() if page.titles else ""
    return title, collapse("".join(page.out)), page.links


def _parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for html, base in batches:
        yield pd.DataFrame([parse_page(h, b) for h, b in zip(html, base, strict=True)], columns=["title", "text", "links"])


def parsed(html: Column, base: Column) -> Column:
    """struct<title, text, links> of a page."""
    return F.pandas_udf(_parse, "title string, text string, links array<string>")(html, base)
