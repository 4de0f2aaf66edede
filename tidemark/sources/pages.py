"""Article fields from HTML: structured data first, then meta tags, then the page itself. Standard library parsing in an Arrow map."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Meta tags that hold the time of publication, by trust (fixed values).
TIME_META = ("article:published_time", "og:article:published_time", "publish-date", "datePublished", "pubdate", "article.published", "og:published_time", "content_type:published_time")
#: Elements without article text (fixed values).
SKIPPED = frozenset(("script", "style", "noscript", "iframe", "form", "figure", "aside", "nav", "header", "footer", "svg", "button"))
#: Words of a gate (fixed values).
GATE = ("paywall", "isprime", "subscribe now", "subscriber only", "premium story", "for subscribers")
_LD = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script>", re.I | re.S)
_SPACE = re.compile(r"\s+")


class _Page(HTMLParser):
    """Meta tags, title, first heading, first time element, and paragraphs by the container they stand in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.title = self.h1 = self.time = ""
        self.stack: list[tuple[str, int]] = []
        self.paragraphs: dict[int, list[str]] = {}
        self.containers, self.skip, self.into, self.text = 0, 0, "", []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = a.get("property") or a.get("name") or a.get("itemprop")
            if name and a.get("content"):
                self.meta.setdefault(name, a["content"])
        if tag in SKIPPED:
            self.skip += 1
        if tag in ("article", "div", "section", "main", "body"):
            self.containers += 1
            self.stack.append((tag, self.containers))
        if tag == "time" and not self.time:
            self.time = a.get("datetime", "")
        if tag in ("p", "h1", "title"):
            self.into, self.text = tag, []

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED and self.skip:
            self.skip -= 1
        if tag == self.into:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if tag == "p" and text and self.stack:
                self.paragraphs.setdefault(self.stack[-1][1], []).append(text)
            elif tag == "h1" and not self.h1:
                self.h1 = text
            elif tag == "title":
                self.title = text
            self.into = ""
        while self.stack and self.stack[-1][0] == tag:
            self.stack.pop()
            break

    def handle_data(self, data: str) -> None:
        if self.into and not self.skip:
            self.text.append(data)


def articles(html: str) -> list[dict]:
    """The article nodes of a page's structured data, at any depth; broken blocks are skipped."""
    out: list[dict] = []

    def walk(node: object) -> None:
        if isinstance(node, dict):
            kind = node.get("@type")
            if any("Article" in str(k) for k in (kind if isinstance(kind, list) else [kind])):
                out.append(node)
            for v in node.values():
                walk(v)
        elif isinstance(node, list):
            for v in node:
                walk(v)

    for block in _LD.findall(html):
        try:
            walk(json.loads(block))
        except ValueError:
            continue
    return out


def cleaned(headline: str, outlets: tuple[str, ...] = ()) -> str:
    """A headline without the outlet's name behind its last dash or bar."""
    text = headline.strip()
    if outlets:
        text = re.sub(rf"\s*[-|–—]\s*(?:{'|'.join(map(re.escape, sorted(outlets, key=len, reverse=True)))})\s*$", "", text, flags=re.I)
    return text.strip()


class _Container(HTMLParser):
    """The text of the first element that a selector names: ``tag``, ``.class``, ``tag.class`` or ``#id``."""

    def __init__(self, selector: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.mark, self.name = re.fullmatch(r"([a-z0-9]*)([.#]?)(.*)", selector).groups()
        self.depth, self.skip, self.found, self.text = 0, 0, False, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if self.depth:
            if tag in SKIPPED:
                self.skip += 1
            if tag == self.within:
                self.depth += 1
        elif not self.found and (not self.tag or tag == self.tag) and (not self.mark or (self.name in a.get("class", "").split() if self.mark == "." else a.get("id") == self.name)):
            self.depth, self.found, self.within = 1, True, tag

    def handle_endtag(self, tag: str) -> None:
        if self.depth and tag in SKIPPED and self.skip:
            self.skip -= 1
        if self.depth and tag == self.within:
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        if self.depth and not self.skip:
            self.text.append(data)


def selected(html: str, selectors: tuple[str, ...], least: int = 200) -> str:
    """The text of the first selected element that has more than ``least`` characters; '' if none has."""
    for s in selectors:
        c = _Container(s)
        c.feed(html)
        text = _SPACE.sub(" ", " ".join(c.text)).strip()
        if len(text) > least:
            return text
    return ""


def parsed(html: str | None, selectors: tuple[str, ...] = (), outlets: tuple[str, ...] = ()) -> tuple[str, str, str, str, bool]:
    """(headline, body, snippet, published, gated) of a page; empty strings where a page has none. ``selectors`` are those of its site,
    ``outlets`` the names that headlines end in."""
    if not html:
        return "", "", "", "", False
    page, found = _Page(), articles(html)
    page.feed(html)
    text = lambda key: next((n[key].strip() for n in found if isinstance(n.get(key), str) and n[key].strip()), "")
    headline = text("headline") or page.meta.get("og:title") or page.meta.get("twitter:title") or page.h1 or page.title.split("|")[0].strip()
    body = _SPACE.sub(" ", text("articleBody"))
    if len(body) <= 200:
        body = selected(html, selectors) or max((" ".join(p) for p in page.paragraphs.values() if len(p) >= 3), key=len, default="")
    snippet = text("description") or text("abstract") or page.meta.get("og:description") or page.meta.get("description") or ""
    published = text("datePublished") or next((page.meta[m] for m in TIME_META if page.meta.get(m)), "") or page.time
    low = html.lower()
    return cleaned(headline, outlets), body, snippet.strip(), published, any(g in low for g in GATE) and len(body) < 600


def extracted(pages: DataFrame, selectors: dict[str, tuple[str, ...]] | None = None, outlets: tuple[str, ...] = ()) -> DataFrame:
    """(url, headline, body, snippet, published, gated) of (url, text), or of (url, text, source) with the selectors of each source."""
    sites = selectors or {}
    own = pages.select("url", "text", "source" if sites else F.lit("").alias("source"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [parsed(t, sites.get(s, ()), outlets) for t, s in zip(b["text"], b["source"], strict=True)]
            yield pd.DataFrame(rows, columns=["headline", "body", "snippet", "published", "gated"]).assign(url=b["url"].to_numpy())[["url", "headline", "body", "snippet", "published", "gated"]]

    return own.mapInPandas(run, "url string, headline string, body string, snippet string, published string, gated boolean")
