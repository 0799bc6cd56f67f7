"""HTML by the standard library's parser, in batches through Arrow."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCKS = {"p", "div", "li", "ul", "ol", "tr", "table", "section", "article", "header", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "br", "title", "nav", "td", "th"}
SILENT = {"script", "style", "noscript", "template"}
NOISE = {"nav", "footer", "aside", "form"}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.tables: list[list[list[str]]] = []
        self.silent = self.noise = 0
        self.link: list | None = None
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        self.silent += tag in SILENT
        self.noise += tag in NOISE
        if tag in BLOCKS:
            self.parts.append("\n")
        if tag == "a":
            self.link = [dict(attrs).get("href") or "", []]
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_endtag(self, tag):
        self.silent -= tag in SILENT and self.silent > 0
        self.noise -= tag in NOISE and self.noise > 0
        if tag in BLOCKS:
            self.parts.append("\n")
        if tag == "a" and self.link is not None:
            self.links.append((self.link[0], " ".join("".join(self.link[1]).split())))
            self.link = None
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.link is not None:
            self.link[1].append(data)
        if self.cell is not None:
            self.cell.append(data)
        if not self.silent and not self.noise:
            self.parts.append(data)


def read(html: str | None) -> _Reader:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader


def text_of(html: str | None) -> str:
    """Visible text: a line to a block, single blanks, no scripts, menus or footers."""
    lines = (" ".join(x.split()) for x in "".join(read(html).parts).split("\n"))
    return "\n".join(x for x in lines if x)


def links_of(html: str | None, base: str) -> list[dict]:
    """Links in order, each address once, made absolute, without fragments."""
    found: dict[str, str] = {}
    for href, label in read(html).links:
        if not href or href.startswith(("#", "javascript:", "mailto:")) or "{" in href:
            continue
        try:
            url = re.sub(r"#.*$", "", urljoin(base or "", href.strip()))
        except ValueError:
            continue
        found.setdefault(url, label)
    return [{"url": u, "label": t} for u, t in found.items()]


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(text_of)


LINKS = T.ArrayType(T.StructType([T.StructField("url", T.StringType()), T.StructField("label", T.StringType())]))


@F.pandas_udf(LINKS)
def html_links(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([links_of(h, b) for h, b in zip(html, base, strict=True)])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))))
def html_tables(html: pd.Series) -> pd.Series:
    return html.map(lambda h: read(h).tables)


DOCUMENT = re.compile(r"\.(pdf|xlsx?|docx?|zip)$", re.I)


def route_link(url: str | None, host: str) -> str:
    """unknown, external, document, circular or subpage."""
    if not url:
        return "unknown"
    found = re.match(r"https?://([^/?#]+)([^?#]*)", url, re.I)
    if found and not (found[1].lower() == host or found[1].lower().endswith("." + host)):
        return "external"
    path = (found[2] if found else re.sub(r"[?#].*$", "", url)).rstrip("/")
    if DOCUMENT.search(path):
        return "document"
    if re.search(r"/circulars/[^/]+", path):
        return "circular"
    return "subpage" if re.search(r"/laws-regulations/[^/]+", path) else "unknown"


def questions(markdown: Column) -> Column:
    """Questions ``**Q1.** text`` of a page, a line each, as an array of (key, question)."""
    pattern = r"(?m)^\s*\*\*(Q?[0-9]+)\.?\*\*\.?\s*(\S.*)$"
    part = lambda i: F.regexp_extract_all(markdown, F.lit(pattern), F.lit(i))
    return F.transform(F.arrays_zip(part(1).alias("key"), part(2).alias("question")), lambda q: F.struct(q["key"].alias("key"), F.trim(q["question"]).alias("question")))
