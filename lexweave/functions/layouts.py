"""Pages of known layouts, read by one pass of the standard library's parser, in batches through Arrow.

Every layout is a function from a page and its address to records, and a
Column function that gives them as an array of structs. Broken pages give what
can be read of them; null and empty pages give nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMPTY = {"area", "base", "br", "col", "hr", "img", "input", "link", "meta", "source", "wbr"}
# Endings of documents, rows of a listing's page, and types of laws by their listing's names.
DOCUMENTS = (".pdf", ".xlsx", ".xls", ".docx", ".doc", ".zip", ".csv")
PAGE_ROWS = 30
LAW_TYPES = {"laws": "law", "regulations": "regulation", "gazette notifications": "gazette", "guidelines": "guideline", "licensing guidelines": "licensing"}
SECTION = "/laws-regulations/"


class Node:
    """An element: its tag, attributes, children (elements and texts) and place in the page."""

    __slots__ = ("attrs", "children", "order", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, order: int):
        self.tag, self.attrs, self.parent, self.order, self.children = tag, attrs, parent, order, []

    def walk(self) -> Iterator[Node]:
        stack = [x for x in reversed(self.children) if isinstance(x, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [x for x in reversed(node.children) if isinstance(x, Node)]

    def has(self, tag: str | None, *classes: str) -> bool:
        mine = self.attrs.get("class", "").split()
        return (tag is None or self.tag == tag) and all(c in mine for c in classes)

    def all(self, tag: str | None, *classes: str) -> list[Node]:
        return [n for n in self.walk() if n.has(tag, *classes)]

    def first(self, tag: str | None, *classes: str) -> Node | None:
        return next((n for n in self.walk() if n.has(tag, *classes)), None)

    def strings(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            else:
                stack += reversed(x.children)

    def text(self, between: str = " ") -> str:
        return " ".join(between.join(self.strings()).split())

    def links(self) -> list[tuple[str, Node]]:
        """Addresses that lead somewhere, in order."""
        found = [((n.attrs.get("href") or "").strip(), n) for n in self.all("a")]
        return [(h, n) for h, n in found if h and not h.lower().startswith(("#", "javascript:", "mailto:"))]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None, 0)
        self.count = 0

    def handle_starttag(self, tag, attrs):
        self.count += 1
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at, self.count)
        self.at.children.append(node)
        if tag not in EMPTY:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.at.tag == tag and tag not in EMPTY:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def tidy(text: str) -> str:
    plain = " ".join((text or "").translate(str.maketrans("’‘–—", "''--")).split())
    return re.sub(r"\s*/\s*", "/", plain)


def _joined(base: str, href: str) -> str | None:
    try:
        return urljoin(base or "", href)
    except ValueError:
        return None


def _year(*texts: str) -> str:
    return next((m[1] for t in texts if (m := re.search(r"\b((?:19|20)\d{2})\b", t or ""))), "")


def circular_listing(html: str | None, base: str) -> list[dict]:
    """Boxes of a listing of circulars: a heading's link, a reference line, and a line of date, department, category and type."""
    found = []
    for box in tree(html).all("div", "publication-box-new"):
        link = next((a for h in box.all("h4") for _, a in h.links()), None)
        title = link.text("") if link else ""
        url = _joined(base, link.attrs["href"].strip()) if link else None
        if not title or not url:
            continue
        lines = box.all("p", "date")
        reference = next((p.text() for p in lines if p.has("p", "mb-3")), "")
        meta = next((p for p in lines if p.first("span", "dept")), None)
        span = lambda name, meta=meta: s.text("") if meta is not None and (s := meta.first("span", name)) else ""
        day = meta.text().split("|", 1)[0].strip() if meta is not None else ""
        department = span("dept") or (reference.split()[0] if reference else "")
        found.append({"title": title, "url": re.sub(r"#.*$", "", url), "reference": reference, "date": day, "department": department, "category": span("cat"), "doc_type": span("type"), "year": _year(reference, day)})
    return found


def listing_pages(html: str | None) -> int:
    """How many pages a listing has: what its pager says, or its count of records needs; else one."""
    page = tree(html)
    said = next((n.attrs["data-total-pages"] for n in page.all(None, "pagination-custom") if n.attrs.get("data-total-pages", "").isdigit()), None)
    if said is not None:
        return max(1, int(said))
    total = next((n.attrs.get("value", "") for n in page.walk() if n.attrs.get("id") == "total_all_records"), "")
    return max(1, -(-int(total) // PAGE_ROWS)) if total.isdigit() else 1


def law_listing(html: str | None, base: str) -> list[dict]:
    """Rows of a listing of laws, told by their data attributes, in page order."""
    found = []
    for order, row in enumerate(tree(html).all("tr", "law-row")):
        title = tidy(row.attrs.get("data-title") or row.text())
        if not title:
            continue
        kind = tidy(row.attrs.get("data-type", "")).lower()
        day = row.attrs.get("data-date", "").strip()
        href = next((h for h, _ in row.links()), None)
        found.append({"title": title, "doc_type": LAW_TYPES.get(kind, kind or None), "url": _joined(base, href) if href else None, "listed": day if re.fullmatch(r"\d{4}-\d{2}-\d{2}", day) else None, "position": order})
    return found


def series_index(html: str | None, base: str) -> list[dict]:
    """Rows of an index of data series: the section and category above their table, the title, two badges and the addresses."""
    section, category, found = "General", None, []
    for node in tree(html).walk():
        if node.has("h2", "sector-heading"):
            section = node.text() or "General"
        elif node.has("h5", "primary-color"):
            category = node.text()
        elif node.has("div", "data-row-wrapper") and _inside(node, "table", "economic-data-table"):
            head = node.first("h6")
            title = head.text() if head else ""
            if len(title) < 3:
                continue
            badges = [n.text() for n in node.all(None, "pill-badge")]
            urls = [u for h, _ in node.links() if (u := _joined(base, h))]
            series = next((u for u in urls if "/economic-data/" in u), None)
            document = next((u for u in urls if "/economic-data/" not in u or u != series if u.lower().endswith((".xlsx", ".xls", ".pdf", ".csv"))), None)
            found.append({"section": section, "category": category, "title": title, "url": series or document, "frequency": badges[0] if badges else None, "updated": badges[1] if len(badges) > 1 else None, "document_url": document, "document_type": document.rsplit(".", 1)[1].lower() if document else None, "position": len(found)})
    return found


def _inside(node: Node, tag: str, name: str) -> bool:
    while node.parent is not None:
        node = node.parent
        if node.has(tag, name):
            return True
    return False


def news_cards(html: str | None, base: str) -> list[dict]:
    """Cards of a feed of news: title, date and address; cards in Urdu go."""
    page = tree(html)
    found = []
    for card in (page.first(None, "what-new") or page).all(None, "news-card"):
        anchor = next((a for a in card.all("a") if a.attrs.get("href", "").strip()), None)
        if anchor is None:
            continue
        head, day = card.first(None, "title"), card.first(None, "date")
        title, href = (head or anchor).text(""), anchor.attrs["href"].strip()
        if title and not href.lower().endswith("-u.pdf") and "urdu" not in title.lower():
            found.append({"title": title, "date": day.text("") if day else "", "url": _joined(base, href) or href, "position": len(found)})
    return found


def attachments(html: str | None, base: str) -> list[dict]:
    """Linked documents of a page, each address and each file name once; templates' placeholders and Urdu versions go.

    A bare file name belongs to the store of documents: to the folder that the
    page names in ``automationPathHolder``, with the store itself to fall back on.
    """
    page = tree(html)
    holder = next((n.attrs.get("value") or n.text("") for n in page.walk() if "automationPathHolder" in (n.attrs.get("id"), n.attrs.get("name"))), "").strip("/ ")
    origin = "{0.scheme}://{0.netloc}".format(urlsplit(base or ""))
    found, urls, names = [], set(), set()
    for href, _ in page.links():
        if "{" in href or "}" in href:
            continue
        bare = "/" not in href and not re.match(r"[A-Za-z][\w+.-]*:", href)
        store = f"{origin}/assets/documents/"
        url = _joined(f"{store}{holder}/" if bare and holder else store if bare else base, href)
        if not url:
            continue
        url = re.sub(r"#.*$", "", url)
        path = urlsplit(url).path
        name = unquote(path.rsplit("/", 1)[-1])
        ending = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
        if ending not in DOCUMENTS or path.lower().endswith("-u.pdf") or url in urls:
            continue
        urls.add(url)
        if name.lower() in names:
            continue
        names.add(name.lower())
        found.append({"url": url, "filename": name, "file_type": ending[1:], "fallback_url": _joined(store, href) if bare and holder else None, "position": len(found)})
    return found


# The form of a part's key ("12", "III", "A-I"), nouns of parts, their odd plurals, and heads that name nothing.
KEY = re.compile(r"[0-9]{1,3}[a-z]?|[ivxlc]+|[a-z]{1,3}-[0-9ivxlc]{1,6}", re.I)
NOUNS = ("appendix", "annexure", "annex", "chapter", "schedule", "part", "section", "form")
PLURALS = {"appendices": "Appendix", "annexes": "Annex"}
NAMELESS = {"", "sr no", "s no", "sr", "no", "number", "#", "serial no", "item", "items"}


def singular(head: str) -> str | None:
    """A column's head as the noun of its parts; None if it names nothing."""
    plain = re.sub(r"\s*(no|number)$", "", " ".join(tidy(head).replace(".", " ").lower().split()).strip(" :-")).strip()
    if plain in NAMELESS:
        return None
    if plain in PLURALS:
        return PLURALS[plain]
    return (plain[:-1] if len(plain) > 3 and plain.endswith("s") and not plain.endswith("ss") else plain).title()


def _part_links(node: Node) -> list[str]:
    return [h for h, _ in node.links() if urlsplit(h).path.lower().endswith(DOCUMENTS) or SECTION in urlsplit(h).path]


def _caption(table: Node, texts: list[tuple[int, str]]) -> str:
    """The text right above a table, of the last eight that are more than two characters."""
    before = [t for order, t in texts if order < table.order][-8:]
    return next((t for t in reversed(before) if len(t) > 2), "")


def _texts(root: Node) -> list[tuple[int, str]]:
    """Texts with the order of the element that comes last before each."""
    found, last = [], [root.order]

    def visit(node: Node) -> None:
        for x in node.children:
            if isinstance(x, str):
                if tidy(x):
                    found.append((last[0], tidy(x)))
            else:
                last[0] = x.order
                visit(x)

    visit(root)
    return found


def parts_of_page(html: str | None, base: str) -> list[dict]:
    """The parts that a container's page lists: rows of tables, cards, or else links in its prose; each address once.

    A table's key column is the first whose cells are all short keys ("12",
    "III", "A-I") or empty; the longest other cell is the title.
    """
    page = tree(html)
    root = page.first("div", "border-box") or page.first("main") or page.first("body") or page
    texts, found = _texts(page), []
    for table in root.all("table"):
        rows = [[tidy(c.text()) for c in r.walk() if c.tag in ("td", "th")] for r in table.all("tr")]
        body = [(cells, links) for cells, r in zip(rows, table.all("tr"), strict=True) if (links := _part_links(r))]
        columns = [[cells[i] for cells, _ in body if i < len(cells)] for i in range(max((len(c) for c, _ in body), default=0))]
        keyed = next((i for i, col in enumerate(columns) if all(KEY.fullmatch(v) or v in ("", "-") for v in col) and any(KEY.fullmatch(v) for v in col)), None)
        noun = None
        if keyed is not None:
            noun = (singular(rows[0][keyed]) if keyed < len(rows[0]) else None) or singular(_caption(table, texts))
        for cells, links in body:
            key = cells[keyed] if keyed is not None and keyed < len(cells) else ""
            others = [v for i, v in enumerate(cells) if i != keyed and v]
            title = max(others, key=len) if others else key
            if not title:
                continue
            named = next((n.title() for n in NOUNS if re.match(rf"{n}\b", title, re.I)), noun)
            label = title if not KEY.fullmatch(key) else f"{named} {key.upper()}" if named else key.upper()
            found.append({"part_key": key.upper() if KEY.fullmatch(key) else None, "part_label": label, "title": title, "url": _joined(base, links[0])})
    for card in root.all("div", "category-box"):
        head = next((n for n in card.walk() if n.tag in ("h5", "h4", "h3") or n.has(None, "title")), None)
        links, title = _part_links(card), tidy(head.text()) if head else ""
        if links and title:
            found.append({"part_key": None, "part_label": title, "title": title, "url": _joined(base, links[0])})
    if not found:
        for href, anchor in root.links():
            if href in _part_links(anchor.parent) and href:
                title = tidy(anchor.text()) or tidy(unquote(urlsplit(href).path.rsplit("/", 1)[-1].rsplit(".", 1)[0]))
                found.append({"part_key": None, "part_label": title, "title": title, "url": _joined(base, href)})
    unique: dict[str, dict] = {}
    for part in found:
        unique.setdefault(part["url"], part)
    return [p | {"position": i} for i, p in enumerate(unique.values())]


def page_title(html: str | None, url: str | None = None) -> str | None:
    """A page's first heading, its title, or the last word of its address."""
    page = tree(html)
    for tag in ("h1", "h2", "title"):
        if (node := page.first(tag)) and tidy(node.text()):
            return tidy(node.text())
    name = urlsplit(url or "").path.rstrip("/").rsplit("/", 1)[-1]
    return tidy(re.sub(r"[-_]+", " ", unquote(name))) or None


def _struct(**kinds: str) -> T.ArrayType:
    types = {"s": T.StringType(), "i": T.IntegerType()}
    return T.ArrayType(T.StructType([T.StructField(n, types[k]) for n, k in kinds.items()]))


CIRCULARS = _struct(title="s", url="s", reference="s", date="s", department="s", category="s", doc_type="s", year="s")
LAWS = _struct(title="s", doc_type="s", url="s", listed="s", position="i")
SERIES = _struct(section="s", category="s", title="s", url="s", frequency="s", updated="s", document_url="s", document_type="s", position="i")
NEWS = _struct(title="s", date="s", url="s", position="i")
ATTACHMENTS = _struct(url="s", filename="s", file_type="s", fallback_url="s", position="i")
PARTS = _struct(part_key="s", part_label="s", title="s", url="s", position="i")


def records(read: Callable[[str | None, str], list[dict]], schema: T.ArrayType) -> Callable[[Column | str, Column | str], Column]:
    """A layout as a Column function of a page and its address."""

    @F.pandas_udf(schema)
    def run(html: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([read(h, b or "") for h, b in zip(html, base, strict=True)])

    return run


@F.pandas_udf(T.IntegerType())
def page_count(html: pd.Series) -> pd.Series:
    return html.map(listing_pages)


@F.pandas_udf(T.StringType())
def title_of(html: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([page_title(h, u) for h, u in zip(html, url, strict=True)])


class _Rewriter(HTMLParser):
    """Gives a page's markup again, with known addresses and references led to documents."""

    def __init__(self, base: str, addresses: dict[str, str], references: dict[str, str], find):
        super().__init__(convert_charrefs=False)
        self.base, self.addresses, self.references, self.find = base, addresses, references, find
        self.out: list[str] = []
        self.inside = 0

    def handle_starttag(self, tag, attrs):
        raw = self.get_starttag_text()
        if tag == "a":
            self.inside += 1
            href = dict(attrs).get("href") or ""
            url = _joined(self.base, href.strip()) if href else None
            known = self.addresses.get(re.sub(r"[#?].*$", "", url or "").lower().rstrip("/"))
            if known:
                raw = f'<a href="/documents/{known}" data-document="{known}">'
        self.out.append(raw)

    def handle_startendtag(self, tag, attrs):
        self.out.append(self.get_starttag_text())

    def handle_endtag(self, tag):
        self.inside -= tag == "a" and self.inside > 0
        self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if self.inside or self.cdata_elem:
            self.out.append(data)
            return
        at = 0
        for start, end, key in self.find(data):
            known = self.references.get(key)
            if known and start >= at:
                self.out += [data[at:start], f'<a href="/documents/{known}" data-document="{known}">{data[start:end]}</a>']
                at = end
        self.out.append(data[at:])

    def handle_entityref(self, name):
        self.out.append(f"&{name};")

    def handle_charref(self, name):
        self.out.append(f"&#{name};")

    def handle_comment(self, data):
        self.out.append(f"<!--{data}-->")

    def handle_decl(self, decl):
        self.out.append(f"<!{decl}>")


# Fixed value: the form of a reference with its year.
PLAIN = re.compile(r"\b([A-Z][A-Z&]{1,12})\s+Circular(\s+Letter)?\s+(?:No\.?\s*)?(\d{1,3})\s+of\s+((?:19|20)\d{2})\b", re.I)


def plain_references(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, canonical reference) of references with their year."""
    for m in PLAIN.finditer(text):
        yield m.start(), m.end(), f"{m[1].upper()} CIRCULAR{' LETTER' if m[2] else ''} NO {int(m[3])} OF {m[4]}"


def rewritten(html: str | None, base: str, addresses: dict[str, str], references: dict[str, str]) -> str | None:
    """A page whose links to known addresses, and references in plain text, lead to documents; all else stays as it was."""
    if html is None:
        return None
    writer = _Rewriter(base, addresses, references, plain_references)
    writer.feed(html)
    writer.close()
    return "".join(writer.out)


@F.pandas_udf(T.StringType())
def _rewritten(html: pd.Series, base: pd.Series, addresses: pd.Series, references: pd.Series) -> pd.Series:
    return pd.Series([rewritten(h, b or "", dict(a or ()), dict(r or ())) for h, b, a, r in zip(html, base, addresses, references, strict=True)])


def rewrite_links(pages, addresses, references):
    """(page_id, html) of pages (page_id, url, html): links and references led to documents.

    Addresses are (address, id), references (reference, id). Only those that a
    page mentions go with it, as maps found by joins.
    """
    from lexweave.functions import references as REF
    from lexweave.functions.markup import html_links, html_text
    from lexweave.operators.links import address_key
    from lexweave.operators.retrieval import small_side

    linked = pages.select("page_id", F.explode(html_links("html", "url")).alias("l")).select("page_id", address_key(F.col("l.url")).alias("address"))
    a = linked.join(small_side(addresses, 100_000), "address").groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("address", F.col("id").cast("string")))).alias("a"))
    said = pages.select("page_id", html_text("html").alias("text")).select("page_id", F.explode(REF.mentions(F.col("text"))).alias("m")).select("page_id", REF.canonical(F.col("m")).alias("reference"))
    r = said.join(small_side(references, 100_000), "reference").groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("reference", F.col("id").cast("string")))).alias("r"))
    return pages.join(a, "page_id", "left").join(r, "page_id", "left").select("page_id", _rewritten("html", "url", "a", "r").alias("html"))
