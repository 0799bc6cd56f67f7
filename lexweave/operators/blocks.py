"""From layout items to units with references, and from units to blocks for analysis.

Items are rows (doc, position, kind, level, text, page, marker, indent); kind is
title, heading, text, list, table or form, or one that is left out. A document
is one group: its items are bounded by the document, never by the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.evidence import not_applicable

# Labels by depth of a list, kinds that are no content, bounds in words, and words that head a form.
MARKERS = ("Para", "Sub-para", "Clause", "Sub-clause", "Item")
LEFT_OUT = ("page_header", "page_footer", "footnote", "caption")
UNIT_WORDS, PART_WORDS, BLOCK_WORDS, INDENT = 600, 450, 1800, 12.0
FORM_WORDS = ("application", "certificate", "proforma", "questionnaire", "template", "form")
PART = re.compile(r"(annex(ure)?|appendix|schedule|chapter|part|form)\b[\s:.-]*([0-9]+|[ivxlc]+|[a-z])?\b", re.I)

UNITS = "doc long, unit long, ref string, kind string, text string, path array<string>, page int, words int"


def is_part(heading: str) -> bool:
    """Whether a heading opens a part of a document of its own, such as "Annexure A"."""
    return bool(PART.match(heading.strip())) and len(heading.split()) <= 8


def reference(path: list[str], markers: list[str] | None = None, terminal: str | None = None) -> str:
    """Where something stands: its headings, its place in lists, and what it is, joined by " > "."""
    parts, sections = [], 0
    for heading in path:
        if is_part(heading):
            parts.append(heading)
            continue
        label = "Subsection" if sections else "Section"
        sections += 1
        parts.append(heading if heading.lower().startswith(label.lower()) else f"{label} {heading}")
    parts += [f"{MARKERS[i] if i < len(MARKERS) else 'Sub-item'} {m}" for i, m in enumerate(markers or [])]
    return " > ".join([*parts, terminal] if terminal else parts)


class Outline:
    """The headings and lists that are open at an item."""

    def __init__(self) -> None:
        self.headings: dict[int, str] = {}
        self.lists: list[tuple[float, str]] = []

    def path(self) -> list[str]:
        return [self.headings[k] for k in sorted(self.headings)]

    def open(self, text: str, level: int) -> None:
        """A heading closes all headings of its level and deeper, and all lists."""
        self.headings = {k: v for k, v in self.headings.items() if k < level} | {level: text}
        self.lists.clear()

    def marker(self, marker: str, indent: float | None) -> list[str]:
        """The markers from the outermost list to this item; depth is told by the indent."""
        if indent is None:
            return [marker]
        while self.lists and indent < self.lists[-1][0] - INDENT:
            self.lists.pop()
        if self.lists and indent <= self.lists[-1][0] + INDENT:
            self.lists.pop()
        self.lists.append((indent, marker))
        return [m for _, m in self.lists]


def units_of(items: Iterator[tuple]) -> Iterator[tuple]:
    """(ref, kind, text, path, page) of the items of one document in order."""
    outline, counts, tables, seen = Outline(), {}, 0, {}

    def once(ref: str) -> str:
        seen[ref] = seen.get(ref, 0) + 1
        return ref if seen[ref] == 1 else f"{ref} (occurrence {seen[ref]})"

    for kind, level, text, page, marker, indent in items:
        text = (text or "").strip()
        if kind in ("title", "heading") or (kind == "text" and text and is_part(text)):
            if text:
                numbered = re.match(r"(?:\d+(?:\.\d+)*|[A-Za-z]|[ivxlcdm]+)[.)]\s", text, re.I)
                outline.open(text, 0 if kind == "title" or is_part(text) else 1 if numbered else max(1, int(level or 1)))
            continue
        if kind in LEFT_OUT or not re.search(r"[^\W_]", text):
            continue
        path = outline.path()
        if kind == "form":
            ref = reference(path, terminal="Form")
        elif kind == "table":
            tables += 1
            ref = reference(path, terminal=f"Table {tables}")
        elif kind == "list" and marker:
            ref = reference(path, outline.marker(marker, indent))
        else:
            counts[tuple(path)] = counts.get(tuple(path), 0) + 1
            ref = reference(path, terminal=f"Para {counts[tuple(path)]}")
        ref = once(ref)
        words = text.split()
        if len(words) <= UNIT_WORDS or kind in ("form", "table"):
            yield ref, kind if kind in ("form", "table") else "text", text, path, page
            continue
        for n, i in enumerate(range(0, len(words), PART_WORDS), 1):
            yield f"{ref} (part {n})", "text", " ".join(words[i : i + PART_WORDS]), path, page


def reference_units(items: DataFrame) -> DataFrame:
    """The rows of ``UNITS``: each content item with its reference; what exceeds ``UNIT_WORDS`` words in parts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("position", kind="stable")
        blank = lambda x: None if x is None or x != x else x
        values = (tuple(blank(v) for v in r) for r in rows[["kind", "level", "text", "page", "marker", "indent"]].itertuples(index=False))
        out = [(int(pdf["doc"].iloc[0]), n, ref, kind, text, path, None if page is None else int(page), len(text.split())) for n, (ref, kind, text, path, page) in enumerate(units_of(values))]
        found = pd.DataFrame(out, columns=[f.split()[0] for f in UNITS.split(", ")])
        return found.astype({"page": "Int32", "words": "int32"})

    return items.groupBy("doc").applyInPandas(run, UNITS)


def analysis_blocks(units: DataFrame) -> DataFrame:
    """(doc, block, kind, path, refs, text, words, page_start, page_end): sections as blocks of up to ``BLOCK_WORDS`` words.

    A form or a table is a block of its own; a text goes on a block while
    document, headings (or page, without any) and room allow. Blocks of texts
    that all need no judgement go. A unit over the bound is a block alone.
    """
    ordered = units.withColumn("idle", not_applicable(F.col("text")).isNotNull())
    item = F.struct("unit", "ref", "kind", "text", "path", "page", "words", "idle")
    listed = ordered.groupBy("doc").agg(F.sort_array(F.collect_list(item)).alias("units"))
    atom = lambda u: u["kind"].isin("form", "table")
    place = lambda u: F.when(F.size(u["path"]) == 0, F.coalesce(u["page"], F.lit(-1)))

    def step(state: Column, u: Column) -> Column:
        """The number of the block that a unit falls in, and how many words it has by then."""
        fresh = state["last"].isNull() | atom(u) | atom(state["last"]) | ~u["path"].eqNullSafe(state["last"]["path"]) | ~place(u).eqNullSafe(place(state["last"])) | (state["words"] + u["words"] > BLOCK_WORDS)
        number = state["n"] + fresh.cast("int")
        return F.struct(number.alias("n"), F.when(fresh, u["words"]).otherwise(state["words"] + u["words"]).alias("words"), u.alias("last"), F.concat(state["out"], F.array(number)).alias("out"))

    # The units' own type, null, before the first.
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"), F.get(F.col("units"), F.lit(-1)).alias("last"), F.array().cast("array<int>").alias("out"))
    numbered = listed.select("doc", "units", F.aggregate("units", start, step, lambda s: s["out"]).alias("block"))
    rows = numbered.select("doc", F.explode(F.arrays_zip("units", "block")).alias("z")).select("doc", F.col("z.block").alias("block"), "z.units.*")
    grouped = rows.groupBy("doc", "block").agg(F.sort_array(F.collect_list(F.struct("unit", "ref", "kind", "text", "page", "words"))).alias("us"), F.first("path").alias("path"), F.every("idle").alias("idle"), F.max("kind").alias("kind"), F.sum("words").alias("words"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    kept = grouped.where(F.col("kind").isin("form", "table") | ~F.col("idle"))
    return kept.select("doc", "block", block_kind(F.col("us"), F.col("path")).alias("kind"), "path", F.transform("us", lambda u: u["ref"]).alias("refs"), block_text(F.col("doc"), F.col("us")).alias("text"), "words", "page_start", "page_end")


def block_kind(units: Column, path: Column) -> Column:
    """form, table or regulation: by its units, its headings, or two places to fill in."""
    head = F.lower(F.array_join(path, " "))
    body = F.array_join(F.transform(units, lambda u: u["text"]), " ")
    blanks = F.size(F.regexp_extract_all(body, F.lit(r"(?i)_{3,}|(?:\\_){3,}|<[^>]+>|\b20xx\b"), F.lit(0)))
    is_kind = lambda k: F.exists(units, lambda u: u["kind"] == k)
    named = head.rlike(r"\b(" + "|".join(FORM_WORDS) + r")\b")
    return F.when(is_kind("form") | named | (blanks >= 2), F.lit("form")).when(is_kind("table"), F.lit("table")).otherwise("regulation")


def block_text(doc: Column, units: Column) -> Column:
    """The units of a block under their sources, references and pages."""
    one = lambda u: F.concat(F.lit("[SOURCE_ID: "), doc.cast("string"), F.lit(":"), u["unit"].cast("string"), F.lit("]\nReference: "), u["ref"], F.lit("\nPage: "), F.coalesce(u["page"].cast("string"), F.lit("HTML")), F.lit("\n"), u["text"])
    return F.array_join(F.transform(units, one), "\n\n")


def windows(text: Column, limit: int) -> Column:
    """A text in as few windows as fit whole paragraphs up to ``limit`` characters; a longer paragraph is one alone."""
    paragraphs = F.filter(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n"), lambda p: F.trim(p) != "")
    text_array = F.array().cast("array<string>")
    start = F.struct(text_array.alias("done"), text_array.alias("open"), F.lit(0).alias("size"))
    shut = lambda s: F.concat(s["done"], F.when(F.size(s["open"]) > 0, F.array(F.array_join(s["open"], "\n\n"))).otherwise(text_array))

    def step(s: Column, p: Column) -> Column:
        full = (F.size(s["open"]) > 0) & (s["size"] + F.length(p) > limit)
        return F.struct(F.when(full, shut(s)).otherwise(s["done"]).alias("done"), F.when(full, F.array(p)).otherwise(F.concat(s["open"], F.array(p))).alias("open"), F.when(full, F.length(p)).otherwise(s["size"] + F.length(p)).alias("size"))

    found = F.aggregate(paragraphs, start, step, shut)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.coalesce(text, F.lit(""))))


def dehyphenated(lines: Column) -> Column:
    """An array of lines where a line that ends in a hyphen is joined to the next if that begins in lower case."""
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"(?U)-\n(?=\p{Ll})", "")
    return F.when(F.size(lines) > 0, F.split(joined, "\n")).otherwise(lines)


def document_texts(circulars: DataFrame, attachments: DataFrame) -> DataFrame:
    """(owner, position, source_id, kind, text): a circular's body, then its attachments by file name; blank texts go."""
    body = circulars.select(F.col("id").alias("owner"), F.lit(0).alias("part"), F.lit("").alias("name"), F.col("id").cast("string").alias("source_id"), F.lit("circular").alias("kind"), "text")
    files = attachments.select("owner", F.lit(1).alias("part"), F.lower("filename").alias("name"), F.col("attachment_id").cast("string").alias("source_id"), F.lit("attachment").alias("kind"), "text")
    rows = body.unionByName(files).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("owner").orderBy("part", "name", "source_id")) - 1
    return rows.withColumn("position", at.cast("long")).select("owner", "position", "source_id", "kind", "text")
