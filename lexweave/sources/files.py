"""Kept files: names, kinds by their first bytes, texts of workbooks, workbooks and archives as bytes."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The name space of addresses, first bytes of kinds of files, and the longest cell.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"
SIGNS = {"pdf": ("25504446",), "xlsx": ("504B0304", "504B0506"), "docx": ("504B0304",), "zip": ("504B0304", "504B0506"), "xls": ("D0CF11E0",), "doc": ("D0CF11E0",)}
CELL = 32767
SCANNED_CHARS = 50


def url_uuid(url: Column) -> Column:
    """The name-based identifier (version 5) of an address, from built-in functions alone."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), F.encode(url, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def cache_name(url: Column) -> Column:
    """The file that keeps a page."""
    return F.concat(url_uuid(url), F.lit(".html"))


def cached_pages(spark: SparkSession, folder: str, urls: DataFrame) -> DataFrame:
    """(url, html): pages of ``urls`` (url) that a folder keeps; null where it does not. The folder may be in any store."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.decode("content", "UTF-8").alias("html"))
    return urls.withColumn("name", cache_name(F.col("url"))).join(files, "name", "left").select("url", "html")


def matches_kind(content: Column, kind: Column) -> Column:
    """Whether bytes begin as their kind does; kinds without a sign match anything that is not empty."""
    head = F.hex(F.substring(content, 1, 4))
    test = F.length(content) > 0
    for name, signs in SIGNS.items():
        test = F.when(F.lower(kind) == name, head.isin(*signs)).otherwise(test)
    return F.coalesce(test, F.lit(False))


def chosen_download(candidates: DataFrame) -> DataFrame:
    """(id, url, sha, archive_name): of each file's addresses (id, position, url, kind, content) the first whose bytes are of its kind."""
    good = candidates.where(matches_kind(F.col("content"), F.col("kind")))
    first = good.groupBy("id").agg(F.min_by(F.struct("url", "content"), "position").alias("c"))
    sha = F.sha2("c.content", 256)
    return candidates.select("id").distinct().join(first, "id", "left").select("id", "c.url", sha.alias("sha"), archive_name(F.col("c.url"), sha).alias("archive_name"))


def archive_name(url: Column, sha: Column) -> Column:
    """A file's name in the archive: the start of its digest, and its own name with odd characters replaced."""
    name = F.regexp_replace(F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), r"([^/]+)$", 1), r"[^A-Za-z0-9._-]+", "_")
    return F.concat(F.left(sha, F.lit(8)), F.lit("-"), F.when(name != "", name).otherwise("file"))


def extractor_of(kind: Column) -> Column:
    """Which reader a file needs: pdf, xlsx or unsupported."""
    return F.when(F.lower(kind) == "pdf", "pdf").when(F.lower(kind) == "xlsx", "xlsx").otherwise("unsupported")


def _members(data: bytes) -> zipfile.ZipFile | None:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, OSError, ValueError):
        return None


def workbook_heads(data: bytes | None) -> list[tuple[str, list[str]]] | None:
    """(sheet, cells of its first row) of a workbook; None if it can't be read."""
    book = _members(data or b"")
    if book is None:
        return None
    local = lambda tag: tag.rsplit("}", 1)[-1]
    try:
        shared = [] if "xl/sharedStrings.xml" not in book.namelist() else ["".join(t.text or "" for t in s.iter() if local(t.tag) == "t") for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        relations = {r.attrib["Id"]: r.attrib["Target"] for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        found = []
        for sheet in (s for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if local(s.tag) == "sheet"):
            target = next(relations[v] for k, v in sheet.attrib.items() if local(k) == "id")
            root = ElementTree.fromstring(book.read("xl/" + target.lstrip("/").removeprefix("xl/")))
            row = next((r for r in root.iter() if local(r.tag) == "row"), None)
            cells = []
            for cell in row if row is not None else ():
                value = "".join(t.text or "" for t in cell.iter() if local(t.tag) in ("v", "t"))
                cells.append(shared[int(value)] if cell.attrib.get("t") == "s" and value else value)
            found.append((sheet.attrib["name"], [c for c in cells if c.strip()]))
        return found
    except (KeyError, StopIteration, ValueError, IndexError, ElementTree.ParseError):
        return None


@F.pandas_udf(T.StringType())
def workbook_text(content: pd.Series) -> pd.Series:
    """Names and first rows of a workbook's sheets, a line each; null if it can't be read."""
    heads = content.map(workbook_heads)
    return heads.map(lambda h: None if h is None else "\n".join(f"{name}: {', '.join(cells)}" if cells else name for name, cells in h))


def pdf_status(pages: Column) -> Column:
    """What an array of page texts says of its file: failed without pages, scanned with hardly a character on them, else extracted."""
    chars = F.aggregate(pages, F.lit(0), lambda s, p: s + F.length(F.trim(F.coalesce(p, F.lit("")))))
    return F.when(F.coalesce(F.size(pages), F.lit(0)) <= 0, "failed").when(chars / F.size(pages) < SCANNED_CHARS, "scanned").otherwise("extracted")


def extracted(files: DataFrame, read_pdf: Callable[[Column], Column]) -> DataFrame:
    """(id, text, status) of files (id, kind, content); ``read_pdf`` gives an array of page texts, as no PDF reader is built in."""
    reader = extractor_of(F.col("kind"))
    pages = F.when(reader == "pdf", read_pdf(F.col("content")))
    rows = files.withColumn("pages", pages).withColumn("book", F.when(reader == "xlsx", workbook_text("content")))
    marked = F.array_join(F.transform("pages", lambda p, i: F.concat(F.lit("[[PAGE:"), (i + 1).cast("string"), F.lit("]]\n"), F.coalesce(p, F.lit("")))), "\n")
    status = F.when(reader == "pdf", pdf_status(F.col("pages"))).when(reader == "xlsx", F.when(F.col("book").isNull(), "failed").otherwise("extracted")).otherwise("unsupported")
    return rows.select("id", F.when(reader == "pdf", marked).otherwise(F.col("book")).alias("text"), status.alias("status"))


def cell_text(value: object) -> str:
    """A value as a cell's text: what a spreadsheet would take for a formula is quoted, what is too long is cut."""
    text = "" if value is None or value != value else str(value)
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
    return (("'" + text) if text[:1] in ("=", "+", "-", "@", "\t", "\r") else text)[:CELL]


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of text cells, as bytes; sheets are lists of rows. Equal sheets give equal bytes."""
    letters = lambda i: (letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)
    space = "http://schemas.openxmlformats.org"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        put = lambda name, body: book.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n{body}', zipfile.ZIP_DEFLATED)
        numbers = range(1, len(sheets) + 1)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in numbers)
        put("[Content_Types].xml", f'<Types xmlns="{space}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        put("_rels/.rels", f'<Relationships xmlns="{space}/package/2006/relationships"><Relationship Id="r1" Type="{space}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(name[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, name in zip(numbers, sheets, strict=True))
        put("xl/workbook.xml", f'<workbook xmlns="{space}/spreadsheetml/2006/main" xmlns:r="{space}/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{space}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{space}/package/2006/relationships">{links}</Relationships>')
        for i, rows in zip(numbers, sheets.values(), strict=True):
            lines = "".join(f'<row r="{r}">' + "".join(f'<c r="{letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(cell_text(v))}</t></is></c>' for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            put(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{space}/spreadsheetml/2006/main"><sheetData>{lines}</sheetData></worksheet>')
    return out.getvalue()


def workbooks(rows: DataFrame, key: str, sheet: str, order: str, columns: list[str]) -> DataFrame:
    """(key, workbook): a workbook for each key, with a sheet for each value of ``sheet`` and ``columns`` as its head.

    A workbook is a file for one reader, so a key's rows are bounded by what a
    sheet can hold; of more than a million rows a sheet keeps all, in further sheets.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sheets: dict[str, list[list]] = {}
        for name, part in pdf.sort_values(order, kind="stable").groupby(sheet, sort=True):
            listed = part[columns].values.tolist()
            for n, i in enumerate(range(0, max(len(listed), 1), 1_000_000)):
                sheets[str(name) if not n else f"{name} ({n + 1})"] = [columns, *listed[i : i + 1_000_000]]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "workbook": [workbook(sheets)]})

    return rows.groupBy(key).applyInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, workbook binary")


def zip_names(files: DataFrame, key: str, folder: str, name: str, order: str) -> DataFrame:
    """``files`` with ``path``: folder and name, where equal ones of a key, case aside, get " (2)" and so on before the ending."""
    nth = F.row_number().over(Window.partitionBy(key, F.lower(F.col(folder)), F.lower(F.col(name))).orderBy(order))
    stem, ending = F.regexp_replace(F.col(name), r"\.[^.]*$", ""), F.regexp_extract(F.col(name), r"(\.[^.]*)$", 1)
    return files.withColumn("_n", nth).withColumn("path", F.concat(F.col(folder), F.lit("/"), F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), ending)))).drop("_n")


def zipped(files: DataFrame, key: str, path: str, content: str) -> DataFrame:
    """(key, archive): each key's files as one ZIP archive, in order of their paths. An archive is a download, bounded by its request."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for at, body in sorted(zip(pdf[path], pdf[content], strict=True)):
                archive.writestr(zipfile.ZipInfo(at, (1980, 1, 1, 0, 0, 0)), body or b"", zipfile.ZIP_DEFLATED)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "archive": [out.getvalue()]})

    return files.groupBy(key).applyInPandas(run, f"{key} {files.schema[key].dataType.simpleString()}, archive binary")
