"""Queries over pages of known layouts, layout items, files and exports.

The pages table has no such layouts, so a page's markup is written by rule
from its number alone; the SQL says what it holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import layouts
from lexweave.operators import blocks as B
from lexweave.plans.relational import Tables
from lexweave.session import table
from lexweave.sources import files as FI

BASE = "https://www.example.org/laws-regulations/manual"


def _each(n: Column, item: Callable[[Column], Column]) -> Column:
    """The texts of items 1 to ``n``, one after the other."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), item), "\n")).otherwise("")


def _s(x: Column) -> Column:
    return x.cast("string")


def _pages(spark: SparkSession, sf_dir: str, html: Callable[[Column], Column]) -> DataFrame:
    p = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", html(p).alias("html"))


def _read(frame: DataFrame, layout, schema) -> DataFrame:
    found = layouts.records(layout, schema)(F.col("html"), F.lit(BASE))
    return frame.select("page_id", F.explode(found).alias("r")).select("page_id", "r.*")


def _circular_page(p: Column) -> Column:
    box = lambda i: F.concat(
        F.lit('<div class="publication-box-new x"><h4><a href="/circulars/c-'), _s(p), F.lit("-"), _s(i), F.lit('#top">Title &amp; '), _s(i), F.lit("</a></h4>"),
        F.when(i % 3 != 0, F.concat(F.lit('<p class="mb-3 date">BPRD  Circular No. '), _s(i), F.lit(" of "), _s(p % 10 + 2010), F.lit("</p>"))).otherwise(F.lit('<p class="mb-3 date">FE Notice</p>')),
        F.lit('<p class="date">Jan '), _s(i), F.lit(', 2024 | <span class="dept">'), F.when(i % 2 == 0, "Payments").otherwise(""), F.lit('</span><span class="cat">C</span> | <span class="type">T</span></p></div>'),
    )
    return F.concat(F.lit("<html><body><div>x</div>"), _each(p % 4, box), F.lit('<div class="publication-box-new"><h4>no link</h4></div><input id="total_all_records" value="'), _s(p), F.lit('">'), F.when(p % 5 == 0, F.concat(F.lit('<ul class="pagination-custom" data-total-pages="'), _s(p % 7), F.lit('"></ul>'))).otherwise(""))


def circular_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _read(_pages(spark, sf_dir, _circular_page), layouts.circular_listing, layouts.CIRCULARS)
    return found.select("page_id", "title", "url", "reference", F.col("date").alias("day"), "department", "category", "doc_type", "year")


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir, _circular_page).select("page_id", layouts.page_count("html").cast("long").alias("pages"))


def oldest_on_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest day that a page lists, at which a crawl may stop."""
    found = _read(_pages(spark, sf_dir, _circular_page), layouts.circular_listing, layouts.CIRCULARS)
    return found.groupBy("page_id").agg(F.min(F.try_to_date("date", "MMM d, yyyy")).cast("string").alias("oldest"))


def law_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = lambda p: lambda i: F.concat(
        F.lit('<tr class="law-row" data-title="Law '), _s(i), F.lit(' – of  '), _s(p), F.lit('" data-type="'), F.get(F.array(F.lit("Laws"), F.lit("Guidelines"), F.lit("Other Things")), (i % 3).cast("int")),
        F.lit('" data-date="'), F.when(i % 2 == 0, "2024-05-01").otherwise("soon"), F.lit('"><td><a href="#x">i</a><a href="/laws-regulations/law-'), _s(i), F.lit('">View</a></td></tr>'),
    )
    frame = _pages(spark, sf_dir, lambda p: F.concat(F.lit("<table>"), _each(p % 4, row(p)), F.lit("</table>")))
    return _read(frame, layouts.law_listing, layouts.LAWS).withColumn("position", F.col("position").cast("long"))


def series_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = lambda i: F.concat(F.lit('<tr><td><div class="data-row-wrapper"><h6>Series '), _s(i), F.lit('</h6><span class="pill-badge">Monthly</span>'), F.when(i % 2 == 0, '<span class="pill-badge">May 2024</span>').otherwise(""), F.when(i % 3 != 0, F.concat(F.lit('<a href="/assets/s'), _s(i), F.lit('.XLSX">d</a>'))).otherwise(""), F.when(i % 3 == 1, F.concat(F.lit('<a href="/economic-data/s'), _s(i), F.lit('">s</a>'))).otherwise(""), F.lit("</div></td></tr>"))
    frame = _pages(spark, sf_dir, lambda p: F.concat(F.lit('<h2 class="sector-heading">Sector '), _s(p % 3), F.lit('</h2><h5 class="primary-color">Category</h5><table class="economic-data-table"><tr><td><div class="data-row-wrapper"><h6>ab</h6></div></td></tr>'), _each(p % 5, row), F.lit("</table>")))
    return _read(frame, layouts.series_index, layouts.SERIES).withColumn("position", F.col("position").cast("long"))


def news_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to eight cards of each kind, with the circular that an address means."""
    card = lambda p: lambda i: F.concat(F.lit('<div class="news-card"><a href="/circulars/c-'), _s(p * 10 + i), F.when(i % 4 == 0, "-u.pdf").otherwise(""), F.lit('"><p class="date">May '), _s(i), F.lit('</p><p class="title">'), F.when(i % 5 == 0, "Urdu news").when(i % 2 == 0, "Press Release").otherwise("Note"), F.lit(" "), _s(i), F.lit("</p></a></div>"))
    frame = _pages(spark, sf_dir, lambda p: F.concat(F.lit('<div class="news-card"><a href="/out">outside</a></div><section class="what-new">'), _each(p % 20, card(p)), F.lit("</section>")))
    found = _read(frame, layouts.news_cards, layouts.NEWS).withColumn("kind", F.when(F.lower("title").startswith("press"), "press").otherwise("other"))
    from lexweave.operators.relational import numbered

    first = numbered(found, ["page_id", "kind"], [F.asc("position")], "nth", 8)
    known = table(spark, sf_dir, "documents").select(F.concat(F.lit("https://www.example.org/circulars/c-"), _s(F.col("doc_id"))).alias("url"), "doc_id")
    return first.join(known, "url", "left").select("page_id", "kind", F.col("nth").cast("long").alias("nth"), "title", F.col("date").alias("day"), "doc_id")


def attachment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = lambda i: F.concat(F.lit('<a href="'), F.get(F.array(F.lit("/a/F%20"), F.lit("Annex-"), F.lit("{Site}/x"), F.lit("/b/f%20"), F.lit("/c/page"), F.lit("/u/z")), (i % 6).cast("int")), F.when(i % 6 == 4, "").when(i % 6 == 5, "-U.pdf").otherwise(F.concat(_s(F.floor(i / 6)), F.lit(".PDF#p"))), F.lit('">f</a>'))
    frame = _pages(spark, sf_dir, lambda p: F.concat(F.when(p % 2 == 0, '<input id="automationPathHolder" value="/bprd/2020/">').otherwise(""), _each(p % 13, link)))
    return _read(frame, layouts.attachments, layouts.ATTACHMENTS).withColumn("position", F.col("position").cast("long"))


def container_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that a container's page lists in a table, of which the first column is the key."""
    row = lambda i: F.concat(F.lit("<tr><td>"), F.when(i % 4 == 0, "-").otherwise(_s(i)), F.lit('</td><td><a href="/assets/p'), _s(F.when(i == 5, F.lit(1)).otherwise(i)), F.lit('.pdf">Subject of '), F.when(i == 3, "").otherwise(_s(i)), F.lit("</a></td></tr>"))
    frame = _pages(spark, sf_dir, lambda p: F.concat(F.lit('<body><nav><a href="/laws-regulations/other">nav</a></nav><div class="border-box"><h3>Appendices</h3><table><tr><th>'), F.when(p % 2 == 0, "Chapters").otherwise("Sr. No."), F.lit("</th><th>Subject</th></tr>"), _each(p % 7, row), F.lit("</table></div></body>")))
    return _read(frame, layouts.parts_of_page, layouts.PARTS).withColumn("position", F.col("position").cast("long"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    html = F.when(p % 3 == 0, F.concat(F.lit("<title>T</title><h2>Head "), _s(p), F.lit("</h2>"))).when(p % 3 == 1, "<title>Only  title</title>").otherwise("<p>none</p>")
    return table(spark, sf_dir, "pages").select("page_id", layouts.title_of(html, F.concat(F.lit("https://x.y/a/some-page_"), _s(p), F.lit("/?q"))).alias("title"))


def rewritten_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that link every second circular and name another in their text."""
    t = Tables(spark, sf_dir)
    p = F.col("page_id")
    html = F.concat(F.lit("<!DOCTYPE html><p>See &amp; <A class=x href='/circulars/C-"), _s(p), F.lit("/#a'>EPD Circular No. 3 of 2010</A>, EPD Circular No. "), _s(p % 9), F.lit(" of 2010.<br/></p><!-- c -->"))
    pages = t.pages.select("page_id", F.lit(BASE).alias("url"), html.alias("html"))
    addresses = t.documents.where("doc_id % 2 = 0").select(F.concat(F.lit("https://www.example.org/circulars/c-"), _s(F.col("doc_id"))).alias("address"), F.col("doc_id").alias("id"))
    known = t.documents.where("doc_id < 5").select(F.concat(F.lit("EPD CIRCULAR NO "), _s(F.col("doc_id")), F.lit(" OF 2010")).alias("reference"), (F.col("doc_id") + 700).alias("id"))
    return layouts.rewrite_links(pages, addresses, known).select("page_id", F.md5("html").alias("html_md5"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as layout items: a head every third turn, lists, tables, a form, and texts."""
    t = table(spark, sf_dir, "conversations")
    k = F.col("turn")
    kind = F.when(k % 6 == 0, "heading").when(k % 6 == 1, "list").when(k % 6 == 2, "list").when(k % 6 == 3, "table").when(k % 6 == 4, "form").otherwise("text")
    text = F.when(k % 6 == 0, F.concat(F.lit("Scope "), _s(k))).otherwise(F.concat(F.lit("Banks shall report "), _s(k)))
    return t.select(F.col("conv_id").alias("doc"), k.alias("position"), kind.alias("kind"), F.lit(1).alias("level"), text.alias("text"), (k + 1).cast("int").alias("page"), F.concat(F.lit("("), _s(k), F.lit(")")).alias("marker"), F.when(k % 6 == 1, 10.0).otherwise(40.0).alias("indent"))


def reference_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.reference_units(_items(spark, sf_dir))
    return found.select("doc", F.col("unit").cast("long").alias("unit"), "ref", "kind", F.col("words").cast("long").alias("words"))


def analysis_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.analysis_blocks(B.reference_units(_items(spark, sf_dir)))
    return found.select("doc", F.col("block").cast("long").alias("block"), "kind", F.size("refs").cast("long").alias("units"), F.col("words").cast("long").alias("words"), F.md5("text").alias("text_md5"))


def paragraph_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as paragraphs, in windows of up to 2,000 characters."""
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(B.windows(text, 2000)).alias("n", "window"))
    return found.select("doc_id", F.col("n").cast("long").alias("n"), F.length("window").cast("long").alias("chars"))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's first turn as a circular, its other turns as attachments by name."""
    t = table(spark, sf_dir, "conversations")
    body = t.where("turn = 0").select(F.col("conv_id").alias("id"), F.when(F.col("conv_id") % 5 != 0, F.col("text")).alias("text"))
    files = t.where("turn > 0").select(F.col("conv_id").alias("owner"), F.col("turn").alias("attachment_id"), F.concat(F.when(F.col("turn") % 2 == 0, "b").otherwise("A"), _s(F.col("turn"))).alias("filename"), "text")
    return B.document_texts(body, files).select("owner", "position", "source_id", "kind")


def cache_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of kept pages; equal addresses have one."""
    rows = table(spark, sf_dir, "pages").select("page_id", FI.cache_name(F.col("url")).alias("name"))
    return rows.select("page_id", F.length("name").cast("long").alias("n"), F.substring("name", 15, 1).alias("version"), F.substring("name", 20, 1).isin("8", "9", "a", "b").alias("variant"), F.right("name", F.lit(5)).alias("ending"))


def _files(t: Tables) -> DataFrame:
    """Documents as files whose first bytes follow from their number."""
    d = F.col("doc_id")
    head = F.get(F.array(F.lit("25504446"), F.lit("504B0304"), F.lit("D0CF11E0"), F.lit("3C68746D")), (d % 4).cast("int"))
    kind = F.get(F.array(F.lit("pdf"), F.lit("xlsx"), F.lit("PDF")), (d % 3).cast("int"))
    return t.documents.select(d.alias("id"), kind.alias("kind"), F.concat(F.unhex(head), F.encode("text", "UTF-8")).alias("content"))


def sniffed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(Tables(spark, sf_dir)).select("id", FI.matches_kind(F.col("content"), F.col("kind")).alias("good"), FI.extractor_of(F.col("kind")).alias("reader"))


def chosen_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two addresses of a file the first whose bytes are right, with its name in the archive."""
    f = _files(Tables(spark, sf_dir))
    first = f.select((F.col("id") - F.col("id") % 2).alias("id"), (F.col("id") % 2).alias("position"), F.concat(F.lit("https://x.y/d/File "), _s(F.col("id")), F.lit(".pdf?q")).alias("url"), F.lit("pdf").alias("kind"), "content")
    found = FI.chosen_download(first)
    return found.select("id", "url", F.regexp_replace("archive_name", "^[0-9a-f]{8}", "h").alias("archive_name"))


def extracted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files through a reader that takes the lines of a text as its pages."""
    pages = lambda content: F.split(F.decode(F.substring(content, 5, 2**31 - 1), "UTF-8"), "\n")
    f = _files(Tables(spark, sf_dir))
    return FI.extracted(f, pages).select("id", "status", F.md5("text").alias("text_md5"))


def workbook_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation as a workbook, and what a reader finds in its sheets' first rows."""
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", F.concat(F.lit("Sheet "), _s(F.col("s_suppkey") % 2)).alias("sheet"), "s_suppkey", F.col("s_name").alias("=name"))
    books = FI.workbooks(rows, "s_nationkey", "sheet", "s_suppkey", ["s_suppkey", "=name"])
    return books.select("s_nationkey", FI.workbook_text("workbook").alias("heads"))


def zip_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit("files").alias("folder"), F.concat(F.when(F.col("doc_id") % 2 == 0, "Annex").otherwise("annex"), _s(F.col("doc_id") % 3), F.lit(".pdf")).alias("name"))
    return FI.zip_names(rows, "source", "folder", "name", "doc_id").select("doc_id", "path")


def zipped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of each source's documents: how many bytes begin as an archive does."""
    rows = FI.zip_names(table(spark, sf_dir, "documents").select("source", "doc_id", F.lit("t").alias("folder"), F.lit("x.txt").alias("name"), F.encode("text", "UTF-8").alias("content")), "source", "folder", "name", "doc_id")
    return FI.zipped(rows, "source", "path", "content").select("source", F.hex(F.substring("archive", 1, 4)).alias("head"))


QUERIES = {
    f.__name__: f
    for f in (
        circular_listing, listing_pages, oldest_on_page, law_listing, series_index, news_cards, attachment_links, container_parts, page_titles, rewritten_links, reference_units, analysis_blocks, paragraph_windows, document_texts, cache_names,
        sniffed_files, chosen_downloads, extracted_files, workbook_round_trip, zip_paths, zipped_files,
    )
}

ORIGIN = "https://www.example.org"
N = "(SELECT page_id, unnest(range(1, page_id % {0} + 1)) AS i FROM pages)"
LISTED = f"""SELECT page_id, i, 'Title & ' || i AS title, '{ORIGIN}/circulars/c-' || page_id || '-' || i AS url, CASE WHEN i % 3 <> 0 THEN 'BPRD Circular No. ' || i || ' of ' || (page_id % 10 + 2010) ELSE 'FE Notice' END AS reference,
'Jan ' || i || ', 2024' AS day, CASE WHEN i % 2 = 0 THEN 'Payments' WHEN i % 3 <> 0 THEN 'BPRD' ELSE 'FE' END AS department, 'C' AS category, 'T' AS doc_type, CASE WHEN i % 3 <> 0 THEN (page_id % 10 + 2010)::VARCHAR ELSE '2024' END AS year FROM {N.format(4)}"""
# Six turns of a conversation open a section: its head, two levels of a list, a table, a form and a text.
UNITS = """SELECT conv_id AS doc, turn, turn // 6 AS part, 'Section Scope ' || (turn - turn % 6) AS head, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS unit, 4 AS words, CASE turn % 6 WHEN 3 THEN 'table' WHEN 4 THEN 'form' ELSE 'text' END AS kind,
'Section Scope ' || (turn - turn % 6) || ' > ' || CASE turn % 6 WHEN 1 THEN 'Para (' || turn || ')' WHEN 2 THEN 'Para (' || (turn - 1) || ') > Sub-para (' || turn || ')' WHEN 3 THEN 'Table ' || (turn // 6 + 1) WHEN 4 THEN 'Form' ELSE 'Para 1' END AS ref FROM conversations WHERE turn % 6 <> 0"""
ORACLE = {
    "circular_listing": f"SELECT page_id, title, url, reference, day, department, category, doc_type, year FROM ({LISTED})",
    "listing_pages": "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN greatest(1, page_id % 7) ELSE greatest(1, CAST(ceil(page_id / 30.0) AS BIGINT)) END AS pages FROM pages",
    "oldest_on_page": "SELECT page_id, '2024-01-01' AS oldest FROM pages WHERE page_id % 4 > 0",
    "law_listing": f"SELECT page_id, 'Law ' || i || ' - of ' || page_id AS title, ['law', 'guideline', 'other things'][i % 3 + 1] AS doc_type, '{ORIGIN}/laws-regulations/law-' || i AS url, CASE WHEN i % 2 = 0 THEN '2024-05-01' END AS listed, i - 1 AS position FROM {N.format(4)}",
    "series_index": f"""SELECT page_id, 'Sector ' || (page_id % 3) AS section, 'Category' AS category, 'Series ' || i AS title, CASE i % 3 WHEN 1 THEN '{ORIGIN}/economic-data/s' || i WHEN 2 THEN '{ORIGIN}/assets/s' || i || '.XLSX' END AS url, 'Monthly' AS frequency, CASE WHEN i % 2 = 0 THEN 'May 2024' END AS updated,
CASE WHEN i % 3 <> 0 THEN '{ORIGIN}/assets/s' || i || '.XLSX' END AS document_url, CASE WHEN i % 3 <> 0 THEN 'xlsx' END AS document_type, i - 1 AS position FROM {N.format(5)}""",
    "news_cards": f"""WITH c AS (SELECT page_id, i, CASE WHEN i % 2 = 0 THEN 'press' ELSE 'other' END AS kind, CASE WHEN i % 2 = 0 THEN 'Press Release ' ELSE 'Note ' END || i AS title, 'May ' || i AS day FROM {N.format(20)} WHERE i % 4 <> 0 AND i % 5 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, kind ORDER BY i) AS nth FROM c) SELECT page_id, kind, nth, title, day, doc_id FROM r LEFT JOIN documents ON doc_id = page_id * 10 + i WHERE nth <= 8""",
    "attachment_links": f"""WITH l AS (SELECT page_id, i, i // 6 AS k, CASE i % 6 WHEN 0 THEN '{ORIGIN}/a/F%20' || (i // 6) || '.PDF' WHEN 3 THEN '{ORIGIN}/b/f%20' || (i // 6) || '.PDF' ELSE '{ORIGIN}/assets/documents/' || CASE WHEN page_id % 2 = 0 THEN 'bprd/2020/' ELSE '' END || 'Annex-' || (i // 6) || '.PDF' END AS url,
CASE i % 6 WHEN 0 THEN 'F ' || (i // 6) || '.PDF' WHEN 3 THEN 'f ' || (i // 6) || '.PDF' ELSE 'Annex-' || (i // 6) || '.PDF' END AS filename FROM {N.format(13)} WHERE i % 6 IN (0, 1, 3)),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(filename) ORDER BY i) AS r FROM l)
SELECT page_id, url, filename, 'pdf' AS file_type, CASE WHEN page_id % 2 = 0 AND i % 6 = 1 THEN '{ORIGIN}/assets/documents/' || filename || '#p' END AS fallback_url, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS position FROM f WHERE r = 1""",
    "container_parts": f"""SELECT page_id, CASE WHEN i % 4 <> 0 THEN i::VARCHAR END AS part_key, CASE WHEN i % 4 = 0 THEN 'Subject of ' || i WHEN page_id % 2 = 0 THEN 'Chapter ' || i ELSE 'Appendix ' || i END AS part_label, CASE WHEN i = 3 THEN 'Subject of' ELSE 'Subject of ' || i END AS title,
'{ORIGIN}/assets/p' || i || '.pdf' AS url, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS position FROM {N.format(7)} WHERE i <> 5""",
    "page_titles": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Head ' || page_id WHEN 1 THEN 'Only title' ELSE 'some page ' || page_id END AS title FROM pages",
    "rewritten_links": """SELECT page_id, md5('<!DOCTYPE html><p>See &amp; ' || CASE WHEN page_id % 2 = 0 AND page_id IN (SELECT doc_id FROM documents) THEN '<a href="/documents/' || page_id || '" data-document="' || page_id || '">' ELSE '<A class=x href=''/circulars/C-' || page_id || '/#a''>' END || 'EPD Circular No. 3 of 2010</a>, '
|| CASE WHEN page_id % 9 < 5 THEN '<a href="/documents/' || (page_id % 9 + 700) || '" data-document="' || (page_id % 9 + 700) || '">EPD Circular No. ' || (page_id % 9) || ' of 2010</a>' ELSE 'EPD Circular No. ' || (page_id % 9) || ' of 2010' END || '.<br/></p><!-- c -->') AS html_md5 FROM pages""",
    "reference_units": f"SELECT doc, unit, ref, kind, words FROM ({UNITS})",
    "analysis_blocks": f"""WITH u AS ({UNITS}), b AS (SELECT *, CASE WHEN kind <> 'text' OR turn % 6 = 5 OR turn % 6 = 1 THEN 1 ELSE 0 END AS fresh FROM u),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc ORDER BY turn) AS block FROM b)
SELECT doc, block, CASE WHEN bool_or(kind = 'form') THEN 'form' WHEN bool_or(kind = 'table') THEN 'table' ELSE 'regulation' END AS kind, count(*) AS units, sum(words) AS words,
md5(string_agg('[SOURCE_ID: ' || doc || ':' || unit || ']' || chr(10) || 'Reference: ' || ref || chr(10) || 'Page: ' || (turn + 1) || chr(10) || 'Banks shall report ' || turn, chr(10) || chr(10) ORDER BY turn)) AS text_md5 FROM g GROUP BY doc, block""",
    "paragraph_windows": """WITH RECURSIVE p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, length(x) AS c FROM (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE trim(x, ' ') <> ''),
r AS (SELECT doc_id, n, 0::BIGINT AS w, c AS size, c AS chars FROM p WHERE n = 1
  UNION ALL SELECT p.doc_id, p.n, CASE WHEN r.size + p.c > 2000 THEN r.w + 1 ELSE r.w END, CASE WHEN r.size + p.c > 2000 THEN p.c ELSE r.size + p.c END, CASE WHEN r.size + p.c > 2000 THEN p.c ELSE r.chars + 2 + p.c END FROM r JOIN p ON p.doc_id = r.doc_id AND p.n = r.n + 1)
SELECT doc_id, w AS n, max(chars) AS chars FROM r GROUP BY 1, 2""",
    "document_texts": """SELECT owner, row_number() OVER (PARTITION BY owner ORDER BY part, name, source_id) - 1 AS position, source_id, kind FROM (
SELECT conv_id AS owner, CASE WHEN turn = 0 THEN 0 ELSE 1 END AS part, CASE WHEN turn = 0 THEN '' WHEN turn % 2 = 0 THEN 'b' || turn ELSE 'a' || turn END AS name, CASE WHEN turn = 0 THEN conv_id ELSE turn END::VARCHAR AS source_id, CASE WHEN turn = 0 THEN 'circular' ELSE 'attachment' END AS kind FROM conversations WHERE trim(text) <> '' AND (turn > 0 OR conv_id % 5 <> 0))""",
    "cache_names": "SELECT page_id, 41 AS n, '5' AS version, true AS variant, '.html' AS ending FROM pages",
    "sniffed_files": "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 1 THEN doc_id % 4 = 1 ELSE doc_id % 4 = 0 END AS good, CASE WHEN doc_id % 3 = 1 THEN 'xlsx' ELSE 'pdf' END AS reader FROM documents",
    "chosen_downloads": "SELECT doc_id - doc_id % 2 AS id, min(CASE WHEN doc_id % 4 = 0 THEN 'https://x.y/d/File ' || doc_id || '.pdf?q' END) AS url, min(CASE WHEN doc_id % 4 = 0 THEN 'h-File_' || doc_id || '.pdf' END) AS archive_name FROM documents GROUP BY 1",
    "extracted_files": """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents),
c AS (SELECT doc_id, ps, list_sum(list_transform(ps, lambda x: length(trim(x, ' '))))::DOUBLE / len(ps) AS mean FROM p)
SELECT doc_id AS id, CASE WHEN doc_id % 3 = 1 THEN 'failed' WHEN mean < 50 THEN 'scanned' ELSE 'extracted' END AS status, CASE WHEN doc_id % 3 <> 1 THEN md5(array_to_string(list_transform(ps, lambda x, i: '[[PAGE:' || i || ']]' || chr(10) || x), chr(10))) END AS text_md5 FROM c""",
    "workbook_round_trip": "SELECT s_nationkey, string_agg(DISTINCT 'Sheet ' || (s_suppkey % 2) || ': s_suppkey, ''=name', chr(10) ORDER BY 'Sheet ' || (s_suppkey % 2) || ': s_suppkey, ''=name') AS heads FROM supplier GROUP BY 1",
    "zip_paths": "SELECT doc_id, 'files/' || CASE WHEN doc_id % 2 = 0 THEN 'Annex' ELSE 'annex' END || (doc_id % 3) || CASE WHEN r > 1 THEN ' (' || r || ')' ELSE '' END || '.pdf' AS path FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, doc_id % 3 ORDER BY doc_id) AS r FROM documents)",
    "zipped_files": "SELECT DISTINCT source, '504B0304' AS head FROM documents",
}
