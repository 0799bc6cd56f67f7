"""Checks on what models and parsers give."""

import pytest
from pyspark.sql import functions as F

from lexweave.operators import validation as V


def test_entities(spark):
    rows = spark.createDataFrame([("ratio", "CRR", "5.5%"), ("ratio", "CRR", "none"), ("rumour", "x", "1"), ("deadline", "Filing", "2024-05-06"), ("requirement", " ", "x"), ("fee", "Fee", "Rs 1,000")], "entity_type string, metric string, value_text string")
    got = {(r.entity_type, r.value_numeric, str(r.effective_date)) for r in V.clean_entities(rows).collect()}
    assert got == {("ratio", 5.5, "None"), ("deadline", 2024.0, "2024-05-06"), ("fee", 1000.0, "None")}


def test_items_and_relations(spark):
    items = spark.createDataFrame([(1, "a", ["b1", "b2", "zz"]), (2, "b", ["zz"])], "item_id long, text string, citations array<string>")
    blocks = spark.createDataFrame([("b1", 3), ("b2", 1)], "block_id string, page int")
    assert [(r.item_id, r.cited, r.page_start, r.page_end) for r in V.valid_items(items, blocks).collect()] == [(1, ["b1", "b2"], 1, 3)]
    edges = spark.createDataFrame([(1, 2, "amends", 0.5), (1, 2, "amends", 0.9), (1, 1, "amends", 1.0), (1, 9, "amends", 1.0), (2, 1, "loves", 1.0)], "source_id long, target_id long, kind string, confidence double")
    good = V.valid_relations(edges, spark.createDataFrame([(1,), (2,)], "id long"))
    assert [(r.source_id, r.target_id, r.confidence) for r in good.collect()] == [(1, 2, 0.9)]
    anchors = spark.createDataFrame([(1, 2), (1, 3), (3, 3), (1, 3)], "source_id long, target_id long")
    assert sorted((r.source_id, r.target_id, r.kind) for r in V.harvested(good, anchors).collect()) == [(1, 2, "amends"), (1, 3, "clarifies")]


def test_pages(spark):
    pages = spark.createDataFrame([(1, p, f"Head of ALL\n\nSection {p}\nbody {chr(96 + p)} regu-\nlation\nlast {p}\nPage {p} of 4") for p in range(1, 5)] + [(2, 1, "Head of all\nx\n3"), (3, 1, None)], "doc long, page long, text string")
    got = {(r.doc, r.page): r.text for r in V.clean_pages(pages).collect()}
    assert got[1, 2] == "Section 2\nbody b regulation\nlast 2" and got[2, 1] == "Head of all\nx" and got[3, 1] == ""


def test_attachments(spark):
    got = spark.range(1).select(V.attachment_info(F.lit("https://a.b/c/File.PDF?x=1")).alias("x")).first().x
    assert tuple(got) == ("File.PDF", "pdf")
