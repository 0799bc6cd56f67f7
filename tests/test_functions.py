"""Functions and operators of the library on small fixtures."""

from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexweave.functions import citations, dates, layouts, markup, references, titles
from lexweave.functions import text as X
from lexweave.operators import blocks, folds, graph, retrieval
from lexweave.sources import listing, sinks
from lexweave.streaming import jobs


def one(spark, column, **values):
    schema = ", ".join(f"{name} string" for name in values) if all(v is None or isinstance(v, str) for v in values.values()) else list(values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, X.tokens(F.col("t")), t="The U.S.A. and Foo-bar é_x 8 08") == ["usa", "foo", "bar", "é_x", "08"]
    assert one(spark, X.tokens(F.col("t")), t="") == []
    assert one(spark, X.padded_numbers(F.array(F.lit("8"), F.lit("08"), F.lit("x"), F.lit("100"))), t="") == ["8", "08", "08", "8", "x", "100"]


@pytest.mark.parametrize(("n", "want"), [(0, 0), (1, 1), (130, 1), (131, 2), (230, 2), (231, 3), (1000, 10)])
def test_chunks(spark, n, want):
    words = " ".join(f"w{i}" for i in range(n))
    got = one(spark, X.chunks(X.blank_split(F.col("t")), 130, 30), t=words)
    assert len(got) == want and one(spark, X.chunk_count(F.size(X.blank_split(F.col("t"))), 130, 30), t=words) == want
    if want > 1:
        assert got[1][0] == "w100" and got[-1][-1] == f"w{n - 1}"


def test_text_pieces(spark):
    assert one(spark, X.clip(F.col("t"), 3, "…"), t="abcdef") == "abc…"
    assert one(spark, X.highlight(F.col("t"), ["bank"]), t="Banking on a bank") == "<mark>Banking</mark> on a <mark>bank</mark>"
    assert one(spark, X.excerpt(F.col("t"), ["zeta"], 10), t="alpha beta gamma zeta omega") == "amma zeta "
    assert one(spark, X.url_canonical(F.col("t")), t=" http://A.b/C/?q#f") == "https://a.b/c"
    assert one(spark, X.slug(F.col("t")), t="--Mixed  Case & more!") == "Mixed-Case-more"
    assert one(spark, X.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))), t="") == pytest.approx(1 / 3)
    assert one(spark, references.canonical_reference(F.col("t")), t="see AC & MFD circular letter no. 05 of 2024") == "AC&MFD CIRCULAR LETTER NO 5 OF 2024"
    assert one(spark, references.canonical_reference(F.col("t")), t="none") is None
    assert one(spark, X.places(F.col("t"), "an"), t="banana an") == [2, 4, 8]


def test_references(spark):
    text = "BPRD Circulars; EPD Circular No. 20, 21 and 22 dated November 03, 2011 and BC & CPD Circular Letter No. 5 of 2009; Banking Supervision Department Circular 7"
    found = one(spark, F.transform(references.mentions(F.col("t")), lambda m: F.struct(m["at"], references.canonical(m).alias("c"))), t=text)
    assert [r.c for r in found] == ["EPD CIRCULAR NO 20 OF 2011", "EPD CIRCULAR NO 21 OF 2011", "EPD CIRCULAR NO 22 OF 2011", "BC&CPD CIRCULAR LETTER NO 5 OF 2009", "BSD CIRCULAR NO 7"]
    assert [r.at for r in found] == [text.index("EPD")] * 3 + [text.index("BC & CPD"), text.index("Banking")]
    assert one(spark, references.mentions(F.col("t")), t=None) == []
    context = "As told in DMMD Circular No. 20 dated 3rd March, 2012, banks shall"
    year = lambda t: one(spark, references.year_in_context(F.col("t"), F.lit(context)), t=t)
    assert [year("DMMD Circular no. 20"), year("DMMD Circular No. 20 of 2001"), year("DMMD Circular No. 20 (1999)"), year("DMMD Circular No. 9")] == [2012, 2001, 1999, None]
    assert one(spark, references.focused_query(F.col("t")), t="what does BPRD Circular No. 5 of 2024 say on capital") == "what does say on capital"
    assert one(spark, references.focused_query(F.col("t")), t="BPRD Circular No. 5 of 2024") == "BPRD Circular No. 5 of 2024"
    typed = one(spark, references.typed(F.col("t")), t="bprd cir let 08 2018, BSD1 circular 4")
    assert [tuple(r) for r in typed] == [("BPRD", "letter", 8, 2018), ("BSD1", "plain", 4, None)]


@pytest.mark.parametrize(
    ("text", "want"),
    [("3rd March 2020", date(2020, 3, 3)), ("applicable from January 1, 2026", date(2026, 1, 1)), ("on December 2019", date(2019, 12, 1)), ("30 February 2021", date(2021, 2, 1)), ("", None), (None, None), ("in May 2020 and 7 June 2021", date(2021, 6, 7)), ("15-March-2027", date(2027, 3, 15))],
)
def test_dates(spark, text, want):
    assert one(spark, dates.find_date(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    ("title", "name", "version"),
    [
        ("Rules for Payments (Updated till July 16, 2026)", "Rules for Payments", "Updated till July 16, 2026"),
        ("Rules for Payments, updated till October 07, 2024", "Rules for Payments", "updated till October 07, 2024"),
        ("Rules for Payments (as of August 03, 2016)", "Rules for Payments", "as of August 03, 2016"),
        ("Ordinance 1962 ( being updated )", "Ordinance 1962", "being updated"),
        ("Rules - effective from 2020 (Updated)", "Rules", "Updated"),
        ("Survey of Investment (FIS)", "Survey of Investment (FIS)", None),
        ("Some Bank Act, 1956", "Some Bank Act, 1956", None),
        ("Cards – Credit / Debit", "Cards - Credit/Debit", None),
        ("Guide - Money and Finance", "Guide - Money and Finance", None),
        (None, "", None),
    ],
)
def test_titles(spark, title, name, version):
    assert tuple(one(spark, titles.split_title(F.col("t")), t=title)) == (name, version)


def test_title_dates_names_and_nouns(spark):
    day = lambda t: one(spark, titles.effective_from(F.col("t")), t=t)
    assert [day("R (to be applicable from January 1, 2026)"), day("R (effective from July 2026)"), day("R (Updated till July 16, 2026)"), day("R")] == [date(2026, 1, 1), date(2026, 7, 1), None, None]
    nouns = {"CHAPTERS": "Chapter", "Chapter No.": "Chapter", "Appendices": "Appendix", "Annexures": "Annexure", "policies": "Policie", "process": "Process", "Sr. No.": None, "": None}
    assert {w: one(spark, titles.part_noun(F.col("t")), t=w) for w in nouns} == nouns
    assert {w: layouts.singular(w) for w in nouns} == nouns
    names = lambda t: one(spark, titles.identifying_names(F.col("t")), t=t)
    assert [names("Foreign Exchange Manual"), names("Reporting Guide"), names("A B C D")] == [["foreign exchange manual", "fe manual"], [], ["a b c d"]]
    label = lambda *c: one(spark, titles.law_label(*[F.lit(x).cast("string") for x in c]), t="")
    assert [label("Manual", "Chapter 1", "Exports"), label(None, "Chapter 1", "Exports"), label("Manual", None, "Exports")] == ["Manual - Chapter 1: Exports", "Exports", "Exports"]


def test_markup():
    page = "<html><nav>menu</nav><h1>T</h1><p>a <b>b</b><script>x</script><br>c &amp; d</p><a href='/x#y'>X</a><a href='/x'>again</a><a href='#z'>z</a><table><tr><td>1</td><th>2</th></tr></table></html>"
    assert markup.text_of(page).startswith("T\na b\nc & d") and "menu" not in markup.text_of(page)
    assert markup.links_of(page, "https://a.b/c") == [{"url": "https://a.b/x", "label": "X"}]
    assert markup.read(page).tables == [[["1", "2"]]]
    assert markup.text_of(None) == "" and markup.links_of("<a href='http://[bad'>", "") == []
    assert [markup.route_link(u, "a.b") for u in (None, "https://x.y/z", "https://w.a.b/f.PDF", "/circulars/1", "/laws-regulations/q", "/other")] == ["unknown", "external", "document", "circular", "subpage", "unknown"]


ID = "1dcf1c84-0f3a-4b7e-9a55-0123456789ab"


def offered():
    handles = citations.Handles()
    handles.mint("circular", "id-1", "BPRD Circular Letter No. 01 of 2021")
    handles.mint("law", "id-2", "Foreign Exchange Manual")
    handles.mint("circular", "id-3", "BPRD Circular Letter No. 01 of 2021")
    return handles


def test_citation_slugs(spark):
    cases = [
        ("circular", "BPRD Circular Letter No. 01 of 2021", "BPRD-CL-01-2021"), ("circular", "SH&SFD Circular No. 4 of 2026", "SHSFD-C-4-2026"), ("attachment", "CL8-Annex_A-_Form.xlsx", "CL8-Annex-A-Form"),
        ("law", "Rules of the Road", "Rules-of-the-Road"), ("law", "!!", "doc"), ("law", " ".join(["manual"] * 12) + " EXPORTS", "-".join(["manual"] * 7) + "-EXPORTS"), ("law", "x" * 70, "x" * 56),
    ]
    for kind, label, want in cases:
        assert one(spark, citations.slug(F.col("t"), F.lit(kind)), t=label) == want == citations.python_slug(label, kind)
    rows = spark.createDataFrame([(1, 1, "law", "Some Act"), (1, 2, "law", "some act"), (2, 1, "law", "Some Act")], "turn long, position long, kind string, label string")
    assert sorted(r.slug for r in citations.minted(rows, "turn").collect()) == ["Some-Act", "Some-Act", "some-act-2"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("See [[c:BPRD-CL-01-2021]].", "See [[circular:id-1|BPRD Circular Letter No. 01 of 2021]]."),
        ("[[ C : bprd-cl-01-2021-2 | wrong ]]", "[[circular:id-3|BPRD Circular Letter No. 01 of 2021]]"),
        ("Under [[c:BPRD-C-99-2099]] as amended.", "Under BPRD-C-99-2099 as amended."),
        ("Per [[circular:nobody|Some Circular]] it is.", "Per Some Circular it is."),
        ("By [[law:id-2|FE Manual]].", "By [[law:id-2|FE Manual]]."),
        ("Banks report [[circular:1dc2c et al]] monthly.", "Banks report monthly."),
        ("Banks report ([[circular:1dc2c et al]]) monthly.", "Banks report monthly."),
        (f"Circular {ID} applies, ({ID}) too.", "Circular applies, too."),
        ("The [[ see annexure ]] lists  two [x] [[", "The [[ see annexure ]] lists  two [x] [["),
        (None, ""),
    ],
)
def test_citations_expand(text, want):
    assert offered().expand(text) == want
    for width in (1, 2, 3, 7, 50):
        stream = citations.StreamExpander(offered())
        assert "".join(stream.feed((text or "")[i : i + width]) for i in range(0, len(text or ""), width)) + stream.close() == want


def test_citations_replay_and_drops():
    handles = offered()
    text = f"See [[circular:id-9|EPD Circular No. 2 of 2020]] and {ID} here"
    assert handles.replayed(text) == "See [[c:EPD-C-2-2020]] and here" == handles.replayed(handles.replayed(text))
    handles.expand("[[l:nothing]] [[law:zz|Z]]")
    assert [k for _, k in handles.fresh_drops()] == ["l:nothing", "law:zz"] and handles.fresh_drops() == []


def test_stream_operator_keeps_state(spark, tmp_path):
    spark.createDataFrame([(1, 0, "x [[l:some-"), (1, 1, "act]] y"), (1, 2, None), (2, 0, "[[l:Some-Act]]"), (2, 1, None)], "session long, position long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session long, position long, text string").parquet(str(tmp_path / "in"))
    rows = jobs.drain(jobs.expand_stream(stream, [("law", "id-1", "Some Act")])).orderBy("session", "position").collect()
    assert ["".join(r.text for r in rows if r.session == k) for k in (1, 2)] == ["x [[law:id-1|Some Act]] y", "[[law:id-1|Some Act]]"] and rows[0].text == "x"


def test_incremental_index_replaces(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "two")], "k long, v long, t string").write.parquet(path)
    stream = spark.readStream.schema("k long, v long, t string").parquet(path)
    assert sorted(map(tuple, jobs.incremental(stream, "k", "v").collect())) == [(1, 2, "new"), (2, 1, "two")]
    jobs.replace_by_key(str(tmp_path / "out"), "k", "v")(spark.read.parquet(path), 0)
    jobs.replace_by_key(str(tmp_path / "out"), "k", "v")(spark.createDataFrame([(2, 2, "later")], "k long, v long, t string"), 1)
    kept = jobs.compacted(spark, str(tmp_path / "out"), "k", str(tmp_path / "small"), spark.createDataFrame([(1,)], "k long"))
    assert [tuple(r) for r in kept.collect()] == [(2, 2, "later")] and spark.read.parquet(str(tmp_path / "small")).count() == 1


def test_graph(spark):
    edges = spark.createDataFrame([(2, 1, "amends"), (3, 2, "adds_to"), (4, 1, "amends"), (1, 3, "amends"), (9, 8, "clarifies"), (7, None, "amends")], "source_id long, target_id long, kind string")
    seeds = spark.createDataFrame([(2,), (9,)], "seed long")
    assert sorted(map(tuple, graph.chain(edges, seeds).collect())) == [(2, 1), (2, 2), (2, 3), (2, 4), (9, 9)]
    fork = spark.createDataFrame([(3, 1, "amends"), (4, 1, "adds_to"), (4, 9, "amends"), (5, 9, "amends")], "source_id long, target_id long, kind string")
    chains = graph.chain(fork, spark.createDataFrame([(3,), (7,)], "seed long"))
    assert sorted(r.node for r in chains.collect() if r.seed == 3) == [1, 3, 4]
    days = spark.createDataFrame([(1, 5), (3, 2), (4, None), (7, 1)], "id long, day int")
    assert sorted((r.position, r.node, r.base) for r in graph.chain_members(chains, days).collect()) == [(0, 4, 4), (1, 3, 4), (2, 1, 4)]
    assert sorted(map(tuple, graph.neighbourhood(edges, seeds, 1).where("seed = 9").collect())) == [(9, 8, 1), (9, 9, 0)]
    nodes = spark.createDataFrame([(1,), (8,), (5,)], "id long")
    assert dict(graph.status_rollup(nodes, edges).collect()) == {1: "amended", 8: "amended", 5: "active"}
    wanted = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", 9), (5, "a", None)], "source_id long, reference string, target_id long")
    known = spark.createDataFrame([(5, "a"), (6, "b"), (7, "b")], "id long, reference string")
    assert {(r.source_id, r.target_id) for r in graph.resolve(wanted, known).collect()} == {(1, 5), (2, None), (3, 9), (5, None)}


def test_folds(spark):
    changes = spark.createDataFrame(
        [(1, 0, "s0", "add", "r1", "a"), (1, 0, "s0", "add", "r2", "b"), (1, 1, "s1", "modify", "r1", "a2"), (1, 1, "s1", "add", "r3", "c"), (1, 2, "s2", "modify", "r3", "c2"), (1, 2, "s2", "remove", "r2", None), (1, 3, "s3", "modify", "r2", "x"), (1, 3, "s3", "add", "r4", None), (1, 3, "s3", "remove", "r9", None)],
        "chain long, position long, source string, action string, req_id string, requirement string",
    )
    got = {r.req_id: (r.requirement, r.status, r.origin, r.history) for r in folds.consolidate(changes).collect()}
    assert got == {"r1": ("a2", "modified", "s0", 2), "r2": ("b", "removed", "s0", 2), "r3": ("c2", "added", "s1", 2)}
    rows = spark.createDataFrame([(1, 1, 50), (1, 2, 60), (1, 3, 40), (1, 4, 20)], "g long, o long, n long")
    assert [r.o for r in folds.greedy_budget(rows, "g", "o", "n", 100).orderBy("o").collect()] == [1, 3]
    assert one(spark, blocks.dehyphenated(F.split("t", ",")), t="regu-,lation,A-,B") == ["regulation", "A-", "B"]


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "money laundering rules for banks"), (2, "cash reserve requirement"), (3, "laundering money elsewhere"), (4, ""), (5, "x1 y1"), (6, "x2 y2"), (7, "x3 y3")], "doc_id long, text string")
    asked = spark.createDataFrame([(9, "money laundering")], "q long, text string")
    best = retrieval.bm25(docs, retrieval.query_terms(asked, "q", "text"), "q", "doc_id", 5).orderBy("rank").collect()
    assert [r.doc_id for r in best] == [3, 1]
    phrases = asked.select("q", F.col("text").alias("phrase_text"))
    assert [tuple(r) for r in retrieval.phrase_matches(docs, phrases, "doc_id", "q").collect()] == [(9, 1)]
    posts = retrieval.asked_postings(docs.withColumn("title", F.lit("cash")), retrieval.query_terms(asked, "q", "text").unionByName(asked.select("q", F.lit("cash").alias("term"), F.lit(1).cast("long").alias("qtf"))), "doc_id", {"title": 5.0, "text": 1.0})
    weighted = {(r.doc_id, r.term): r.tf for r in posts.collect()}
    assert weighted[2, "cash"] == 6.0 and weighted[1, "cash"] == 5.0
    assert one(spark, retrieval.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), t="") == 0.0


def test_query_sets_of_any_size_meet_all_vectors(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    few = sorted(map(tuple, retrieval.cosine_top_k(vectors, asked, 3).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 1)
    assert sorted(map(tuple, retrieval.cosine_top_k(vectors, asked, 3).collect())) == few and len(few) == 12


def test_listing_source_and_merge(spark):
    day = datetime(2024, 1, 1)
    spark.dataSource.register(listing.listing_source(lambda n: [(f"id{n}", f"u{n}", "t", day.replace(day=n + 1)), ("id0", "u0", "t", day)], "pages_of_test"))
    listed = spark.read.format("pages_of_test").option("pages", 3).load()
    stored = spark.createDataFrame([("id1",)], "id string")
    assert [r.id for r in listing.new_rows(listed, stored).collect()] == ["id2", "id0"]
    assert [r.id for r in listing.new_rows(listed, stored, day).collect()] == ["id2"]
    assert listing.availability(listed.distinct(), stored).first().status == "new_available"
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, v string, w string")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", None)], "k long, v string, w string")
    assert sorted(map(tuple, listing.merge(old, new, "k").collect())) == [(1, "a", "x"), (2, "b", "z"), (3, "c", None)]
    assert [r.k for r in listing.changed(old, new, "k", ["v", "w"]).collect()] == [2]


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(1, "=SUM(A1)"), (2, "plain"), (3, None)], "id long, v string")
    assert [r.v for r in frame.select("id", sinks.cell(F.col("v")).alias("v")).orderBy("id").collect()] == ["'=SUM(A1)", "plain", ""]
    sinks.write_csv(frame, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    names = spark.createDataFrame([(1, "a.pdf"), (2, "A.pdf"), (3, "b")], "id long, name string")
    assert {r.id: r.name for r in sinks.unique_names(names, "name", "id").collect()} == {1: "a.pdf", 2: "A-2.pdf", 3: "b"}
    assert one(spark, sinks.safe_filename(F.col("t")), t="../a b?.txt") == "a_b_.txt"


def test_written_tables_are_shared_and_discarded(spark):
    from lexweave import session

    frame = session.settled(spark.range(3))
    assert frame.count() == 3 and session.shared_root(spark) == session.shared_root(spark)
    path = session._WRITTEN[-1]
    session.discard(spark)
    assert not session._WRITTEN and not Path(path.removeprefix("file://")).exists()


def test_tools_check_their_arguments(spark):
    from lexweave.operators.tools import ToolError, Tools

    circulars = spark.createDataFrame([(1, "Capital rules", "EPD Circular No. 1 of 2010", "EPD", date(2010, 1, 1), "minimum capital of banks"), (2, "Cash", "EPD Circular No. 2 of 2011", "BSD", date(2011, 1, 1), "cash reserve")], "id long, title string, reference string, department string, day date, body string")
    edges = spark.createDataFrame([(2, 1, "amends")], "source_id long, target_id long, kind string")
    values = spark.createDataFrame([("CAR", "banks", date(2010, 1, 1))], "metric string, subject string, day date")
    tools = Tools(circulars, edges, values)
    first = lambda name, **given: [r[0] for r in tools.call(name, given).collect()]
    assert first("find_reference", reference="EPD Circular 2") == [2] and first("amendment_chain", id=2) == [1, 2] and first("related_circulars", id=1) == [2]
    assert [r.id for r in tools.call("search_circulars", {"query": "cash reserve", "department": "bsd"}).collect()] == [2]
    assert first("find_values", metric="car") == ["CAR"] and first("list_departments") == ["BSD", "EPD"] and first("get_circular", id=1) == [1]
    for name, given in (("none", {}), ("get_circular", {}), ("get_circular", {"id": "1"}), ("get_circular", {"id": 1, "x": 2})):
        with pytest.raises(ToolError):
            tools.call(name, given)


def test_requests_terms_and_fields():
    from lexweave.operators import inventory as I

    assert I.Request("capital").checked().band == 150
    for bad in ({"query": " "}, {"query": "a", "sources": ()}, {"query": "a", "sources": ("x",)}, {"query": "a", "band": -1}, {"query": "a", "candidates": 0}, {"query": "a", "results": 0}, {"query": "a", "evidence": 6}):
        with pytest.raises(I.InvalidRequest):
            I.Request(**bad).checked()
    terms, warned = I.build_terms("call centre", ["of the", "Call Centre"], lambda q: {"found": ["contact center", "CALL CENTRE", "", 3, "a b c d e f g"]})
    assert terms == {"verbatim": ["call centre"], "caller": ["Call Centre"], "generated": ["contact center"]} and warned == []
    assert I.build_terms("x", None, lambda q: 1 / 0)[1] and I.field_of_kind({"a": [1], "b": [2]}, "terms", list) is None


def test_every_department_by_its_full_name(spark):
    from lexweave.functions import references

    assert len(references.DEPARTMENTS) == 21
    for name, code in references.DEPARTMENTS.items():
        rows = spark.createDataFrame([(f"see {name.title()} Circular No. 5 of 2020, and {name} circular letter 7",)], "t string")
        found = rows.select(F.transform(references.mentions(F.col("t")), references.canonical).alias("c")).first().c
        assert found == [f"{code} CIRCULAR NO 5 OF 2020", f"{code} CIRCULAR LETTER NO 7"], name


def test_maxima_of_groups_for_many_queries(spark, monkeypatch):
    import numpy as np

    from lexweave.operators import retrieval as R

    dealt = np.random.default_rng(3)
    x = dealt.normal(size=(60, 5))
    vectors = spark.createDataFrame([(i, i % 4, [float(v) for v in row]) for i, row in enumerate(x)] + [(60, 1, None), (61, 2, [0.0] * 5)], "vec_id long, label int, embedding array<double>")
    asked = vectors.where("vec_id < 25").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    few = {g: sorted(map(tuple, R.best_per_group(vectors, asked, g).collect())) for g in ("label", "vec_id")}
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    assert dict((r[:2], r[2]) for r in few["label"])[(3, 0)] == round(float((unit[::4] @ unit[3]).max()), 6)
    monkeypatch.setattr(R, "BROADCAST_QUERIES", 7)
    assert {g: sorted(map(tuple, R.best_per_group(vectors, asked, g).collect())) for g in ("label", "vec_id")} == few


def test_a_prefix_budget_of_a_hot_group(spark):
    rows = [("hot", i, 1 + i % 3) for i in range(5000)] + [("small", 1, 4), ("small", 2, 90), ("none", 1, 99), (None, 1, 5), (None, 2, 0), (None, 3, 60)]
    frame = spark.createDataFrame(rows, "source string, doc_id long, tokens long").repartition(5)
    got = folds.prefix_budget(frame, "source", "doc_id", "tokens", 50)
    assert got.columns == ["source", "doc_id", "tokens"]
    want, taken, ended = [], {}, set()
    for source, i, n in rows:
        taken[source] = taken.get(source, 0) + n
        if taken[source] > 50:
            ended.add(source)
        if source not in ended:
            want.append((source, i, n))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
