"""Queries on tables that showed differences from their SQL, or costs that grew too fast."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexweave.plans import registry

PASSAGES = ["alpha beta gamma delta epsilon", "one two three four five", "red green blue white black", "north south east west middle", "spring summer autumn winter season"]


def equal(spark, folder, name):
    """The query's rows, after they were compared with those of its SQL over the folder's tables."""
    found = duckdb.connect()
    for path in folder.glob("*.parquet"):
        found.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    frame = registry.queries()[name](spark, str(folder))
    columns = sorted(frame.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in frame.collect())
    answer = found.execute(registry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert got == sorted(tuple(str(row[names.index(c)]) for c in columns) for row in answer.fetchall())
    return got


def documents(folder, rows):
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]}), folder / "documents.parquet")


@pytest.mark.parametrize("name", ["reextraction", "reindex_preview", "reference_targets"])
def test_ids_past_a_hundred_thousand(spark, tmp_path, name):
    documents(tmp_path, [(i + far, f"Text {i} of it") for i in range(200) for far in (0, 13500, 100000, 999990)])
    assert equal(spark, tmp_path, name)


def test_a_chapter_counts_for_the_law_it_is_cited_of_alone(spark, tmp_path):
    pq.write_table(pa.table({"item_id": pa.array(range(5), pa.int64()), "text": PASSAGES}), tmp_path / "benchmark.parquet")
    documents(tmp_path, [(i, f"Some words before {PASSAGES[i % 2 * 4]}") for i in range(120)])
    got = equal(spark, tmp_path, "name_links")
    assert {"1", "2", "41", "42"} & {document for document, _ in got}


def test_subset_classes_tell_all_pairs(spark):
    from lexweave.operators import corpus as C

    lines = ["alpha beta", "beta alpha", "", "alpha", "beta gamma alpha", "alpha", None, "gamma", "alpha beta"]
    titles = spark.createDataFrame([(i, i, t) for i, t in enumerate(lines)], "id long, day long, title string")
    subjects = spark.createDataFrame([(i, i, t) for i, t in enumerate(reversed(lines))], "subject_id long, before long, subject string")
    rows = [tuple(r) for r in C.subset_classes(titles, subjects).collect()]
    of = {part: {i: c for p, i, c in rows if p == part} for part in ("title", "subject")}
    pairs = {(i, c) for p, i, c in rows if p == "pair"}
    told = {(s, t) for s, a in of["subject"].items() for t, b in of["title"].items() if t < s and (a, b) in pairs}
    words = lambda x: set((x or "").split())
    want = {(s, t) for s, x in enumerate(reversed(lines)) for t, y in enumerate(lines) if t < s and y is not None and words(x) and words(x) <= words(y)}
    assert told == want == {tuple(r) for r in C.subset_titles(titles, subjects).collect()} and len(pairs) == len(set(pairs))


def test_copies_of_titles_are_not_paired_on_the_way(spark, monkeypatch):
    """Six hundred copies match each other 180,000 times; what is written stays a few rows to a copy."""
    from lexweave.operators import corpus as C
    from lexweave.operators import subsets, supersession

    written = []
    for module in (C, subsets, supersession):
        kept = module.settled
        monkeypatch.setattr(module, "settled", lambda frame, kept=kept: (found := kept(frame), written.append(found.count()))[0])
    nodes = spark.range(600).select("id", F.col("id").alias("day"), F.lit("alpha beta gamma").alias("title"))
    flags = nodes.select(F.col("id").alias("source_id"), F.lit("alpha gamma").alias("subject"))
    edges, review = supersession.blanket(nodes, flags)
    assert edges.groupBy("source_id").count().where("count > 40").count() == 0 and review.count() == 519
    assert C.subset_classes(nodes, flags.select(F.col("source_id").alias("subject_id"), F.col("source_id").alias("before"), "subject")).count() == 1201
    assert max(written) < 5000


@pytest.mark.parametrize("where", [None, "label = 1"])
def test_vectors_without_clusters_are_found(spark, where):
    import numpy as np

    from lexweave.operators import retrieval as R
    from lexweave.operators import vector_index as V

    x = np.random.default_rng(3).normal(size=(1200, 48)).tolist()
    vectors = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    asked = vectors.where("vec_id % 8 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    exact = {tuple(r) for r in R.cosine_top_k(vectors.where(where or "true"), asked, 10).select("query_id", "vec_id").collect()}
    got = {tuple(r) for r in V.search(V.index(vectors, ["label"]), asked, 10, where).select("query_id", "vec_id").collect()}
    assert len(exact & got) >= 0.9 * len(exact) and len(got) == len(exact)


def test_an_index_is_built_without_a_shuffle_of_single_places(spark, tmp_path, monkeypatch):
    """Postings are put together within their cells; what is shuffled by term are whole blocks."""
    from pyspark.sql.readwriter import DataFrameWriter

    from lexweave.operators.kept_index import KeptIndex

    plans, write = [], DataFrameWriter.parquet

    def told(self, path, *args, **kwargs):
        plans.append((path.rsplit("/", 1)[-1], self._df._jdf.queryExecution().optimizedPlan().toString()))
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", told)
    index = KeptIndex(spark, f"file://{tmp_path}/index")
    index.upsert(spark.createDataFrame([(i, "alpha beta alpha " + "gamma " * (i % 3)) for i in range(40)] + [(50, None), (51, "")], "doc_id long, text string"))
    index.upsert(spark.createDataFrame([(3, "beta delta")], "doc_id long, text string"))
    index.merge()
    blocks = [plan for name, plan in plans if name == "blocks"]
    assert len(blocks) == 3 and not any("Generate" in plan or "Aggregate" in plan for plan in blocks)
    rows = spark.read.parquet(index.log.at(index.log.manifest()["segments"][0]["blocks"])).collect()
    places = {(r["term"], e["doc"]): list(e["positions"]) for r in rows for e in r["entries"]}
    assert places["alpha", 4] == [0, 2] and places["gamma", 5] == [3, 4] and places["beta", 3] == [0] and ("alpha", 3) not in places
    assert all(r["n"] == len(r["entries"]) and r["max_tf"] == max(e["tf"] for e in r["entries"]) and r["min_length"] == min(e["length"] for e in r["entries"]) for r in rows)
    assert {(r["term"], r["df"]) for r in index.frequencies().collect()} == {("alpha", 39), ("beta", 40), ("gamma", 26), ("delta", 1)}


class Calls:
    """A state or a handle that counts what is asked of it."""

    def __init__(self, told):
        self.told, self.held = told, None

    def __getattr__(self, name):
        def call(*args):
            if name.startswith("get") and name.endswith("State"):
                return Calls(self.told)
            self.told.append(name)
            if name in ("put", "update", "appendList"):
                self.held = args[0]
            if name in ("clear", "removeKey"):
                self.held = None
            return self.held is not None if name in ("exists", "containsKey") else self.held

        return call


def test_state_calls_do_not_grow_with_a_keys_versions():
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

    from lexweave.streaming import timed

    told = []
    currency = timed._Currency("EventTime")
    currency.init(Calls(told))
    rows = iter([Row(effective_ms=1000 + i // 2, version_id=500 - i) for i in range(400)])
    assert list(currency.handleInputRows((1,), rows, TimerValues(0, 5))) == [] and len(told) < 8
    flips = list(currency.handleExpiredTimer((1,), TimerValues(0, 1100), ExpiredTimerInfo(1000)))
    assert [f.version_id for f in flips] == [499 - 2 * i for i in range(101)] and flips[5].replaced == 491 and len(told) < 16


def test_a_trace_costs_few_state_calls():
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

    from lexweave.streaming import timed

    told = []
    traces = timed._Traces(100)
    traces.init(Calls(told))
    assert list(traces.handleInputRows(("a",), iter([Row(ms=7, ends=False), Row(ms=5, ends=False)]), TimerValues(0, 0))) == []
    assert [r.state for r in traces.handleExpiredTimer(("a",), TimerValues(0, 120), ExpiredTimerInfo(107))] == ["interrupted"]
    assert list(traces.handleInputRows(("a",), iter([Row(ms=130, ends=True)]), TimerValues(0, 120))) == []
    assert list(traces.handleExpiredTimer(("a",), TimerValues(0, 300), ExpiredTimerInfo(207))) == []
    assert len(told) <= 9
