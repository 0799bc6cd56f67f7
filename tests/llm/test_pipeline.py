"""The pipeline's stages on their own inputs, held against brute force."""

import corpus_pipeline
import pytest

from lexweave.llm import queries
from tests.llm.test_operators import brute_components, brute_lines


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_stages_return_documents(spark, documents, sf_dir):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, documents, sf_dir)
        assert found.columns == documents.columns and found.dtypes == documents.dtypes, name


def test_filters_keep_most_and_reject_no_letters(spark, documents, sf_dir):
    odd = spark.createDataFrame([(10**6, "1234 !!", "en", "src0", 7)], documents.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, documents.unionByName(odd), sf_dir).collect()}
    assert kept == {r.doc_id for r in documents.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality_filter(spark, documents, sf_dir).collect()}
    right = [(i in kept) == (q == 1) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.9


def test_lines_and_copies_equal_brute_force(spark, documents, sf_dir):
    rows = documents.orderBy("doc_id").limit(80).collect()
    part = spark.createDataFrame(rows, documents.schema)
    order = [r.doc_id for r in rows]
    want = brute_lines([r.text for r in rows])
    found = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, part, sf_dir).collect()}
    assert found == {order[i]: (t, len(t)) for i, t in want.items()}
    groups = brute_components([r.text for r in rows], corpus_pipeline.SHINGLE_WORDS)
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, part, sf_dir).collect()} == {order[i] for i, (_, c) in groups.items() if c == i}


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, component_id long"


@pytest.fixture(scope="module")
def odd(spark, documents):
    """Nulls, empty and very long texts, ties, repeated rows and columns with the operators' own names."""
    texts = [r.text for r in documents.where("lang = 'en'").orderBy("doc_id").limit(12).collect()]
    rows = [(i, t, "en", "s", len(t), 0.5, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (50, texts[0], None, None, None, None, None, None), (None, texts[1], "en", "s", 1, 0.5, "x", 1), (51, None, "en", "s", None, 0.5, "x", 1), (52, "", "en", "s", 0, 0.5, "x", 1), (53, " ".join(texts) * 40, "en", "s", 1, 0.5, "x", 1)]
    return spark.createDataFrame(rows, ODD)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_none(spark, sf_dir, odd, name, stage):
    found = stage(spark, odd, sf_dir)
    rows = found.collect()
    assert stage(spark, odd.where("false"), sf_dir).collect() == []
    if name == "best-fit packing":
        assert {r.doc_id for r in rows} == {*range(12), 50, 51, 52, 53, None}
        return
    assert found.columns == odd.columns and found.dtypes == odd.dtypes
    ids = [r.doc_id for r in rows]
    if name == "language ID":
        assert {51, 52}.isdisjoint(ids) and ids.count(0) == 3 and {*range(12), 53, None} <= set(ids)
    if name == "line dedup":
        assert len(ids) == odd.count() and next(r.text for r in rows if r.doc_id == 51) is None
    if name == "MinHash near-dedup":
        assert ids.count(0) == 3 and 50 not in ids and {51, 52, 53, None} <= set(ids)


def test_run_packs_what_is_left(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(r.offset + r.length <= 1024 for r in rows)


def test_every_operator_has_its_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.queries())
    assert numbers == list(range(1, 11)) and set(queries.oracle_sql()) <= set(queries.queries())
