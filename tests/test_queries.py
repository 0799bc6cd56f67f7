"""Every registered query of the library against DuckDB on the smallest tables."""

import duckdb
import pytest

from lexweave.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return found


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str([plain(v) for v in value]) if isinstance(value, (list, tuple)) else str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, oracle, name):
    frame = registry.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    answer = oracle.execute(registry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in answer.fetchall())


def test_registry_and_entry(spark):
    import __spark_entry__

    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_else_imports_the_training_data_operators():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for path in (root / "lexweave").rglob("*.py"):
        if "llm" not in path.parts:
            assert "lexweave.llm" not in path.read_text(), path
