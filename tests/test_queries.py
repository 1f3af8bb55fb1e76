"""Every registered query of the engine against its SQL statement, or for rows where SQL has none."""

import pytest
from marlstone import catalog

from .conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, duck, name):
    same_rows(catalog.QUERIES[name](spark, DATA), duck.sql(catalog.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["id", "context_id", "score", "match_type", "content"]


def test_entry_returns_whole_contents(spark):
    import __spark_entry__ as e

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    rows = e.entry(spark).collect()
    assert rows and all(r.content == texts[r.context_id] for r in rows) and any(len(r.content) > 40 for r in rows)
