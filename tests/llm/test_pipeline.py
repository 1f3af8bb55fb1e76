import corpus_pipeline as c
import pytest
from marlstone.llm import queries as q
from marlstone.llm.common import materialize, table

from ..conftest import DATA, same_rows


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_oracles(spark, duck, name):
    same_rows(q.QUERIES[name](spark, DATA), duck.sql(q.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(n for n in q.QUERIES if n.startswith("op")))
def test_one_row_for_each_input(spark, name):
    rows, base = q.QUERIES[name](spark, DATA).count(), {"op1": "pages", "op5": "pages", "op7": "pages"}.get(name.split("_")[0], "documents")
    assert rows == table(spark, DATA, base).count() or name.split("_")[0] in ("op9", "op11", "op12") and rows > 0


@pytest.fixture
def folder(spark, tmp_path, prose):
    """Documents with one planted case for every stage, and labels and benchmark items."""
    item = prose(900, 20)
    docs = [(k, prose(k, 60) + ("\nRead our newsletter" if k < 40 else ""), "en", "s", 0) for k in range(100)]
    docs += [(200, "too short", "en", "s", 9), (201, None, "en", "s", 0), (202, "", None, None, None), (203, docs[50][1] + " tail", "en", "s", 0), (204, prose(204, 30) + " " + item, "fr", "t", 0), (None, prose(205, 30), "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_every_stage_takes_effect(spark, folder):
    docs, kept = table(spark, folder, "documents"), {}
    for name, stage in c.STAGES[:-1]:
        after = materialize(stage(spark, docs, folder), name)
        assert after.columns == docs.columns
        docs = after
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    clean = set(range(100))
    assert kept["quality_rules"] == clean | {203, 204, None} == kept["line_dedup"]
    assert kept["near_duplicates"] == clean | {204, None} and kept["decontamination"] == clean | {None}
    assert docs.where("text like '%newsletter%'").count() == 0
    last = c.STAGES[-1][1](spark, docs, folder)
    assert last.where("round_trip").count() == 101 and last.where("n_tokens = size(ids)").count() == 101


def test_run_and_empty_corpus(spark, folder, tmp_path):
    assert c.run(spark, folder).count() == 101
    empty = table(spark, folder, "documents").limit(0)
    empty.write.parquet(f"{tmp_path}/e/documents.parquet")
    for t in ("labels", "benchmark"):
        table(spark, folder, t).write.parquet(f"{tmp_path}/e/{t}.parquet")
    assert c.run(spark, f"{tmp_path}/e").count() == 0


def test_stage_list():
    assert [n for n, _ in c.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "bpe_tokens"] and c.ORACLE_SQL is None


def test_null_and_repeated_ids_are_judged_by_their_text(spark, folder, tmp_path, prose):
    item = " ".join(prose(900, 20).split())
    rows = [(None, prose(300, 40) + " " + item, "en", "s", 0), (None, prose(50, 60) + " tail", "en", "s", 0), (50, prose(301, 30), "en", "s", 0)]
    docs = table(spark, folder, "documents").unionAll(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    docs.write.parquet(f"{tmp_path}/n/documents.parquet")
    for t in ("labels", "benchmark"):
        table(spark, folder, t).write.parquet(f"{tmp_path}/n/{t}.parquet")
    got = [r.doc_id for r in c.run(spark, f"{tmp_path}/n").collect()]
    # the null-id leak and the null-id copy of document 50 go, its namesake stays
    assert len(got) == 102 and got.count(None) == 1 and got.count(50) == 2
