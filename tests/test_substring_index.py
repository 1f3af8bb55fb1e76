import pytest
from marlstone.operators import substring_index as X
from pyspark.sql import functions as F

ROWS = [(k, f"Customer#{k:09d}", ("Blue Whale", "red_fox 100%", None, "ÉCOLE élève", "ab")[k % 5]) for k in range(300)]
COLUMNS = ("name", "note")


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = spark.createDataFrame(ROWS, "id long, name string, note string")
    return rows, X.build(rows, COLUMNS, f"{tmp_path_factory.mktemp('grams')}/index")


@pytest.mark.parametrize("pattern", ["whale", "r#00000_01", "BLUE%hale", "red\\_fox", "100\\%", "élève", "ab", "_", "", "no such text", "mer#000000299"])
def test_equals_the_scan(indexed, pattern):
    rows, index = indexed
    scan = rows.where(F.col("name").ilike(f"%{pattern}%") | F.coalesce(F.col("note").ilike(f"%{pattern}%"), F.lit(False)))
    assert sorted(r.id for r in X.search(index, rows, COLUMNS, pattern).collect()) == sorted(r.id for r in scan.collect())


def test_few_rows_are_checked(indexed):
    rows, index = indexed
    assert X.candidates(index, rows, "mer#000000299").count() == 1 and X.candidates(index, rows, "fox").count() == 60
    assert X.candidates(index, rows, "ab").count() == 300  # no trigram: a scan


def test_trigrams_of_patterns():
    assert X.pattern_grams("abcd%EF_ghi") == ["abc", "bcd", "ghi"] and X.pattern_grams("a\\%bc\\_") == ["a%b", "%bc", "bc_"] and X.pattern_grams("ab_cd") == []
