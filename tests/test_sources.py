"""CSV files whose rows or headers don't fit: nothing vanishes."""

import pytest
from compare import rows
from pyspark.errors import PySparkException

from areaspark import session
from areaspark.queries import load
from areaspark.sources import readers, sinks


@pytest.fixture
def csv(tmp_path):
    def make(*texts):
        folder = tmp_path / "in"
        folder.mkdir()
        for k, text in enumerate(texts):
            (folder / f"{k}.csv").write_text(text)
        return str(folder)

    return make


TWO = "a int, b int"


def test_rows_that_fit(spark, csv):
    path = csv("a,b\n1,2\n,4\n", "a,b\n5,6\n")
    assert rows(readers.csv_typed(spark, path, TWO)) == [(1, 2), (5, 6), (None, 4)]
    assert rows(readers.csv_typed(spark, path, "skip_x string, n int", ["a", "b"])) == [(2,), (4,), (6,)]


@pytest.mark.parametrize("text", ["b,a\n1,2\n", "a,c\n1,2\n", "a,b,c\n1,2,3\n"])
def test_another_header_stops_the_read(spark, csv, text):
    path = csv(text)
    with pytest.raises(Exception, match="(?i)header"):
        readers.csv_typed(spark, path, TWO).collect()


@pytest.mark.parametrize("bad", ["x,3", "4,5,6", "7", "8,9.5"])
def test_a_row_that_does_not_fit_stops_the_read(spark, csv, bad):
    path = csv(f"a,b\n1,2\n{bad}\n")
    with pytest.raises(PySparkException, match=bad):
        readers.csv_typed(spark, path, TWO).collect()
    # also where only the other column is asked for
    with pytest.raises(PySparkException, match=bad):
        readers.csv_typed(spark, path, TWO).select("b").collect()


def test_quarantine_holds_every_row_that_does_not_fit(spark, csv, tmp_path):
    path = csv("b,a\n1,2\nx,3\n4,5,6\n", "b,a\n7\n8,9\n")
    good, bad = readers.csv_quarantine(spark, path, TWO, lambda df: session.keep(df, "csv"), ["b", "a"])
    assert good.columns == ["a", "b"] and rows(good) == [(1, 2), (8, 9)]
    assert sinks.write_bad_rows(bad, str(tmp_path / "bad")) == 3
    held = spark.read.parquet(str(tmp_path / "bad"))
    assert sorted((r["value"], r["file"][-5:]) for r in held.collect()) == [("4,5,6", "0.csv"), ("7", "1.csv"), ("x,3", "0.csv")]


def test_any_header(spark, csv):
    path = csv("u,v\n1,2\n")
    assert rows(readers.csv_typed(spark, path, TWO, any_header=True)) == [(1, 2)]


def test_inferred_rows_of_another_length(spark, csv):
    path = csv("a,b\n1,x\n2,y,z\n")
    with pytest.raises(PySparkException, match="2,y,z"):
        readers.csv_inferred(spark, path).collect()


def test_names_of_the_wrong_number(spark, csv):
    with pytest.raises(ValueError):
        readers.csv_typed(spark, csv("a,b\n"), TWO, ["a"])


def test_every_listed_code_and_department_is_compared(spark):
    """flag_condition and exception_codes are compared on each value of the fixed lists."""
    from areaspark.plans import cohorts
    from areaspark.queries.registry import Tables

    load.queries()
    t = Tables(spark, "/root/testdata/sf0.001")
    seen = {r[0] for r in t.px_encounter.select("disch_icd_1").distinct().collect()}
    assert {*cohorts.ASTHMA_CODES, *cohorts.DIABETES_CODES, *cohorts.MENTAL_HEALTH_PREFIXES, None} <= seen
    assert {*cohorts.MENTAL_HEALTH_DEPARTMENTS} <= {r[0] for r in t.px_encounter.select("department_id").distinct().collect()}
    codes = {r[0] for r in t.px_dx_code.select("code").collect()}
    assert {*cohorts.EXCEPTION_CODES, *cohorts.EXCEPTION_PREFIXES, "D57.1", "D57.3"} <= codes
    assert len(load.queries()["flag_condition"](spark, "/root/testdata/sf0.001").where("Asthma = 1").limit(1).collect()) == 1
