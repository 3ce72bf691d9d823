"""What travels through the joins and sums of the final dataset and the hospital benchmarks."""

import re

from compare import rows
from pyspark.sql import functions as F

from areaspark import session
from areaspark.functions import text
from areaspark.plans import catalog, cohorts, statistics, survey, themes
from areaspark.queries import indicators, people
from areaspark.queries.registry import Tables

FOLDER = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString().split("\n")


def test_survey_rows_are_summed_before_they_count_in_four_geographies(spark, monkeypatch):
    monkeypatch.setattr(session, "keep", lambda df, name: df)
    t = Tables(spark, FOLDER)
    indicators.read_once(t)
    plan = optimized(t.kept("statistics", lambda: None))
    fanned = next(i for i, line in enumerate(plan) if "Generate" in line and "geography" in line)
    assert any("Aggregate [source" in line for line in plan[fanned + 1 :])


def test_children_sum_their_own_variables_only(spark, monkeypatch):
    monkeypatch.setattr(session, "keep", lambda df, name: df)
    seen = []
    for name in ("city_long", "municipality_long"):
        monkeypatch.setattr(survey, name, lambda df, *args, f=getattr(survey, name): seen.append(df) or f(df, *args))
    t = Tables(spark, FOLDER)
    found = people.children(t)
    levels = catalog.with_levels(catalog.dictionary(spark))
    wanted = {r["variable"] for r in levels.where(F.col("Group3").isin(catalog.CHILD_BANDS)).collect()}
    assert len(seen) == 2
    for df in seen:
        assert {r["variable"] for r in df.select("variable").distinct().collect()} == wanted
    whole = themes.children(indicators.hub(t))
    assert rows(indicators.r6(found, "Children")) == rows(indicators.r6(whole, "Children"))


def test_statistics_of_sources_regrouped_are_those_of_the_areas(spark):
    cells = [(i % 7, f"v{i % 3}", None if i % 11 == 0 else float(i % 5 - 2)) for i in range(200)]
    df = spark.createDataFrame(cells, "source int, variable string, estimate double")
    areas = lambda d: d.selectExpr("*", "inline(array(named_struct('geography', 'a', 'GEOID', source % 2), named_struct('geography', 'b', 'GEOID', 0)))")
    sums = statistics.collect(df, ["source", "variable"])
    order = [*statistics.KEYS, *statistics.MERGED]
    assert rows(statistics.regroup(areas(sums)).select(order)) == rows(statistics.collect(areas(df)).select(order))


def test_addresses_do_not_travel_with_encounters(spark, monkeypatch):
    """Once an address has its coordinates, no join or sum of the encounters holds its text."""
    monkeypatch.setattr(session, "keep", lambda df, name: df)
    t = Tables(spark, FOLDER)
    monkeypatch.setattr(people, "kept_located", lambda t: spark.createDataFrame([(0.0, 0.0, "c", "m", "n")], "X double, Y double, County string, Municipality string, Neighborhood string"))
    plan = people.placed_admissions(t)._jdf.queryExecution().optimizedPlan()

    def held(node):
        own = {a.name() for a in outputs(node)}
        below = [held(node.children().apply(i)) for i in range(node.children().size())]
        if {"pat_enc_csn_id", "add_line_1"} <= own:
            return True
        return any(below)

    def outputs(node):
        return [node.output().apply(i) for i in range(node.output().size())]

    assert not held(plan)


def test_only_addresses_at_located_points_are_joined(spark):
    cache = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0), ("c", None, None)], "add_line_1 string, X double, Y double")
    located = spark.createDataFrame([(1.0, 1.0, "n1"), (1.0, 1.0, "n2")], "X double, Y double, Neighborhood string")
    assert rows(cohorts.known_points(cache, located)) == rows(cache.where("add_line_1 = 'a'"))


def test_codes_are_read_once(spark):
    codes = ["E84.0", "E84.01", "E84x0", "D57.3", "D57.30", "D57.1", "D57", "J96.1", "J96.19", "J96", "xJ96.1", "Z99.1", "Z99.1\n", "", None]
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    code = F.col("code")
    plain = code.isin("E84.0", "Z99.1") | code.startswith("J96.1") | (code.startswith("D57.") & (code != "D57.3"))
    found = text.listed_or_starts("code", ["E84.0", "Z99.1"], ["D57.", "J96.1"], "D57.3")
    assert df.where(found.eqNullSafe(plain)).count() == len(codes)
    # a long expression in the place of the column stands in the filter once
    made = spark.range(5).select(F.col("id").alias("dx_id"), F.concat(F.lit("E84."), F.col("id").cast("string")).alias("code"))
    accounts = spark.range(3).select(F.col("id").alias("hsp_account_id"), F.col("id").alias("dx_id"), F.col("id").alias("pat_enc_csn_id"))
    plan = cohorts.exception_encounters(accounts, made, accounts)
    assert rows(plan) == rows(spark.range(1).select(F.col("id").alias("pat_enc_csn_id")))
    assert max(len(re.findall("concat", line)) for line in optimized(plan)) == 1
