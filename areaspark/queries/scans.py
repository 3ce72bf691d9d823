"""Sources and sinks. Files are written from the driver tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from areaspark import session
from areaspark.operators import ordering
from areaspark.plans import catalog
from areaspark.queries.registry import Tables, query
from areaspark.queries.shapes import bg_geoid, text, tract_text
from areaspark.sources import readers, schemas, sinks

_BG_FILE = (
    f"SELECT {bg_geoid('s_suppkey')} AS a, 'x' AS b, {text('s_suppkey')} AS c, 'y' AS d, "
    f"'Nation_' || {text('s_nationkey')} AS e, CAST(0.62 AS DOUBLE) AS f, 'Hood-' || {text('s_suppkey')} AS g FROM supplier"
)
_TRACT_FILE = (
    f"SELECT '39061' AS a, {tract_text('s_suppkey')} AS b, 'x' AS c, 'Butler OH' AS d, "
    f"'Nation_' || {text('s_nationkey')} || ' city' AS e, 'y' AS f, CAST(s_acctbal AS DOUBLE) AS g FROM supplier"
)


def _csv(t: Tables, sql: str, name: str) -> str:
    return sinks.write_csv(t.sql(sql), session.work_folder(t.spark, name))


@query(
    "scan_csv_typed",
    f"""SELECT {bg_geoid('s_suppkey')} AS "GEOID", 'Nation_' || {text('s_nationkey')} AS "Municipality",
    CAST(0.62 AS DOUBLE) AS "Allocation", 'Hood-' || {text('s_suppkey')} AS "Neighborhood" FROM supplier""",
)
def _(t: Tables):
    return readers.csv_typed(t.spark, _csv(t, _BG_FILE, "bg"), schemas.BG_ALLOCATION, list("abcdefg"))


@query(
    "scan_csv_renamed",
    f"""SELECT '39061' AS "CountyCode", {tract_text('s_suppkey')} AS "Tract", 'Butler OH' AS "County",
    'Nation_' || {text('s_nationkey')} || ' city' AS "Municipality", s_acctbal AS "Allocation" FROM supplier""",
)
def _(t: Tables):
    return readers.csv_typed(t.spark, _csv(t, _TRACT_FILE, "tract"), schemas.TRACT_ALLOCATION, list("abcdefg"))


@query(
    "scan_csv_inferred",
    """SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer""",
)
def _(t: Tables):
    path = _csv(t, "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer", "inferred")
    return readers.csv_inferred(t.spark, path).withColumn("id", F.col("id").cast("long"))


@query(
    "scan_delim_positional",
    """SELECT w[1] AS "A", w[2] AS "B", w[3] AS "C", w[4] AS "D", w[5] AS "E", w[6] AS "G", w[7] AS "H", w[8] AS "I",
    w[9] AS "J", w[10] AS "K", w[11] AS "L", nullif(array_to_string(w[12:], ' '), '') AS "M" FROM (SELECT string_split(value, ' ') AS w FROM px_school_lines)""",
)
def _(t: Tables):
    from areaspark.operators import placelists

    path = sinks.write_lines(t.px_school_lines, session.work_folder(t.spark, "lines"))
    return readers.tokens(t.spark, path, placelists.SCHOOL_COLUMNS, surplus="merge")


_WANTED = ["B01001_001", "B02001_002", "B02001_003", "B03002_012"]


@query(
    "scan_long_survey",
    """SELECT "GEOID", "NAME", variable, estimate FROM px_survey_long WHERE geography = 'tract' AND state IN ('OH', 'KY')
    AND county IN ('C1', 'C2') AND year = 2022 AND variable IN ('B01001_001', 'B02001_002', 'B02001_003', 'B03002_012')""",
)
def _(t: Tables):
    path = sinks.write_partitioned(t.px_survey_long, session.work_folder(t.spark, "survey"), ["geography", "state"])
    stored = t.spark.read.parquet(path)
    return readers.long_survey(stored, "tract", _WANTED, ["OH", "KY"], ["C1", "C2"], 2022)


@query(
    "scan_dictionary",
    """SELECT d.concept, d.label, count(*) AS n FROM px_bg_rows r JOIN px_dict d ON r.variable = d.variable
    WHERE d.variable IN ('B01001_001', 'B02001_002', 'B02001_003', 'B03002_012') GROUP BY d.concept, d.label""",
)
def _(t: Tables):
    wanted = readers.dictionary_for(catalog.dictionary(t.spark), _WANTED, "variable")
    counts = t.px_bg_rows.groupBy("variable").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(wanted, "variable").groupBy("concept", "label").agg(F.sum("n").alias("n"))


@query(
    "scan_sql_query",
    """SELECT o_orderstatus AS status, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE c_mktsegment LIKE 'B%' GROUP BY o_orderstatus""",
)
def _(t: Tables):
    text_ = """SELECT o_orderstatus AS status, count(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey
    WHERE c_mktsegment LIKE 'B%' GROUP BY o_orderstatus"""
    return readers.sql_query(t.spark, text_, {"orders": t.orders, "customer": t.customer})


_EDGES = (
    "SELECT CASE WHEN s_nationkey % 5 < 2 THEN 'OH' WHEN s_nationkey % 5 < 4 THEN 'KY' ELSE 'IN' END AS state, "
    f"'C' || {text('s_nationkey % 7')} AS county, {text('s_suppkey')} AS GEOID, 0 AS ring, CAST(s_nationkey AS INT) AS seq, "
    "CAST(s_nationkey AS DOUBLE) AS x1, 0.5 AS y1, s_acctbal AS x2, 1.5 AS y2 FROM supplier"
)


@query("scan_boundaries", f"""SELECT state, county, "GEOID", seq, x1, x2 FROM ({_EDGES}) e WHERE state IN ('OH', 'KY') AND county IN ('C1', 'C3')""")
def _(t: Tables):
    path = sinks.write_partitioned(t.sql(_EDGES), session.work_folder(t.spark, "edges"), ["state"])
    return readers.boundaries(t.spark.read.parquet(path), ["OH", "KY"], ["C1", "C3"]).select(
        "state", "county", "GEOID", "seq", "x1", "x2"
    )


@query(
    "scan_geocode_results",
    """SELECT "ID", lon AS "X", lat AS "Y" FROM px_geocoded WHERE precision = 'range' AND geocode_result <> 'imprecise_geocode'""",
)
def _(t: Tables):
    path = sinks.write_csv(
        t.px_geocoded.select("ID", "address", "lat", "lon", "precision", "geocode_result"),
        session.work_folder(t.spark, "geocoded"),
    )
    return readers.geocode_results(t.spark, path, schemas.GEOCODE_RESULT)


@query(
    "literal_lookup",
    """SELECT c.category, count(*) AS n, sum(r.estimate) AS total FROM px_bg_rows r JOIN px_cat c ON r.variable = c.variable
    GROUP BY c.category""",
)
def _(t: Tables):
    sums = t.px_bg_rows.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.sum("estimate").alias("total"))
    return (
        sums.join(catalog.category_lookup(t.spark), "variable")
        .groupBy("category")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    )


@query(
    "variable_list_gen",
    """SELECT variable, count(*) AS n FROM px_bg_rows WHERE variable = 'B15003_001' OR (substring(variable, 1, 7) = 'B15003_'
    AND CAST(substring(variable, 8, 3) AS INT) BETWEEN 17 AND 25) GROUP BY variable""",
)
def _(t: Tables):
    ids = catalog.numbered("B15003", 1, *range(17, 26))
    return t.px_bg_rows.where(F.col("variable").isin(ids)).groupBy("variable").agg(F.count(F.lit(1)).alias("n"))


@query("sink_csv", """SELECT s_suppkey AS key, s_name AS name, round(s_acctbal, 2) AS balance FROM supplier""")
def _(t: Tables):
    out = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.round("s_acctbal", 2).alias("balance"))
    path = sinks.write_csv(out, session.work_folder(t.spark, "out"))
    return readers.csv_typed(t.spark, path, "key bigint, name string, balance double")


@query("preview_head", """SELECT s_name AS name, s_nationkey AS nation FROM supplier ORDER BY s_nationkey, s_name LIMIT 6""")
def _(t: Tables):
    rows = t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return ordering.first_rows(rows, ["nation", "name"])
