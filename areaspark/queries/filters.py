"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from areaspark.functions import dates, missing, numbers
from areaspark.operators import reshape, windows
from areaspark.queries.registry import Tables, query


@query("select_named", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", "o_totalprice")


@query("select_drop", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def _(t: Tables):
    return t.supplier.drop("s_acctbal")


@query("select_range", "SELECT o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(t: Tables):
    return t.orders.select(reshape.columns_between(t.orders, "o_custkey", "o_totalprice"))


@query("select_pattern", "SELECT l_orderkey, l_partkey, l_suppkey, l_linestatus, l_linenumber, l_discount FROM lineitem")
def _(t: Tables):
    cols = reshape.columns_like(t.lineitem, ends="key")
    return t.lineitem.select(*cols, *reshape.columns_like(t.lineitem, starts="l_line"), "l_discount")


@query(
    "select_keeps_group_keys",
    """SELECT c_nationkey, c_mktsegment, sum(c_acctbal) AS total FROM customer GROUP BY c_nationkey, c_mktsegment""",
)
def _(t: Tables):
    keys = ["c_nationkey", "c_mktsegment"]
    return t.customer.groupBy(*keys).agg(F.sum("c_acctbal").alias("total")).select(*keys, "total")


@query(
    "mutate_expr",
    """SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net,
    l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem""",
)
def _(t: Tables):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    out = t.lineitem.withColumns({"net": net}).withColumns({"gross": F.col("net") * (1 + F.col("l_tax"))})
    return out.select("l_orderkey", "l_linenumber", "net", "gross")


@query(
    "across_map",
    """SELECT l_orderkey, l_linenumber, coalesce(nullif(l_quantity, 50), 0) AS l_quantity,
    coalesce(nullif(l_extendedprice, 50), 0) AS l_extendedprice, coalesce(nullif(l_tax, 50), 0) AS l_tax FROM lineitem""",
)
def _(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax")
    return reshape.across(
        rows,
        ["l_quantity", "l_extendedprice", "l_tax"],
        lambda c: F.coalesce(F.when(c != 50, c), F.lit(0.0)),
    )


@query("rename_cols", "SELECT s_suppkey AS supplier_id, s_name AS supplier_name, s_acctbal AS balance FROM supplier")
def _(t: Tables):
    return t.supplier.withColumnsRenamed(
        {"s_suppkey": "supplier_id", "s_name": "supplier_name", "s_acctbal": "balance"}
    ).select("supplier_id", "supplier_name", "balance")


@query("const_cols", """SELECT c_custkey, 'Hamilton' AS "County", CAST(NULL AS VARCHAR) AS "Neighborhood", 1 AS one FROM customer""")
def _(t: Tables):
    return t.customer.select(
        "c_custkey",
        F.lit("Hamilton").alias("County"),
        F.lit(None).cast("string").alias("Neighborhood"),
        F.lit(1).alias("one"),
    )


@query("filter_and", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' AND nullif(l_quantity, 50) > 20")
def _(t: Tables):
    known = F.when(F.col("l_quantity") != 50, F.col("l_quantity"))
    return t.lineitem.where((F.col("l_returnflag") == "A") & (known > 20)).select("l_orderkey", "l_linenumber")


@query(
    "filter_nested_bool",
    """SELECT pat_id, state, county FROM px_patient WHERE (state = 'Ohio' AND county IN ('AFRICA', 'AMERICA'))
    OR (state = 'Kentucky' AND county IN ('ASIA')) OR (state IN ('Ohio', 'Indiana', 'Kentucky') AND county IS NULL)""",
)
def _(t: Tables):
    s, c = F.col("state"), F.col("county")
    keep = (
        ((s == "Ohio") & c.isin("AFRICA", "AMERICA"))
        | ((s == "Kentucky") & c.isin("ASIA"))
        | (s.isin("Ohio", "Indiana", "Kentucky") & c.isNull())
    )
    return t.px_patient.where(keep).select("pat_id", "state", "county")


@query("filter_in", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(t: Tables):
    return t.customer.where(missing.is_in("c_mktsegment", ["BUILDING", "MACHINERY"])).select("c_custkey")


@query("filter_not_in", "SELECT pat_id, county FROM px_patient WHERE county IS NULL OR county NOT IN ('AFRICA', 'ASIA')")
def _(t: Tables):
    return t.px_patient.where(missing.not_in("county", ["AFRICA", "ASIA"])).select("pat_id", "county")


@query("filter_null", "SELECT pat_id FROM px_patient WHERE add_line_2 IS NULL")
def _(t: Tables):
    return t.px_patient.where(F.col("add_line_2").isNull()).select("pat_id")


@query("filter_notnull", """SELECT "X", "Y" FROM px_cache WHERE "X" IS NOT NULL""")
def _(t: Tables):
    return t.px_cache.where(~missing.is_missing("X")).select("X", "Y")


@query("pred_prefix", "SELECT variable, count(*) AS n FROM px_bg_rows WHERE starts_with(variable, 'B01') GROUP BY variable")
def _(t: Tables):
    return t.px_bg_rows.where(F.col("variable").startswith("B01")).groupBy("variable").agg(F.count(F.lit(1)).alias("n"))


@query("pred_suffix", "SELECT variable, count(*) AS n FROM px_bg_rows WHERE ends_with(variable, '_001') GROUP BY variable")
def _(t: Tables):
    return t.px_bg_rows.where(F.col("variable").endswith("_001")).groupBy("variable").agg(F.count(F.lit(1)).alias("n"))


@query(
    "pred_contains",
    """SELECT p_partkey, contains(p_name, 'ring') AS has, NOT contains(p_name, 'ring') AS lacks,
    regexp_matches(p_name, '^(red|small) .*t') AS fits FROM part""",
)
def _(t: Tables):
    n = F.col("p_name")
    return t.part.select(
        "p_partkey",
        n.contains("ring").alias("has"),
        (~n.contains("ring")).alias("lacks"),
        n.rlike("^(red|small) .*t").alias("fits"),
    )


@query(
    "pred_prefix_from_column",
    """SELECT pharmacy_id, starts_with(a, num) AS added FROM (SELECT pharmacy_id, a, nullif(regexp_extract(a, '[0-9]+'), '') AS num
    FROM (SELECT pharmacy_id, string_split(pharmacy_name, '-')[3] AS a FROM px_pharmacy))""",
)
def _(t: Tables):
    from areaspark.functions import text

    a = text.piece("pharmacy_name", "-", 2)
    rows = t.px_pharmacy.select("pharmacy_id", a.alias("a"))
    return rows.select(
        "pharmacy_id", F.col("a").startswith(numbers.number_text(numbers.parse_number("a"))).alias("added")
    )


@query(
    "pred_sql_like",
    """SELECT dx_id, code FROM px_dx_code WHERE code IN ('Z93.0', 'E84.0') OR (code LIKE 'D57.%' AND code <> 'D57.3')
    OR code LIKE 'J96.1%' OR code LIKE 'Q24.%'""",
)
def _(t: Tables):
    return t.sql(
        """SELECT dx_id, code FROM px_dx_code WHERE code IN ('Z93.0', 'E84.0') OR (code LIKE 'D57.%' AND code <> 'D57.3')
        OR code LIKE 'J96.1%' OR code LIKE 'Q24.%'"""
    )


@query("pred_year_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE year(l_shipdate) IN (1997, 1998)")
def _(t: Tables):
    return t.lineitem.where(dates.in_years("l_shipdate", 1997, 1998)).select("l_orderkey", "l_linenumber")


@query(
    "filter_rowcount_one",
    """SELECT o_custkey, o_orderdate_day, o_orderkey FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate_day, o_orderkey,
    count(*) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)) AS n FROM orders) WHERE n = 1""",
)
def _(t: Tables):
    rows = t.orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate_day"), "o_orderkey")
    return windows.only_single_rows(rows, ["o_custkey", "o_orderdate_day"])
