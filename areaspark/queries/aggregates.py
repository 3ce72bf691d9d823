"""Aggregations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from areaspark.functions import missing
from areaspark.operators import joins, reshape
from areaspark.queries.registry import Tables, query, view

QTY = "nullif(l_quantity, 50)"


def _lines(t: Tables):
    return t.lineitem.withColumn("q", F.when(F.col("l_quantity") != 50, F.col("l_quantity")))


def strict(expr: str, agg: str = "sum") -> str:
    return f"CASE WHEN count({expr}) = count(*) THEN {agg}({expr}) END"


@query("agg_sum_strict", f"SELECT l_orderkey, {strict(QTY)} AS total, sum({QTY}) AS skipping FROM lineitem GROUP BY l_orderkey")
def _(t: Tables):
    return _lines(t).groupBy("l_orderkey").agg(missing.sum_strict("q").alias("total"), F.sum("q").alias("skipping"))


@query(
    "agg_sum_across",
    f"""SELECT l_suppkey, {strict(QTY)} AS q, round(sum(l_extendedprice), 2) AS l_extendedprice, round(sum(l_tax), 6) AS l_tax
    FROM lineitem GROUP BY l_suppkey""",
)
def _(t: Tables):
    cols = {"q": None, "l_extendedprice": 2, "l_tax": 6}
    sums = {c: missing.sum_strict(c) for c in cols}
    return _lines(t).groupBy("l_suppkey").agg(
        *[(s if cols[c] is None else F.round(s, cols[c])).alias(c) for c, s in sums.items()]
    )


@query("agg_count", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def _(t: Tables):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_count_distinct_if",
    """SELECT event_type, count(DISTINCT CASE WHEN value > 20 THEN user_id END) AS users FROM events GROUP BY event_type""",
)
def _(t: Tables):
    # one row per type and user first: partial sums, no expansion per distinct count
    per_user = t.events.groupBy("event_type", "user_id").agg(F.max(F.col("value") > 20).alias("hit"))
    return per_user.groupBy("event_type").agg(F.count(F.when(F.col("hit"), F.lit(1))).alias("users"))


@query(
    "agg_conditional_sum",
    """SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks,
    CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM events GROUP BY user_id""",
)
def _(t: Tables):
    return t.events.groupBy("user_id").agg(
        *[F.sum((F.col("event_type") == k).cast("int")).alias(n) for n, k in (("clicks", "click"), ("errors", "error"))]
    )


@query(
    "agg_min_max",
    f"""SELECT l_suppkey, {strict(QTY, 'min')} AS low, {strict(QTY, 'max')} AS high, min({QTY}) AS low_known, max({QTY}) AS high_known
    FROM lineitem GROUP BY l_suppkey""",
)
def _(t: Tables):
    return _lines(t).groupBy("l_suppkey").agg(
        missing.min_strict("q").alias("low"),
        missing.max_strict("q").alias("high"),
        F.min("q").alias("low_known"),
        F.max("q").alias("high_known"),
    )


@query(
    "agg_stddev",
    f"""SELECT l_orderkey, round(CASE WHEN count({QTY}) = count(*) THEN stddev_samp({QTY}) END, 6) AS sd, round(stddev_samp({QTY}), 6) AS sd_known
    FROM lineitem GROUP BY l_orderkey""",
)
def _(t: Tables):
    return _lines(t).groupBy("l_orderkey").agg(
        F.round(missing.stddev_strict("q"), 6).alias("sd"), F.round(F.stddev_samp("q"), 6).alias("sd_known")
    )


@query(
    "agg_mean_present_years",
    """SELECT o_custkey, round(avg(total), 4) AS mean FROM (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS total FROM orders
    GROUP BY 1, 2) GROUP BY o_custkey""",
)
def _(t: Tables):
    yearly = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("total"))
    return yearly.groupBy("o_custkey").agg(F.round(F.avg("total"), 4).alias("mean"))


@query(
    "agg_global_baseline",
    """SELECT s_suppkey, round(s_acctbal / nullif((SELECT sum(s_acctbal) FROM supplier WHERE s_nationkey < 12), 0), 8) AS share FROM supplier""",
)
def _(t: Tables):
    base = t.supplier.where("s_nationkey < 12").agg(missing.sum_strict("s_acctbal").alias("base"))
    out = joins.attach_scalar(t.supplier, base)
    return out.select("s_suppkey", F.round(missing.ratio("s_acctbal", "base"), 8).alias("share"))


@query(
    "agg_rollup_all",
    """SELECT CASE WHEN grouping(state) = 1 THEN 'All' ELSE state END AS state, CASE WHEN grouping(county) = 1 THEN 'All' ELSE county END AS county,
    CASE WHEN grouping(city) = 1 THEN 'All' ELSE city END AS city, CAST(sum(1) AS BIGINT) AS people, CAST(sum(CASE WHEN add_line_2 IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS floors
    FROM px_patient GROUP BY ROLLUP (state, county, city)""",
)
def _(t: Tables):
    rows = t.px_patient.withColumns({"people": F.lit(1), "floors": F.col("add_line_2").isNotNull().cast("int")})
    return reshape.rollup_labelled(rows, ["state", "county", "city"], ["people", "floors"])


@query(
    "agg_rollup_county_metro",
    """SELECT n_regionkey AS county, round(sum(s_acctbal), 2) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1
    UNION ALL SELECT -1, round(sum(s_acctbal), 2) FROM supplier""",
)
def _(t: Tables):
    place = t.supplier.groupBy("s_nationkey").agg(missing.sum_strict("s_acctbal").alias("total"))
    county = (
        joins.null_safe_join(place, t.nation, {"s_nationkey": "n_nationkey"})
        .groupBy(F.col("n_regionkey").alias("county"))
        .agg(missing.sum_strict("total").alias("total"))
    )
    metro = county.agg(missing.sum_strict("total").alias("total")).withColumn("county", F.lit(-1))
    return county.unionByName(metro).withColumn("total", F.round("total", 2))


@query(
    "agg_subtotal_append",
    """WITH r AS (SELECT city, county, count(*) AS people FROM px_patient WHERE county IS NOT NULL GROUP BY ALL)
    SELECT city, county, people FROM r UNION ALL SELECT 'AFRICA total', county, CAST(sum(people) AS BIGINT) FROM r WHERE county = 'AFRICA' GROUP BY county""",
)
def _(t: Tables):
    rows = t.px_patient.where("county is not null").groupBy("city", "county").agg(F.count(F.lit(1)).alias("people"))
    return reshape.append_subtotal(rows, F.col("county") == "AFRICA", {"city": "AFRICA total"}, ["city", "county"], ["people"])


@query(
    "agg_weighted_mean",
    """SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0), 4) AS mean FROM lineitem GROUP BY l_suppkey""",
)
def _(t: Tables):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.round(missing.ratio(F.sum(F.col("l_extendedprice") * F.col("l_quantity")), F.sum("l_quantity")), 4).alias("mean")
    )


view(
    "ox_income_bg",
    """SELECT "GEOID", max(CASE WHEN variable = 'B19049_001' THEN estimate END) AS median, sum(CASE WHEN variable = 'B11012_001' THEN estimate END) AS hh
    FROM px_bg GROUP BY "GEOID" """,
)


@query(
    "agg_ratio_of_sums",
    """SELECT substring("GEOID", 1, 11) AS tract, round(sum(median * hh) / nullif(sum(hh), 0), 4) AS income FROM ox_income_bg
    WHERE median IS NOT NULL GROUP BY 1""",
)
def _(t: Tables):
    wide = reshape.widen(
        t.px_bg.where(F.col("variable").isin("B19049_001", "B11012_001")), ["GEOID"], "variable", "estimate", ["B19049_001", "B11012_001"]
    ).where("B19049_001 is not null")
    return wide.groupBy(F.substring("GEOID", 1, 11).alias("tract")).agg(
        F.round(missing.ratio(F.sum(F.col("B19049_001") * F.col("B11012_001")), F.sum("B11012_001")), 4).alias("income")
    )


@query("distinct_rows", "SELECT DISTINCT add_line_1, city, state, zip FROM px_patient")
def _(t: Tables):
    return t.px_patient.select("add_line_1", "city", "state", "zip").distinct()


@query("distinct_on", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(t: Tables):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


STATUSES = ["F", "O", "P"]


def _wide_sql(names: dict[str, str], empty: str = "NULL") -> str:
    cells = ", ".join(
        f'coalesce(max(CASE WHEN o_orderstatus = \'{s}\' THEN n END), {empty}) AS "{n}"' for s, n in names.items()
    )
    return f"SELECT o_custkey, {cells} FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY o_custkey"


def _status_counts(t: Tables):
    return t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("pivot_wider", _wide_sql({s: s for s in STATUSES}))
def _(t: Tables):
    return reshape.widen(_status_counts(t), ["o_custkey"], "o_orderstatus", "n", STATUSES)


@query("pivot_wider_prefixed", _wide_sql({s: f"Total{s}" for s in STATUSES}))
def _(t: Tables):
    return reshape.widen(_status_counts(t), ["o_custkey"], "o_orderstatus", "n", STATUSES, prefix="Total")


@query("pivot_wider_filled", _wide_sql({s: s for s in STATUSES}, "0"))
def _(t: Tables):
    return reshape.widen(_status_counts(t), ["o_custkey"], "o_orderstatus", "n", STATUSES, fill=0)


@query(
    "pivot_longer",
    """SELECT l_orderkey, l_linenumber, 'l_quantity' AS name, l_quantity AS value FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""",
)
def _(t: Tables):
    return reshape.lengthen(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])
