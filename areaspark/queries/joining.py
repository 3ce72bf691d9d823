"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from areaspark.functions import text
from areaspark import session
from areaspark.operators import joins, ordering, reshape, windows
from areaspark.queries.registry import Tables, query, view
from areaspark.sources import readers


@query(
    "join_natural_inner",
    """SELECT a.county, a.state, a.people, b.floors FROM (SELECT county, state, count(*) AS people FROM px_patient GROUP BY ALL) a
    JOIN (SELECT county, state, count(add_line_2) AS floors FROM px_patient GROUP BY ALL) b
    ON a.county IS NOT DISTINCT FROM b.county AND a.state IS NOT DISTINCT FROM b.state""",
)
def _(t: Tables):
    keys = ["county", "state"]
    people = t.px_patient.groupBy(*keys).agg(F.count(F.lit(1)).alias("people"))
    floors = t.px_patient.groupBy(*keys).agg(F.count("add_line_2").alias("floors"))
    return joins.null_safe_join(people, floors)


@query(
    "join_keyed_renamed",
    """SELECT l_suppkey, s_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""",
)
def _(t: Tables):
    counts = t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return joins.null_safe_join(counts, t.supplier.select("s_suppkey", "s_name"), {"l_suppkey": "s_suppkey"})


@query(
    "join_left",
    """SELECT c_custkey, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT'
    GROUP BY o_custkey) o ON c_custkey = o_custkey""",
)
def _(t: Tables):
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return joins.null_safe_join(t.customer.select("c_custkey"), urgent, {"c_custkey": "o_custkey"}, "left")


@query(
    "join_right",
    """SELECT c_custkey AS custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY o_custkey) o
    RIGHT JOIN customer ON c_custkey = o_custkey""",
)
def _(t: Tables):
    high = t.orders.where("o_orderpriority = '2-HIGH'").groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias("n"))
    return joins.null_safe_join(high, t.customer.select(F.col("c_custkey").alias("custkey")), ["custkey"], "right").select("custkey", "n")


@query(
    "join_full",
    """SELECT coalesce(a.k, b.k) AS k, a.n AS urgent, b.n AS high FROM
    (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) a FULL JOIN
    (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1) b ON a.k = b.k""",
)
def _(t: Tables):
    def part(p: str, name: str):
        return t.orders.where(F.col("o_orderpriority") == p).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias(name))

    return joins.null_safe_join(part("1-URGENT", "urgent"), part("2-HIGH", "high"), ["k"], "full")


@query(
    "join_cross_scalar",
    """SELECT o_orderkey, round(o_totalprice / (SELECT max(o_totalprice) FROM orders), 8) AS share,
    (SELECT count(*) FROM orders) AS n FROM orders""",
)
def _(t: Tables):
    one = t.orders.agg(F.max("o_totalprice").alias("top"), F.count(F.lit(1)).alias("n"))
    out = joins.attach_scalar(t.orders, one)
    return out.select("o_orderkey", F.round(F.col("o_totalprice") / F.col("top"), 8).alias("share"), "n")


@query(
    "join_fanout",
    """SELECT a."Municipality", a."Neighborhood", count(*) AS n, round(sum(r.estimate * a."Allocation"), 6) AS total
    FROM px_bg r JOIN px_alloc a ON r."GEOID" = a."GEOID" WHERE r.estimate IS NOT NULL GROUP BY ALL""",
)
def _(t: Tables):
    joined = joins.null_safe_join(t.px_bg.where("estimate is not null"), t.px_alloc, ["GEOID"])
    return joined.groupBy("Municipality", "Neighborhood").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("estimate") * F.col("Allocation")), 6).alias("total")
    )


_PARTS = ["add_line_1", "add_line_2", "city", "state", "zip"]
view(
    "ox_cached",
    "SELECT p.*, g.\"X\", g.\"Y\", g.foster, g.rmh, g.pobox, g.own_site, g.stjoe, g.unknown_address, g.foreign_address FROM px_patient p JOIN px_cache g ON "
    + " AND ".join(f"p.{c} IS NOT DISTINCT FROM g.{c}" for c in _PARTS),
)


@query("join_nullsafe_sql", """SELECT pat_id, "X", "Y" FROM ox_cached""")
def _(t: Tables):
    return joins.null_safe_join(t.px_patient, t.px_cache.select(*_PARTS, "X", "Y"), _PARTS).select("pat_id", "X", "Y")


@query(
    "join_left_then_filter",
    """SELECT pat_id, "X", pobox FROM ox_cached WHERE foster <> 1 AND pobox <> 1 AND state IN ('Ohio', 'Kentucky', 'Indiana')""",
)
def _(t: Tables):
    on = " AND ".join(f"(p.{c} = g.{c} OR (p.{c} IS NULL AND g.{c} IS NULL))" for c in _PARTS)
    return t.sql(
        f"""SELECT p.pat_id, g.X, g.pobox FROM px_patient p LEFT JOIN px_cache g ON {on}
        WHERE g.foster <> 1 AND g.pobox <> 1 AND g.state IN ('Ohio', 'Kentucky', 'Indiana')"""
    )


@query(
    "join_valid_time",
    """SELECT e.pat_enc_csn_id, e.pat_id, h.add_line_1, h.eff_start_date FROM px_encounter e JOIN px_history h ON e.pat_id = h.pat_id
    WHERE e.hosp_admsn_time >= h.eff_start_date AND (h.eff_end_date IS NULL OR e.hosp_admsn_time < h.eff_end_date)
    AND year(e.hosp_admsn_time) IN (1997, 1998)""",
)
def _(t: Tables):
    return joins.join_valid_time(
        t.px_encounter, t.px_history, ["pat_id"], "hosp_admsn_time", "eff_start_date", "eff_end_date", "1997-01-01", "1998-12-31"
    ).select("pat_enc_csn_id", "pat_id", "add_line_1", "eff_start_date")


@query(
    "join_multiway_cohort",
    """SELECT DISTINCT p.pat_id, c.registry_id, c.registry_name FROM px_config c JOIN px_membership m ON c.registry_id = m.registry_id
    JOIN px_record d ON m.record_id = d.record_id JOIN px_patient p ON p.pat_id = d.networked_id WHERE m.status_c = 1""",
)
def _(t: Tables):
    active = t.px_membership.where("status_c = 1").select("registry_id", "record_id").distinct()
    enrolled = joins.null_safe_join(joins.null_safe_join(active, t.px_config, ["registry_id"]), t.px_record, ["record_id"])
    people = enrolled.select(F.col("networked_id").alias("pat_id"), "registry_id", "registry_name").distinct()
    return joins.null_safe_join(people, t.px_patient.select("pat_id"), ["pat_id"])


@query(
    "join_exists_flag",
    """SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48) THEN 1 ELSE 0 END AS big FROM orders""",
)
def _(t: Tables):
    big = t.lineitem.where("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.flag_exists(t.orders.select("o_orderkey"), big, ["o_orderkey"], "big")


@query(
    "join_dictionary_self",
    """WITH tract AS (SELECT DISTINCT 'T' || d.variable AS name, d.label, d.concept FROM px_bg_rows r JOIN px_dict d ON r.variable = d.variable),
    bg AS (SELECT DISTINCT d.variable AS name, d.label, d.concept FROM px_bg_rows r JOIN px_dict d ON r.variable = d.variable WHERE d.variable < 'B11')
    SELECT t.name, t.label, t.concept, b.name AS "name.y" FROM tract t LEFT JOIN bg b ON t.label = b.label AND t.concept = b.concept""",
)
def _(t: Tables):
    from areaspark.plans import catalog

    used = joins.null_safe_join(t.px_bg_rows.select("variable").distinct(), catalog.dictionary(t.spark), ["variable"])
    named = used.withColumnRenamed("variable", "name")
    tract = named.withColumn("name", F.concat(F.lit("T"), "name"))
    return readers.match_dictionaries(tract, named.where("name < 'B11'"))


@query(
    "join_on_coordinates",
    """SELECT p.pat_id, a."X", a."Y", a.n FROM ox_cached p JOIN (SELECT "X", "Y", count(*) AS n FROM px_cache WHERE "X" IS NOT NULL GROUP BY ALL) a
    ON p."X" = a."X" AND p."Y" = a."Y" """,
)
def _(t: Tables):
    from areaspark.plans import cohorts

    people = joins.null_safe_join(t.px_patient, t.px_cache.select(*_PARTS, "X", "Y"), _PARTS).select("pat_id", "X", "Y")
    spots = t.px_cache.where("X is not null").groupBy("X", "Y").agg(F.count(F.lit(1)).alias("n"))
    return cohorts.at_located_points(people, spots)


@query(
    "join_roundtrip_address",
    """WITH u AS (SELECT city, state, zip, count(*) AS residents FROM px_patient GROUP BY ALL)
    SELECT p.pat_id, u.residents FROM px_patient p JOIN u ON p.city IS NOT DISTINCT FROM u.city
    AND p.state IS NOT DISTINCT FROM u.state AND p.zip IS NOT DISTINCT FROM u.zip""",
)
def _(t: Tables):
    from areaspark.operators import address

    ids = t.px_patient.groupBy("city", "state", "zip").agg(F.count(F.lit(1)).alias("residents"))
    return address.roundtrip(ids, t.px_patient.select("pat_id", "city", "state", "zip"), ["city", "state", "zip"]).select(
        "pat_id", "residents"
    )


@query(
    "join_wide_assembly",
    """WITH a AS (SELECT o_custkey AS k, count(*) AS orders FROM orders GROUP BY 1),
    b AS (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS spent FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    c AS (SELECT c_custkey AS k, c_acctbal AS balance FROM customer)
    SELECT a.k, orders, spent, balance FROM a JOIN c ON a.k = c.k LEFT JOIN b ON a.k = b.k""",
)
def _(t: Tables):
    k = F.col("o_custkey").alias("k")
    a = t.orders.groupBy(k).agg(F.count(F.lit(1)).alias("orders"))
    b = t.orders.where("o_orderstatus = 'F'").groupBy(k).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    return joins.assemble_wide([(a, "inner"), (c, "inner"), (b, "left")], ["k"])


# Sorting, limits, set operations


# every row with its place in the partitions as they were written, so that the order itself is compared


def _placed(t: Tables, name: str, ordered):
    return ordering.positions(ordered, lambda df: session.keep(df, name))


@query("sort_asc", "SELECT pat_id, county, row_number() OVER (ORDER BY county NULLS LAST, pat_id) AS position FROM px_patient")
def _(t: Tables):
    return _placed(t, "sort_asc", ordering.sort_rows(t.px_patient.select("pat_id", "county"), "county", "pat_id"))


@query("sort_desc", "SELECT o_custkey, n, row_number() OVER (ORDER BY n DESC, o_custkey) AS position FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def _(t: Tables):
    counts = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return _placed(t, "sort_desc", ordering.sort_rows(counts, "n", "o_custkey", descending=["n"]))


@query("sort_expr", "SELECT p_partkey, p_name, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS position FROM part")
def _(t: Tables):
    return _placed(t, "sort_expr", ordering.sort_rows(t.part.select("p_partkey", "p_name"), text.title_case("p_name"), "p_partkey"))


@query(
    "sort_category",
    """SELECT o_orderpriority, n, rank, row_number() OVER (ORDER BY rank NULLS LAST, o_orderpriority) AS position FROM (
    SELECT o_orderpriority, n, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '1-URGENT' THEN 3 END AS rank
    FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1))""",
)
def _(t: Tables):
    counts = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    rank = ordering.category_rank("o_orderpriority", ["5-LOW", "3-MEDIUM", "1-URGENT"]).cast("int")
    return _placed(t, "sort_category", ordering.sort_rows(counts.withColumn("rank", rank), "rank", "o_orderpriority"))


@query("limit_head", "SELECT c_custkey, c_name FROM customer ORDER BY c_name LIMIT 6")
def _(t: Tables):
    return ordering.first_rows(t.customer.select("c_custkey", "c_name"), ["c_name"])


@query(
    "union_all_by_name",
    "SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier",
)
def _(t: Tables):
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = t.customer.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("id"))
    return reshape.stack(s, c, s)


@query(
    "union_distinct",
    """SELECT "X", "Y" FROM px_cache WHERE "X" IS NOT NULL UNION SELECT "X", "Y" FROM px_points""",
)
def _(t: Tables):
    known = t.px_cache.where("X is not null").select("X", "Y")
    return reshape.stack(known, t.px_points.select("X", "Y")).distinct()


# Windows


@query(
    "win_group_total",
    "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total FROM orders",
)
def _(t: Tables):
    out = windows.with_group_total(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "total")
    return out.select("o_orderkey", F.round("total", 2).alias("total"))


@query(
    "win_share",
    "SELECT o_orderkey, round(o_totalprice / nullif(sum(o_totalprice) OVER (PARTITION BY o_custkey), 0), 8) AS share FROM orders",
)
def _(t: Tables):
    out = windows.with_share(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "share")
    return out.select("o_orderkey", F.round("share", 8).alias("share"))


@query("win_group_count", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS count FROM lineitem")
def _(t: Tables):
    return windows.with_group_count(t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey"])


@query(
    "win_row_number_ordered",
    """SELECT c_name, c_mktsegment, row_number() OVER (ORDER BY c_mktsegment, c_name) AS id FROM customer""",
)
def _(t: Tables):
    rows = t.customer.select("c_name", "c_mktsegment")
    return windows.dense_ids(rows, {"segment": F.col("c_mktsegment"), "name": F.col("c_name")}, "id", lambda df: session.keep(df, "ranges"))


@query(
    "win_row_number_surrogate",
    """SELECT city, state, count(*) AS addresses FROM (SELECT DISTINCT add_line_1, add_line_2, city, state, zip FROM px_patient) GROUP BY city, state""",
)
def _(t: Tables):
    from areaspark.operators import address

    ids = address.address_ids(t.px_patient, _PARTS)
    return ids.groupBy("city", "state").agg(F.count_distinct("ID").alias("addresses"))


@query(
    "win_global_extreme",
    "SELECT s_suppkey, round(s_acctbal / (SELECT max(s_acctbal) FROM supplier), 8) AS share FROM supplier",
)
def _(t: Tables):
    out = windows.relative_to_extreme(t.supplier.select("s_suppkey", "s_acctbal"), "s_acctbal", "share")
    return out.select("s_suppkey", F.round("share", 8).alias("share"))
