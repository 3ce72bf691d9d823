"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from areaspark.functions import dates, missing, numbers, text
from areaspark.operators import names
from areaspark.queries.registry import Tables, query
from areaspark.queries.shapes import tract_geoid, tract_text

AS_OF = "2024-06-30"


@query(
    "sc_case_when",
    """SELECT pat_id, CASE WHEN county = 'AFRICA' THEN 'a' WHEN county IN ('ASIA', 'EUROPE') THEN 'b' ELSE 'c' END AS kind FROM px_patient""",
)
def _(t: Tables):
    c = F.col("county")
    return t.px_patient.select("pat_id", F.when(c == "AFRICA", "a").when(c.isin("ASIA", "EUROPE"), "b").otherwise("c").alias("kind"))


@query("sc_ifelse", "SELECT pat_id, CASE WHEN county IS NULL THEN NULL WHEN county = 'AFRICA' THEN 'a' ELSE 'b' END AS kind FROM px_patient")
def _(t: Tables):
    return t.px_patient.select("pat_id", missing.if_else(F.col("county") == "AFRICA", F.lit("a"), F.lit("b")).alias("kind"))


@query("sc_coalesce", "SELECT pat_id, coalesce(add_line_1, add_line_2, 'none') AS line FROM px_patient")
def _(t: Tables):
    return t.px_patient.select("pat_id", F.coalesce("add_line_1", "add_line_2", F.lit("none")).alias("line"))


@query(
    "sc_is_inf_nan",
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END, 8) AS share FROM lineitem""",
)
def _(t: Tables):
    zero = F.col("l_tax") == 0
    raw = (
        F.when(zero & (F.col("l_discount") == 0), F.lit(float("nan")))
        .when(zero, F.lit(float("inf")))
        .otherwise(F.col("l_discount") / F.when(~zero, F.col("l_tax")))
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(missing.finite_or_null(raw), 8).alias("share"))


@query(
    "sc_arith",
    """SELECT l_orderkey, l_linenumber, l_quantity + l_linenumber AS a, l_quantity - l_linenumber AS s, l_quantity * l_linenumber AS m,
    round(l_quantity / nullif(l_linenumber - 1, 0), 8) AS d FROM lineitem""",
)
def _(t: Tables):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", (q + n).alias("a"), (q - n).alias("s"), (q * n).alias("m"), F.round(missing.ratio(q, n - 1), 8).alias("d")
    )


@query(
    "sc_round",
    """SELECT o_orderkey, round_even(o_totalprice, 0) AS r0, round_even(o_totalprice / 7.3, 1) AS r1, round_even(o_totalprice / 11, 3) AS r3 FROM orders""",
)
def _(t: Tables):
    p = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", numbers.half_even(p).alias("r0"), numbers.half_even(p / 7.3, 1).alias("r1"), numbers.half_even(p / 11, 3).alias("r3")
    )


@query("sc_trunc_int", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", numbers.truncate_int("o_totalprice").alias("whole"))


@query(
    "sc_str_concat",
    """SELECT pat_id, coalesce(add_line_1, 'NA') || ', ' || coalesce(city, 'NA') || ', ' || coalesce(zip, 'NA') AS pasted,
    concat_ws(', ', add_line_1, city, zip) AS skipped FROM px_patient""",
)
def _(t: Tables):
    return t.px_patient.select(
        "pat_id",
        text.paste("add_line_1", "city", "zip", sep=", ").alias("pasted"),
        F.concat_ws(", ", "add_line_1", "city", "zip").alias("skipped"),
    )


@query("sc_str_remove_first", "SELECT c_custkey, regexp_replace(c_name, '0+', '') AS a, regexp_replace(c_name, '#', '') AS b FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", text.remove_first("c_name", "0+").alias("a"), text.remove_first_text("c_name", "#").alias("b"))


@query(
    "sc_str_remove_colpattern",
    """SELECT p_partkey, CASE WHEN instr(p_name, w) > 0 THEN substring(p_name, 1, CAST(instr(p_name, w) AS BIGINT) - 1) || substring(p_name, CAST(instr(p_name, w) + length(w) AS BIGINT)) ELSE p_name END AS rest,
    regexp_replace(p_name, w, '') AS rest_pattern FROM (SELECT p_partkey, p_name, string_split(p_name, ' ')[2] AS w FROM part)""",
)
def _(t: Tables):
    rows = t.part.select("p_partkey", "p_name", text.piece("p_name", " ", 1).alias("w"))
    return rows.select(
        "p_partkey",
        text.remove_first_of("p_name", "w").alias("rest"),
        text.remove_first_of("p_name", "w", literal=False).alias("rest_pattern"),
    )


_TITLED = "regexp_extract_all({}, '[a-zA-Z0-9_]+|[^a-zA-Z0-9_]+')"


@query(
    "sc_title_case",
    f"""SELECT p_partkey, array_to_string(list_transform({_TITLED.format("p_name || '-' || p_type || '/' || p_brand")}, lambda x: upper(x[1]) || lower(x[2:])), '') AS name FROM part""",
)
def _(t: Tables):
    joined = F.concat("p_name", F.lit("-"), "p_type", F.lit("/"), "p_brand")
    return t.part.select("p_partkey", text.title_case(joined).alias("name"))


@query("sc_upper", "SELECT p_partkey, upper(p_name) AS name FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", F.upper("p_name").alias("name"))


@query("sc_trim", "SELECT p_partkey, p_name AS name FROM part")
def _(t: Tables):
    padded = F.concat(F.lit(" \t"), "p_name", F.lit("  \n"))
    return t.part.select("p_partkey", text.trim_space(padded).alias("name"))


@query("sc_prefix_n", """SELECT "GEOID", substring("GEOID", 1, 11) AS tract, count(*) AS n FROM px_bg_rows GROUP BY ALL""")
def _(t: Tables):
    return t.px_bg_rows.groupBy("GEOID", text.prefix("GEOID", 11).alias("tract")).agg(F.count(F.lit(1)).alias("n"))


@query("sc_length", "SELECT page_id, CAST(length(url) AS INT) AS n FROM pages")
def _(t: Tables):
    return t.pages.select("page_id", F.length("url").alias("n"))


@query(
    "sc_parse_number",
    """SELECT value, try_cast(replace(nullif(regexp_extract(value, '-?[0-9][0-9,]*\\.?[0-9]*'), ''), ',', '') AS DOUBLE) AS number FROM
    (SELECT p_name || ' 1,' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') || '.5 x' AS value FROM part UNION ALL SELECT p_name FROM part)""",
)
def _(t: Tables):
    numbered = F.concat("p_name", F.lit(" 1,"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit(".5 x"))
    rows = t.part.select(numbered.alias("value")).unionByName(t.part.select(F.col("p_name").alias("value")))
    return rows.select("value", numbers.parse_number("value").alias("number"))


@query(
    "sc_num_to_text",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = trunc(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE CAST(l_quantity AS VARCHAR) END AS q,
    CASE WHEN l_discount = trunc(l_discount) THEN CAST(CAST(l_discount AS BIGINT) AS VARCHAR) ELSE CAST(l_discount AS VARCHAR) END AS d FROM lineitem""",
)
def _(t: Tables):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", numbers.number_text("l_quantity").alias("q"), numbers.number_text("l_discount").alias("d")
    )


@query("sc_geoid_pad", f"SELECT s_suppkey, {tract_geoid('s_suppkey')} AS geoid FROM supplier")
def _(t: Tables):
    rows = t.sql(f"SELECT s_suppkey, {tract_text('s_suppkey')} AS tract FROM supplier")
    return rows.select("s_suppkey", text.tract_id(F.lit("39061"), "tract").alias("geoid"))


@query(
    "sc_split_exact",
    """SELECT DISTINCT "NAME", string_split("NAME", ', ')[1] AS "Municipality", string_split("NAME", ', ')[2] AS "County", string_split("NAME", ', ')[3] AS "State"
    FROM px_muni_rows""",
)
def _(t: Tables):
    return names.split_area_name(t.px_muni_rows.select("NAME").distinct())


@query(
    "sc_split_pad",
    """SELECT url, w[1] AS a, w[2] AS b, w[3] AS c, w[4] AS d, w[5] AS e, w[6] AS f, w[7] AS g FROM (SELECT url, string_split(url, '/') AS w FROM pages)""",
)
def _(t: Tables):
    return t.pages.select("url", *[c.alias(n) for n, c in text.split_columns("url", "/", list("abcdefg")).items()])


@query("sc_split_drop", "SELECT p_partkey, string_split(p_name, ' ')[1] AS first, string_split(p_brand, '#')[1] AS brand FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", text.piece("p_name", " ", 0).alias("first"), text.before_any("p_brand", ["#"]).alias("brand"))


@query(
    "sc_split_merge",
    """SELECT pharmacy_id, w[1] AS a, w[2] AS b, CASE WHEN len(w) > 2 THEN array_to_string(w[3:], '-') END AS c
    FROM (SELECT pharmacy_id, string_split(pharmacy_name, '-') AS w FROM px_pharmacy)""",
)
def _(t: Tables):
    parts = text.split_columns("pharmacy_name", "-", ["a", "b", "c"], "merge")
    return t.px_pharmacy.select("pharmacy_id", *[c.alias(n) for n, c in parts.items()])


@query("sc_year", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", F.year("o_orderdate").alias("y"))


@query("sc_cast_date", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.col("ts").cast("date").alias("day"))


@query(
    "sc_age_years",
    f"""SELECT pat_id, round((DATE '{AS_OF}' - birth_date) / 365.25, 6) AS age, round((DATE '{AS_OF}' - birth_date) / 385.25, 6) AS age_earlier FROM px_patient""",
)
def _(t: Tables):
    return t.px_patient.select(
        "pat_id",
        F.round(dates.age_years("birth_date", AS_OF), 6).alias("age"),
        F.round(dates.age_years("birth_date", AS_OF, dates.DAYS_PER_YEAR_EARLIER), 6).alias("age_earlier"),
    )


@query("sc_today", f"SELECT pat_id, DATE '{AS_OF}' AS contact_date FROM px_patient")
def _(t: Tables):
    return t.px_patient.select("pat_id", dates.run_date(AS_OF).alias("contact_date"))


@query(
    "sc_format_thousands",
    """SELECT o_orderkey, regexp_replace(CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR), '([0-9]+)([0-9]{3})$', '\\1,\\2') AS plain,
    '$' || regexp_replace(CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR), '([0-9]+)([0-9]{3})$', '\\1,\\2') AS money FROM orders""",
)
def _(t: Tables):
    whole = numbers.truncate_int("o_totalprice")
    return t.orders.select("o_orderkey", numbers.thousands(whole).alias("plain"), numbers.thousands(whole, "$").alias("money"))


@query(
    "sc_format_percent",
    """SELECT l_orderkey, l_linenumber, CASE WHEN p = trunc(p) THEN CAST(CAST(p AS BIGINT) AS VARCHAR) ELSE CAST(p AS VARCHAR) END || '%' AS label
    FROM (SELECT l_orderkey, l_linenumber, round_even(l_discount * 100 + l_linenumber / 8, 1) AS p FROM lineitem)""",
)
def _(t: Tables):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", numbers.percent_text((F.col("l_discount") * 100 + F.col("l_linenumber") / 8) / 100).alias("label")
    )


@query("sc_format_date", "SELECT o_orderkey, strftime(o_orderdate, '%b %d, %Y') AS day FROM orders")
def _(t: Tables):
    return t.orders.select("o_orderkey", dates.day_label("o_orderdate").alias("day"))


_CLEAN_PLACE = (
    "replace(replace(replace(replace(string_split(\"NAME\", ', ')[1], ' city', ''), ' CCD', ''), ' village', ''), 'The Village of ', '')"
)
CLEAN_SQL = f"replace(replace({_CLEAN_PLACE}, 'NATION', 'Nation'), 'township', 'Township')"


@query(
    "harmonise_names",
    f"""SELECT "GEOID", {CLEAN_SQL} AS "Municipality", replace(string_split("NAME", ', ')[2], ' County', '') AS "County", string_split("NAME", ', ')[3] AS "State", count(*) AS n
    FROM px_muni_rows GROUP BY ALL""",
)
def _(t: Tables):
    rows = t.px_muni_rows.groupBy("GEOID", "NAME").agg(F.count(F.lit(1)).alias("n"))
    return names.harmonise_places(rows).select("GEOID", "Municipality", "County", "State", "n")


@query(
    "merge_neighbourhoods",
    """SELECT CASE WHEN "Neighborhood" IN ('Hood-3', 'Hood-4') THEN 'Hood-3-Hood-4' ELSE "Neighborhood" END AS "Neighborhood", count(*) AS parts,
    round(sum("Allocation"), 6) AS share FROM px_alloc GROUP BY 1""",
)
def _(t: Tables):
    from areaspark.queries.shapes import MERGES

    merged = names.merge_neighbourhoods(t.px_alloc, MERGES)
    return merged.groupBy("Neighborhood").agg(F.count(F.lit(1)).alias("parts"), F.round(F.sum("Allocation"), 6).alias("share"))


@query(
    "state_code_map",
    """SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'Ohio' WHEN 1 THEN 'Kentucky' ELSE 'Indiana' END AS name,
    CASE c_nationkey % 3 WHEN 0 THEN 'OH' WHEN 1 THEN 'KY' ELSE 'IN' END AS code,
    CASE WHEN c_nationkey % 3 = 0 AND c_nationkey % 2 = 0 THEN 'Hamilton' WHEN c_nationkey % 3 = 0 THEN 'Butler' END AS county FROM customer""",
)
def _(t: Tables):
    rows = t.sql(
        """SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'OH' WHEN 1 THEN 'KY' ELSE 'IN' END AS st,
        CASE c_nationkey % 2 WHEN 0 THEN '061' ELSE '017' END AS fips FROM customer"""
    )
    out = rows.withColumn("name", names.state_name("st"))
    return out.select(
        "c_custkey", "name", names.state_code("name").alias("code"), names.county_name("name", "fips").alias("county")
    )


@query(
    "level_label",
    """SELECT state AS "County", coalesce(county, 'All') AS "Municipality", coalesce(zip, 'All') AS "Neighborhood",
    CASE WHEN zip IS NOT NULL THEN 'Neighborhood' WHEN county IS NOT NULL THEN 'Municipality' ELSE 'County' END AS "Level",
    CASE WHEN zip IS NOT NULL THEN zip WHEN county IS NOT NULL THEN county ELSE state END AS "Label" FROM px_patient""",
)
def _(t: Tables):
    from areaspark.operators import benchmark

    rows = t.px_patient.select(
        F.col("state").alias("County"),
        F.coalesce("county", F.lit("All")).alias("Municipality"),
        F.coalesce("zip", F.lit("All")).alias("Neighborhood"),
    )
    return benchmark.level_and_label(rows)
