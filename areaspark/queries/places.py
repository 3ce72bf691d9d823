"""Points, polygons and place lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaspark import session
from areaspark.operators import address, benchmark, overlay, placelists, spatial
from areaspark.plans import cohorts, earlier_asthma, locate, survey
from areaspark.queries import indicators, people, shapes
from areaspark.queries.indicators import AREA, KEYS, r6
from areaspark.queries.registry import Tables, query, view
from areaspark.queries.shapes import CITY
from areaspark.sources import readers

MUNI = ["County", "Municipality"]
people.hits("ox_point_hits", "px_points", "ID, X, Y", "px_edges_muni", "County, Municipality")


@query("spatial_join_inner", "SELECT ID, County, Municipality FROM ox_point_hits")
def _(t: Tables):
    return spatial.points_in_polygons(t.px_points, t.px_edges_muni, MUNI).select("ID", *MUNI)


@query(
    "spatial_join_left",
    """SELECT p.ID, h.County, h.Municipality FROM (SELECT ID FROM px_points UNION ALL SELECT -1) p LEFT JOIN ox_point_hits h ON p.ID = h.ID""",
)
def _(t: Tables):
    far = t.sql("SELECT DISTINCT CAST(-1 AS BIGINT) AS ID, CAST(99 AS DOUBLE) AS X, CAST(99 AS DOUBLE) AS Y FROM customer")
    return spatial.points_in_polygons(t.px_points.unionByName(far), t.px_edges_muni, MUNI, how="left").select("ID", *MUNI)


@query(
    "spatial_join_poly_left",
    """SELECT e.County, e.Municipality, h.ID FROM (SELECT DISTINCT County, Municipality FROM px_edges_muni UNION ALL SELECT 'FAR', 'Empty') e
    LEFT JOIN ox_point_hits h ON e.County = h.County AND e.Municipality = h.Municipality""",
)
def _(t: Tables):
    # one more polygon that no point falls into
    empty = t.px_edges_muni.where("Municipality = 'Overlap'").select(
        F.lit("FAR").alias("County"), F.lit("Empty").alias("Municipality"), *[(F.col(c) + 50).alias(c) for c in spatial.EDGE]
    )
    edges = t.px_edges_muni.unionByName(empty)
    return spatial.polygons_with_points(
        t.px_points, edges, MUNI, keep=lambda df: session.keep(df, "matched")
    ).select(*MUNI, "ID")


@query("spatial_ambiguity_drop", "SELECT ID, min(County) AS County, min(Municipality) AS Municipality FROM ox_point_hits GROUP BY ID HAVING count(*) = 1")
def _(t: Tables):
    placed = spatial.points_in_polygons(t.px_points, t.px_edges_muni, MUNI).select("ID", *MUNI)
    return locate.unambiguous(placed, ["ID"])


view(
    "ox_ambiguous",
    """SELECT h.ID, h.X, h.Y, CASE WHEN h.County IN ('AFRICA', 'AMERICA') THEN 'Ohio' WHEN h.County IN ('ASIA', 'EUROPE') THEN 'Kentucky' ELSE 'Indiana' END AS State, h.County, h.Municipality
    FROM ox_point_hits h JOIN (SELECT ID FROM ox_point_hits GROUP BY ID HAVING count(*) > 1) m ON h.ID = m.ID""",
)
view("ox_spots_ambiguous", "SELECT DISTINCT ID, X, Y FROM ox_ambiguous")
people.hits("ox_tract_hits", "ox_spots_ambiguous", "ID, X, Y", "px_edges_tract", "GEOID")


@query(
    "spatial_crosswalk_fallback",
    """SELECT a.ID, a.State, a.County, a.Municipality FROM ox_ambiguous a JOIN ox_crosswalk c ON a.State = c.State AND a.County = c.County AND a.Municipality = c.Municipality
    JOIN (SELECT DISTINCT ID, GEOID FROM ox_tract_hits) t ON t.ID = a.ID AND t.GEOID = c.GEOID""",
)
def _(t: Tables):
    placed = t.kept("placed", lambda: spatial.points_in_polygons(t.px_points, t.px_edges_muni, MUNI))
    several = placed.groupBy("ID").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ID")
    state = (
        F.when(F.col("County").isin("AFRICA", "AMERICA"), "Ohio").when(F.col("County").isin("ASIA", "EUROPE"), "Kentucky").otherwise("Indiana")
    )
    ambiguous = placed.join(several, "ID", "left_semi").withColumn("State", state)
    return locate.resolve_by_crosswalk(ambiguous, t.px_edges_tract, indicators.crosswalk(t))


def outline(name: str, edges: str, keys: str) -> None:
    """Brute force: every corner of a group against every edge of it; pieces that occur once."""
    own = " AND ".join(f"e.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    named = ", ".join(f"e.{k.strip()}" for k in keys.split(","))
    view(
        f"{name}_stops",
        f"""SELECT {keys}, x1, y1, x2, y2, x1 AS x, y1 AS y, 0 AS t FROM {edges} UNION ALL SELECT {keys}, x1, y1, x2, y2, x2, y2, 1 FROM {edges}
        UNION ALL SELECT {named}, x1, y1, x2, y2, c.x, c.y, ((c.x - x1) * (x2 - x1) + (c.y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)
        FROM {edges} e JOIN (SELECT {keys}, x1 AS x, y1 AS y FROM {edges} UNION SELECT {keys}, x2, y2 FROM {edges}) c ON {own}
        WHERE (c.x - x1) * (y2 - y1) = (c.y - y1) * (x2 - x1) AND (c.x - x1) * (c.x - x2) + (c.y - y1) * (c.y - y2) < 0""",
    )
    view(
        name,
        f"""SELECT {keys}, min(x1) AS x1, min(y1) AS y1, min(x2) AS x2, min(y2) AS y2 FROM (
          SELECT {keys}, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM {name}_stops WINDOW w AS (PARTITION BY {keys}, x1, y1, x2, y2 ORDER BY t)
        ) WHERE x2 IS NOT NULL
        GROUP BY {keys}, least(x1 * 1000 + y1, x2 * 1000 + y2), greatest(x1 * 1000 + y1, x2 * 1000 + y2) HAVING count(*) = 1""",
    )


view("ox_walls", "SELECT County, x1, y1, x2, y2 FROM px_edges_muni WHERE County <> 'EXTRA' UNION ALL SELECT County, x1, y1, x2, y2 FROM px_edges_brick")
outline("ox_outline", "ox_walls", "County")


# counties are columns of the grid, so dissolving them removes the inner borders; bricks share parts of their sides
@query(
    "poly_dissolve",
    """SELECT County, x1, y1, x2, y2, coalesce(n, 0) AS residents FROM ox_outline o LEFT JOIN
    (SELECT County AS c, count(*) AS n FROM ox_point_hits GROUP BY County) h ON o.County = h.c""",
)
def _(t: Tables):
    walls = t.px_edges_muni.where("County <> 'EXTRA'").select("County", *spatial.EDGE).unionByName(t.px_edges_brick)
    borders = overlay.dissolve(walls, ["County"])
    residents = spatial.points_in_polygons(t.px_points, t.px_edges_muni, MUNI).groupBy("County").agg(F.count(F.lit(1)).alias("n"))
    return borders.join(residents, "County", "left").select("County", "x1", "y1", "x2", "y2", F.coalesce("n", F.lit(0)).alias("residents"))


_CENTROID = """SELECT {k}, abs(sum(x1 * y2 - x2 * y1)) / 2 AS size, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / nullif(3 * sum(x1 * y2 - x2 * y1), 0) AS X,
    sum((y1 + y2) * (x1 * y2 - x2 * y1)) / nullif(3 * sum(x1 * y2 - x2 * y1), 0) AS Y FROM {e} GROUP BY {k}"""


@query(
    "poly_centroid",
    f"""SELECT c.County, c.Municipality, round(size, 6) AS size, round(X, 6) AS X, round(Y, 6) AS Y, n FROM ({_CENTROID.format(k='County, Municipality', e='px_edges_muni')}) c
    JOIN (SELECT County, Municipality, count(*) AS n FROM ox_point_hits GROUP BY 1, 2) h ON c.County = h.County AND c.Municipality = h.Municipality""",
)
def _(t: Tables):
    centre = spatial.centroids(t.px_edges_muni, MUNI)
    placed = spatial.points_in_polygons(t.px_points, t.px_edges_muni, MUNI).groupBy(*MUNI).agg(F.count(F.lit(1)).alias("n"))
    return r6(centre.join(placed, MUNI), "size", "X", "Y")


def sphere_sql(keys: str, edges: str) -> str:
    """Arcs (below a quarter turn) from the sine of the angle between their ends, areas from the solid angles of the triangles with the pole."""
    return f"""SELECT {keys}, abs(sum(2 * atan2(ax * b_y - ay * bx, 1 + az + bz + ax * bx + ay * b_y + az * bz))) AS size,
      degrees(atan2(sum(w * ny) * s, sum(w * nx) * s)) AS X, degrees(atan2(sum(w * nz) * s, sqrt(sum(w * nx) ** 2 + sum(w * ny) ** 2))) AS Y FROM (
        SELECT *, asin(least(1, sqrt(nx ** 2 + ny ** 2 + nz ** 2))) / sqrt(nx ** 2 + ny ** 2 + nz ** 2) AS w, 1 AS s FROM (
          SELECT *, ay * bz - az * b_y AS nx, az * bx - ax * bz AS ny, ax * b_y - ay * bx AS nz FROM (
            SELECT {keys}, cos(radians(y1)) * cos(radians(x1)) AS ax, cos(radians(y1)) * sin(radians(x1)) AS ay, sin(radians(y1)) AS az,
              cos(radians(y2)) * cos(radians(x2)) AS bx, cos(radians(y2)) * sin(radians(x2)) AS b_y, sin(radians(y2)) AS bz FROM {edges})))
    GROUP BY {keys}, s"""


# the same areas with their corners taken as longitude and latitude
@query(
    "poly_centroid_sphere",
    f"""SELECT c.County, c.Municipality, round(size, 8) AS size, round(X, 6) AS X, round(Y, 6) AS Y, n FROM ({sphere_sql('County, Municipality', 'px_edges_muni')}) c
    JOIN (SELECT County, Municipality, count(*) AS n FROM ox_point_hits GROUP BY 1, 2) h ON c.County = h.County AND c.Municipality = h.Municipality""",
)
def _(t: Tables):
    centre = overlay.sphere_centroids(t.px_edges_muni, MUNI)
    placed = spatial.points_in_polygons(t.px_points, t.px_edges_muni, MUNI).groupBy(*MUNI).agg(F.count(F.lit(1)).alias("n"))
    return r6(centre.join(placed, MUNI), "X", "Y").withColumn("size", F.round("size", 8))


_FIXED = {"Nation_5": (9.5, 9.25), "Nation_6": (None, 7.75)}


@query(
    "centroid_override",
    f"""SELECT c.Municipality, round(CASE WHEN c.Municipality = 'Nation_5' THEN 9.5 ELSE X END, 6) AS X, round(CASE c.Municipality WHEN 'Nation_5' THEN 9.25 WHEN 'Nation_6' THEN 7.75 ELSE Y END, 6) AS Y, n
    FROM ({_CENTROID.format(k='Municipality', e='px_edges_muni')}) c JOIN (SELECT Municipality, count(*) AS n FROM ox_point_hits GROUP BY 1) h ON c.Municipality = h.Municipality""",
)
def _(t: Tables):
    centre = locate.centroid_override(spatial.centroids(t.px_edges_muni, ["Municipality"]), _FIXED, "Municipality").drop("size")
    placed = spatial.points_in_polygons(t.px_points, t.px_edges_muni, MUNI).groupBy("Municipality").agg(F.count(F.lit(1)).alias("n"))
    return r6(centre.join(placed, "Municipality"), "X", "Y")


outline("ox_hoods", "px_edges_hood", "Neighborhood")
view(
    "ox_outlines",
    """SELECT 'AFRICA' AS County, 'Nation_0' AS Municipality, Neighborhood, x1, y1, x2, y2 FROM ox_hoods
    UNION ALL SELECT County, Municipality, Municipality, x1, y1, x2, y2 FROM px_edges_muni""",
)


def _dimension_sql(centroid: str) -> str:
    return f"""SELECT {KEYS}, HoodID, {indicators._TIER.format('value')} AS Tier, round(X, 6) AS X, round(Y, 6) AS Y FROM ox_areas JOIN ox_di USING ({KEYS})
    JOIN ({centroid}) c USING ({KEYS})"""


def _dimension(t: Tables, sphere: bool):
    hoods = overlay.dissolve(t.px_edges_hood, ["Neighborhood"]).select(
        F.lit(CITY.county).alias("County"), F.lit(CITY.name).alias("Municipality"), "Neighborhood", *spatial.EDGE
    )
    munis = t.px_edges_muni.select(*MUNI, F.col("Municipality").alias("Neighborhood"), *spatial.EDGE)
    tiers = indicators.di(t).select(*AREA, benchmark.tier(F.col("value")).alias("Tier"))
    out = locate.area_dimension(survey.areas(indicators.kept_hub(t)), tiers, hoods.unionByName(munis), AREA, sphere)
    return r6(out, "X", "Y").select(*AREA, "HoodID", "Tier", "X", "Y")


@query("area_dimension", _dimension_sql(_CENTROID.format(k=KEYS, e="ox_outlines")))
def _(t: Tables):
    return _dimension(t, sphere=False)


@query("area_dimension_sphere", _dimension_sql(sphere_sql(KEYS, "ox_outlines")))
def _(t: Tables):
    return _dimension(t, sphere=True)


# --- earlier chain: neighbourhoods through block groups, addresses to area totals --------------------

view("ox_city_points", "SELECT ID, X, Y FROM ox_point_hits WHERE ID IN (SELECT ID FROM ox_point_hits GROUP BY ID HAVING count(*) = 1) AND Municipality = 'Nation_0'")
view("ox_bg_edges", "SELECT GEOID, x1, y1, x2, y2 FROM px_edges_bg WHERE County = 'AFRICA'")


def blockgroup_view(name: str, points: str) -> None:
    """Brute force over the block groups of the city's county; points with one neighbourhood."""
    people.hits(f"{name}_hits", points, "ID, X, Y", "ox_bg_edges", "GEOID")
    view(
        name,
        f"""SELECT ID, min(Neighborhood) AS Neighborhood FROM {name}_hits h JOIN px_bg_hood a ON h.GEOID = a.GEOID WHERE Municipality = 'Nation_0'
        GROUP BY ID HAVING count(DISTINCT Neighborhood) = 1""",
    )


blockgroup_view("ox_bg_placed", "ox_city_points")


@query("spatial_blockgroup_hood", "SELECT ID, 'Ohio' AS State, 'AFRICA' AS County, 'Nation_0' AS Municipality, Neighborhood FROM ox_bg_placed")
def _(t: Tables):
    placed = locate.unambiguous(spatial.points_in_polygons(t.px_points, t.px_edges_muni, MUNI).select("ID", "X", "Y", *MUNI), ["ID"])
    inside = placed.where(F.col("Municipality") == CITY.name)
    return earlier_asthma.blockgroup_hood(inside, t.px_edges_bg, t.px_bg_hood, CITY, cell=0.05)


_REGION = {"Ohio": ["AFRICA", "AMERICA"], "Kentucky": ["ASIA", "EUROPE"], "Indiana": ["MIDDLE-EAST"]}
_CODES = {("Ohio", "061"): "AFRICA", ("Ohio", "017"): "AMERICA", ("Kentucky", "015"): "ASIA", ("Kentucky", "037"): "EUROPE", ("Indiana", "029"): "MIDDLE-EAST"}
_E4 = "State, County, Municipality, Neighborhood"
_CLEAN = """upper(city) AS City, state, left(zip, 5) AS Zip,
    regexp_replace(upper(coalesce(add_line_1, add_line_2)), '(APT|#|UNIT).*', '') AS Address"""
view(
    "ox_a_rows",
    f"""SELECT {_CLEAN}, 1 AS r, 0 AS a FROM (SELECT DISTINCT p.* FROM px_patient p WHERE pat_id IN (SELECT networked_id FROM px_record JOIN px_membership USING (record_id)
        JOIN px_config USING (registry_id) WHERE status_c = 1 AND contains(registry_name, 'click'))
      AND NOT contains(add_line_1, '222 E') AND datediff('day', birth_date, DATE '{people.AS_OF}') / 385.25 < 18
      AND (CASE state WHEN 'Ohio' THEN county IN ('AFRICA', 'AMERICA') WHEN 'Kentucky' THEN county IN ('ASIA', 'EUROPE') WHEN 'Indiana' THEN county = 'MIDDLE-EAST' ELSE false END
        OR (state IN ('Ohio', 'Kentucky', 'Indiana') AND county IS NULL)))
    UNION ALL SELECT {_CLEAN}, 0, 1 FROM px_network WHERE year(hosp_admsn_time) = 1997 AND asthma_admission = 1 AND NOT contains(add_line_1, '222 E')
      AND (CASE state WHEN 'Ohio' THEN countyfp IN ('061', '017') WHEN 'Kentucky' THEN countyfp IN ('015', '037') WHEN 'Indiana' THEN countyfp = '029' ELSE false END
        OR (state IN ('Ohio', 'Kentucky', 'Indiana') AND countyfp IS NULL))""",
)
view("ox_a_unique", "SELECT *, row_number() OVER () AS ID FROM (SELECT DISTINCT City, state, Zip, Address FROM ox_a_rows)")
view(
    "ox_a_points",
    f"SELECT ID, lon AS X, lat AS Y FROM (SELECT ID, {', '.join(f'{e} AS {c}' for c, e in shapes.GEOCODED.items())} FROM ox_a_unique) WHERE precision = 'range' AND geocode_result <> 'imprecise_geocode'",
)
people.hits("ox_a_hits", "ox_a_points", "ID, X, Y", "px_edges_places", "State, County, Municipality")
view("ox_a_several", "SELECT ID FROM ox_a_hits GROUP BY ID HAVING count(*) > 1")
view("ox_a_border", "SELECT DISTINCT ID, X, Y FROM ox_a_hits WHERE ID IN (FROM ox_a_several)")
people.hits("ox_a_tracts", "ox_a_border", "ID, X, Y", "px_edges_tract", "GEOID")
view("ox_a_city", "SELECT ID, X, Y FROM ox_a_hits WHERE ID NOT IN (FROM ox_a_several) AND Municipality = 'Nation_0'")
blockgroup_view("ox_a_hoods", "ox_a_city")
view(
    "ox_a_placed",
    """SELECT ID, State, County, Municipality, CAST(NULL AS VARCHAR) AS Neighborhood FROM ox_a_hits WHERE ID NOT IN (FROM ox_a_several) AND Municipality <> 'Nation_0'
    UNION ALL SELECT h.ID, h.State, h.County, h.Municipality, NULL FROM ox_a_hits h JOIN (SELECT DISTINCT ID, GEOID FROM ox_a_tracts) t ON h.ID = t.ID
      JOIN ox_crosswalk c ON c.GEOID = t.GEOID AND c.State = h.State AND c.County = h.County AND c.Municipality = h.Municipality
    UNION ALL SELECT ID, 'Ohio', 'AFRICA', 'Nation_0', Neighborhood FROM ox_a_hoods""",
)
view(
    "ox_a_sums",
    f"""SELECT {_E4}, sum(r) AS r, sum(a) AS a FROM (SELECT p.*, u.City, u.Address, u.Zip, u.state AS st FROM ox_a_placed p JOIN ox_a_unique u ON p.ID = u.ID) k
    JOIN ox_a_rows w ON w.City IS NOT DISTINCT FROM k.City AND w.state IS NOT DISTINCT FROM k.st AND w.Zip IS NOT DISTINCT FROM k.Zip AND w.Address IS NOT DISTINCT FROM k.Address
    GROUP BY k.State, k.County, k.Municipality, k.Neighborhood""".replace(f"SELECT {_E4}, sum(r)", "SELECT k.State, k.County, k.Municipality, k.Neighborhood, sum(r)"),
)
view(
    "ox_a_levels",
    f"""WITH l AS (SELECT {_E4}, r, a FROM ox_a_sums WHERE Neighborhood <> 'All' UNION ALL SELECT State, County, Municipality, 'All', sum(r), sum(a) FROM ox_a_sums GROUP BY 1, 2, 3
      UNION ALL SELECT State, County, 'All', 'All', sum(r), sum(a) FROM ox_a_sums GROUP BY 1, 2 UNION ALL SELECT 'All', 'All', 'All', 'All', sum(r), sum(a) FROM ox_a_sums)
    SELECT {_E4}, Children, CAST(coalesce(r, 0) AS BIGINT) AS AsthmaRegistry, CAST(coalesce(a, 0) AS BIGINT) AS AsthmaAdmissions,
    coalesce(coalesce(r, 0) / nullif(Children, 0), 0) AS AsthmaRegistryRate, coalesce(coalesce(a, 0) / nullif(Children, 0), 0) AS AsthmaAdmissionRate
    FROM l RIGHT JOIN px_e_children USING ({_E4})""",
)


def placed_patients(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Patients with the identity of their address, and where these addresses are."""
    wanted = F.col("registry_name").like("%click%")
    registry = earlier_asthma.registry_rows(t.px_config, t.px_membership, t.px_record, t.px_patient, wanted, people.AS_OF, _REGION)
    admitted = earlier_asthma.admission_rows(t.px_network, 1997, _CODES)
    patients = session.keep(earlier_asthma.with_address(registry.unionByName(admitted)), "patients")
    unique = patients.select("ID", *earlier_asthma.PARTS).distinct()
    geocoded = address.precise_only(unique.select("ID", *[F.expr(e).alias(c) for c, e in shapes.GEOCODED.items()]))
    placed = earlier_asthma.places(
        geocoded.select("ID", F.col("lon").alias("X"), F.col("lat").alias("Y")), t.px_edges_places, t.px_edges_tract, t.px_edges_bg,
        indicators.crosswalk(t), t.px_bg_hood, CITY, cell=0.1, keep=lambda df: session.keep(df, "municipalities"),
    )
    return patients, placed


_ASTHMA = ["AsthmaRegistryRate", "AsthmaAdmissionRate"]


@query("asthma_pipeline", f"SELECT {_E4}, Children, AsthmaRegistry, AsthmaAdmissions, {', '.join(f'round({c}, 6) AS {c}' for c in _ASTHMA)} FROM ox_a_levels")
def _(t: Tables):
    patients, placed = placed_patients(t)
    levels = cohorts.earlier_area_totals(earlier_asthma.back_to_patients(patients, placed), t.px_e_children)
    return r6(levels, *_ASTHMA).select(*earlier_asthma.AREA, "Children", "AsthmaRegistry", "AsthmaAdmissions", *_ASTHMA)


_LEVELS = [*indicators._LM, *_ASTHMA]
view(
    "ox_ea",
    f"""WITH l AS (SELECT {_E4}, r, a FROM ox_a_sums WHERE Neighborhood <> 'All' UNION ALL SELECT State, County, Municipality, 'All', sum(r), sum(a) FROM ox_a_sums GROUP BY 1, 2, 3
      UNION ALL SELECT State, County, 'All', 'All', sum(r), sum(a) FROM ox_a_sums GROUP BY 1, 2 UNION ALL SELECT 'All', 'All', 'All', 'All', sum(r), sum(a) FROM ox_a_sums),
    c AS (SELECT e.*, w.Children FROM ox_e_labelled e JOIN ox_e_wide w ON e.State = w.State AND e.County = w.County AND e.Municipality = coalesce(w.Municipality, 'All')
      AND e.Neighborhood = coalesce(w.Neighborhood, 'All'))
    SELECT c.*, coalesce(coalesce(r, 0) / nullif(Children, 0), 0) AS AsthmaRegistryRate, coalesce(coalesce(a, 0) / nullif(Children, 0), 0) AS AsthmaAdmissionRate
    FROM l RIGHT JOIN c USING ({_E4})""",
)
view("ox_ea_long", " UNION ALL ".join(f"SELECT Level, County, Municipality, Neighborhood, '{m}' AS variable, {m} AS value FROM ox_ea" for m in _LEVELS))
view(
    "ox_ea_bench",
    """SELECT Level, variable, Mean, Minimum, Maximum FROM (SELECT 'Municipality' AS Level, variable, value AS Mean FROM ox_ea_long WHERE County = 'All'
      UNION ALL SELECT 'County', variable, value FROM ox_ea_long WHERE County = 'All' UNION ALL SELECT 'Neighborhood', variable, value FROM ox_ea_long WHERE Municipality = 'Nation_0' AND Neighborhood = 'All') m
    JOIN (SELECT Level, variable, min(value) AS Minimum, max(value) AS Maximum FROM ox_ea_long GROUP BY 1, 2) e USING (Level, variable)""",
)
_SHARES = ", ".join(f"'{m}'" for m in benchmark.RAW_SCALE_RATES)


# the level benchmarks of all measures, the asthma rates among them
@query(
    "bench_level_asthma",
    f"""SELECT r.Level, r.County, r.Municipality, r.Neighborhood, r.variable, round(Mean, 5) AS Mean,
    round(CASE WHEN r.variable IN ({_SHARES}) THEN value ELSE (value - Minimum) / nullif(Maximum - Minimum, 0) END, 5) AS Scale,
    round(CASE WHEN value > Mean THEN (value - Mean) / nullif(Maximum - Mean, 0) WHEN value IS NULL OR Mean IS NULL THEN NULL ELSE (value - Mean) / nullif(Mean - Minimum, 0) END, 5) AS Shade
    FROM ox_ea_long r JOIN ox_ea_bench b ON r.Level = b.Level AND r.variable = b.variable WHERE r.County <> 'All'""",
)
def _(t: Tables):
    patients, placed = placed_patients(t)
    census = t.kept("census", lambda: indicators.labelled(t).drop("Level", "Label"))
    both = cohorts.earlier_area_totals(earlier_asthma.back_to_patients(patients, placed), census.select(*earlier_asthma.AREA, "Children", *indicators._LM))
    rows = t.kept("levels_asthma", lambda: benchmark.level_and_label(both))
    bench = benchmark.level_benchmarks(rows, _LEVELS, CITY.name, benchmark.PAIRING_METRO_LABELLED_COUNTY)
    long = rows.where("County <> 'All'").select("Level", *AREA, *_LEVELS).unpivot(["Level", *AREA], _LEVELS, "variable", "value")
    out = benchmark.compare_levels(long, bench)
    return out.select("Level", *AREA, "variable", *[F.round(c, 5).alias(c) for c in ("Mean", "Scale", "Shade")])


_PLACES = """SELECT c_name AS Name, CASE WHEN c_custkey % 2 = 0 THEN 'School' ELSE 'Pharmacy' END AS Type,
    CASE WHEN c_acctbal < 0 THEN NULL ELSE ((c_custkey * 7919) % 1000) / 200 END AS X, ((c_custkey * 104729) % 1000) / 200 AS Y, c_mktsegment AS Address FROM customer"""
view(
    "ox_places",
    """SELECT c_name AS Name, CASE WHEN c_custkey % 2 = 0 THEN 'School' ELSE 'Pharmacy' END AS Type, c_mktsegment AS Address, h.County, h.Municipality
    FROM customer JOIN ox_point_hits h ON c_custkey = h.ID WHERE c_acctbal >= 0""",
)


@query(
    "points_in_area",
    """SELECT 'all' AS map, Name, Type, Address, County, Municipality FROM ox_places UNION ALL SELECT 'city', Name, Type, Address, County, Municipality FROM ox_places
    WHERE Municipality IN ('Nation_0', 'Nation_1', 'Nation_2', 'Nation_3 Township') OR Type = 'School'""",
)
def _(t: Tables):
    located, city = locate.points_in_area(
        t.sql(_PLACES), t.px_edges_muni, CITY, keep=lambda df: session.keep(df, "places")
    )
    cols = ["Name", "Type", "Address", *MUNI]
    return located.select(F.lit("all").alias("map"), *cols).unionByName(city.select(F.lit("city").alias("map"), *cols))


# --- place lists ---------------------------------------------------------------------

_NUM = "nullif(regexp_extract({0}, '[0-9]+'), '')"
_W = [*[f"w[{i}]" for i in range(1, 12)], "nullif(array_to_string(w[12:], ' '), '')"]
_SCHOOL = f"""WITH l AS (SELECT value, string_split(value, ' ') AS w FROM px_school_lines),
    n AS (SELECT *, CASE WHEN w[2] = 'Promise' THEN '5425' ELSE coalesce({', '.join(_NUM.format(c) for c in _W[2:9])}) END AS num FROM l),
    p AS (SELECT *, coalesce(list_position(w[3:7], num), 0) AS pos FROM n),
    m AS (SELECT *, CASE WHEN num IS NULL OR (pos = 0 AND len(w) < 7) THEN NULL ELSE array_to_string(w[1:CASE WHEN pos = 0 THEN 7 ELSE 1 + pos END], ' ') END AS nm,
      array_to_string([{', '.join(f"coalesce({c}, 'NA')" for c in _W)}], ' ') AS combo FROM p),
    c AS (SELECT *, trim(CASE WHEN instr(rest1, num) > 0 THEN substring(rest1, 1, CAST(instr(rest1, num) AS BIGINT) - 1) || substring(rest1, CAST(instr(rest1, num) + length(num) AS BIGINT)) ELSE rest1 END) AS rest FROM
      (SELECT *, CASE WHEN instr(combo, nm) > 0 THEN substring(combo, 1, CAST(instr(combo, nm) AS BIGINT) - 1) || substring(combo, CAST(instr(combo, nm) + length(nm) AS BIGINT)) ELSE combo END AS rest1 FROM m)),
    s AS (SELECT DISTINCT num, CASE WHEN w[2] = 'Promise' THEN 'Winton Ridge Lane' ELSE string_split(rest, ',')[1] END AS street,
      CASE WHEN nm = 'Mt. Washington School' THEN '45230' ELSE string_split(trim(string_split(rest, ',')[3]), ' ')[2] END AS zip,
      CASE WHEN w[2] = 'Promise' THEN 'The Promise Center' WHEN contains(nm, 'Aiken') THEN 'Aiken High School' WHEN contains(nm, 'Gamble Montessori Elementary') THEN 'Gamble Montessori Elementary School' ELSE nm END AS nm FROM c)
    SELECT nm AS Name, coalesce(num, 'NA') || ' ' || coalesce(street, 'NA') AS Address, 'Cincinnati' AS City, 'OH' AS State, zip AS Zip, 'School' AS Type FROM s
    WHERE nm IS NULL OR nm NOT IN ('Cincinnati Digital Academy', 'Virtual High School', 'Hospital/Satellite Program Office')"""


@query("parse_school_lines", _SCHOOL)
def _(t: Tables):
    lines = readers.token_columns(t.px_school_lines, placelists.SCHOOL_COLUMNS, surplus="merge")
    return placelists.parse_schools(lines)


def _merge(col: str, n: int, sep: str) -> list[str]:
    """Pieces of a text split n ways, the remainder joined in the last."""
    w = f"string_split({col}, '{sep}')"
    return [*[f"{w}[{i}]" for i in range(1, n)], f"CASE WHEN len({w}) >= {n} THEN array_to_string({w}[{n}:], '{sep}') END"]


def _cols(exprs: list[str], names_: list[str]) -> str:
    return ", ".join(f"{e} AS {n}" for e, n in zip(exprs, names_))


_COMMA = "contains({0}, ',')"
_ROOMS = "regexp_replace({0}, '(SUITE| STE| ROOM| PO | RM ).*', '')"
_NEWER = f"""WITH a AS (SELECT pharmacy_id, {_cols(_merge('pharmacy_name', 3, '-'), ['n1', 'n2', 'n3'])} FROM px_pharmacy),
    b AS (SELECT *, CASE WHEN n2 IS NULL THEN NULL WHEN n2 = '' THEN n3 ELSE n2 END AS m2 FROM a),
    c AS (SELECT *, trim(CASE WHEN m2 IS NULL THEN NULL WHEN {_COMMA.format('m2')} THEN m2 ELSE n3 END) AS blk FROM b),
    d AS (SELECT *, {_cols(_merge('blk', 4, '-'), ['c1', 'c2', 'c3', 'c4'])} FROM c),
    e AS (SELECT *, CASE WHEN {_COMMA.format('c1')} THEN c1 WHEN {_COMMA.format('c2')} THEN trim(c2) WHEN {_COMMA.format('c3')} THEN trim(c3) END AS place FROM d),
    f AS (SELECT *, string_split(place, ',') AS pl, trim({_ROOMS.format('c3')}) AS u, CASE WHEN contains(c4, 'NON E-RX') THEN NULL ELSE string_split(trim(c4), ',')[1] END AS a3 FROM e WHERE place IS NOT NULL),
    g AS (SELECT *, trim(coalesce(pl[4], pl[3], pl[2])) AS st, coalesce(regexp_matches(u, '^[1-9]'), false) AS isnum FROM f),
    h AS (SELECT *, coalesce(CASE WHEN isnum AND length(u) >= 4 THEN u END, a3, trim(CASE WHEN isnum OR u IS NULL THEN c2 ELSE coalesce(c2, 'NA') || ' ' || u END), n3) AS addr FROM g)
    SELECT n1 AS Name, trim(regexp_replace(addr, '( AT | STE| SUITE ).*', '')) AS Address, pl[1] AS City, st AS State, CAST(NULL AS VARCHAR) AS Zip, 'Pharmacy' AS Type FROM h WHERE st IN ('OH', 'KY', 'IN')"""


def _numbered(c: str) -> str:
    return f"starts_with({c}, {_NUM.format(c)})"


_OLDER = f"""WITH a AS (SELECT pharmacy_id, {_cols(_merge('pharmacy_name', 3, '-'), ['n1', 'n2', 'n3x'])} FROM px_pharmacy WHERE record_state_name IS NULL OR record_state_name = 'Active'),
    a2 AS (SELECT *, {_cols(_merge('n3x', 3, '--'), ['n3', 'n4', 'n5'])} FROM a),
    b AS (SELECT *, CASE WHEN n2 IS NULL THEN NULL WHEN n2 = '' THEN n3 ELSE n2 END AS m2 FROM a2),
    c AS (SELECT *, trim(CASE WHEN m2 IS NULL THEN NULL WHEN {_COMMA.format('m2')} THEN m2 ELSE n3 END) AS blk FROM b),
    d AS (SELECT *, string_split(blk, '-') AS w FROM c),
    e AS (SELECT *, CASE WHEN {_COMMA.format('w[1]')} THEN trim(w[1]) WHEN {_COMMA.format('w[2]')} THEN trim(w[2]) WHEN {_COMMA.format('w[3]')} THEN w[3] WHEN {_COMMA.format('w[4]')} THEN w[4]
      WHEN {_COMMA.format('w[5]')} THEN w[5] END AS place FROM d),
    f AS (SELECT *, string_split(place, ',')[1] AS City, trim(string_split(place, ',')[2]) AS State, trim(string_split(n3, ' AT ')[1]) AS s0 FROM e WHERE place IS NOT NULL),
    g AS (SELECT *, CASE WHEN {_numbered('s0')} THEN s0 WHEN NOT {_numbered('s0')} THEN trim(n4) END AS s1 FROM f WHERE State IN ('OH', 'IN', 'KY')),
    h AS (SELECT *, CASE WHEN {_numbered('s1')} IS NULL THEN trim(w[2]) ELSE s1 END AS s2 FROM g),
    i AS (SELECT *, CASE WHEN {_numbered('s2')} THEN s2 WHEN NOT {_numbered('s2')} THEN trim(w[3]) END AS s3 FROM h)
    SELECT pharmacy_id, n1 AS name, s3 AS Address, City, State FROM i WHERE {_numbered('s3')}"""


@query(
    "parse_pharmacy_names",
    f"""SELECT 'newer' AS variant, Name AS name, Address, City, State FROM ({_NEWER}) UNION ALL SELECT 'older', name, Address, City, State FROM ({_OLDER})""",
)
def _(t: Tables):
    newer = placelists.parse_pharmacies(t.px_pharmacy).select(F.lit("newer").alias("variant"), F.col("Name").alias("name"), "Address", "City", "State")
    active = t.px_pharmacy.where("record_state_name IS NULL OR record_state_name = 'Active'")
    older = placelists.parse_pharmacies_earlier(active).select(F.lit("older").alias("variant"), "name", "Address", "City", "State")
    return newer.unionByName(older)

