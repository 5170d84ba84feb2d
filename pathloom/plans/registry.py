"""Registered queries over the derived road network, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, tags
from ..operators import cells, network, route, search, snap, stats
from ..sources import derived, store
from . import engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NET = f"WITH RECURSIVE {derived.SQL}"
GRID = """, ext AS (SELECT min(lat) AS a, max(lat) AS b, min(lng) AS c, max(lng) AS d FROM vertices),
cel AS (SELECT vertex_id, CAST(floor((lat - a) * 4 / (b - a + 1.0)) * 4 + floor((lng - c) * 4 / (d - c + 1.0)) AS INT) AS cell_id FROM vertices, ext),
ce AS (SELECT edges.*, s.cell_id AS src_cell, t.cell_id AS dst_cell FROM edges JOIN cel s ON src = s.vertex_id JOIN cel t ON dst = t.vertex_id),
bd AS (SELECT src_cell AS cell_id, src AS vertex_id FROM ce WHERE src_cell <> dst_cell UNION SELECT dst_cell, dst FROM ce WHERE src_cell <> dst_cell)"""


def _darts_sql(mode: str, name: str = "darts", backward: bool = False) -> str:
    a, b = ("dst", "src") if backward else ("src", "dst")
    return f"{name} AS (SELECT {a} AS src, {b} AS dst, edge_id, distance AS weight FROM edges WHERE {mode} UNION ALL SELECT {b}, {a}, edge_id, distance FROM edges WHERE {mode}{'' if mode == 'foot' else ' AND NOT oneway'})"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.settled(derived.ways(spark, sf_dir))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    w = ways(spark, sf_dir)
    return network.build(w, derived.nodes(w))


def settled_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v, e = graph(spark, sf_dir)
    return search.settled(v), search.settled(e)


@query(NET + " SELECT way_id, CAST(CASE WHEN highway IS NULL AND junction IS NULL AND route IS NULL THEN 0 ELSE mask END AS INT) AS mask FROM am")
def tag_access_mask(spark, d):
    return ways(spark, d).select("way_id", tags.access_mask(F.col("tags")).alias("mask"))


@query(NET + " SELECT am.way_id, state, (SELECT node_id FROM pl WHERE pl.way_id = am.way_id AND pos = CASE WHEN state = 'reversed' THEN am.n - 1 ELSE 0 END) AS first_node FROM am")
def tag_oneway(spark, d):
    state = tags.oneway_state(F.col("tags"))
    return ways(spark, d).select("way_id", state.alias("state"), F.when(state == "reversed", F.element_at("nodes", -1)).otherwise(F.element_at("nodes", 1)).alias("first_node"))


@query(NET + " SELECT way_id, round(speed, 6) AS speed FROM sp")
def tag_maxspeed(spark, d):
    return ways(spark, d).select("way_id", F.round(tags.max_speed(F.col("tags")), 6).alias("speed"))


# Inputs of the field's unit tests with the truth, km/h, metres and metric tons that they must give; None is no value.
UNITS = [
    ("Yes", True, None, None, None), ("true", True, None, None, None), ("No", False, None, None, None), ("0", False, 0.0, 0.0, 0.0), ("1", True, 1.0, 1.0, 1.0),
    ("30", False, 30.0, 30.0, 30.0), ("31.25", False, 31.25, 31.25, 31.25), ("6,5", False, 6.5, 6.5, 6.5), ("20kmh", False, 20.0, None, None), ("50 Km/h", False, 50.0, None, None),
    ("20 mph", False, 32.1869, None, None), ("6 Knoten", False, 11.112, None, None), ("+70", False, 70.0, 70.0, 70.0), ("0020", False, 20.0, 20.0, 20.0), ("5 kt", False, 9.26, None, None),
    ("30 Km/Hour", False, 30.0, None, None), ("40 kmp", False, 40.0, None, None), ("walk", False, None, None, None), ("2 km", False, 2.0, 2000.0, None), ("12' 6\"", False, 12.0, 3.81, 12.0),
    ("6'", False, 6.0, 1.8288, 6.0), ("6\"", False, 6.0, 0.1524, 6.0), ("7ft6in", False, None, 2.286, None), ("6'-6\"", False, 6.0, 1.9812, 6.0), ("1,5 Meter", False, None, 1.5, None),
    ("130cm", False, None, 1.3, None), ("0.6 mi", False, None, 965.6064, None), ("7.5T", False, None, None, 7.5), ("7.5 tonnes", False, None, None, 7.5), ("5 To", False, None, None, 5.0),
    ("200kg", False, None, None, 0.2), ("108000 lbs", False, None, None, 48.9888), ("", False, None, None, None),
]


def _units_sql() -> str:
    word = lambda x: "'" + x.replace("'", "''") + "'"
    number = lambda x: "NULL::DOUBLE" if x is None else f"{x}::DOUBLE"
    rows = ", ".join(f"({word(u)}, {str(flag).lower()}, {', '.join(map(number, rest))})" for u, flag, *rest in UNITS)
    return f"SELECT * FROM (VALUES {rows}) t(input, flag, speed, length, weight)"


@query(_units_sql())
def units(spark, d):
    x = F.col("input")
    rows = spark.createDataFrame([(u[0],) for u in UNITS], "input string")
    return rows.select("input", tags.parse_bool(x).alias("flag"), *[F.round(f(x), 4).alias(n) for n, f in (("speed", tags.parse_speed), ("length", tags.parse_length), ("weight", tags.parse_weight))])


@query(NET + " SELECT way_id, CAST(modes AS INT) AS mask, state FROM ok")
def way_filter(spark, d):
    return network.accepted(ways(spark, d)).select("way_id", "mask", "state")


@query(NET + " SELECT vertex_id, lat, lng FROM vertices")
def vertex_selection(spark, d):
    return graph(spark, d)[0]


@query(NET + " SELECT way_id, src, dst, CAST(from_pos AS INT) AS from_pos, CAST(to_pos AS INT) AS to_pos FROM ed")
def way_segments(spark, d):
    return graph(spark, d)[1].select("way_id", "src", "dst", "from_pos", "to_pos")


@query(NET + " SELECT edge_id, round(distance, 3) AS distance FROM edges")
def edge_lengths(spark, d):
    return graph(spark, d)[1].select("edge_id", F.round("distance", 3).alias("distance"))


@query()
def edge_lengths_ellipsoid(spark, d):
    """Lengths on the ellipsoid over all nodes of an edge, and as 16-bit floats keep them."""
    v, e = settled_graph(spark, d)
    return network.ellipsoid_lengths(e, v)


@query(NET + " SELECT edge_id, maxspeed, oneway, car, bike, foot, ferry FROM edges")
def edge_attributes(spark, d):
    return graph(spark, d)[1].select("edge_id", "maxspeed", "oneway", "car", "bike", "foot", "ferry")


def _add_darts(mode: str) -> None:
    def darts(spark, d):
        return network.darts(graph(spark, d)[1], mode).select("src", "dst", "edge_id", F.round("weight", 3).alias("weight"))

    darts.__name__ = f"darts_{mode}"
    query(f"{NET}, {_darts_sql(mode)} SELECT src, dst, edge_id, round(weight, 3) AS weight FROM darts")(darts)


for _mode in network.MODES:
    _add_darts(_mode)


@query(NET + " SELECT src, dst, arg_min(edge_id, (round(distance, 6), edge_id)) AS edge_id FROM edges WHERE car GROUP BY src, dst")
def parallel_edge_min(spark, d):
    # rounded as SQL does: scaled first; copies of a segment that are driven the other way differ in their last bits
    e = graph(spark, d)[1].where("car").select("src", "dst", "edge_id", F.round(F.col("distance") * 1e6).alias("weight"))
    return network.best_parallel(e).select("src", "dst", "edge_id")


INC = ", inc AS (SELECT src AS v FROM edges UNION ALL SELECT dst FROM edges), deg AS (SELECT vertex_id, count(v) AS degree FROM vertices LEFT JOIN inc ON v = vertex_id GROUP BY vertex_id)"


@query(NET + INC + " SELECT degree, count(*) AS n FROM deg GROUP BY degree")
def degree_histogram(spark, d):
    return stats.degrees(*graph(spark, d)).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


@query(NET + INC + " SELECT count(*) AS vertices, CAST(sum(degree) // 2 AS BIGINT) AS edges, round(avg(degree), 6) AS avg_degree, min(degree) AS min_degree, max(degree) AS max_degree FROM deg")
def degree_stats(spark, d):
    return stats.degree_summary(*graph(spark, d)).withColumn("avg_degree", F.round("avg_degree", 6))


@query(f"{NET}, {', '.join(_darts_sql(m, 'd' + m) for m in network.MODES)} SELECT mode, n AS out_darts, n AS in_darts, CAST(0 AS BIGINT) AS differing FROM ({' UNION ALL '.join(f'''SELECT '{m}' AS mode, count(*) AS n FROM d{m}''' for m in network.MODES)})")
def degree_balance(spark, d):
    return stats.balance(graph(spark, d)[1])


@query(NET + """, tt AS (SELECT coalesce(oneway, '(missing)') AS o, coalesce(highway, '(missing)') AS h, coalesce(junction, '(missing)') AS j FROM tg)
SELECT key, value, count(*) AS n FROM (SELECT 'oneway' AS key, o AS value FROM tt UNION ALL SELECT 'highway', h FROM tt UNION ALL SELECT 'junction', j FROM tt UNION ALL SELECT 'junction+oneway', j || '+' || o FROM tt UNION ALL SELECT 'junction+highway', j || '+' || h FROM tt) GROUP BY key, value""")
def tag_statistics(spark, d):
    return stats.tag_counts(ways(spark, d))


@query(NET + " SELECT coalesce(highway, '(missing)') AS highway, min(way_id) AS way_id FROM tg GROUP BY 1")
def tag_examples(spark, d):
    return stats.tag_examples(ways(spark, d))


@query(NET + " SELECT key, value, min(way_id) AS way_id FROM (SELECT 'access' AS key, access AS value, way_id FROM tg WHERE access IS NOT NULL UNION ALL SELECT 'bicycle', bicycle, way_id FROM tg WHERE bicycle IS NOT NULL) GROUP BY key, value")
def access_examples(spark, d):
    return stats.access_examples(ways(spark, d))


@query(NET + " SELECT vertex_id, CAST(coalesce(sum(n) OVER (ORDER BY vertex_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_out FROM (SELECT vertex_id, count(edge_id) AS n FROM vertices LEFT JOIN edges ON src = vertex_id GROUP BY vertex_id)")
def csr_offsets(spark, d):
    return network.offsets(*graph(spark, d))


def celled(spark, d):
    v, e = graph(spark, d)
    cell_of = cells.by_grid(v)
    return v, e, cell_of, cells.with_cells(e, cell_of)


@query(NET + GRID + " SELECT cell_id, count(*) AS vertices FROM cel GROUP BY cell_id")
def cell_sizes(spark, d):
    return cells.sizes(celled(spark, d)[2])


@query(NET + GRID + " SELECT edge_id, src_cell, dst_cell FROM ce WHERE src_cell <> dst_cell")
def cut_edges(spark, d):
    return cells.cut_edges(celled(spark, d)[3]).select("edge_id", "src_cell", "dst_cell")


@query(NET + GRID + " SELECT cell_id, vertex_id FROM bd")
def boundary_vertices(spark, d):
    return cells.boundary(celled(spark, d)[3])


@query(NET + GRID + " SELECT cell_id, vertex_id, b AS is_boundary, row_number() OVER (PARTITION BY cell_id ORDER BY b DESC, vertex_id) - 1 AS local_id FROM (SELECT cel.*, bd.vertex_id IS NOT NULL AS b FROM cel LEFT JOIN bd USING (cell_id, vertex_id))")
def cell_numbering(spark, d):
    _, _, cell_of, ce = celled(spark, d)
    return cells.numbering(cell_of, cells.boundary(ce))


@query(NET + GRID + " SELECT edge_id FROM ce WHERE src_cell < 8 AND dst_cell < 8")
def induced_subgraph(spark, d):
    _, e, cell_of, _ = celled(spark, d)
    return network.induced(e, cell_of.where("cell_id < 8")).select("edge_id")


BOXES = ", bx AS (SELECT cell_id, min(lat) - 20000 AS min_lat, min(lng) - 20000 AS min_lng, max(lat) + 20000 AS max_lat, max(lng) + 20000 AS max_lng FROM cel JOIN vertices USING (vertex_id) GROUP BY cell_id)"
POINTS = ", qs AS (SELECT event_id AS query_id, 490000000 + (event_id * 6007 % 10006000) AS qlat, 60000000 + (event_id * 7001 % 16017000) AS qlng FROM events WHERE event_id % 100 = 0)"


def asked(spark, d):
    """Query points: one for each hundredth event."""
    e = F.col("event_id")
    return derived.table(spark, d, "events").where(e % 100 == 0).select(e.alias("query_id"), (490_000_000 + (e * 6007 % 10_006_000)).alias("qlat"), (60_000_000 + (e * 7001 % 16_017_000)).alias("qlng"))


@query(NET + GRID + BOXES + " SELECT * FROM bx")
def cell_bboxes(spark, d):
    v, _, cell_of, _ = celled(spark, d)
    return cells.boxes(cell_of.join(v, "vertex_id"))


@query(NET + GRID + BOXES + POINTS + " SELECT query_id, cell_id FROM qs JOIN bx ON qlat BETWEEN min_lat AND max_lat AND qlng BETWEEN min_lng AND max_lng")
def point_in_bbox(spark, d):
    v, _, cell_of, _ = celled(spark, d)
    return snap.containing(asked(spark, d), cells.boxes(cell_of.join(v, "vertex_id")))


@query(NET + POINTS + " SELECT query_id, arg_min(vertex_id, (pow((lat - qlat)::DOUBLE, 2) + pow((lng - qlng)::DOUBLE, 2), vertex_id)) AS vertex_id FROM qs, vertices GROUP BY query_id")
def nearest_vertex(spark, d):
    return snap.nearest_by_grid(asked(spark, d), search.settled(graph(spark, d)[0])).select("query_id", "vertex_id")


KD = """, kd AS (SELECT vertex_id, NULL::BIGINT AS edge_id, NULL::INT AS step, any_value(lat) AS lat, any_value(lng) AS lng, bool_or(car) AS car, bool_or(bike) AS bike, bool_or(foot) AS foot
  FROM vertices JOIN (SELECT src AS v, car, bike, foot FROM edges UNION ALL SELECT dst, car, bike, foot FROM edges) ON v = vertex_id GROUP BY vertex_id
  UNION ALL SELECT src, edge_id, CAST(ps.pos - from_pos - 1 AS INT), lat, lng, car, bike, foot FROM edges JOIN ps ON ps.way_id = edges.way_id AND ps.pos > from_pos AND ps.pos < to_pos)"""


@query(NET + KD + " SELECT * FROM kd")
def kd_points(spark, d):
    return snap.points(*settled_graph(spark, d))


def _add_nearest(mode: str) -> None:
    def nearest(spark, d):
        return snap.nearest_by_grid(asked(spark, d), snap.points(*settled_graph(spark, d)).where(mode)).select("query_id", "vertex_id", "edge_id", "step")

    nearest.__name__ = f"nearest_point_{mode}"
    best = "arg_min((vertex_id, e, s), (pow((lat - qlat)::DOUBLE, 2) + pow((lng - qlng)::DOUBLE, 2), vertex_id, e, s))"
    query(f"{NET}{KD}{POINTS}, b AS (SELECT query_id, {best} AS m FROM qs, (SELECT *, coalesce(edge_id, -1) AS e, coalesce(step, -1) AS s FROM kd WHERE {mode}) GROUP BY query_id) SELECT query_id, m[1] AS vertex_id, nullif(m[2], -1) AS edge_id, nullif(m[3], -1) AS step FROM b")(nearest)


for _mode in network.MODES:
    _add_nearest(_mode)


@query(NET + " , nd AS (SELECT DISTINCT node_id, 490000000 + (node_id * 7919 % 20011) * 500 AS lat, 60000000 + (node_id * 104729 % 20021) * 800 AS lng FROM pl WHERE n >= 2), best AS (SELECT arg_min(node_id, (abs(lat - 495000000) + abs(lng - 68000000), node_id)) AS node_id FROM nd) SELECT DISTINCT node_id, way_id FROM pl JOIN best USING (node_id) WHERE n >= 2")
def stabbing_ways(spark, d):
    w = ways(spark, d)
    return snap.stabbing_ways(w, derived.nodes(w), 495_000_000, 68_000_000)


START = "(SELECT min(src) FROM darts)"


def _reach_sql(backward: bool = False) -> str:
    return f"{_darts_sql('car')}, {_darts_sql('car', 'dd', backward)}, r(vertex_id) AS (SELECT {START} UNION SELECT dst FROM r JOIN dd ON src = vertex_id)"


def car_darts(spark, d):
    darts = search.settled(network.darts(graph(spark, d)[1], "car"))
    return darts, darts.agg(F.min("src").alias("vertex_id"))


@query(f"{NET}, {_reach_sql()} SELECT vertex_id FROM r")
def reach_forward(spark, d):
    darts, start = car_darts(spark, d)
    return search.reach(darts, start)


@query(f"{NET}, {_reach_sql(True)} SELECT vertex_id FROM r")
def reach_backward(spark, d):
    darts, start = car_darts(spark, d)
    return search.reach(darts.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start)


@query(f"{NET}, {_darts_sql('car')}, {_darts_sql('car', 'bb', True)}, f(v) AS (SELECT {START} UNION SELECT dst FROM f JOIN darts ON src = v), b(v) AS (SELECT {START} UNION SELECT dst FROM b JOIN bb ON src = v) SELECT v AS vertex_id FROM f INTERSECT SELECT v FROM b")
def scc_of(spark, d):
    darts, start = car_darts(spark, d)
    return search.component_of(darts, start.first()["vertex_id"])


@query()
def accessible_region(spark, d):
    """Vertices of strong components of 16 vertices or more, by mode."""
    e = search.settled(graph(spark, d)[1])
    return search.accessible({m: network.darts(e, m) for m in network.MODES}, 16)


@query(f"{NET}, {_darts_sql('car')}, h(vertex_id, dist, hops) AS (SELECT {START}, 0::DOUBLE, 0 UNION SELECT dst, min(dist + weight), hops + 1 FROM h JOIN darts ON src = vertex_id WHERE hops < 4 GROUP BY dst, hops) SELECT vertex_id, round(min(dist), 3) AS dist FROM h GROUP BY vertex_id")
def sssp_hops_bounded(spark, d):
    darts, start = car_darts(spark, d)
    return search.distances(darts, start.withColumn("dist", F.lit(0.0)), bound=4).select("vertex_id", F.round("dist", 3).alias("dist"))


@query(f"{NET}, {_darts_sql('car')}, sp_(vertex_id, dist) USING KEY (vertex_id) AS (SELECT {START}, 0::DOUBLE UNION SELECT dst, min(sp_.dist + weight) FROM sp_ JOIN darts ON src = sp_.vertex_id LEFT JOIN recurring.sp_ AS old ON old.vertex_id = dst WHERE old.dist IS NULL OR sp_.dist + weight < old.dist GROUP BY dst) SELECT vertex_id, round(dist, 3) AS dist FROM sp_")
def sssp_full(spark, d):
    darts, start = car_darts(spark, d)
    return search.distances(darts, start.withColumn("dist", F.lit(0.0))).select("vertex_id", F.round("dist", 3).alias("dist"))


@query("SELECT kind, CAST(0 AS BIGINT) AS n FROM (SELECT unnest(['bad_weight', 'not_closed', 'not_least', 'loose_tree_edge', 'bad_root']) AS kind)")
def sssp_certificate(spark, d):
    darts, start = car_darts(spark, d)
    sources = start.withColumn("dist", F.lit(0.0))
    return search.violations(darts, sources, search.distances(darts, sources))


_WEIGHTS = {"distance": "distance", "time": "distance / maxspeed"}
MATRIX = ", ".join(
    f"md_{m}_{k} AS (SELECT src_cell AS cell_id, src, dst, {w} AS weight FROM ce WHERE {m} AND src_cell = dst_cell UNION ALL SELECT src_cell, dst, src, {w} FROM ce WHERE {m} AND src_cell = dst_cell{'' if m == 'foot' else ' AND NOT oneway'}), "
    f"mx_{m}_{k}(cell_id, src, vertex_id, dist) USING KEY (cell_id, src, vertex_id) AS (SELECT cell_id, vertex_id, vertex_id, 0::DOUBLE FROM bd UNION SELECT h.cell_id, h.src, l.dst, min(h.dist + l.weight) FROM mx_{m}_{k} h JOIN md_{m}_{k} l ON l.cell_id = h.cell_id AND l.src = h.vertex_id "
    f"LEFT JOIN recurring.mx_{m}_{k} AS old ON old.cell_id = h.cell_id AND old.src = h.src AND old.vertex_id = l.dst WHERE old.dist IS NULL OR h.dist + l.weight < old.dist GROUP BY h.cell_id, h.src, l.dst)"
    for m in network.MODES for k, w in _WEIGHTS.items()
)


@query(NET + GRID + ", " + MATRIX + " " + " UNION ALL ".join(f"SELECT '{m}' AS mode, '{k}' AS metric, cell_id, x.src, vertex_id AS dst, round(dist, 6) AS weight FROM mx_{m}_{k} x JOIN bd USING (cell_id, vertex_id) WHERE x.src <> vertex_id" for m in network.MODES for k in _WEIGHTS))
def boundary_matrix(spark, d):
    """Shortcuts between the boundary vertices of each cell, for all modes and metrics."""
    ce = search.settled(celled(spark, d)[3])
    out = None
    for mode in network.MODES:
        for metric in _WEIGHTS:
            rows = cells.overlay(ce, mode, metric)[0].where("cell_id is not null and src <> dst").select(F.lit(mode).alias("mode"), F.lit(metric).alias("metric"), "cell_id", "src", "dst", F.round("weight", 6).alias("weight"))
            out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT CAST(0 AS BIGINT) AS differing")
def overlay_query(spark, d):
    """Boundary vertices whose distance over the overlay differs from that over the whole graph."""
    _, _, cell_of, ce = celled(spark, d)
    ce = search.settled(ce)
    over, _ = cells.overlay(ce, "car", "distance")
    over = search.settled(over.where("src <> dst"))
    sources = over.agg(F.min("src").alias("vertex_id")).withColumn("dist", F.lit(0.0))
    a = search.distances(over, sources).select("vertex_id", F.col("dist").alias("a"))
    b = search.distances(network.darts(ce, "car"), sources).join(cells.boundary(ce).select("vertex_id").distinct(), "vertex_id", "left_semi").select("vertex_id", F.col("dist").alias("b"))
    return a.join(b, "vertex_id", "full").agg(F.count_if(F.coalesce(F.abs(F.col("a") - F.col("b")) > 1e-6, F.lit(True))).alias("differing"))


@query(NET + """, p AS (SELECT way_id, pos, lat / 1e7 AS r0, lng / 1e7 AS r1, lag(lat) OVER w / 1e7 AS q0, lag(lng) OVER w / 1e7 AS q1, lag(lat, 2) OVER w / 1e7 AS p0, lag(lng, 2) OVER w / 1e7 AS p1 FROM ps WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
s AS (SELECT way_id, pos, (q0 - p0) * (r1 - p1) - (q1 - p1) * (r0 - p0) AS s FROM p WHERE p0 IS NOT NULL)
SELECT way_id, CAST(pos AS INT) AS pos, CASE WHEN abs(s) < 1e-9 THEN 'Continue straightforward' WHEN s > 0 THEN 'Turn right' ELSE 'Turn left' END AS instruction FROM s""")
def turn_instructions(spark, d):
    w = ways(spark, d)
    at = network.located(network.places(network.accepted(w)), derived.nodes(w))
    by = Window.partitionBy("way_id").orderBy("pos")
    point = lambda k: (F.lag("lat", k).over(by) / geo.SCALE, F.lag("lng", k).over(by) / geo.SCALE) if k else (F.col("lat") / geo.SCALE, F.col("lng") / geo.SCALE)
    rows = at.select("way_id", "pos", geo.orientation(point(2), point(1), point(0)).alias("instruction"), F.lag("lat", 2).over(by).alias("first"))
    return rows.where("first is not null").drop("first")


@query(NET + " SELECT edge_id, CASE WHEN distance < 0.5 THEN 'mm' WHEN distance < 500 THEN 'm' ELSE 'km' END AS unit, CAST(floor(distance) AS BIGINT) AS value FROM edges")
def format_distance(spark, d):
    e = graph(spark, d)[1].withColumn("m", route.measured(F.col("distance"), route.distance_text))
    return e.select("edge_id", F.element_at(F.split("m.text", " "), -1).alias("unit"), F.col("m.value").alias("value"))


@query(NET + " SELECT edge_id, CASE WHEN t < 30 THEN 'secs' WHEN t < 1800 THEN 'mins' ELSE 'hours' END AS unit, CAST(floor(t) AS BIGINT) AS value FROM (SELECT edge_id, distance * 3.6::DOUBLE / maxspeed AS t FROM edges)")
def format_duration(spark, d):
    e = graph(spark, d)[1].withColumn("m", route.measured(route.duration(F.col("distance"), F.col("maxspeed"), "car"), route.duration_text))
    return e.select("edge_id", F.element_at(F.split("m.text", " "), -1).alias("unit"), F.col("m.value").alias("value"))


@query("SELECT * FROM (VALUES ('49.1,7.2|49.2,7.3', 2::INT), ('49.1,7.2', NULL), ('1,2,3|4,5', NULL), ('a,2|3,4', NULL), ('1,2|3,4|-5.5,6', 3)) t(request, points)")
def waypoint_parse(spark, d):
    rows = spark.createDataFrame([("49.1,7.2|49.2,7.3",), ("49.1,7.2",), ("1,2,3|4,5",), ("a,2|3,4",), ("1,2|3,4|-5.5,6",)], "request string")
    points = route.parse_waypoints(F.col("request"))
    return rows.select("request", F.when(points.isNotNull(), F.size(points)).alias("points"))


MERC = ", mc AS (SELECT lng / 1e7 * pi() * 6378137.0 / 180 AS x, ln(tan((90 + lat / 1e7) * pi() / 360)) * 6378137.0 AS y FROM vertices), me AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM mc)"


@query(NET + MERC + " SELECT round(x0, 2) AS min_x, round(y0, 2) AS min_y, round(x1, 2) AS max_x, round(y1, 2) AS max_y FROM me")
def mercator_extent(spark, d):
    return stats.extent(graph(spark, d)[0]).select(*[F.round(k, 2).alias(k) for k in ("min_x", "min_y", "max_x", "max_y")])


@query(NET + MERC + " SELECT CAST(least(floor(64 * (x - x0) / (x1 - x0)), 63) AS BIGINT) AS px, CAST(least(floor(64 * (1 - (y - y0) / (y1 - y0))), 63) AS BIGINT) AS py, count(*) AS n FROM mc, me GROUP BY 1, 2")
def pixel_density(spark, d):
    return stats.pixels(graph(spark, d)[0])


CHECKS = ["vertex_out_of_range", "vertex_repeated", "edge_repeated", "edge_source_missing", "edge_target_missing", "edge_loop", "edge_flag_missing", "edge_weight_bad", "step_out_of_range", "box_bad"]


@query(f'SELECT "check", CAST(0 AS BIGINT) AS n FROM (SELECT unnest({CHECKS}) AS "check")')
def graph_lint(spark, d):
    v, e = settled_graph(spark, d)
    return stats.lint(v, e, cells.boxes(v.withColumn("cell_id", F.lit(0))))


@query(NET + " SELECT vertex_id, lat / 1e7 AS lat_deg, CAST(floor(lat / 1e7 * 1e7 + 0.5) AS BIGINT) AS lat_again, round(6372797.0 * sqrt(pow(radians(abs(lat / 1e7 - 49.5)), 2) + (1 + cos(radians(lat / 1e7 + 49.5))) / 2 * pow(radians(least(abs(lng / 1e7 - 7), 360 - abs(lng / 1e7 - 7))), 2)), 3) AS metres FROM vertices")
def coordinates(spark, d):
    lat = F.col("lat") / geo.SCALE
    return graph(spark, d)[0].select("vertex_id", lat.alias("lat_deg"), geo.encode(lat).alias("lat_again"), F.round(geo.distance(lat, F.col("lng") / geo.SCALE, F.lit(49.5), F.lit(7.0)), 3).alias("metres"))


@query(NET + """, hb(vertex_id, x, y, k, l) AS (SELECT vertex_id, lat::BIGINT + 900000000, lng::BIGINT + 1800000000, 0::HUGEINT, 31 FROM vertices
  UNION ALL SELECT vertex_id, CASE WHEN ry THEN my ELSE mx END, CASE WHEN ry THEN mx ELSE my END, k * 4 + CASE WHEN rx AND ry THEN 2 WHEN rx THEN 3 WHEN ry THEN 1 ELSE 0 END, l - 1
  FROM (SELECT *, CASE WHEN ry AND NOT rx THEN 4294967295 - x ELSE x END AS mx, CASE WHEN ry AND NOT rx THEN 4294967295 - y ELSE y END AS my FROM (SELECT *, (x >> l) & 1 = 1 AS rx, (y >> l) & 1 = 1 AS ry FROM hb WHERE l >= 0)))
SELECT vertex_id, CAST(k - 9223372036854775808::HUGEINT AS BIGINT) AS key FROM hb WHERE l = -1""")
def hilbert_keys(spark, d):
    return graph(spark, d)[0].select("vertex_id", geo.hilbert_key(F.col("lat"), F.col("lng")).alias("key"))


@query()
def hilbert_cells(spark, d):
    return cells.by_curve(graph(spark, d)[0], 16)


@query(NET + """, nm AS (SELECT vertex_id, row_number() OVER (ORDER BY vertex_id) AS number FROM vertices),
pr AS (SELECT DISTINCT least(s.number, t.number) AS a, greatest(s.number, t.number) AS b FROM edges JOIN nm s ON src = s.vertex_id JOIN nm t ON dst = t.vertex_id WHERE src <> dst),
nb AS (SELECT a AS number, string_agg(b::VARCHAR, ' ' ORDER BY b) AS line FROM (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr) GROUP BY a)
SELECT number, coalesce(line, '') AS line FROM nm LEFT JOIN nb USING (number) UNION ALL SELECT 0, (SELECT count(*) FROM nm)::VARCHAR || ' ' || (SELECT count(*) FROM pr)::VARCHAR""")
def metis_graph(spark, d):
    return store.metis_lines(*settled_graph(spark, d))


@query(NET + " SELECT edge_id, round(distance / maxspeed, 6) AS weight, round(distance * 3.6::DOUBLE / maxspeed, 6) AS seconds FROM edges WHERE car")
def edge_times(spark, d):
    e = graph(spark, d)[1].where("car")
    return e.select("edge_id", F.round(network.weight("time"), 6).alias("weight"), F.round(route.duration(F.col("distance"), F.col("maxspeed"), "car"), 6).alias("seconds"))


@query("SELECT * FROM (VALUES ('falling', 0::BIGINT), ('start', 0), ('wrong_degree', 0), ('unknown', 0), ('shared', 0), ('elsewhere', 0), ('missing', 0)) t(\"check\", n)")
def offset_checks(spark, d):
    """Errors of the offsets of out-edges and of the lists of in-edges; a sound network has none, tests have broken ones."""
    v, e = settled_graph(spark, d)
    return stats.offset_errors(network.offsets(v, e), e).unionByName(stats.in_edge_errors(e.select(F.col("dst").alias("vertex_id"), "edge_id"), e))


@query(NET + " SELECT vertex_id, round(lat / 1e7, 7) AS lat, round(lng / 1e7, 7) AS lng, 0.0::DOUBLE AS height FROM vertices")
def ecef_roundtrip(spark, d):
    x, y, z = geo.to_ecef(F.col("lat") / geo.SCALE, F.col("lng") / geo.SCALE, F.lit(0.0))
    rows = graph(spark, d)[0].select("vertex_id", x.alias("x"), y.alias("y"), z.alias("z"))
    lat, lng, h = geo.from_ecef(F.col("x"), F.col("y"), F.col("z"))
    return rows.select("vertex_id", F.round(lat, 7).alias("lat"), F.round(lng, 7).alias("lng"), F.abs(F.round(h, 3)).alias("height"))


@query()
def route_json(spark, d):
    return flagship(spark, d)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driving by distance between the first and the last vertex of the largest component, over four cells."""
    w = ways(spark, sf_dir)
    v, e = network.build(w, derived.nodes(w))
    e = search.settled(e)
    comps = search.settled(search.strong_components(network.darts(e, "car")))
    largest = comps.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    region = search.settled(comps.join(largest, "component", "left_semi").select("vertex_id"))
    machine = engine.Engine(v.join(region, "vertex_id", "left_semi"), network.induced(e, region), 4)
    ends = machine.vertices.agg(F.min(F.struct("vertex_id", "lat", "lng")).alias("a"), F.max(F.struct("vertex_id", "lat", "lng")).alias("b")).first()
    text = "|".join(f"{p['lat'] / geo.SCALE},{p['lng'] / geo.SCALE}" for p in (ends["a"], ends["b"]))
    return machine.route(text, "driving", "distance")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
