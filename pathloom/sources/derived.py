"""A road network derived from the star-schema tables: users' events make ways, their values make nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Beyond this many events the network has ten times the nodes.
MANY_EVENTS = 50_000
CLASSES = {"view": "residential", "click": "secondary", "purchase": "motorway", "signup": "footway", "error": "track"}
ONEWAY = ["yes", "-1", "no", "reversible", None]
MAXSPEED = ["50", "30 mph", "none", "signals", "6,5", "walk", None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _listed(values: list[str | None], index: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in enumerate(values):
        if v is not None:
            out = F.when(index == k, v).otherwise(out)
    return out


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(way_id, nodes, tags) of every way with two nodes or more."""
    events = table(spark, sf_dir, "events")
    modulus = 40_000 if events.count() > MANY_EVENTS else 4_000
    rows = events.select((F.col("user_id") * 100 + F.floor((F.dayofmonth("ts") - 1) / 6).cast("bigint")).alias("way_id"), F.struct("ts", "event_id", (F.floor(F.col("value") * 100).cast("bigint") % modulus).alias("node_id"), "event_type").alias("e"))
    grouped = rows.groupBy("way_id").agg(F.sort_array(F.collect_list("e")).alias("es")).where(F.size("es") >= 2)
    w = F.col("way_id")
    ferry = w % 29 == 0
    kind = F.element_at("es", 1)["event_type"]
    highway = F.lit(None).cast("string")
    for event, name in CLASSES.items():
        highway = F.when(kind == event, name).otherwise(highway)
    pairs = {
        "highway": F.when(~ferry, highway), "route": F.when(ferry, "ferry"), "oneway": _listed(ONEWAY, w % 5), "maxspeed": _listed(MAXSPEED, w % 7),
        "access": F.when(w % 13 == 0, "no"), "bicycle": F.when(w % 17 == 0, "designated"), "junction": F.when(w % 11 == 0, "roundabout"),
    }
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()]), lambda e: e["value"].isNotNull())
    return grouped.select("way_id", F.transform("es", lambda e: e["node_id"]).alias("nodes"), F.map_from_entries(entries).alias("tags"))


def node_position(node_id: Column) -> tuple[Column, Column]:
    """Fixed-point latitude and longitude of a node."""
    return 490_000_000 + (node_id * 7919 % 20011) * 500, 60_000_000 + (node_id * 104729 % 20021) * 800


def nodes(ways_df: DataFrame) -> DataFrame:
    """(node_id, lat, lng) of every node of the ways, fixed point."""
    lat, lng = node_position(F.col("node_id"))
    return ways_df.select(F.explode("nodes").alias("node_id")).distinct().select("node_id", lat.alias("lat"), lng.alias("lng"))


#: The same as SQL, up to ways with tags (one row a way) and their nodes (one row a place).
SQL = f"""params AS (SELECT CASE WHEN count(*) > {MANY_EVENTS} THEN 40000 ELSE 4000 END AS m FROM events),
ev AS (SELECT user_id * 100 + CAST(floor((extract(day FROM ts) - 1) / 6) AS BIGINT) AS way_id, CAST(floor(value * 100) AS BIGINT) % m AS node_id, event_type, ts, event_id FROM events, params),
pl AS (SELECT *, row_number() OVER (PARTITION BY way_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY way_id) AS n FROM ev),
tg AS (SELECT way_id, n, CASE WHEN way_id % 29 = 0 THEN NULL ELSE CASE event_type WHEN 'view' THEN 'residential' WHEN 'click' THEN 'secondary' WHEN 'purchase' THEN 'motorway' WHEN 'signup' THEN 'footway' WHEN 'error' THEN 'track' END END AS highway,
  CASE WHEN way_id % 29 = 0 THEN 'ferry' END AS route, CASE way_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' WHEN 3 THEN 'reversible' END AS oneway,
  CASE way_id % 7 WHEN 0 THEN '50' WHEN 1 THEN '30 mph' WHEN 2 THEN 'none' WHEN 3 THEN 'signals' WHEN 4 THEN '6,5' WHEN 5 THEN 'walk' END AS maxspeed,
  CASE WHEN way_id % 13 = 0 THEN 'no' END AS access, CASE WHEN way_id % 17 = 0 THEN 'designated' END AS bicycle, CASE WHEN way_id % 11 = 0 THEN 'roundabout' END AS junction FROM pl WHERE pos = 0 AND n >= 2),
df AS (SELECT *, CASE WHEN highway IN ('secondary', 'residential') THEN 7 WHEN highway = 'motorway' THEN 1 WHEN highway = 'track' THEN 6 WHEN highway = 'footway' THEN 4 WHEN route = 'ferry' THEN 6 ELSE 0 END AS base FROM tg),
am AS (SELECT *, CASE WHEN highway IS NULL AND junction IS NULL AND route IS NULL THEN 0 WHEN access = 'no' THEN CASE WHEN bicycle = 'designated' THEN 2 ELSE 0 END WHEN bicycle = 'designated' THEN base | 2 ELSE base END AS mask,
  CASE WHEN oneway = 'yes' THEN 'forward' WHEN oneway = '-1' THEN 'reversed' WHEN oneway = 'no' THEN 'both' WHEN junction = 'roundabout' OR highway = 'motorway' THEN 'forward' WHEN oneway IS NOT NULL THEN 'unsafe' ELSE 'both' END AS state,
  CASE WHEN bicycle = 'designated' THEN 30.0 WHEN route = 'ferry' THEN 12.0 WHEN highway = 'motorway' THEN 130.0 WHEN highway IN ('residential', 'secondary') THEN 50.0 ELSE 10.0 END AS usual FROM df),
sp AS (SELECT *, CASE WHEN highway IS NULL AND junction IS NULL AND route IS NULL THEN 0.0 WHEN maxspeed = '50' THEN 50.0 WHEN maxspeed = '30 mph' THEN 30 * 1.609344::DOUBLE WHEN maxspeed = 'none' THEN 130.0 WHEN maxspeed = '6,5' THEN 6.5 ELSE usual END::DOUBLE AS speed FROM am),
ok AS (SELECT *, CASE WHEN state = 'unsafe' THEN mask & 6 ELSE mask END AS modes FROM sp WHERE mask <> 0 AND NOT (state = 'unsafe' AND mask = 1)),
wn AS (SELECT pl.way_id, node_id, CASE WHEN state = 'reversed' THEN pl.n - 1 - pos ELSE pos END AS pos, pl.n FROM pl JOIN ok USING (way_id)),
vx AS (SELECT node_id FROM wn GROUP BY node_id HAVING bool_or(pos = 0 OR pos = n - 1) OR count(DISTINCT way_id) >= 2),
ps AS (SELECT *, 490000000 + (node_id * 7919 % 20011) * 500 AS lat, 60000000 + (node_id * 104729 % 20021) * 800 AS lng FROM wn),
st AS (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM ps WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
cu AS (SELECT *, sum(CASE WHEN plat IS NULL THEN 0 ELSE 6372797.0 * sqrt(pow(radians(abs(lat - plat) / 1e7), 2) + (1 + cos(radians((lat + plat) / 1e7))) / 2 * pow(radians(abs(lng - plng) / 1e7), 2)) END) OVER (PARTITION BY way_id ORDER BY pos) AS run FROM st),
sv AS (SELECT cu.*, lag(cu.node_id) OVER (PARTITION BY way_id ORDER BY pos) AS prev_node FROM cu JOIN vx ON cu.node_id = vx.node_id),
kp AS (SELECT *, lag(node_id) OVER w AS src, lag(pos) OVER w AS from_pos, lag(run) OVER w AS from_run FROM sv WHERE prev_node IS NULL OR prev_node <> node_id WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
ed AS (SELECT way_id * 100000 + from_pos AS edge_id, way_id, src, node_id AS dst, from_pos, pos AS to_pos, run - from_run AS distance FROM kp WHERE src IS NOT NULL),
edges AS (SELECT ed.*, CASE WHEN speed >= 1 THEN CAST(floor(speed) AS INT) ELSE 1 END AS maxspeed, state IN ('forward', 'reversed') AS oneway, modes & 1 > 0 AS car, modes & 2 > 0 AS bike, modes & 4 > 0 AS foot, coalesce(route = 'ferry', false) AS ferry FROM ed JOIN ok USING (way_id)),
vertices AS (SELECT DISTINCT node_id AS vertex_id, lat, lng FROM sv)"""
