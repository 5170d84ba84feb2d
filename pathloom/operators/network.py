"""From ways and nodes to a street graph: way filter, vertices, segments, attributes, darts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, tags as t
from . import search

MODES = ["car", "bike", "foot"]
_MASK = {"car": t.CAR, "bike": t.BIKE, "foot": t.FOOT}


def accepted(ways: DataFrame, modes: list[str] = MODES) -> DataFrame:
    """Ways that some of the modes may use, with mask, oneway and speed; reversed ways have their nodes turned.

    A oneway tag that can't be read closes a way to cars; a way for cars alone goes.
    """
    rows = ways.where(F.size("nodes") >= 2).withColumns({"mask": t.access_mask(F.col("tags")), "state": t.oneway_state(F.col("tags")), "speed": t.max_speed(F.col("tags"))})
    wanted = sum(_MASK[m] for m in modes)
    rows = rows.where((F.col("mask").bitwiseAND(wanted) != 0) & ~((F.col("state") == "unsafe") & (F.col("mask") == t.CAR)))
    unsafe_mask = F.col("mask").bitwiseAND(t.ALL & ~t.CAR)
    rows = rows.withColumn("mask", F.when(F.col("state") == "unsafe", unsafe_mask).otherwise(F.col("mask")))
    return rows.withColumn("nodes", F.when(F.col("state") == "reversed", F.reverse("nodes")).otherwise(F.col("nodes")))


def places(ways: DataFrame) -> DataFrame:
    """One row for each place of a node in a way."""
    return ways.select("way_id", F.size("nodes").alias("n"), F.posexplode("nodes").alias("pos", "node_id"))


def vertex_ids(places_df: DataFrame) -> DataFrame:
    """Nodes at an end of a way or in two ways or more."""
    end = (F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1)
    # the least and greatest way tell one way from several without a set of ways a node
    rows = places_df.groupBy("node_id").agg(F.max(end).alias("is_end"), (F.min("way_id") != F.max("way_id")).alias("is_shared"))
    return rows.where("is_end or is_shared").select(F.col("node_id").alias("vertex_id"))


def located(places_df: DataFrame, nodes: DataFrame, strict: bool = False) -> DataFrame:
    """Places with positions; a node that is missing lies at 0, 0, or its places go if ``strict``."""
    rows = places_df.join(nodes.select("node_id", "lat", "lng"), "node_id", "inner" if strict else "left")
    return rows.withColumns({k: F.coalesce(k, F.lit(0).cast("bigint")) for k in ("lat", "lng")})


def segments(located_df: DataFrame, vertices: DataFrame) -> DataFrame:
    """(way_id, src, dst, from_pos, to_pos, distance, steps): ways cut at their vertices.

    Of a run of the same vertex the first counts, so a loop's length falls to the segment that follows it.
    """
    way = Window.partitionBy("way_id").orderBy("pos")
    step = geo.fixed_distance(F.lag("lat").over(way), F.lag("lng").over(way), F.col("lat"), F.col("lng"))
    marked = located_df.join(vertices.select(F.col("vertex_id").alias("node_id"), F.lit(True).alias("is_vertex")), "node_id", "left")
    run = marked.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("run", F.sum("step").over(way))
    kept = run.where("is_vertex").withColumn("before", F.lag("node_id").over(way)).where("before is null or before <> node_id")
    cut = kept.withColumns({"src": F.lag("node_id").over(way), "from_pos": F.lag("pos").over(way), "from_run": F.lag("run").over(way)}).where("src is not null")
    # a way's line once, joined to its cuts where both lie dealt by way already
    lines = located_df.groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "lat", "lng"))).alias("line"))
    cut = cut.select("way_id", "src", "node_id", "from_pos", "pos", "run", "from_run").join(lines, "way_id")
    inner = F.when(F.col("pos") - F.col("from_pos") > 1, F.slice("line", F.col("from_pos") + 2, F.col("pos") - F.col("from_pos"))).otherwise(F.slice("line", 1, 0))
    return cut.select("way_id", "src", F.col("node_id").alias("dst"), "from_pos", F.col("pos").alias("to_pos"), (F.col("run") - F.col("from_run")).alias("distance"), F.transform(inner, lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng"))).alias("steps"))


def edges(segments_df: DataFrame, accepted_df: DataFrame) -> DataFrame:
    """Segments with their ways' attributes."""
    mask = F.col("mask")
    attributes = accepted_df.select(
        "way_id", F.greatest(F.floor("speed").cast("int"), F.lit(1)).alias("maxspeed"), F.col("state").isin("forward", "reversed").alias("oneway"),
        *[(mask.bitwiseAND(_MASK[m]) > 0).alias(m) for m in MODES], t.is_ferry(F.col("tags")).alias("ferry"),
    )
    return segments_df.join(attributes, "way_id").withColumn("edge_id", F.col("way_id") * 100_000 + F.col("from_pos"))


def build(ways: DataFrame, nodes: DataFrame, modes: list[str] = MODES) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the street graph of some ways."""
    good = search.settled(accepted(ways, modes))  # three uses, and a plan of its own
    at = located(places(good), nodes)
    ids = vertex_ids(places(good))
    vertices = ids.join(nodes.select(F.col("node_id").alias("vertex_id"), "lat", "lng"), "vertex_id", "left").withColumns({k: F.coalesce(k, F.lit(0).cast("bigint")) for k in ("lat", "lng")})
    return vertices, edges(segments(at, ids), good)


def weight(metric: str) -> Column:
    """Metres, or metres over km/h for time (seconds by 3.6)."""
    if metric not in ("distance", "time"):
        raise ValueError("wrong metric")
    return F.col("distance") if metric == "distance" else F.col("distance") / F.col("maxspeed")


def darts(edges_df: DataFrame, mode: str, metric: str = "distance", forward: bool = True, avoid_ferries: bool = False) -> DataFrame:
    """(src, dst, edge_id, weight): each direction in which a mode may use an edge; on foot oneways don't count."""
    if mode not in MODES:
        raise ValueError("wrong travelmode")
    usable = edges_df.where(F.col(mode) & (~F.col("ferry") if avoid_ferries else F.lit(True))).withColumn("weight", weight(metric))
    back = usable if mode == "foot" else usable.where("not oneway")
    there = usable.select("src", "dst", "edge_id", "weight").unionByName(back.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_id", "weight"))
    return there if forward else there.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_id", "weight")


def ellipsoid_lengths(edges_df: DataFrame, vertices: DataFrame) -> DataFrame:
    """(edge_id, metres, half): lengths on WGS84 over all nodes of an edge, exact and as 16-bit floats keep them."""
    at = vertices.select(F.col("vertex_id").alias("src"), F.struct("lat", "lng").alias("p")).join(edges_df.select("edge_id", "src", "dst", "steps"), "src")
    last = vertices.select(F.col("vertex_id").alias("dst"), F.struct("lat", "lng").alias("q"))
    # an edge without inner nodes has no steps
    line = F.concat(F.array("p"), F.when(F.size("steps") > 0, F.col("steps")).otherwise(F.array("q")))
    rows = at.join(last, "dst").withColumn("line", line)
    metres = geo.line_length(F.transform("line", lambda p: p["lat"] / geo.SCALE), F.transform("line", lambda p: p["lng"] / geo.SCALE))
    return rows.select("edge_id", metres.alias("metres")).select("edge_id", "metres", geo.half_rounded(F.col("metres").cast("float")).alias("half"))


def incident(edges_df: DataFrame) -> DataFrame:
    """(vertex_id, other, edge_id): every edge from both ends, whatever may use it."""
    return edges_df.select(F.col("src").alias("vertex_id"), F.col("dst").alias("other"), "edge_id").unionByName(edges_df.select(F.col("dst").alias("vertex_id"), F.col("src").alias("other"), "edge_id"))


def best_parallel(darts_df: DataFrame) -> DataFrame:
    """Of parallel darts the lightest, of equals the one with the least edge id."""
    return darts_df.groupBy("src", "dst").agg(F.min(F.struct("weight", "edge_id")).alias("m")).select("src", "dst", "m.edge_id", "m.weight")


def induced(edges_df: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends among the vertices."""
    ids = vertices.select("vertex_id")
    return edges_df.join(ids.withColumnRenamed("vertex_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("vertex_id", "dst"), "dst", "left_semi")


def offsets(vertices: DataFrame, edges_df: DataFrame) -> DataFrame:
    """(vertex_id, first_out): running sum of out-degrees before each vertex, for export as arrays.

    Sums are first taken within ranges of ids, so that only one row a range meets in one task.
    """
    degree = vertices.select("vertex_id").join(edges_df.groupBy(F.col("src").alias("vertex_id")).count(), "vertex_id", "left").select("vertex_id", F.coalesce("count", F.lit(0).cast("bigint")).alias("d"), F.floor(F.col("vertex_id") / 4096).alias("range"))
    ranges = degree.groupBy("range").agg(F.sum("d").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")))
    inside = F.coalesce(F.sum("d").over(Window.partitionBy("range").orderBy("vertex_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    return degree.withColumn("inside", inside).join(ranges.select("range", "base"), "range").select("vertex_id", (F.col("base") + F.col("inside")).alias("first_out"))
