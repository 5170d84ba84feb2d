"""Snapping of coordinates to the street graph, and point-in-box and nearest-point queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import search


def points(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vertex_id, edge_id, step, lat, lng, car, bike, foot): every vertex of an edge, and every inner step of one."""
    modes = ["car", "bike", "foot"]
    ends = edges.select(F.explode(F.array("src", "dst")).alias("vertex_id"), *modes).groupBy("vertex_id").agg(*[F.max(m).alias(m) for m in modes])
    at = vertices.join(ends, "vertex_id").select("vertex_id", F.lit(None).cast("bigint").alias("edge_id"), F.lit(None).cast("int").alias("step"), "lat", "lng", *modes)
    inner = edges.select(F.col("src").alias("vertex_id"), "edge_id", F.posexplode("steps").alias("step", "p"), *modes, F.size("steps").alias("k"))
    # the last step is the end vertex itself
    return at.unionByName(inner.where(F.col("step") < F.col("k") - 1).select("vertex_id", "edge_id", "step", F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng"), *modes))


def nearest(queries: DataFrame, points_df: DataFrame, mode: str | None = None) -> DataFrame:
    """Each query (query_id, qlat, qlng; fixed point) with its nearest point, by squared degrees, ties by the least ids.

    The queries of one call are a bounded block, sent to every task; each task keeps one candidate a query.
    """
    usable = points_df.where(F.col(mode)) if mode else points_df
    gap = (F.col("lat") - F.col("qlat")).cast("double"), (F.col("lng") - F.col("qlng")).cast("double")
    rank = F.struct((gap[0] * gap[0] + gap[1] * gap[1]).alias("d"), "vertex_id", F.coalesce("edge_id", F.lit(-1).cast("bigint")).alias("e"), F.coalesce("step", F.lit(-1)).alias("s"), "lat", "lng")
    best = usable.join(F.broadcast(queries)).groupBy("query_id", "qlat", "qlng").agg(F.min(rank).alias("m"))
    return best.select("query_id", "qlat", "qlng", "m.vertex_id", F.when(F.col("m.e") >= 0, F.col("m.e")).alias("edge_id"), F.when(F.col("m.s") >= 0, F.col("m.s")).alias("step"), "m.lat", "m.lng")


def nearest_by_grid(queries: DataFrame, points_df: DataFrame, cell: int = 200_000) -> DataFrame:
    """``nearest`` for very many queries: an equi-join on grid squares, widened until no nearer point can lie outside.

    Of the points at one position only the one with the least ids can be an answer, so a position is one row. A query is done when its best point is no farther than the rings looked at reach; the rest go on with squares of four
    times the side, until a square holds the earth, where the best is the answer. Longitudes don't wrap. Without points
    the queries have no rows. Points without edges (no ``edge_id`` and ``step``) are vertices.
    """
    if "edge_id" not in points_df.columns:
        points_df = points_df.withColumns({"edge_id": F.lit(None).cast("bigint"), "step": F.lit(None).cast("int")})
    ids = F.struct("vertex_id", F.coalesce("edge_id", F.lit(-1).cast("bigint")).alias("e"), F.coalesce("step", F.lit(-1)).alias("s"))
    places = search.settled(points_df.groupBy("lat", "lng").agg(F.min(ids).alias("m")).select("m.*", "lat", "lng"))
    if places.isEmpty():
        return nearest(queries.limit(0), points_df)
    todo, done = search.settled(queries), None
    while True:
        side = cell
        last = side >= 3_600_000_000
        square = lambda lat, lng: (F.floor(F.col(lat) / side), F.floor(F.col(lng) / side))  # noqa: E731,B023
        gy, gx = square("lat", "lng")
        qy, qx = square("qlat", "qlng")
        ring = F.explode(F.expr("flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i as i, j as j))))"))
        asked = todo.select("query_id", "qlat", "qlng", qy.alias("y"), qx.alias("x"), ring.alias("r")).select("query_id", "qlat", "qlng", (F.col("y") + F.col("r.i")).alias("y"), (F.col("x") + F.col("r.j")).alias("x"))
        dy, dx = (F.col("lat") - F.col("qlat")).cast("double"), (F.col("lng") - F.col("qlng")).cast("double")
        rank = F.struct((dy * dy + dx * dx).alias("d"), "vertex_id", "e", "s", "lat", "lng")
        best = places.select("vertex_id", "e", "s", "lat", "lng", gy.alias("y"), gx.alias("x")).join(asked, ["y", "x"]).groupBy("query_id", "qlat", "qlng").agg(F.min(rank).alias("m"))
        found = search.settled((best if last else best.where(F.col("m.d") <= float(side) ** 2)).select("query_id", "qlat", "qlng", "m.vertex_id", F.when(F.col("m.e") >= 0, F.col("m.e")).alias("edge_id"), F.when(F.col("m.s") >= 0, F.col("m.s")).alias("step"), "m.lat", "m.lng"))
        done = found if done is None else done.unionByName(found)
        todo = search.settled(todo.join(found, "query_id", "left_anti"))
        cell *= 4
        if last or todo.isEmpty():
            return done


def containing(queries: DataFrame, boxes: DataFrame, side: int = 10_000_000) -> DataFrame:
    """(query_id, cell_id) of every box that holds a query's point, edges included.

    An equi-join on squares of ``side`` (a degree), of which a box has one row each that it touches, before the box is tested.
    """
    square = lambda x: F.floor(F.col(x) / side).cast("bigint")
    spread = boxes.where("min_lat <= max_lat and min_lng <= max_lng").withColumn("y", F.explode(F.sequence(square("min_lat"), square("max_lat")))).withColumn("x", F.explode(F.sequence(square("min_lng"), square("max_lng"))))
    asked = queries.select("query_id", "qlat", "qlng", square("qlat").alias("y"), square("qlng").alias("x"))
    return asked.alias("q").join(spread.alias("b"), ["y", "x"]).where(geo.in_box(F.col("q.qlat"), F.col("q.qlng"), "b")).select("query_id", "cell_id")


def stabbing_ways(ways: DataFrame, nodes: DataFrame, lat: int, lng: int) -> DataFrame:
    """(node_id, way_id): the ways through the node that is nearest by the sum of both differences, the least of equals."""
    gap = F.abs(F.col("lat") - lat) + F.abs(F.col("lng") - lng)
    node = nodes.agg(F.min(F.struct(gap.alias("g"), "node_id")).alias("m")).select("m.node_id")
    return ways.join(F.broadcast(node), F.array_contains("nodes", F.col("node_id"))).select("node_id", "way_id")


def approaches(snapped: DataFrame, edges: DataFrame, vertices: DataFrame, mode: str, forward: bool) -> DataFrame:
    """(query_id, vertex_id, length, path): how a snapped point is left (``forward``) or reached by the graph's vertices.

    A vertex is its own with length 0; a point inside an edge has both ends, or the one that the oneway allows. ``path`` is
    the geometry from the point to the vertex, or back.
    """
    direct = snapped.where("edge_id is null").select("query_id", "vertex_id", F.lit(0.0).alias("length"), F.array(F.struct("lat", "lng")).alias("path"))
    at = vertices.select(F.col("vertex_id").alias("v"), F.struct("lat", "lng").alias("p"))
    inside = snapped.where("edge_id is not null").select("query_id", "edge_id", "step").join(edges, "edge_id").join(at.withColumnsRenamed({"v": "src", "p": "ps"}), "src")
    line = inside.withColumn("line", F.concat(F.array("ps"), "steps"))
    to_end, to_start = F.expr("slice(line, step + 2, size(line))"), F.expr("reverse(slice(line, 1, step + 2))")
    ways = [F.struct(F.col("dst").alias("v"), to_end.alias("path"), F.lit(forward).alias("ok")), F.struct(F.col("src").alias("v"), to_start.alias("path"), F.lit(not forward).alias("ok"))]
    rows = line.select("query_id", "oneway", F.explode(F.array(*ways)).alias("w")).where((~F.col("oneway")) | F.col("w.ok") | F.lit(mode == "foot"))
    path = rows.select("query_id", F.col("w.v").alias("vertex_id"), (F.col("w.path") if forward else F.reverse("w.path")).alias("path"))
    return direct.unionByName(path.select("query_id", "vertex_id", length("path").alias("length"), "path"))


def length(path: str):
    """Metres of a line of fixed-point positions."""
    def leg(i):
        a, b = F.col(path)[i], F.col(path)[i + 1]
        return geo.distance(a["lat"] / geo.SCALE, a["lng"] / geo.SCALE, b["lat"] / geo.SCALE, b["lng"] / geo.SCALE)

    return F.when(F.size(path) < 2, 0.0).otherwise(F.aggregate(F.transform(F.sequence(F.lit(0), F.greatest(F.size(path) - 2, F.lit(0))), leg), F.lit(0.0), lambda x, y: x + y))
