"""Statistics and data-quality checks of networks and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import tags as t
from . import network, search


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    counts = network.incident(edges).groupBy("vertex_id").agg(F.count(F.lit(1)).alias("degree"))
    return vertices.select("vertex_id").join(counts, "vertex_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))


def degree_summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(vertices, edges).agg(F.count(F.lit(1)).alias("vertices"), (F.sum("degree") / 2).cast("bigint").alias("edges"), F.avg("degree").alias("avg_degree"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"))


def balance(edges: DataFrame) -> DataFrame:
    """(mode, out_darts, in_darts, differing): darts counted from both sides for each mode."""
    out = None
    for mode in network.MODES:
        there = network.darts(edges, mode).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("a"))
        back = network.darts(edges, mode, forward=False).groupBy(F.col("dst").alias("src"), F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("b"))
        row = there.join(back, ["src", "dst"], "full").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("out_darts"), F.coalesce(F.sum("b"), F.lit(0)).alias("in_darts"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing")).select(F.lit(mode).alias("mode"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def tag_counts(ways: DataFrame) -> DataFrame:
    """(key, value, n) of the tags that describe a road, alone and together with junction."""
    tag = lambda k: F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit("(missing)"))
    pairs = [("oneway", tag("oneway")), ("highway", tag("highway")), ("junction", tag("junction")), ("junction+oneway", F.concat_ws("+", tag("junction"), tag("oneway"))), ("junction+highway", F.concat_ws("+", tag("junction"), tag("highway")))]
    rows = ways.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])).alias("p"))
    return rows.groupBy("p.key", "p.value").agg(F.count(F.lit(1)).alias("n"))


def tag_examples(ways: DataFrame) -> DataFrame:
    """(highway, way_id): the first way of each class."""
    return ways.groupBy(F.coalesce(F.try_element_at("tags", F.lit("highway")), F.lit("(missing)")).alias("highway")).agg(F.min("way_id").alias("way_id"))


def access_examples(ways: DataFrame) -> DataFrame:
    """(key, value, way_id): the first way that has a value of one of the tags that regulate access."""
    rows = ways.select("way_id", F.explode("tags").alias("key", "value")).where(F.col("key").isin(*[k for k, _ in t.OVERRIDES]))
    return rows.groupBy("key", "value").agg(F.min("way_id").alias("way_id"))


def lint(vertices: DataFrame, edges: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """(check, n): rows that break a rule of the network; all are 0 in a sound one."""
    ids = vertices.select(F.col("vertex_id").alias("v"))
    outside = lambda lat, lng: ~F.col(lat).between(-900_000_000, 900_000_000) | ~F.col(lng).between(-1_800_000_000, 1_800_000_000)
    checks = {
        "vertex_out_of_range": vertices.where(outside("lat", "lng")),
        "vertex_repeated": vertices.groupBy("vertex_id").count().where("count > 1"),
        "edge_repeated": edges.groupBy("edge_id").count().where("count > 1"),
        "edge_source_missing": edges.join(ids, F.col("src") == F.col("v"), "left_anti"),
        "edge_target_missing": edges.join(ids, F.col("dst") == F.col("v"), "left_anti"),
        "edge_loop": edges.where("src = dst"),
        "edge_flag_missing": edges.where("oneway is null or car is null or bike is null or foot is null or ferry is null"),
        "edge_weight_bad": edges.where("distance is null or isnan(distance) or distance <= 0 or distance = double('inf') or maxspeed < 1"),
        "step_out_of_range": edges.select(F.explode("steps").alias("p")).where(~F.col("p.lat").between(-900_000_000, 900_000_000) | ~F.col("p.lng").between(-1_800_000_000, 1_800_000_000)),
    }
    if boxes is not None:
        checks["box_bad"] = boxes.where((F.col("min_lat") > F.col("max_lat")) | (F.col("min_lng") > F.col("max_lng")))
    out = None
    for name, rows in checks.items():
        row = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def extent(vertices: DataFrame) -> DataFrame:
    """The projected extent of the vertices."""
    x, y = geo.mercator(F.col("lat") / geo.SCALE, F.col("lng") / geo.SCALE)
    return vertices.select(x.alias("x"), y.alias("y")).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


def pixels(vertices: DataFrame, width: int = 64, height: int = 64) -> DataFrame:
    """(px, py, n): vertices a pixel of the projected map."""
    x, y = geo.mercator(F.col("lat") / geo.SCALE, F.col("lng") / geo.SCALE)
    rows = vertices.select(x.alias("x"), y.alias("y")).crossJoin(F.broadcast(extent(vertices)))
    px = F.least(F.floor(width * (F.col("x") - F.col("min_x")) / (F.col("max_x") - F.col("min_x"))), F.lit(width - 1))
    py = F.least(F.floor(height * (1 - (F.col("y") - F.col("min_y")) / (F.col("max_y") - F.col("min_y")))), F.lit(height - 1))
    return rows.groupBy(px.cast("bigint").alias("px"), py.cast("bigint").alias("py")).agg(F.count(F.lit(1)).alias("n"))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """The distinct values of ``key`` with their places (``number``) in order, from 1, counted by ranges and not in one task."""
    ids = rows.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id())
    ids = search.settled(ids.withColumn("place", F.monotonically_increasing_id() % (1 << 33)))
    firsts, total = [], 0
    for r in sorted(ids.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a partition
        firsts.append((r["part"], total + 1))
        total += r["n"]
    first = ids.sparkSession.createDataFrame(firsts, "part int, first bigint")
    return ids.join(F.broadcast(first), "part").select(key, (F.col("first") + F.col("place")).alias("number"))


def offset_errors(offsets: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, n): offsets (vertex_id, first_out) that fall, don't begin at 0, or leave out or exceed the edges of a vertex."""
    at = numbered(offsets, "vertex_id").join(offsets, "vertex_id")
    following = at.select((F.col("number") - 1).alias("number"), F.col("first_out").alias("next_out"))
    out = edges.groupBy(F.col("src").alias("vertex_id")).agg(F.count(F.lit(1)).alias("n"))
    rows = at.join(following, "number", "left").join(out, "vertex_id", "left")
    return rows.agg(
        F.count_if(F.col("next_out") < F.col("first_out")).alias("falling"),
        F.count_if((F.col("number") == 1) & (F.col("first_out") != 0)).alias("start"),
        F.count_if(F.col("next_out") - F.col("first_out") != F.coalesce("n", F.lit(0))).alias("wrong_degree"),
    ).select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("n")) for k in ("falling", "start", "wrong_degree")])).alias("c")).select("c.*")


def in_edge_errors(in_edges: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, n): in-edges (vertex_id, edge_id) that are no edges, end elsewhere, or stand twice; and edges that are no in-edge."""
    both = in_edges.groupBy("vertex_id", "edge_id").agg(F.count(F.lit(1)).alias("times")).join(edges.select("edge_id", "dst"), "edge_id", "full")
    return both.agg(
        F.count_if(F.col("dst").isNull()).alias("unknown"), F.count_if(F.col("times") > 1).alias("shared"),
        F.count_if(F.col("vertex_id") != F.col("dst")).alias("elsewhere"), F.count_if(F.col("times").isNull()).alias("missing"),
    ).select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("n")) for k in ("unknown", "shared", "elsewhere", "missing")])).alias("c")).select("c.*")
