"""Cells of the street graph, their boundaries, and the overlay of cut edges and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import network, search

MARGIN = 20_000  # fixed point: 0.002 degrees


def by_grid(vertices: DataFrame, rows: int = 4, columns: int = 4) -> DataFrame:
    """(vertex_id, cell_id) by a grid over the vertices' extent."""
    box = vertices.agg(*[f(k).alias(f"{k}_{n}") for k in ("lat", "lng") for n, f in (("lo", F.min), ("hi", F.max))])
    at = lambda k, n: F.floor((F.col(k) - F.col(f"{k}_lo")) * n / (F.col(f"{k}_hi") - F.col(f"{k}_lo") + 1))
    return vertices.crossJoin(F.broadcast(box)).select("vertex_id", (at("lat", rows) * columns + at("lng", columns)).cast("int").alias("cell_id"))


def by_curve(vertices: DataFrame, cells: int) -> DataFrame:
    """(vertex_id, cell_id) by ranges of the Hilbert curve that hold about as many vertices each."""
    keyed = vertices.select("vertex_id", geo.hilbert_key(F.col("lat"), F.col("lng")).alias("key"))
    cuts = keyed.agg(F.percentile_approx("key", [k / cells for k in range(1, cells)], 100 * cells)).first()[0] if cells > 1 else []
    bounds = F.split(F.lit(",".join(map(str, sorted(set(cuts or []))))), ",").cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    return keyed.select("vertex_id", F.size(F.filter(bounds, lambda b: b < F.col("key"))).alias("cell_id"))


def with_cells(edges: DataFrame, cell_of: DataFrame) -> DataFrame:
    """Edges with the cells of both ends."""
    return edges.join(cell_of.select(F.col("vertex_id").alias("src"), F.col("cell_id").alias("src_cell")), "src").join(cell_of.select(F.col("vertex_id").alias("dst"), F.col("cell_id").alias("dst_cell")), "dst")


def cut_edges(celled: DataFrame) -> DataFrame:
    return celled.where("src_cell <> dst_cell")


def boundary(celled: DataFrame) -> DataFrame:
    """(cell_id, vertex_id): ends of cut edges, whatever may use these."""
    cut = cut_edges(celled)
    return cut.select(F.col("src_cell").alias("cell_id"), F.col("src").alias("vertex_id")).unionByName(cut.select(F.col("dst_cell").alias("cell_id"), F.col("dst").alias("vertex_id"))).distinct()


def sizes(cell_of: DataFrame) -> DataFrame:
    return cell_of.groupBy("cell_id").agg(F.count(F.lit(1)).alias("vertices"))


def numbering(cell_of: DataFrame, boundary_df: DataFrame) -> DataFrame:
    """(cell_id, vertex_id, is_boundary, local_id): vertices numbered within their cell, boundary ones first."""
    marked = cell_of.join(boundary_df.select("vertex_id", F.lit(True).alias("is_boundary")), "vertex_id", "left").withColumn("is_boundary", F.coalesce("is_boundary", F.lit(False)))
    order = Window.partitionBy("cell_id").orderBy(F.desc("is_boundary"), "vertex_id")
    return marked.select("cell_id", "vertex_id", "is_boundary", (F.row_number().over(order) - 1).cast("bigint").alias("local_id"))


def boxes(points: DataFrame, margin: int = MARGIN) -> DataFrame:
    """(cell_id, min_lat, min_lng, max_lat, max_lng) of the points (cell_id, lat, lng) of each cell, with a margin."""
    return points.groupBy("cell_id").agg((F.min("lat") - margin).alias("min_lat"), (F.min("lng") - margin).alias("min_lng"), (F.max("lat") + margin).alias("max_lat"), (F.max("lng") + margin).alias("max_lng"))


def overlay(celled: DataFrame, mode: str, metric: str, sparse: bool = False) -> tuple[DataFrame, DataFrame]:
    """Darts (src, dst, edge_id, weight, cell_id) of the overlay and of the cells, for one mode and metric.

    In the overlay, shortcuts between boundary vertices of a cell have no edge and the cell's number; cut edges have
    their edge and no cell. Of parallel darts the best one stays. With ``sparse`` there are only shortcuts that don't go
    through a third boundary vertex: distances over the overlay are the same, and where most vertices lie on a boundary
    its size is that of the graph and not of all pairs.
    """
    inner = celled.where("src_cell = dst_cell")
    attached = inner.select("edge_id", F.col("src_cell").alias("cell_id"))
    cell_darts = network.best_parallel(network.darts(inner, mode, metric)).join(attached, "edge_id")
    shortcuts = search.boundary_matrix(cell_darts.select("cell_id", "src", "dst", "weight"), boundary(celled), sparse)
    cut = network.best_parallel(network.darts(cut_edges(celled), mode, metric)).select("src", "dst", "edge_id", "weight", F.lit(None).cast("int").alias("cell_id"))
    return cut.unionByName(shortcuts.select("src", "dst", F.lit(None).cast("bigint").alias("edge_id"), "weight", "cell_id")), cell_darts
