"""Files of a prepared network: Parquet tables, partition vectors and graphs as text, and the request log."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells, network, snap, stats

METRICS = ["distance", "time"]


def save_network(vertices: DataFrame, edges: DataFrame, folder: str, cell_of: DataFrame | None = None) -> None:
    """Writes ``vertices`` and ``edges``; with ``cell_of`` (vertex_id, cell_id) the edges' cells, overlays and snap points too.

    Edges are written by cell of their source, overlays by mode and metric, so that readers skip what they don't need.
    """
    vertices.write.mode("overwrite").parquet(f"{folder}/vertices")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")
    if cell_of is None:
        return
    spark = vertices.sparkSession
    cell_of.write.mode("overwrite").parquet(f"{folder}/cells")
    kept = spark.read.parquet(f"{folder}/cells")
    cells.with_cells(spark.read.parquet(f"{folder}/edges"), kept).write.mode("overwrite").partitionBy("src_cell").parquet(f"{folder}/celled")
    celled = spark.read.parquet(f"{folder}/celled")
    for mode in network.MODES:
        for metric in METRICS:
            shortcuts, _ = cells.overlay(celled, mode, metric)
            shortcuts.write.mode("overwrite").parquet(f"{folder}/overlay/mode={mode}/metric={metric}")
    points = snap.points(spark.read.parquet(f"{folder}/vertices"), spark.read.parquet(f"{folder}/edges"))
    points.write.mode("overwrite").parquet(f"{folder}/points")
    cells.boxes(points.join(kept, "vertex_id")).write.mode("overwrite").parquet(f"{folder}/boxes")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a saved network: vertices, edges, cells, celled, overlay, points or boxes."""
    return spark.read.parquet(f"{folder}/{name}")


def load_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """The cells' boxes; raises if a cell that has points has none, or more than one."""
    boxes = load(spark, folder, "boxes")
    held = load(spark, folder, "points").join(load(spark, folder, "cells"), "vertex_id").select("cell_id").distinct()
    if not boxes.groupBy("cell_id").count().join(held.withColumn("held", F.lit(1)), "cell_id", "full").where("held is null or count is null or count <> 1").isEmpty():
        raise ValueError("boxes and cells don't match")
    return boxes


def save_induced(vertices: DataFrame, edges: DataFrame, wanted: DataFrame, folder: str) -> None:
    """Writes the part of a network that some vertices (vertex_id) induce."""
    save_network(vertices.join(wanted.select("vertex_id").distinct(), "vertex_id", "left_semi"), network.induced(edges, wanted), folder)


def metis_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(number, line): the graph as METIS reads it. Line 0 has the numbers of vertices and edges, the others a vertex's neighbours.

    Neighbours are numbered from 1, in order; parallel edges count once, loops not at all.
    """
    number = stats.numbered(vertices, "vertex_id")
    of = lambda k: number.select(F.col("vertex_id").alias(k), F.col("number").alias(f"{k}_n"))
    pairs = edges.select("src", "dst").join(of("src"), "src").join(of("dst"), "dst").where("src <> dst").select(F.least("src_n", "dst_n").alias("a"), F.greatest("src_n", "dst_n").alias("b")).distinct()
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rows = both.groupBy(F.col("a").alias("number")).agg(F.array_join(F.sort_array(F.collect_list("b")).cast("array<string>"), " ").alias("line"))
    lines = number.select("number").join(rows, "number", "left").select("number", F.coalesce("line", F.lit("")).alias("line"))
    head = number.agg(F.count(F.lit(1)).alias("v")).crossJoin(pairs.agg(F.count(F.lit(1)).alias("e")))  # a row each
    return head.select(F.lit(0).cast("bigint").alias("number"), F.concat_ws(" ", "v", "e").alias("line")).unionByName(lines)


def write_metis(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes the METIS graph as text, sorted; its parts in order of name are the file."""
    metis_lines(vertices, edges).orderBy("number").select("line").write.mode("overwrite").text(path)


def read_partition(spark: SparkSession, path: str, vertices: DataFrame) -> DataFrame:
    """(vertex_id, cell_id) of a partition vector: a cell's number a line, in the order of the vertices' ids.

    A file is read as one value and cut in lines, since lines are told apart by their place alone. Raises if there are not
    as many lines as vertices.
    """
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split(F.rtrim(F.regexp_replace("value", "\\s+$", "")), "\\r?\\n")).alias("place", "cell"))
    given = lines.select((F.col("place") + 1).cast("bigint").alias("number"), F.trim("cell").cast("int").alias("cell_id"))
    both = stats.numbered(vertices, "vertex_id").join(given, "number", "full")
    if not both.where("vertex_id is null or cell_id is null").isEmpty():
        raise ValueError("the partition has not a line for each vertex")
    return both.select("vertex_id", "cell_id")


def log_requests(spark: SparkSession, requests: list[tuple[datetime.datetime, int, str]], folder: str) -> None:
    """Appends requests (time in UTC, microseconds taken, URL) to the log of their day: a line each, with time, microseconds and URL."""
    rows = spark.createDataFrame([(t.strftime("%Y-%m-%d"), f"{t.strftime('%Y-%m-%dT%H:%M:%S')}Z {micros} {url}") for t, micros, url in requests], "day string, value string")
    rows.write.mode("append").partitionBy("day").text(folder)
