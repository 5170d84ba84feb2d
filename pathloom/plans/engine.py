"""The routing engine: a prepared network and the requests it answers."""

from __future__ import annotations

import json
import time
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import cells, network, route, search, snap, stats


#: Bytes of answers that an engine keeps.
CACHE_BYTES = 100 * 1024 * 1024
#: From how many legs points are snapped by a grid and not by broadcast, and legs share tasks; and how many share one.
MANY_LEGS, LEGS_A_TASK = 16, 50


class Cache:
    """Texts by key, of at most so many bytes together; the ones that were not asked for longest go first."""

    def __init__(self, most: int):
        self.most, self.bytes = most, 0
        self.held: OrderedDict[tuple, str] = OrderedDict()

    def __len__(self) -> int:
        return len(self.held)

    def get(self, key: tuple) -> str | None:
        if key in self.held:
            self.held.move_to_end(key)
        return self.held.get(key)

    def put(self, key: tuple, text: str) -> None:
        """Keeps a text, if it alone is not larger than the cache."""
        self.bytes -= len(self.held.pop(key, "").encode())
        if (size := len(text.encode())) <= self.most:
            self.held[key] = text
            self.bytes += size
        while self.bytes > self.most:
            self.bytes -= len(self.held.popitem(last=False)[1].encode())


class Engine:
    """Answers route requests over (vertices, edges).

    With ``cell_count`` cells a leg searches the overlay and the cells of its ends; with 1 it searches the whole graph.
    Overlays are made once for each mode and metric, and kept in the checkpoint folder.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame, cell_count: int = 1, cache_bytes: int = CACHE_BYTES):
        self.vertices, self.edges = search.settled(vertices), search.settled(edges)
        self.cells = search.settled(cells.by_curve(self.vertices, cell_count))
        self.celled = search.settled(cells.with_cells(self.edges, self.cells))
        self.points = search.settled(snap.points(self.vertices, self.edges))
        self.overlays: dict[tuple[str, str, bool], tuple[DataFrame, DataFrame]] = {}
        self.answers = Cache(cache_bytes)
        self.began = time.time()

    @property
    def spark(self) -> SparkSession:
        return self.vertices.sparkSession

    def overlay(self, mode: str, metric: str, avoid_ferries: bool = False) -> tuple[DataFrame, DataFrame]:
        key = (mode, metric, avoid_ferries)
        if key not in self.overlays:
            celled = self.celled.where("not ferry") if avoid_ferries else self.celled
            self.overlays[key] = tuple(search.settled(x) for x in cells.overlay(celled, mode, metric, sparse=True))
        return self.overlays[key]

    def route(self, waypoints: str, travelmode: str = "driving", metric: str = "time", avoid: str | None = None) -> DataFrame:
        """One row with the route's JSON document, metres, seconds and legs. Wrong requests raise ValueError."""
        points, *kind = route.read_request(waypoints, travelmode, metric, avoid)
        rows = [(0, k, lat, lng, k == 0, k == len(points) - 1) for k, (lat, lng) in enumerate(points)]
        return self._routes(self.spark.createDataFrame(rows, "request bigint, query_id bigint, lat double, lng double, first boolean, last boolean"), *kind).drop("request")

    def route_many(self, requests: DataFrame) -> DataFrame:
        """(request_id, error, json, distance, duration, legs) of every request (request_id, waypoints, travelmode, metric, avoid).

        Nulls are the defaults; a wrong request has the text of its error and no route. Requests of one travelmode, metric and
        avoid are one plan. Ids are bigint; of rows with one id one counts, and rows without an id go. A request has less than 2^20 points.
        """
        read = F.pandas_udf(route.read_requests, "points array<array<double>>, mode string, metric string, avoid boolean, error string")
        once = requests.where("request_id is not null").dropDuplicates(["request_id"])
        known = search.settled(once.select("request_id", read(F.struct("waypoints", "travelmode", "metric", "avoid")).alias("r")).select("request_id", "r.*"))
        at = search.settled(stats.numbered(known.where("error is null"), "request_id").join(known, "request_id"))
        none = F.lit(None)
        out = known.where("error is not null").select("request_id", "error", none.cast("string").alias("json"), none.cast("bigint").alias("distance"), none.cast("bigint").alias("duration"), none.cast("int").alias("legs"))
        for kind in at.select("mode", "metric", "avoid").distinct().collect():  # twelve at most
            same = at.where((F.col("mode") == kind["mode"]) & (F.col("metric") == kind["metric"]) & (F.col("avoid") == kind["avoid"]))
            points = same.select("number", F.size("points").alias("n"), F.posexplode("points").alias("pos", "p"))
            points = points.select(F.col("number").alias("request"), (F.col("number") * (1 << 20) + F.col("pos")).alias("query_id"), F.col("p")[0].alias("lat"), F.col("p")[1].alias("lng"), (F.col("pos") == 0).alias("first"), (F.col("pos") == F.col("n") - 1).alias("last"))
            found = self._routes(search.settled(points), *kind).join(at.select("request_id", F.col("number").alias("request")), "request")
            out = out.unionByName(found.select("request_id", none.cast("string").alias("error"), "json", "distance", "duration", "legs"))
        return out

    def answer(self, waypoints: str, travelmode: str = "driving", metric: str = "time", avoid: str | None = None) -> str:
        """The JSON document of ``route``, one string; documents are kept, by all parameters, up to the cache's bytes."""
        key = (waypoints, travelmode, metric, avoid)
        found = self.answers.get(key)
        if found is None:
            found = self.route(*key).first()["json"]
            self.answers.put(key, found)
        return found

    def _routes(self, points: DataFrame, mode: str, metric: str, avoid_ferries: bool) -> DataFrame:
        """The documents of requests given by points (request, query_id, lat, lng, first, last), whose ``query_id`` rises by one within a request."""
        fixed = [F.floor(F.col(k) * geo.SCALE + 0.5).cast("bigint").alias(f"q{k}") for k in ("lat", "lng")]
        asked = points.select("query_id", *fixed)
        number = search.settled(points.where("not last").select(F.col("query_id").alias("leg"), "request"))
        count = number.count()
        snapped = search.settled(snap.nearest(asked, self.points, mode) if count < MANY_LEGS else snap.nearest_by_grid(asked, self.points.where(mode)))
        sides = []
        for forward, end, shift in ((True, "last", 0), (False, "first", 1)):
            way = snap.approaches(snapped, self.edges, self.vertices, mode, forward).join(points.where(f"not {end}").select("query_id"), "query_id", "left_semi")
            sides.append(search.settled(way.withColumn("leg", F.col("query_id") - shift).withColumn("cost", F.col("length"))))
        starts, ends = sides
        overlay, cell_darts = self.overlay(mode, metric, avoid_ferries)
        ends_cells = starts.select("leg", "vertex_id").unionByName(ends.select("leg", "vertex_id")).join(self.cells, "vertex_id").select("leg", "cell_id").distinct()
        inner = cell_darts.join(ends_cells, "cell_id").select("src", "dst", "edge_id", "weight", "cell_id", "leg")
        tasks = max(1, min(count, MANY_LEGS), -(-count // LEGS_A_TASK))
        path = search.settled(route.unpacked(search.settled(route.legs(overlay, inner, starts, ends, tasks)), cell_darts))
        at = snapped.select("query_id", F.struct("lat", "lng").alias("p"))
        found = path.select("leg").distinct().withColumn("found", F.lit(True))
        legs = number.join(at.select(F.col("query_id").alias("leg"), F.col("p").alias("start")), "leg").join(at.select((F.col("query_id") - 1).alias("leg"), F.col("p").alias("stop")), "leg").join(found, "leg", "left").withColumn("found", F.coalesce("found", F.lit(False)))
        return search.settled(route.document(route.steps(path, self.edges, starts, ends, self.vertices, mode), legs))

    def features(self) -> str:
        return json.dumps({"travelmode": {"driving": True, "walking": True, "bicycling": True}, "metric": {"distance": True, "time": True}, "avoid": {"ferries": True}})

    def status(self) -> dict:
        return {"uptime_s": time.time() - self.began, "overlays": len(self.overlays), "answers": len(self.answers)}


def prepared(ways: DataFrame, nodes: DataFrame, *, modes: list[str] = network.MODES, min_size: int = 2**15, cell_count: int = 1) -> Engine:
    """An engine over ways and nodes, cleaned to the large strong components of each mode."""
    vertices, edges = network.build(ways, nodes, modes)
    edges = search.settled(edges)
    region = search.settled(search.accessible({m: network.darts(edges, m) for m in modes}, min_size))
    return Engine(vertices.join(region, "vertex_id", "left_semi"), network.induced(edges, region), cell_count)
