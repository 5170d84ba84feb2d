"""Routes: requests, legs, steps with instructions, totals, boxes and the JSON document."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import search

OK, NO_ROUTE = "OK", "No route found"
TRAVELMODES = {"driving": "car", "walking": "foot", "bicycling": "bike"}
METRICS = ["distance", "time"]


def distance_text(metres: Column) -> Column:
    return F.when(metres < 0.5, F.format_string("%.2f mm", metres * 1000)).when(metres < 500, F.format_string("%.2f m", metres)).otherwise(F.format_string("%.2f km", metres / 1000))


def duration_text(seconds: Column) -> Column:
    return F.when(seconds < 30, F.format_string("%.2f secs", seconds)).when(seconds < 1800, F.format_string("%.2f mins", seconds / 60)).otherwise(F.format_string("%.2f hours", seconds / 3600))


def measured(value: Column, text) -> Column:
    return F.struct(text(value).alias("text"), value.cast("bigint").alias("value"))


def duration(metres: Column, maxspeed: Column, mode: str) -> Column:
    """Seconds of a step: a car's by the limit (30 km/h where there is none), else by a usual pace."""
    if mode == "car":
        return F.when(F.coalesce(maxspeed, F.lit(0)) > 0, metres * 3.6 / maxspeed).otherwise(metres * 0.12)
    return metres / (1.1 if mode == "foot" else 13.0)


def parse_waypoints(value: Column) -> Column:
    """The points (lat, lng) of ``lat,lng|lat,lng...``; null if there are fewer than two or one can't be read."""
    parts = F.split(value, "\\|")
    number = lambda x: x.try_cast("double")
    points = F.transform(parts, lambda p: F.struct(number(F.split(p, ",")[0]).alias("lat"), F.try_element_at(F.split(p, ","), F.lit(2)).try_cast("double").alias("lng"), (F.size(F.split(p, ",")) == 2).alias("ok")))
    good = (F.size(parts) >= 2) & F.forall(points, lambda p: p["ok"] & p["lat"].isNotNull() & p["lng"].isNotNull())
    return F.when(good, F.transform(points, lambda p: F.struct(p["lat"], p["lng"])))


def read_waypoints(text: str | None) -> list[tuple[float, float]]:
    """The points of a request, or a ValueError that says what is wrong with it."""
    if not text:
        raise ValueError("no waypoints")
    parts = text.split("|")
    if len(parts) < 2:
        raise ValueError("too few waypoints. at least 2 waypoints are required")
    out = []
    for part in parts:
        pair = part.split(",")
        if len(pair) != 2:
            raise ValueError(f"wrong formatted coordinate in waypoint list: {part}")
        values = []
        for x in pair:
            try:
                values.append(float(x))
            except ValueError:
                raise ValueError(f"wrong formatted number in waypoint list: {x}") from None
        out.append((values[0], values[1]))
    return out


def read_request(waypoints: str | None, travelmode: str | None, metric: str | None, avoid: str | None) -> tuple[list[tuple[float, float]], str, str, bool]:
    """Points, mode, metric and whether to avoid ferries; by default a car's and time. Wrong requests raise ValueError."""
    points = read_waypoints(waypoints)
    travelmode, metric = "driving" if travelmode is None else travelmode, "time" if metric is None else metric
    if travelmode not in TRAVELMODES:
        raise ValueError("wrong travelmode")
    if metric not in METRICS:
        raise ValueError("wrong metric")
    if avoid not in (None, "ferries"):
        raise ValueError("wrong avoid")
    return points, TRAVELMODES[travelmode], metric, avoid == "ferries"


def read_requests(asked: pd.DataFrame) -> pd.DataFrame:
    """``read_request`` of each row, and the text of what is wrong with it."""
    out = []
    for r in asked.itertuples(index=False):
        try:
            out.append((*read_request(*(None if pd.isna(x) else x for x in r)), None))
        except ValueError as wrong:
            out.append((None, None, None, None, str(wrong)))
    return pd.DataFrame(out, columns=["points", "mode", "metric", "avoid", "error"])


def legs(overlay: DataFrame, inner: DataFrame, starts: DataFrame, ends: DataFrame, tasks: int) -> DataFrame:
    """(leg, pos, src, dst, edge_id, cell_id, dist): the best path of every leg, none for a leg without one.

    ``overlay`` (src, dst, edge_id, weight, cell_id) is for all legs, ``inner`` has the darts of the cells of a leg's ends and
    the leg; ``starts`` and ``ends`` have leg, vertex_id and cost. The legs are dealt to ``tasks`` tasks, each of which reads the
    overlay once and searches its legs one after another.
    """
    names = ["src", "dst", "edge_id", "cell_id", "weight"]
    task = F.pmod("leg", F.lit(tasks)).cast("int").alias("task")
    numbers = overlay.sparkSession.range(tasks).select(F.col("id").cast("int").alias("task"))
    rows = overlay.crossJoin(F.broadcast(numbers)).select("task", F.lit(None).cast("bigint").alias("leg"), F.lit("d").alias("kind"), *names)
    rows = rows.unionByName(inner.select(task, "leg", F.lit("d").alias("kind"), *names))
    for kind, part in (("s", starts), ("t", ends)):
        none = F.lit(None)
        rows = rows.unionByName(part.select(task, "leg", F.lit(kind).alias("kind"), F.col("vertex_id").alias("src"), none.cast("bigint").alias("dst"), none.cast("bigint").alias("edge_id"), none.cast("int").alias("cell_id"), F.col("cost").alias("weight")))

    def solve(batch: pd.DataFrame) -> pd.DataFrame:
        links, shared, own, sides = [], defaultdict(list), defaultdict(lambda: defaultdict(list)), {"s": defaultdict(dict), "t": defaultdict(dict)}
        for row in batch.itertuples(index=False):
            if row.kind == "d":
                near = shared if pd.isna(row.leg) else own[int(row.leg)]
                near[int(row.src)].append((int(row.dst), float(row.weight), len(links)))
                links.append((None if pd.isna(row.edge_id) else int(row.edge_id), None if pd.isna(row.cell_id) else int(row.cell_id)))
            else:
                side = sides[row.kind][int(row.leg)]
                side[int(row.src)] = min(float(row.weight), side.get(int(row.src), float("inf")))
        by = lambda x: (x[0], x[1], links[x[2]][0] or -1)
        for some in shared.values():
            some.sort(key=by)
        out = []
        for leg in sorted(sides["s"].keys() & sides["t"].keys()):
            adjacent = shared | {v: sorted(shared.get(v, []) + more, key=by) for v, more in own[leg].items()}
            dist, via = search.dijkstra(adjacent, sides["s"][leg])
            best = min(((dist[v] + cost, v) for v, cost in sides["t"][leg].items() if v in dist), default=None)
            if best:
                v, chain = best[1], []
                while v in via:
                    chain.append((via[v][0], v, *links[via[v][1]]))
                    v = via[v][0]
                out += [(leg, k, a, b, e, c, best[0]) for k, (a, b, e, c) in enumerate(reversed(chain))] or [(leg, 0, v, v, None, None, best[0])]
        frame = pd.DataFrame(out, columns=["leg", "pos", "src", "dst", "edge_id", "cell_id", "dist"])
        return frame.astype({"edge_id": "Int64", "cell_id": "Int32"})

    return rows.groupBy("task").applyInPandas(solve, "leg bigint, pos int, src bigint, dst bigint, edge_id bigint, cell_id int, dist double")


def unpacked(path: DataFrame, cell_darts: DataFrame) -> DataFrame:
    """The path with every shortcut replaced by the edges of its cell that it stands for."""
    sketch = path.where("edge_id is null and cell_id is not null")

    def solve(links: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        adjacent = defaultdict(list)
        for row in links.itertuples(index=False):
            adjacent[int(row.src)].append((int(row.dst), float(row.weight), int(row.edge_id)))
        out = []
        for row in wanted.itertuples(index=False):
            _, via = search.dijkstra(adjacent, {int(row.src): 0.0})
            v, chain = int(row.dst), []
            while v != int(row.src):
                chain.append((via[v][0], v, via[v][1]))
                v = via[v][0]
            out += [(row.leg, row.pos, k, a, b, e, row.dist) for k, (a, b, e) in enumerate(reversed(chain))]
        return pd.DataFrame(out, columns=["leg", "pos", "part", "src", "dst", "edge_id", "dist"])

    parts = cell_darts.select("cell_id", "src", "dst", "edge_id", "weight").groupBy("cell_id").cogroup(sketch.groupBy("cell_id")).applyInPandas(solve, "leg bigint, pos int, part int, src bigint, dst bigint, edge_id bigint, dist double")
    plain = path.where("edge_id is not null or cell_id is null").select("leg", "pos", F.lit(0).alias("part"), "src", "dst", "edge_id", "dist")
    order = Window.partitionBy("leg").orderBy("pos", "part")
    return plain.unionByName(parts).withColumn("pos", F.row_number().over(order) - 1).drop("part")


def steps(path: DataFrame, edges: DataFrame, starts: DataFrame, ends: DataFrame, vertices: DataFrame, mode: str) -> DataFrame:
    """(leg, pos, line, metres, seconds, instruction): the steps of each leg, with the parts before and after the graph's edges."""
    at = vertices.select(F.col("vertex_id").alias("src"), F.struct("lat", "lng").alias("p_src"))
    to = vertices.select(F.col("vertex_id").alias("dst"), F.struct("lat", "lng").alias("p_dst"))
    facts = edges.select("edge_id", F.col("src").alias("e_src"), "steps", "maxspeed")
    run = path.where("edge_id is not null").join(at, "src").join(to, "dst").join(facts, "edge_id")
    forward = F.col("src") == F.col("e_src")
    inner = F.when(F.size("steps") < 2, F.slice("steps", 1, 0)).when(forward, F.slice("steps", 1, F.greatest(F.size("steps") - 1, F.lit(1)))).otherwise(F.reverse(F.slice("steps", 1, F.greatest(F.size("steps") - 1, F.lit(1)))))
    middle = run.select("leg", F.lit(1).alias("part"), "pos", F.concat(F.array("p_src"), inner, F.array("p_dst")).alias("line"), "maxspeed")
    first = path.groupBy("leg").agg(F.min_by("src", "pos").alias("v"), F.max_by("dst", "pos").alias("w"))
    pick = lambda part, v, k: part.join(first, [part["leg"] == first["leg"], part["vertex_id"] == first[v]]).where("length > 1e-7").select(part["leg"], F.lit(k).alias("part"), F.lit(0).alias("pos"), F.col("path").alias("line"), F.lit(None).cast("int").alias("maxspeed"))
    rows = pick(starts, "v", 0).unionByName(middle).unionByName(pick(ends, "w", 2))
    order = Window.partitionBy("leg").orderBy("part", "pos")
    metres = geo.line_length(F.transform("line", lambda p: p["lat"] / geo.SCALE), F.transform("line", lambda p: p["lng"] / geo.SCALE))
    rows = rows.withColumn("metres", metres).withColumn("seconds", duration(F.col("metres"), F.col("maxspeed"), mode))
    a, b = F.element_at("line", 1), F.element_at("line", -1)
    point = lambda s: (s["lat"] / geo.SCALE, s["lng"] / geo.SCALE)
    turn = geo.orientation(point(F.lag(a).over(order)), point(F.lag(b).over(order)), point(b))
    number = F.row_number().over(order)
    return rows.withColumn("instruction", F.when(number == 1, "Start your journey").otherwise(turn)).withColumn("pos", number - 1).drop("part", "maxspeed")


def document(steps_df: DataFrame, legs_df: DataFrame) -> DataFrame:
    """(request, json, distance, duration, legs): the route of all legs (request, leg, start, stop: positions of their ends), in order."""
    point = lambda s: F.array(s["lat"] / geo.SCALE, s["lng"] / geo.SCALE)
    step = F.struct(measured(F.col("metres"), distance_text).alias("distance"), measured(F.col("seconds"), duration_text).alias("duration"), point(F.element_at("line", 1)).alias("start_location"), point(F.element_at("line", -1)).alias("end_location"), F.transform("line", point).alias("polyline"), F.col("instruction"))
    box = lambda f, k: f(F.expr(f"{'array_max' if f is F.max else 'array_min'}(transform(line, p -> p.{k}))"))
    by_leg = steps_df.groupBy("leg").agg(F.sort_array(F.collect_list(F.struct("pos", step.alias("s")))).alias("ss"), F.sum(F.col("metres").cast("bigint")).alias("d"), F.sum(F.col("seconds").cast("bigint")).alias("t"), box(F.max, "lat").alias("n"), box(F.min, "lng").alias("w"), box(F.min, "lat").alias("s_"), box(F.max, "lng").alias("e"))
    full = legs_df.join(by_leg, "leg", "left")
    zero = F.lit(0).cast("bigint")
    d, t = F.coalesce("d", zero), F.coalesce("t", zero)
    leg = F.struct(F.when(F.col("found"), OK).otherwise(NO_ROUTE).alias("status"), measured(d.cast("double"), distance_text).alias("distance"), measured(t.cast("double"), duration_text).alias("duration"), point(F.col("start")).alias("start_location"), point(F.col("stop")).alias("end_location"), F.coalesce(F.transform("ss", lambda x: x["s"]), F.array()).alias("steps"))
    whole = full.groupBy("request").agg(F.sort_array(F.collect_list(F.struct("leg", leg.alias("l")))).alias("ls"), F.sum(d).alias("d"), F.sum(t).alias("t"), *[f(F.coalesce(k, zero)).alias(k) for f, k in ((F.max, "n"), (F.min, "w"), (F.min, "s_"), (F.max, "e"))], F.min_by("start", "leg").alias("start"), F.max_by("stop", "leg").alias("stop"))
    route = F.struct(measured(F.col("d").cast("double"), distance_text).alias("distance"), measured(F.col("t").cast("double"), duration_text).alias("duration"), point(F.col("start")).alias("start_location"), point(F.col("stop")).alias("end_location"), F.transform("ls", lambda x: x["l"]).alias("legs"))
    bounds = F.struct(F.array(F.col("n") / geo.SCALE, F.col("w") / geo.SCALE).alias("nw"), F.array(F.col("s_") / geo.SCALE, F.col("e") / geo.SCALE).alias("se"))
    return whole.select("request", F.to_json(F.struct(bounds.alias("boundingBox"), F.array(route).alias("routes"))).alias("json"), F.col("d").alias("distance"), F.col("t").alias("duration"), F.size("ls").alias("legs"))
