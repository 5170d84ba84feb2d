"""Reachability, components and shortest paths by iterated joins; whole cells and legs by grouped functions."""

from __future__ import annotations

import heapq
import tempfile
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """``df`` in the shared checkpoint folder, so that a loop's plan stays short and lost executors cost nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] == "local":
            named = tempfile.mkdtemp(prefix="checkpoints-")
        if not named:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def reach(darts: DataFrame, sources: DataFrame, rounds: int = 100_000) -> DataFrame:
    """(vertex_id) reachable from the sources (vertex_id), these included."""
    links = settled(darts.select("src", "dst").distinct())
    frontier = settled(sources.select("vertex_id").distinct())
    # what was seen lies in few tables, each of twice the rounds of the next: so a vertex is written again only as often
    # as the rounds can be halved, and not once a round
    seen: list[tuple[int, DataFrame]] = [(1, frontier)]
    for _ in range(rounds):
        ahead = frontier.join(links, F.col("vertex_id") == F.col("src")).select(F.col("dst").alias("vertex_id")).distinct()
        for _, part in seen:
            ahead = ahead.join(part, "vertex_id", "left_anti")
        frontier = settled(ahead)
        if frontier.isEmpty():
            return _together([part for _, part in seen])
        seen.append((1, frontier))
        while len(seen) > 1 and seen[-1][0] == seen[-2][0]:
            (n, a), (_, b) = seen.pop(), seen.pop()
            seen.append((2 * n, settled(a.unionByName(b))))
    raise RuntimeError("the search did not end")


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def component_of(darts: DataFrame, vertex: int) -> DataFrame:
    """The strongly connected component of a vertex: reachable from it, and it from them."""
    start = darts.sparkSession.createDataFrame([(vertex,)], "vertex_id bigint")
    back = darts.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(darts, start).intersect(reach(back, start))


def strong_components(darts: DataFrame, rounds: int = 100_000) -> DataFrame:
    """(vertex_id, component) of every vertex of some dart, by forward-backward colouring.

    Every vertex takes the greatest colour that reaches it; what goes back to the colour's own vertex within its colour
    is a component and leaves. Vertices without darts in or out leave first, as components of their own.
    """
    links = settled(darts.select("src", "dst").where("src <> dst").distinct())
    left = settled(darts.select(F.col("src").alias("v")).unionByName(darts.select(F.col("dst").alias("v"))).distinct())
    done: list[DataFrame] = []
    for _ in range(rounds):
        if left.isEmpty():
            break
        core = links.select(F.col("src").alias("v")).intersect(links.select(F.col("dst").alias("v")))
        single = left.join(core, "v", "left_anti")
        if not single.isEmpty():
            done.append(settled(single.select(F.col("v").alias("vertex_id"), F.col("v").alias("component"))))
            left = settled(left.join(core, "v", "left_semi"))
            links = settled(links.join(left.withColumnRenamed("v", "src"), "src", "left_semi").join(left.withColumnRenamed("v", "dst"), "dst", "left_semi"))
            continue
        colour = settled(left.select("v", F.col("v").alias("c")))
        while True:
            better = links.join(colour, links["src"] == colour["v"]).groupBy(F.col("dst").alias("d")).agg(F.max("c").alias("b"))
            new = settled(colour.join(better, F.col("v") == F.col("d"), "left").select("v", F.greatest("c", "b").alias("c"), (F.coalesce("b", "c") > F.col("c")).alias("changed")))
            if new.where("changed").isEmpty():
                break
            colour = new.select("v", "c")
        same = settled(links.join(colour.select(F.col("v").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("v").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        roots = colour.where("v = c").select(F.col("v").alias("vertex_id"))
        found = settled(reach(same, roots).join(colour, F.col("vertex_id") == F.col("v")).select("vertex_id", F.col("c").alias("component")))
        done.append(found)
        gone = found.select(F.col("vertex_id").alias("v"))
        left = settled(left.join(gone, "v", "left_anti"))
        links = settled(links.join(left.withColumnRenamed("v", "src"), "src", "left_semi").join(left.withColumnRenamed("v", "dst"), "dst", "left_semi"))
    out = done[0] if done else left.select(F.col("v").alias("vertex_id"), F.col("v").alias("component"))
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def accessible(darts_by_mode: dict[str, DataFrame], min_size: int = 2**15) -> DataFrame:
    """(vertex_id, one column a mode): vertices in a strong component of ``min_size`` or more for some mode."""
    parts = None
    for mode, darts in darts_by_mode.items():
        comps = strong_components(darts)
        large = comps.groupBy("component").count().where(F.col("count") >= min_size).select("component")
        part = comps.join(large, "component", "left_semi").select("vertex_id", F.lit(mode).alias("mode"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("vertex_id").agg(*[F.max(F.col("mode") == m).alias(m) for m in darts_by_mode])


def distances(darts: DataFrame, sources: DataFrame, rounds: int = 100_000, bound: int | None = None) -> DataFrame:
    """(vertex_id, dist, parent, edge_id): least distances from sources (vertex_id, dist) by frontier relaxation.

    Ties go to the least parent, then the least edge. Each round joins only the vertices that the last one improved;
    ``bound`` stops after so many rounds.
    """
    best = darts.groupBy("src", "dst").agg(F.min(F.struct("weight", "edge_id")).alias("m"))
    links = settled(best.select("src", "dst", "m.weight", "m.edge_id"))
    now = settled(sources.groupBy("vertex_id").agg(F.min("dist").alias("dist")).select("vertex_id", "dist", F.lit(None).cast("bigint").alias("parent"), F.lit(None).cast("bigint").alias("edge_id"), F.lit(True).alias("new")))
    for k in range(rounds):
        if bound is not None and k >= bound:
            break
        frontier = now.where("new").select(F.col("vertex_id").alias("src"), "dist")
        offers = frontier.join(links, "src").groupBy(F.col("dst").alias("vertex_id")).agg(F.min(F.struct((F.col("dist") + F.col("weight")).alias("dist"), F.col("src").alias("parent"), "edge_id")).alias("o"))
        joined = now.join(offers, "vertex_id", "full")
        wins = F.col("o").isNotNull() & (F.col("dist").isNull() | (F.col("o.dist") < F.col("dist")))
        now = settled(joined.select("vertex_id", *[F.when(wins, F.col(f"o.{x}")).otherwise(F.col(x)).alias(x) for x in ("dist", "parent", "edge_id")], wins.alias("new")))
        if now.where("new").isEmpty():
            break
    return now.drop("new")


def violations(darts: DataFrame, sources: DataFrame, tree: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(kind, n): what contradicts that ``tree`` has least distances; all counts are 0 for a right one."""
    d, to = tree.select(F.col("vertex_id").alias("src"), F.col("dist").alias("du")), tree.select(F.col("vertex_id").alias("dst"), F.col("dist").alias("dv"))
    out = darts.join(d, "src").join(to, "dst", "left")
    checks = {
        "bad_weight": darts.where("weight <= 0 or isnan(weight) or weight = double('inf')"),
        "not_closed": out.where("dv is null"),
        "not_least": out.where(F.col("dv") > F.col("du") + F.col("weight") + tolerance),
        "loose_tree_edge": tree.where("parent is not null").join(darts.select(F.col("src").alias("parent"), F.col("dst").alias("vertex_id"), "edge_id", "weight"), ["parent", "vertex_id", "edge_id"], "left").join(d.withColumnsRenamed({"src": "parent"}), "parent", "left").where(F.coalesce(F.abs(F.col("du") + F.col("weight") - F.col("dist")) > tolerance, F.lit(True))),
        "bad_root": tree.where("parent is null").join(sources.select("vertex_id", F.col("dist").alias("d0")), "vertex_id", "left").where(F.coalesce(F.col("dist") > F.col("d0") + tolerance, F.lit(True))),
    }
    counts = [v.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, v in checks.items()]
    result = counts[0]
    for x in counts[1:]:
        result = result.unionByName(x)
    return result


def dijkstra(adjacent: dict[int, list[tuple[int, float, int]]], sources: dict[int, float], stops: set[int] = frozenset()) -> tuple[dict[int, float], dict[int, tuple[int, int]]]:
    """Distances and (parent, edge) on a graph that fits a task; no way goes on from ``stops`` that aren't sources."""
    dist, via, heap, closed = dict(sources), {}, [(d, v) for v, d in sources.items()], set()
    heapq.heapify(heap)
    while heap:
        d, v = heapq.heappop(heap)
        if v in closed:
            continue
        closed.add(v)
        if v in stops and v not in sources:
            continue
        for w, weight, edge in adjacent.get(v, ()):
            new = d + weight
            if w not in dist or new < dist[w] or new == dist[w] and w not in closed and (v, edge) < via.get(w, (v, edge)):
                dist[w], via[w] = new, (v, edge)
                heapq.heappush(heap, (new, w))
    return dist, via


def boundary_matrix(cell_darts: DataFrame, boundary: DataFrame, sparse: bool = False, rows: int = 20_000) -> DataFrame:
    """(cell_id, src, dst, weight): least distances within each cell between its boundary vertices; none if unreachable.

    ``cell_darts`` (cell_id, src, dst, weight) and ``boundary`` (cell_id, vertex_id) are dealt by cell, so a cell is a task's
    work, as large as cells are made. Of parallel darts a task gets the lightest, and it hands on about ``rows`` distances at
    once. ``sparse`` leaves out what goes through a third boundary vertex: the distances are then sums of those that stay.
    """

    def solve(cell: int, darts: list[pd.DataFrame], ends: list[pd.DataFrame]):
        adjacent = defaultdict(list)
        for part in darts:
            for v, w, weight in zip(part["src"].tolist(), part["dst"].tolist(), part["weight"].tolist(), strict=True):
                adjacent[int(v)].append((int(w), weight, 0))
        targets = sorted({int(v) for part in ends for v in part["src"].tolist()})
        stops, found, held = set(targets) if sparse else set(), [], 0
        for v in targets:
            dist, _ = dijkstra(adjacent, {v: 0.0}, stops)
            near = sorted(stops & dist.keys()) if sparse else targets
            some = [(w, dist[w]) for w in near if w != v and w in dist]
            if some:
                frame = pd.DataFrame(some, columns=["dst", "weight"])
                frame.insert(0, "src", v)
                frame.insert(0, "cell_id", cell)
                found.append(frame)
                held += len(frame)
            if held >= rows:
                yield pd.concat(found)
                found, held = [], 0
        if found:
            yield pd.concat(found)

    def by_cell(batches):
        cell, darts, ends = None, [], []
        for batch in batches:
            for number, part in batch.groupby("cell_id"):
                if number != cell:
                    if ends:
                        yield from solve(cell, darts, ends)
                    cell, darts, ends = int(number), [], []
                is_end = part["dst"].isna()
                darts.append(part.loc[~is_end, ["src", "dst", "weight"]])
                ends.append(part.loc[is_end, ["src"]])
        if ends:
            yield from solve(cell, darts, ends)

    lightest = cell_darts.groupBy("cell_id", "src", "dst").agg(F.min("weight").alias("weight"))
    ends = boundary.select("cell_id", F.col("vertex_id").alias("src"), F.lit(None).cast("bigint").alias("dst"), F.lit(None).cast("double").alias("weight"))
    # a fixed number of parts: cells are few and small for their work, and would be put together
    parts = max(cell_darts.sparkSession.sparkContext.defaultParallelism, int(cell_darts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = lightest.unionByName(ends).repartition(parts, "cell_id").sortWithinPartitions("cell_id")
    return dealt.mapInPandas(by_cell, "cell_id int, src bigint, dst bigint, weight double")
