import datetime
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from pathloom.operators import cells, network
from pathloom.sources import pbf, store


# a small writer of the file format, by its public description
def varint(n):
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


zig = lambda n: n << 1 if n >= 0 else (-n << 1) - 1
num = lambda k, n: varint(k << 3) + varint(n)
part = lambda k, data: varint(k << 3 | 2) + varint(len(data)) + data
many = lambda k, ns: part(k, b"".join(map(varint, ns)))
deltas = lambda ns: [zig(b - a) for a, b in zip([0, *ns], ns)]


def block(kind, data, *, how="zlib"):
    body = {"raw": part(1, data), "zlib": num(2, len(data)) + part(3, zlib.compress(data)), "no size": part(3, zlib.compress(data)), "lzma": num(2, len(data)) + part(4, data)}[how]
    head = part(1, kind.encode()) + num(3, len(body))
    return struct.pack(">i", len(head)) + head + body


def header(*required):
    return block("OSMHeader", b"".join(part(4, r.encode()) for r in required), how="raw")


STRINGS = ["", "highway", "primary", "name", "Straße", "stop", "inner"]
TABLE = part(1, b"".join(part(1, s.encode()) for s in STRINGS))
IDS, LATS, LNGS = [10, 7, 3_000_000_000, 12], [495_000_000, -495_000_001, 0, 5], [70_000_000, 1_799_999_999, -1_800_000_000, 6]
DENSE = part(2, part(2, many(1, deltas(IDS)) + many(8, deltas(LATS)) + many(9, deltas(LNGS)) + many(10, [1, 2, 3, 4, 0, 0, 3, 5, 0])))
NODE = part(2, part(1, num(1, zig(-5)) + num(8, zig(100)) + num(9, zig(-200)) + many(2, [1]) + many(3, [5])))
WAY = part(2, part(3, num(1, 77) + many(2, [1, 3]) + many(3, [2, 4]) + many(8, deltas([10, 7, 3_000_000_000, 7]))))
RELATION = part(2, part(4, num(1, 88) + many(2, [3]) + many(3, [4]) + many(8, [6, 0]) + many(9, deltas([77, 10])) + many(10, [1, 0])))
GOOD = header("OsmSchema-V0.6", "DenseNodes")


def written(tmp_path, data, name="x.osm.pbf"):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


def test_entities_of_a_file(spark, tmp_path, monkeypatch):
    path = written(tmp_path, GOOD + block("OSMData", TABLE + DENSE + NODE) + block("OSMData", TABLE + WAY + RELATION, how="raw") + block("OSMData", num(17, 1000) + num(19, (1 << 64) - 500) + num(20, 700) + TABLE + NODE))
    nodes = sorted((r.node_id, r.lat, r.lng, tuple(sorted(r.tags.items()))) for r in pbf.read(spark, path, "nodes").collect())
    road, stop = (("highway", "primary"), ("name", "Straße")), (("highway", "stop"),)
    assert nodes == sorted([(10, LATS[0], LNGS[0], road), (7, LATS[1], LNGS[1], ()), (3_000_000_000, 0, LNGS[2], (("name", "stop"),)), (12, 5, 6, ()), (-5, 100, -200, stop), (-5, 995, -1993, stop)])
    assert [(r.way_id, r.nodes, r.tags) for r in pbf.read(spark, path).collect()] == [(77, [10, 7, 3_000_000_000, 7], dict(road))]
    assert [(r.relation_id, [tuple(m) for m in r.members], r.tags) for r in pbf.read(spark, path, "relations").collect()] == [(88, [(1, 77, "inner"), (0, 10, "")], {"name": "Straße"})]
    monkeypatch.setattr(pbf, "PARTITION_BYTES", 1)
    assert len(pbf.Reader(path, "ways", pbf.ARROW["ways"]).partitions()) == 3
    vertices, edges = network.build(pbf.read(spark, path), pbf.read(spark, path, "nodes"))
    assert vertices.count() > 0 and edges.count() > 0


@pytest.mark.parametrize(
    "data, message",
    [
        (block("OSMData", TABLE), "must begin"), (GOOD + GOOD, "second"), (header("HistoricalInformation"), "unknown required"), (GOOD + block("OSMTiles", TABLE), "unknown block"),
        (struct.pack(">i", 65 * 1024) + b"x", "too long"), (GOOD[:-1], "ends"), (GOOD + b"\0", "ends"), (GOOD + struct.pack(">i", 15) + part(1, b"OSMData") + num(3, 1 << 30), "too long"),
    ],
)
def test_broken_files(tmp_path, data, message):
    with pytest.raises(pbf.FormatError, match=message):
        pbf.Reader(written(tmp_path, data), "ways", pbf.ARROW["ways"]).partitions()


@pytest.mark.parametrize("how, message", [("no size", "without its size"), ("lzma", "not supported")])
def test_broken_blocks(tmp_path, how, message):
    reader = pbf.Reader(written(tmp_path, GOOD + block("OSMData", TABLE + WAY, how=how)), "ways", pbf.ARROW["ways"])
    with pytest.raises(pbf.FormatError, match=message):
        [list(reader.read(p)) for p in reader.partitions()]


def town(spark):
    """Vertices on a line, an edge from each to the next."""
    vertices = spark.createDataFrame([(10 * k, 490_000_000 + 1000 * k, 70_000_000) for k in range(8)], "vertex_id long, lat long, lng long")
    rows = [(k, k, 10 * k, 10 * (k + 1), 0, 1, 100.0 + k, [], 50, k == 3, True, True, True, False) for k in range(7)]
    return vertices, spark.createDataFrame(rows, "edge_id long, way_id long, src long, dst long, from_pos int, to_pos int, distance double, steps array<struct<lat:long,lng:long>>, maxspeed int, oneway boolean, car boolean, bike boolean, foot boolean, ferry boolean")


def test_networks_are_saved_and_loaded(spark, tmp_path):
    vertices, edges = town(spark)
    cell_of = vertices.select("vertex_id", (F.col("vertex_id") / 40).cast("int").alias("cell_id"))
    folder = str(tmp_path / "net")
    store.save_network(vertices, edges, folder, cell_of)
    rows = lambda df, *cols: sorted(tuple(r) for r in df.select(*cols).collect())
    for name, df in (("vertices", vertices), ("edges", edges), ("cells", cell_of)):
        assert rows(store.load(spark, folder, name), *df.columns) == rows(df, *df.columns)
    over = store.load(spark, folder, "overlay")
    assert over.select("mode", "metric").distinct().count() == 6
    want, _ = cells.overlay(cells.with_cells(edges, cell_of), "car", "time")
    assert rows(over.where("mode = 'car' and metric = 'time'"), "src", "dst", "weight") == rows(want, "src", "dst", "weight")
    assert store.load_boxes(spark, folder).count() == 2
    store.load(spark, folder, "boxes").where("cell_id = 0").write.parquet(folder + "/some")
    spark.read.parquet(folder + "/some").write.mode("overwrite").parquet(folder + "/boxes")
    with pytest.raises(ValueError):
        store.load_boxes(spark, folder)
    store.save_induced(vertices, edges, vertices.where("vertex_id < 35"), folder + "2")
    assert store.load(spark, folder + "2", "edges").count() == 3


def test_graphs_and_partitions_as_text(spark, tmp_path):
    vertices, edges = town(spark)
    edges = edges.unionByName(edges.where("edge_id = 0").withColumn("edge_id", F.lit(99)))
    store.write_metis(vertices, edges, str(tmp_path / "graph"))
    lines = [line for f in sorted((tmp_path / "graph").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == ["8 7", "2", "1 3", "2 4", "3 5", "4 6", "5 7", "6 8", "7"]
    (tmp_path / "parts").write_text("".join(f"{k // 3}\n" for k in range(8)))
    got = store.read_partition(spark, str(tmp_path / "parts"), vertices)
    assert sorted(map(tuple, got.collect())) == [(10 * k, k // 3) for k in range(8)]
    (tmp_path / "short").write_text("1\n2\n")
    with pytest.raises(ValueError):
        store.read_partition(spark, str(tmp_path / "short"), vertices)


def test_request_log(spark, tmp_path):
    day = datetime.datetime(2024, 2, 29, 23, 59, 1)
    store.log_requests(spark, [(day, 1500, "/routes?a=1"), (day + datetime.timedelta(minutes=1), 7, "/features")], str(tmp_path / "log"))
    store.log_requests(spark, [(day, 2, "/status")], str(tmp_path / "log"))
    lines = lambda d: sorted(r.value for r in spark.read.text(str(tmp_path / "log" / f"day={d}")).collect())
    assert lines("2024-02-29") == ["2024-02-29T23:59:01Z 1500 /routes?a=1", "2024-02-29T23:59:01Z 2 /status"]
    assert lines("2024-03-01") == ["2024-03-01T00:00:01Z 7 /features"]
