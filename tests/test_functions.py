import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import geo, tags
from pathloom.operators import route, search


def test_units(spark):
    cases = {"speed": {"30": 30, "31.25": 31.25, "6,5": 6.5, "50 Km/h": 50, "20 mph": 32.18688, "6 Knoten": 11.112, "+70": 70, "0020": 20, "5 kt": 9.26, "20km/hr": 20, "walk": None}, "length": {"2km": 2000, "12'6\"": 3.81, "6'": 1.829, "6\"": 0.1524, "7ft6in": 2.286, "6'-6\"": 1.981, "1,5 Meter": 1.5, "130cm": 1.3, "0.6 mi": 965.6064, "12 м": 12}, "weight": {"7.5T": 7.5, "200kg": 0.2, "108000 lbs": 48.988, "5 To": 5}}
    for name, parse in (("speed", tags.parse_speed), ("length", tags.parse_length), ("weight", tags.parse_weight)):
        rows = spark.createDataFrame([(k,) for k in cases[name]], "x string").select("x", parse(F.col("x")).alias("y")).collect()
        for r in rows:
            want = cases[name][r.x]
            assert r.y is None if want is None else r.y == pytest.approx(want, abs=1e-3), (name, r)


def test_access(spark):
    cases = [({"highway": "secondary_link", "oneway": "yes"}, 7), ({"highway": "road", "bicycle": "yes", "foot": "yes", "motorcar": "no"}, 6), ({"highway": "proposed"}, 0), ({"highway": "cycleway"}, 2), ({"highway": "trunk", "motorroad": "yes"}, 1), ({"highway": "service"}, 7), ({"highway": "bridleway", "foot": "yes"}, 4), ({"highway": "motorway", "access": "yes", "bicycle": "no", "foot": "no", "motor_vehicle": "yes"}, 1), ({"name": "x"}, 0), ({"route": "ferry"}, 6)]
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, tags map<string,string>").select("k", tags.access_mask(F.col("tags")).alias("m")).collect()
    assert {r.k: r.m for r in rows} == {k: m for k, (_, m) in enumerate(cases)}


def test_distance(spark):
    cases = [(51.4809180306, -0.00529407598709, 51.4799156, 0.005611, 763.4), (-16.1562805556, -179.999658333, -16.1568638889, 179.999686111, 95.44), (-1.549886, 156.466532, -1.56800166865689, 156.48838856866, 3150.908018)]
    for r in spark.createDataFrame(cases, "a double, b double, c double, d double, e double").select("e", geo.distance(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("m")).collect():
        assert r.m == pytest.approx(r.e, rel=2e-3)


def test_geodesics_invert_each_other():
    rng = np.random.default_rng(1)
    lat, lng, d, b = rng.uniform(-80, 80, 200), rng.uniform(-180, 180, 200), rng.uniform(1, 1e6, 200), rng.uniform(-180, 180, 200)
    lat2, lng2 = geo.direct(lat, lng, d, b)
    got, bearing = geo.inverse(lat, lng, lat2, lng2)
    assert np.allclose(got, d, atol=1e-3) and np.allclose((bearing - b + 180) % 360 - 180, 0, atol=1e-6)
    assert geo.inverse(np.array([50.0]), np.array([8.0]), np.array([50.0]), np.array([8.0]))[0][0] == 0


def test_half_floats():
    x = np.random.default_rng(2).uniform(0, 131008, 1000).astype(np.float32)
    got = geo.from_half(geo.to_half(x))
    fine = (x < 65504) & (x > 2**-14)
    assert (np.abs(got[fine] - x[fine]) <= x[fine] * 2**-11).all() and np.isinf(got[x > 65536]).all()


def test_hilbert_curve(spark):
    rng = np.random.default_rng(5)
    points = [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(rng.integers(-900_000_000, 900_000_001, 300), rng.integers(-1_800_000_000, 1_800_000_001, 300)))]
    points += [(300 + k, lat, lng) for k, (lat, lng) in enumerate([(-900_000_000, -1_800_000_000), (-900_000_000, 1_800_000_000), (900_000_000, 1_800_000_000), (900_000_000, -1_800_000_000), (5, 6), (5, 7)])]
    keys = {r.k: r.key for r in spark.createDataFrame(points, "k int, lat long, lng long").select("k", geo.hilbert_key(F.col("lat"), F.col("lng")).alias("key")).collect()}
    assert len(set(keys.values())) == len(points)
    top = {k: (key + (1 << 63)) >> 62 for k, key in keys.items()}
    for k, lat, lng in points:
        north, east = lat + 900_000_000 >= 1 << 31, lng + 1_800_000_000 >= 1 << 31
        assert top[k] == {(False, False): 0, (False, True): 1, (True, True): 2, (True, False): 3}[north, east]
    # a small square's points have a run of keys, and each quarter of it a run of these
    grid = [(k, i, j) for k, (i, j) in enumerate((i, j) for i in range(8) for j in range(8))]
    start = (1 << 31) - 900_000_000, (1 << 31) - 1_800_000_000  # the corner of a quadrant
    got = [r.key for r in spark.createDataFrame([(k, start[0] + i, start[1] + j) for k, i, j in grid], "k int, lat long, lng long").select(geo.hilbert_key(F.col("lat"), F.col("lng")).alias("key")).collect()]
    assert max(got) - min(got) == 63 and len(set(got)) == 64
    assert all({got[k] - min(got) >> 4 for k, i, j in grid if (i // 4, j // 4) == q} == {min(got[k] - min(got) for k, i, j in grid if (i // 4, j // 4) == q) >> 4} for q in ((0, 0), (0, 1), (1, 1), (1, 0)))


def test_ellipsoids_and_points_between():
    assert len(geo.ELLIPSOIDS) == 31
    for name in geo.ELLIPSOIDS:
        lat, lng = geo.intermediate(49.0, 7.0, 50.5, 9.25, 4, ellipsoid=name)
        whole = geo.inverse(np.array([49.0]), np.array([7.0]), np.array([50.5]), np.array([9.25]), ellipsoid=name)[0][0]
        parts = geo.inverse(lat[:-1], lng[:-1], lat[1:], lng[1:], ellipsoid=name)[0]
        assert np.allclose(parts, whole / 4, atol=1e-4) and abs(lat[-1] - 50.5) < 1e-9 and abs(lng[-1] - 9.25) < 1e-9


def test_steps_round_trip():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 200):
        points = [(int(a), int(b)) for a, b in zip(rng.integers(-900_000_000, 900_000_000, n + 1), rng.integers(-1_800_000_000, 1_800_000_000, n + 1))]
        data = geo.encode_steps(points[0], points[1:])
        assert geo.decode_steps(points[0], data) == points[1:]
        if data:
            with pytest.raises(ValueError):
                geo.decode_steps(points[0], data[:-1])
    assert geo.encode_steps((0, 0), [(1, -1), (1, -65)]) == bytes([2, 1, 0, 127])


def test_finite(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,), (0.0,)], "x double").select(geo.finite(F.col("x")).alias("f")).collect()
    assert [r.f for r in rows] == [True, False, False, False, False, True]


def test_wrong_requests():
    for text, message in (("", "no waypoints"), ("1,2", "too few"), ("1,2,3|4,5", "coordinate"), ("a,2|3,4", "number")):
        with pytest.raises(ValueError, match=message):
            route.read_waypoints(text)


def test_dijkstra_certificate(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b), k, float(w)) for k, (a, b, w) in enumerate(zip(rng.integers(0, 20, 60), rng.integers(0, 20, 60), rng.uniform(1, 9, 60))) if a != b]
    darts = spark.createDataFrame(links, "src long, dst long, edge_id long, weight double")
    sources = spark.createDataFrame([(links[0][0], 0.0)], "vertex_id long, dist double")
    tree = search.distances(darts, sources)
    adjacent = {}
    for a, b, k, w in links:
        adjacent.setdefault(a, []).append((b, w, k))
    want, _ = search.dijkstra(adjacent, {links[0][0]: 0.0})
    assert {r.vertex_id: round(r.dist, 9) for r in tree.collect()} == {k: round(v, 9) for k, v in want.items()}
    assert all(r.n == 0 for r in search.violations(darts, sources, tree).collect())
