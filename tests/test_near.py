"""Steps that meet places, lines and radii: against brute force, and by what they meet."""

from __future__ import annotations

import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F
from test_solvers import metres

from cairn.operators import resolve, spatial, tours

DEGREE = 111194.92664455873
POINT = "service_id long, lat double, lon double"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_duplicates_broadcast_no_rows_dealt_to_cells(spark):
    rows = spark.createDataFrame([(1, "a", "x", 53.0, 24.0), (2, "A", "x", 53.0001, 24.0), (3, "a", "y", 53.0, 24.0), (4, "a", "x", 83.0, 24.0), (5, "a", "x", 83.0, 24.02)], "place_id long, name string, category string, lat double, lon double")
    found = resolve.suspected_duplicates(rows, metres=500.0, close=30.0)
    assert "Broadcast" not in plan(found)
    assert {(r["a"], r["b"]): r["close"] for r in found.collect()} == {(1, 2): True, (4, 5): False}


def test_the_nearest_are_looked_for_near_first(spark, monkeypatch):
    radii, join = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda left, right, metres, **kw: radii.append(metres) or join(left, right, metres, **kw))
    r = random.Random(3)
    crowd = [(i, 53.5 + r.gauss(0, 0.01), 24.0 + r.gauss(0, 0.01)) for i in range(800)] + [(900 + i, 53.5, 24.0) for i in range(9)] + [(950, 53.6, 24.0)]
    asked = [(1, 53.5, 24.0), (2, 53.52, 24.01), (3, 53.57, 24.0), (4, 53.63, 24.0), (5, 55.0, 24.0), (6, None, 24.0)]
    found = spatial.nearest_k(spark.createDataFrame(asked, POINT), spark.createDataFrame(crowd, "place_id long, r_lat double, r_lon double"), 4, 6000.0, key=["service_id"], order=[F.col("place_id")])
    got = {(x["service_id"], x["rank"]): x["place_id"] for x in found.collect()}
    want = {}
    for s, lat, lon in asked[:5]:
        near = sorted((metres((lat, lon), (y, x)), i) for i, y, x in crowd)
        want |= {(s, k + 1): i for k, (d, i) in enumerate(near[:4]) if d <= 6000}
    assert got == want
    assert radii[0] < 1000 and radii[-1] == 6000.0


def far(p, a, b):
    k = math.cos(math.radians(p[0]))
    ax, ay, dx, dy = (a[1] - p[1]) * k, a[0] - p[0], (b[1] - a[1]) * k, b[0] - a[0]
    n = dx * dx + dy * dy
    t = min(1.0, max(0.0, -(ax * dx + ay * dy) / n)) if n > 0 else 0.0
    return DEGREE * math.hypot(ax + t * dx, ay + t * dy)


def test_long_legs_meet_what_lies_along_them(spark):
    r = random.Random(5)
    points = [(i, r.uniform(53, 54.5), r.uniform(23.5, 26.5)) for i in range(3000)]
    legs = [(0, 53.1, 23.6, 54.4, 26.4), (1, 54.4, 23.6, 53.1, 26.4), (2, 53.7, 23.5, 53.7, 26.5), (3, 53.0, 25.0, 54.5, 25.0), (4, 53.7, 25.0, 53.7, 25.0), (5, 10.0, 25.0, 10.0, 26.0)]
    a, b = ("a_lat", "a_lon"), ("b_lat", "b_lon")
    df = spark.createDataFrame(legs, "leg long, a_lat double, a_lon double, b_lat double, b_lon double")
    met = [(x["leg"], x["service_id"]) for x in spatial.meet_legs(spark.createDataFrame(points, POINT), df, a, b, F.lit(2000.0)).collect()]
    near = {(k, i) for k, *e in legs for i, *p in points if far(p, e[:2], e[2:]) <= 2000}
    assert len(met) == len(set(met)) and near <= set(met)
    assert len(met) < 4 * len(near) and len(near) > 100
    none = spark.createDataFrame([], POINT)
    assert spatial.meet_legs(none, df, a, b, F.lit(2000.0)).isEmpty()


def test_points_along_a_line_are_not_shuffled_again(spark):
    stops = spark.createDataFrame([(k, i, 53.1 + 0.3 * i, 23.6 + 0.5 * i) for k in range(3) for i in range(3)], "route_id long, ordinal int, lat double, lon double")
    points = spark.createDataFrame([(1, 53.4, 24.1)], POINT)
    found = spatial.along_lines(points, spatial.segments(stops, "route_id", "ordinal"), "route_id", 2000.0, id_="service_id")
    above, _, _ = plan(found).partition("Generate")
    assert "Exchange" not in above
    assert [(x["route_id"], round(x["offset"])) for x in found.orderBy("route_id").collect()] == [(0, 0), (1, 0), (2, 0)]


def test_detours_keep_the_first_of_equal_legs_in_a_hash_table(spark):
    legs = spark.createDataFrame([(1, 7, 53.0, 24.0, 53.5, 24.6), (1, 8, 53.5, 24.6, 53.0, 24.0)], "route_id long, ordinal int, la double, lo double, lb double, lp double")
    m = metres((53.0, 24.0), (53.5, 24.6))
    found = tours.detours(legs.withColumn("seconds", F.lit(m / (4 / 3.6))), spark.createDataFrame([(1, 53.25, 24.3), (2, 54.4, 26.0)], POINT), most_seconds=1800.0)
    assert "SortAggregate" not in plan(found)
    got = found.collect()
    extra = round((metres((53.0, 24.0), (53.25, 24.3)) + metres((53.25, 24.3), (53.5, 24.6)) - m) / (4 / 3.6), 3)
    assert [(x["service_id"], x["ordinal"]) for x in got] == [(1, 7)] and abs(got[0]["extra"] - extra) < 2e-3
    assert found.schema["ordinal"].dataType.simpleString() == "int"


def test_rows_are_dealt_out_though_they_lie_by_keys_already(spark):
    from cairn.operators.groups import dealt

    own = spark.range(400).withColumn("n", F.count("*").over(Window.partitionBy("id")))
    assert dealt(own, "id").select(F.spark_partition_id()).distinct().count() > 1


def test_what_paths_find_is_not_aggregated(spark):
    stops = spark.createDataFrame([(k, i, 53.1 + 0.3 * i, 23.6 + 0.5 * i) for k in range(3) for i in range(3)], "route_id long, ordinal int, lat double, lon double")
    points = spark.createDataFrame([(1, 53.4, 24.1), (2, 53.41, 24.1)], POINT)
    assert "Aggregate" not in plan(spatial.along_lines(points, spatial.segments(stops, "route_id", "ordinal"), "route_id", 2000.0, id_="service_id"))


def test_the_first_along_a_path_are_looked_for_near_its_start(spark, monkeypatch):
    r = random.Random(11)
    some = lambda n: [(i, r.uniform(53, 53.4), r.uniform(24, 24.6)) for i in range(n)]
    stops = [(k, i, y, x) for k in range(40) for i, y, x in some(1 + k % 6)] + [(90, 1, 53.2, 24.2), (90, 2, 53.2, 24.2), (91, 1, 10.0, 10.0), (91, 2, 10.0, 11.0)]
    legs = spatial.segments(spark.createDataFrame(stops, "route_id long, ordinal int, lat double, lon double"), "route_id", "ordinal")
    points = spark.createDataFrame(some(1500), POINT)
    by_path: dict = {}
    for x in spatial.along_lines(points, legs, "route_id", 2000.0, id_="service_id").collect():
        by_path.setdefault(x["route_id"], []).append((math.floor(x["fraction"] * 1e6 + 0.5), math.floor(x["offset"] * 100 + 0.5), x["service_id"]))
    want = {(k, x[2], i + 1) for k, own in by_path.items() for i, x in enumerate(sorted(own)[:12])}
    ends, on_legs = [], spatial.points_on_legs
    monkeypatch.setattr(spatial, "points_on_legs", lambda *a, **kw: ends.append(kw.get("b")) or on_legs(*a, **kw))
    got = [(x["route_id"], x["service_id"], x["rank"]) for x in spatial.first_along(points, legs, "route_id", 2000.0, 12, id_="service_id").collect()]
    assert len(got) == len(want) and set(got) == want
    assert len(ends) > 1 and ends[0] and not ends[-1]


def test_paths_with_a_point_on_them_are_told_once(spark):
    stops = [(k, i, 53.1 + 0.3 * i, 23.6 + 0.1 * k) for k in range(5) for i in range(3)] + [(9, 0, 53.1, 23.6)]
    legs = spatial.segments(spark.createDataFrame(stops, "route_id long, ordinal int, lat double, lon double"), "route_id", "ordinal")
    points = spark.createDataFrame([(1, 53.2, 23.6), (2, 53.3, 23.6), (3, 53.55, 23.8), (4, 53.2, 23.9001)], POINT)
    found = spatial.paths_met(points, legs, "route_id", 1.0)
    assert sorted(x["route_id"] for x in found.collect()) == [0, 2]


def test_walks_that_are_uncertain_anyway_are_not_held_against_steps(spark, small, monkeypatch):
    from cairn.queries import QUERIES

    asked, met = [], spatial.paths_met
    monkeypatch.setattr(spatial, "paths_met", lambda points, legs, key, metres: asked.append(legs) or met(points, legs, key, metres))
    assert QUERIES["ver_06_step_free"](spark, small).where("route_id % 7 = 0 and status <> 'uncertain'").isEmpty()
    assert asked[0].where("route_id % 7 = 0").isEmpty() and not asked[0].isEmpty()


def test_the_least_of_runs(monkeypatch):
    import pyarrow as pa

    from cairn.operators import groups

    r = random.Random(3)
    rows = [(k, r.randrange(5), r.randrange(3), n) for k in [None, 4, 2, 9] for n in range(r.randrange(1, 30))]
    table = pa.table(dict(zip("kibn", map(list, zip(*rows, strict=True)), strict=True)))
    want: dict = {}
    for k, i, b, n in rows:
        want[k, i] = min(want.get((k, i), (9, 0)), (b, n))
    monkeypatch.setattr(groups, "RUN_ROWS", 4)
    got = [x for t in groups.whole_runs(iter(table.to_batches(max_chunksize=3)), "k") for x in t.take(groups.least(t, "k", "i", "b")).to_pylist()]
    assert sorted(((x["k"] or 0, x["i"], x["b"], x["n"]) for x in got)) == sorted((k or 0, i, *v) for (k, i), v in want.items())


def test_cells_are_smaller_where_points_lie_close(spark):
    r = random.Random(4)
    points = lambda n: spark.createDataFrame([(i, r.uniform(53, 53.3), r.uniform(24, 24.3)) for i in range(n)], POINT)
    few, many = (spatial.fitting_size(points(n), 1.0) for n in (20, 5000))
    assert many < few / 2
    assert spatial.fitting_size(spark.createDataFrame([], POINT), 1.0) == 0.03
    assert spatial.fitting_size(spark.createDataFrame([(i, 53.0, 24.0) for i in range(99)], POINT), 1.0) >= 0.03


def test_stairways_on_long_legs(spark):
    stops = spark.createDataFrame([(1, 1, 53.1, 23.6), (1, 2, 54.4, 26.4), (1, 3, 54.4, 23.6)], "route_id long, ordinal int, lat double, lon double")
    steps = spark.createDataFrame([(1, 53.75, 25.0), (2, 54.4, 25.0), (3, 53.2, 26.3)], POINT)
    found = tours.stepped_legs(stops, steps, near_m=400.0)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 2), (1, 2, 3)]


def test_many_stairways_are_looked_for_part_by_part(spark, monkeypatch):
    r = random.Random(12)
    stops = [(k, i, r.uniform(53, 53.6), r.uniform(24, 24.8)) for k in range(30) for i in range(1, 5)] + [(50, 1, 53.2, 24.2), (50, 2, 53.2, 24.2)]
    steps = [(i, r.uniform(53, 53.6), r.uniform(24, 24.8)) for i in range(4000)]
    parts, on_legs = [], tours.points_on_legs
    monkeypatch.setattr(tours, "points_on_legs", lambda *a, **kw: parts.append(kw) or on_legs(*a, **kw))
    found = tours.stepped_legs(spark.createDataFrame(stops, "route_id long, ordinal int, lat double, lon double"), spark.createDataFrame(steps, POINT), near_m=400.0)
    got = [tuple(x) for x in found.collect()]
    want = {(k, i, j) for k, i, *a in stops for k2, j, *b in stops if k == k2 and i < j and any(far(p, a, b) <= 400 for _, *p in steps)}
    assert len(got) == len(want) and set(got) == want
    assert len(parts) > 1 and len(want) < 30 * 6 + 1


def test_places_with_two_names_close_by_are_settled_first(spark, monkeypatch):
    radii, meet = [], spatial.meet_legs
    monkeypatch.setattr(spatial, "meet_legs", lambda points, legs, a, b, reach, **kw: radii.append(kw["size"]) or meet(points, legs, a, b, reach, **kw))
    r = random.Random(7)
    roads = [(f"r{i % 3}", 53.5 + r.gauss(0, 0.01), 24.0 + r.gauss(0, 0.01)) for i in range(150)] + [("lone", 53.8, 24.0), ("lone", 53.802, 24.0), ("9", 53.9, 24.0), ("near", 54.0, 24.0), ("far", 54.012, 24.0)]
    roads = [(n, y, x, y + 0.002, x + 0.003) for n, y, x in roads]
    places = [(i, 53.5 + r.gauss(0, 0.02), 24.0 + r.gauss(0, 0.02)) for i in range(150)] + [(200, 53.8, 24.001), (201, 53.9, 24.001), (202, 54.0, 24.001), (203, 55.0, 24.0)]
    df = spark.createDataFrame(roads, "road string, a_lat double, a_lon double, b_lat double, b_lon double")
    found = spatial.nearest_named_road(spark.createDataFrame(places, "place_id long, lat double, lon double"), df, within=500.0, rival=1500.0, refused=lambda c: c == "9")
    want = {}
    for k, *p in places:
        near: dict = {}
        for n, ay, ax, by, bx in roads:
            near[n] = min(near.get(n, math.inf), far(p, (ay, ax), (by, bx)))
        (d, n), (other, _) = sorted((d, n) for n, d in near.items())[:2]
        if d <= 500 and other > 1500 and n != "9":
            want[k] = n
    assert {x["place_id"]: x["road"] for x in found.collect()} == want and want[200] == "lone"
    assert len(radii) > 1 and radii[0] < radii[-1]


def test_first_matches_are_looked_for_a_few_at_a_time(spark, monkeypatch):
    places = [(i, 0, 53.0 + i * 0.01, 24.0) for i in range(60)] + [(100, 1, 53.0, 24.0), (101, None, 53.0, 24.0), (102, 0, None, 24.0)]
    photos = [(i, 0, 53.0 + (i * 7 % 100) * 0.01, 24.0) for i in range(90)] + [(200, 1, 53.0, 24.01), (201, 1, 53.0, 24.0)]
    monkeypatch.setattr(spatial, "FIRST_ROWS", 8)
    df = spatial.first_within(spark.createDataFrame(places, "place_id long, k int, lat double, lon double"), spark.createDataFrame(photos, "photo long, k int, r_lat double, r_lon double"), 5000.0, on="k", id_="photo")
    want = {}
    for i, k, *p in places:
        near = [j for j, kk, *q in photos if kk == k and p[0] is not None and metres(p, q) <= 5000]
        if near:
            want[i] = min(near)
    assert dict(map(tuple, df.collect())) == want and want[100] == 200 and max(want.values()) > 16


def test_first_matches_are_dealt_out_and_later_rounds_look_about(spark, monkeypatch):
    """One task's rows are dealt out; later rounds meet cubes, by the poles and across the date line too."""
    r, plans, settle = random.Random(3), [], spatial.settle
    monkeypatch.setattr(spatial, "FIRST_ROWS", 4)
    monkeypatch.setattr(spatial, "settle", lambda df, name: (name == "first" and plans.append(df._jdf.queryExecution().executedPlan().toString())) or settle(df, name))
    spots = [lambda: (r.uniform(89, 90), r.uniform(-180, 180)), lambda: (r.uniform(-1, 1), r.choice([-180, 180]) + r.uniform(-1, 1)), lambda: (r.uniform(53, 54), r.uniform(24, 25))]
    places = [(i, i % 2, *r.choice(spots)()) for i in range(90)] + [(90, 0, None, 24.0), (91, 0, -60.0, 10.0)]
    photos = [(i, i % 2, *r.choice(spots)()) for i in range(90)] + [(90, 1, None, 24.0)]
    left = spark.createDataFrame(places, "place_id long, k int, lat double, lon double").coalesce(1)
    df = spatial.first_within(left, spark.createDataFrame(photos, "photo long, k int, r_lat double, r_lon double"), 40_000.0, on="k", id_="photo")
    want = {}
    for i, k, *p in places:
        near = [j for j, kk, *q in photos if kk == k and None not in (p[0], q[0]) and metres(p, q) <= 40_000]
        if near:
            want[i] = min(near)
    got = df.collect()
    assert dict(map(tuple, got)) == want and len(got) == len(want) and 91 not in want
    assert {n for n in range(3) if any((places[i][2] > 80, abs(places[i][3]) > 150, places[i][2] > 50)[n] for i in want)} == {0, 1, 2}
    assert "REPARTITION_BY_NUM" in plans[0] and len(plans) > 1 and all("_cube" in p for p in plans[1:])


def test_coverage_stops_at_the_first_answer(spark, small, monkeypatch):
    from cairn.queries import QUERIES

    asked, k_ = [], spatial.nearest_k
    monkeypatch.setattr(spatial, "nearest_k", lambda left, right, k, *a, **kw: asked.append(k) or k_(left, right, k, *a, **kw))
    found = QUERIES["j_22_covered"](spark, small)
    assert asked == [1] and found.count() == found.select("service_id").distinct().count()


def test_nearby_places_are_looked_for_near_first(spark):
    """Dense and sparse places, ties, and a box wider than high: as brute force has it, from few pairs."""
    from cairn.operators import retrieval

    r = random.Random(11)
    places = [(i, 53.5 + r.gauss(0, 0.03), 24.0 + r.gauss(0, 0.03)) for i in range(2000)] + [(3000 + i, 53.5, 24.0) for i in range(8)] + [(4000, 54.5, 24.25), (4001, 54.5, 24.4)]
    asked = [(1, 53.5, 24.0), (2, 53.55, 24.05), (3, 53.62, 24.1), (4, 54.5, 24.0), (5, 10.0, 10.0)]
    found = retrieval.nearby_signal(spark.createDataFrame(asked, "query_id long, lat double, lon double"), spark.createDataFrame(places, "place_id long, lat double, lon double"), 6)
    want = set()
    for q, lat, lon in asked:
        dy, dx = 20 / 111, 20 / (111 * max(0.2, math.cos(math.radians(lat))))
        near = sorted(((y - lat) ** 2 + (x - lon) ** 2, i) for i, y, x in places if abs(y - lat) <= dy and abs(x - lon) <= dx)
        want |= {(q, i, k + 1) for k, (_, i) in enumerate(near[:6])}
    assert {(x["query_id"], x["place_id"], x["rank"]) for x in found.collect()} == want
    assert (4, 4000, 1) in want and (4, 4001, 2) not in want
    assert any("/nearby-" in f for f in found.inputFiles())  # what smaller circles have settled


def test_seeds_look_for_one_nearest_town(spark, small, monkeypatch):
    from cairn.queries import QUERIES

    asked, k_ = [], spatial.nearest_k
    monkeypatch.setattr(spatial, "nearest_k", lambda left, right, k, *a, **kw: asked.append(k) or k_(left, right, k, *a, **kw))
    assert QUERIES["msc_15_seeded"](spark, small).where("town is not null").count() and asked == [1]


def test_the_newest_snapshot_may_have_several_files(spark, tmp_path):
    from cairn.sources import files

    for k in (1, 2):
        rows = spark.range(40).repartition(4).select(F.lit("row").alias("record"), F.concat(F.lit(f"{k}-"), "id").alias("case"), F.lit(k).alias("repeat"), F.create_map(F.lit("one"), F.lit(1.0)).alias("metrics"))
        files.jsonl_rows(rows, f"{tmp_path}/{k}")
    found = files.read_runs(spark, files.newest_folder(spark, f"{tmp_path}/*/*.json"))[1]
    assert {x["case"] for x in found.select("case").collect()} == {f"2-{i}" for i in range(40)}
    assert len(list(tmp_path.glob("2/part-*.json"))) > 1
    assert files.newest_folder(spark, f"{tmp_path}/2/*.json").endswith("/2")
