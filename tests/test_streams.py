"""Streams over several files, with late and repeated rows, against plain code."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from cairn import views
from cairn.queries import QUERIES, streams
from cairn.streaming import journal, positions
from cairn.streaming.runs import latest_batch, run_to_end

START = dt.datetime(2024, 1, 1)
KINDS = ("view", "click", "purchase", "error")


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


@pytest.fixture
def feed(spark, tmp_path):
    """Writes a file for each list of events (event_id, minute, user, kind), which the stream reads one a batch."""

    def write(*files):
        for k, rows in enumerate(files):
            full = [(i, at(m), u, kind, 1.0, "{}") for i, m, u, kind in rows]
            spark.createDataFrame(full, journal.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in-{k}"))
        # Files are read in the order of their age.
        return journal.read_events(spark, str(tmp_path / "in-*"))

    return write


def random_files(seed, n=4, each=30):
    rng = random.Random(seed)
    events = [(i, i * 3 + rng.randint(0, 2), rng.randint(1, 5), rng.choice(KINDS)) for i in range(n * each)]
    return [events[k * each : (k + 1) * each] for k in range(n)]


def test_revisions_go_on_from_batch_to_batch(feed):
    files = random_files(1)
    files[2].append((5, 15, files[0][5][2], "view"))  # late, and repeated: it is numbered as it comes
    got = [(r["user_id"], r["event_id"], r["revision"]) for r in run_to_end(journal.revisions(feed(*files)), "revisions").collect()]
    want, n = [], {}
    for rows in files:
        for i, _, u, _ in sorted(rows, key=lambda r: (r[1], r[0])):
            want.append((u, i, n.get(u, 0)))
            n[u] = n.get(u, 0) + 1
    assert sorted(got) == sorted(want)


def test_stages_stop_at_the_last_mark(feed):
    files = random_files(2)
    rows = run_to_end(journal.stages(feed(*files), idle="10 days"), "stages", mode="update").collect()
    assert len({r["batch"] for r in rows}) == 4
    state, want = {}, {}
    for k, own in enumerate(files):
        for _, _, u, kind in sorted(own, key=lambda r: (r[1], r[0])):
            if not state.get(u, (None, False))[1]:
                state[u] = (kind, kind == "error")
        want |= {(k, u): state[u] for u in {r[2] for r in own}}
    assert {(r["batch"], r["user_id"]): (r["stage"], r["finished"]) for r in rows} == want


def test_idle_runs_are_forgotten(feed):
    files = [[(1, 0, 7, "click"), (2, 1, 7, "error")], [(3, 60, 8, "view")], [(6, 61, 8, "view")], [(4, 62, 8, "view"), (5, 63, 7, "view")]]
    rows = run_to_end(journal.stages(feed(*files)), "stages", mode="update").collect()
    assert {(r["batch"], r["user_id"]): (r["stage"], r["finished"]) for r in rows if r["user_id"] == 7} == {(0, 7): ("error", True), (max(r["batch"] for r in rows), 7): ("view", False)}


def test_counts_leave_out_what_comes_after_the_watermark(feed):
    late = [(900, 1, 1, "view"), (901, 119, 1, "view")]
    files = [[(i, i, 1, "view") for i in range(60)], [(60 + i, 90 + i, 1, "view") for i in range(60)], [(800, 150, 1, "view")], late, [(999, 400, 1, "view")]]
    final = {r["start"]: r["n"] for r in run_to_end(journal.counts(feed(*files)), "counts").select("start", "n").collect()}
    # In append mode a window is given once, when the watermark has passed it: the late rows had no window left.
    assert final == {at(0): 60, at(60): 30, at(120): 31}


def test_sessions_over_batches(feed):
    files = [[(1, 0, 7, "view"), (2, 100, 7, "view"), (3, 10, 8, "view")], [(4, 300, 7, "view"), (5, 1000, 7, "view")], [(6, 3000, 8, "view")]]
    rows = latest_batch(run_to_end(journal.sessions(feed(*files)), "sessions", mode="complete")).collect()
    assert sorted((r["user_id"], r["start"], r["n"]) for r in rows) == [(7, at(0), 3), (7, at(1000), 1), (8, at(10), 1), (8, at(3000), 1)]


def test_off_route_counts_on_over_batches(feed):
    files = random_files(3)
    stream = feed(*files).select("user_id", "event_id", "ts", (F.col("event_type") == "click").alias("far"))
    got = {r["event_id"]: r["off"] for r in run_to_end(positions.off_route(stream, in_a_row=2), "off").collect()}
    run, want = {}, {}
    for own in files:
        for i, _, u, kind in sorted(own, key=lambda r: (r[1], r[0])):
            run[u] = run.get(u, 0) + 1 if kind == "click" else 0
            want[i] = run[u] >= 2
    assert got == want and any(want.values())


def test_announcements_are_made_once_within_the_watermark(feed):
    files = [[(1, 0, 7, "view"), (2, 1, 7, "view"), (3, 1, 8, "view")], [(4, 3, 7, "view"), (5, 3, 7, "click")], [(6, 600, 9, "view")], [(8, 605, 9, "view")], [(7, 620, 7, "view")]]
    stream = feed(*files).select("user_id", "ts", "event_type", "event_id")
    rows = run_to_end(positions.announced_once(stream, ["user_id", "event_type"], late="10 minutes"), "said").collect()
    assert sorted((r["user_id"], r["event_type"], r["batch"]) for r in rows) == [(7, "click", 1), (7, "view", 0), (7, "view", 4), (8, "view", 0), (9, "view", 2)]


def test_arrivals_of_a_stream(spark, feed):
    files = random_files(4, n=3)
    stops = spark.createDataFrame([(u, k, 53.5 + k / 100, 24.0) for u in (1, 2, 9) for k in range(3)], "user_id long, ordinal int, lat double, lon double")
    stream = feed(*files).select("user_id", "ts", (F.lit(53.5) + F.col("event_id") % 4 / 100).alias("lat"), F.lit(24.0).alias("lon"))
    got = sorted((r["user_id"], r["ts"], r["ordinal"]) for r in run_to_end(positions.arrivals(stream, stops, 40.0), "arrived").collect())
    assert got == sorted((u, at(m), i % 4) for own in files for i, m, u, _ in own if u in (1, 2) and i % 4 < 3)


def test_an_empty_folder_gives_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert run_to_end(journal.revisions(journal.read_events(spark, str(tmp_path / "in"))), "none").count() == 0


def test_fix_quality(spark):
    rows = [(False, False, None, None), (True, False, None, None), (True, True, 16.0, 5.0), (True, True, 1.0, 51.0), (True, True, 15.0, 50.0), (True, True, 1.0, None)]
    df = spark.createDataFrame(rows, "available boolean, fixed boolean, age double, accuracy double")
    q = positions.fix_quality(available=F.col("available"), fixed=F.col("fixed"), age_s=F.col("age"), accuracy_m=F.col("accuracy"))
    assert [r[0] for r in df.select(q).collect()] == ["unavailable", "waiting", "stale", "poor", "good", "good"]


def flat_metres(a, b):
    p = math.radians
    h = math.sin(p(b[0] - a[0]) / 2) ** 2 + math.cos(p(a[0])) * math.cos(p(b[0])) * math.sin(p(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


def foot_of(line, at):
    """Metres to the nearest point of a line of (lat, lon), and metres along it."""
    best, upto = (math.inf, 0.0), 0.0
    for a, b in zip(line, line[1:]):  # noqa: B905
        y, x = b[0] - a[0], b[1] - a[1]
        span = x * x + y * y
        t = min(1.0, max(0.0, ((at[1] - a[1]) * x + (at[0] - a[0]) * y) / span)) if span else 0.0
        d = flat_metres(at, (a[0] + y * t, a[1] + x * t))
        if d < best[0]:
            best = (d, upto + flat_metres(a, b) * t)
        upto += flat_metres(a, b)
    return best


def guided_by_hand(batches, walks):
    """(user, event) -> off_line, travelled, off, arrived."""
    state, out = {}, {}
    for rows in batches:
        for i, ts, u, lat, lon, good in sorted(rows, key=lambda r: (r[1], r[0])):
            if u not in walks:
                continue
            travelled, run, ahead, seen = state.get(u, (0.0, 0, 0, None))
            if seen and (ts, i) <= seen:
                continue
            arrived, far = None, None
            if good and lat is not None:
                far, along = foot_of(walks[u], (lat, lon))
                travelled = max(travelled, along - 15)
                near = flat_metres((lat, lon), walks[u][ahead]) if ahead < len(walks[u]) else math.inf
                run = run + 1 if far > 60 and near > 80 else 0
                if near <= 40:
                    ahead += 1
                    arrived = ahead
            else:
                run = 0
            state[u] = (travelled, run, ahead, (ts, i))
            out[u, i] = (far, travelled, run >= 2, arrived)
    return out


def same_guide(got, want):
    assert {(r["user_id"], r["event_id"]) for r in got} == want.keys() and len(got) == len(want)
    for r in got:
        far, travelled, off, arrived = want[r["user_id"], r["event_id"]]
        assert (r["off"], r["arrived"]) == (off, arrived)
        assert math.isclose(r["travelled"], travelled, abs_tol=0.1) and (r["off_line_m"] is None) == (far is None)
        assert far is None or math.isclose(r["off_line_m"], far, abs_tol=0.1)


def test_a_guide_goes_on_from_batch_to_batch(spark, tmp_path):
    """Fixes along, off and back on a line, near its stops, bad ones, late ones and repeated ones, in four files."""
    rng = random.Random(8)
    walks = {1: [(53.5, 24.0), (53.505, 24.0), (53.505, 24.01)], 2: [(53.6, 24.0), (53.6, 24.02)]}
    events = []
    for i in range(160):
        u = rng.choice([1, 2, 3])
        line = walks.get(u, walks[1])
        share = min(1.0, i / 150 + rng.uniform(-0.05, 0.02)) * (len(line) - 1)
        k = max(0, min(int(share), len(line) - 2))
        a, b, t = line[k], line[k + 1], max(0.0, share - k)
        aside = rng.choice([0, 0, 0, 0.0004, 0.001])
        events.append((i, at(i * 2 + rng.randint(0, 1)), u, a[0] + (b[0] - a[0]) * t + aside, a[1] + (b[1] - a[1]) * t, rng.random() > 0.1))
    events[70] = (*events[70][:3], None, 24.0, True)
    files = [events[k : k + 40] for k in range(0, 160, 40)]
    files[2] = [*files[2], files[0][7], files[1][3]]  # late and repeated
    files[3] = [*files[3], files[3][5], files[3][5]]
    kind = "event_id long, ts timestamp, user_id long, lat double, lon double, good boolean"
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in-{k}"))
    feed = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in-*"))
    point = lambda p: {"lon": p[1], "lat": p[0]}
    lines = spark.createDataFrame([(u, [point(p) for p in own], [point(p) for p in own]) for u, own in walks.items()], "user_id long, line array<struct<lon:double,lat:double>>, stops array<struct<lon:double,lat:double>>")
    got = run_to_end(positions.guided(feed, lines), "guided").collect()
    want = guided_by_hand(files, walks)
    same_guide(got, want)
    assert len({r["batch"] for r in got}) == 4 and any(w[2] for w in want.values()) and {w[3] for w in want.values()} >= {1, 2}


def test_the_guided_query_is_plain_code(spark, small):
    feed, walks = streams._guided_parts(spark, small, views.read(spark, small, "events"))
    line = {r["user_id"]: [(p["lat"], p["lon"]) for p in r["line"]] for r in walks.collect()}
    rows = [(r["event_id"], r["ts"], r["user_id"], r["lat"], r["lon"], r["good"]) for r in feed.collect()]
    same_guide(QUERIES["stm_06_progress_stream"](spark, small).collect(), guided_by_hand([rows], line))


def test_the_guided_querys_batches_read_settled_walks(spark, small):
    """Walks of the feed's users alone, from a table: no batch ranks all lines again."""
    feed, walks = streams._guided_parts(spark, small, views.read(spark, small, "events"))
    for df in (feed, walks):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "l_orderkey" not in plan
    users = {r[0] for r in views.read(spark, small, "events").select("user_id").distinct().collect()}
    assert {r["user_id"] for r in walks.collect()} <= users
    assert {r["user_id"] for r in walks.collect()} == {r[0] for r in views.stops(spark, small).groupBy("route_id").count().where("count > 1").collect()} & users
