"""Queries over walks and pages against brute force."""

from __future__ import annotations

import math
from itertools import pairwise, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_solvers import metres

from cairn import views
from cairn.operators import tours
from cairn.queries import QUERIES

SPEED = 4 / 3.6
DEGREE = 111194.92664455873


@pytest.fixture(scope="module")
def walks(spark, small):
    own: dict = {}
    for r in views.stops(spark, small).orderBy("route_id", "ordinal").collect():
        own.setdefault(r["route_id"], []).append(r)
    return own


@pytest.fixture(scope="module")
def services(spark, small):
    return views.services(spark, small).collect()


def gap(s, a, b):
    """Metres from the service to the leg, and how far along it."""
    k = math.cos(math.radians(s["lat"]))
    ax, ay, dx, dy = (a["lon"] - s["lon"]) * k, a["lat"] - s["lat"], (b["lon"] - a["lon"]) * k, b["lat"] - a["lat"]
    n = dx * dx + dy * dy
    t = min(1.0, max(0.0, -(ax * dx + ay * dy) / n)) if n > 0 else 0.0
    return DEGREE * math.hypot(ax + t * dx, ay + t * dy), t


def along(a, b):
    return DEGREE * math.hypot((b["lon"] - a["lon"]) * math.cos(math.radians((a["lat"] + b["lat"]) / 2)), b["lat"] - a["lat"])


def test_every_walk_is_judged_for_steps(spark, small, walks, services):
    steps = [s for s in services if s["kind"] == "toilet"]
    want = {}
    for k, w in walks.items():
        hit = any(gap(s, a, b)[0] <= 1 for s in steps for a, b in pairwise(w))
        want[k] = "uncertain" if len(w) < 2 or k % 7 == 0 else "unmet" if hit else "satisfied"
    assert dict(map(tuple, QUERIES["ver_06_step_free"](spark, small).select("route_id", "status").collect())) == want


def test_services_along_every_walk(spark, small, walks, services):
    found = {(r["route_id"], r["service_id"]): r for r in QUERIES["j_04_along_line"](spark, small).collect()}
    want = set()
    for k, w in walks.items():
        legs = list(pairwise(w))
        lengths = [along(a, b) for a, b in legs]
        for s in services:
            gaps = [gap(s, a, b) for a, b in legs]
            least = min((g for g, _ in gaps), default=math.inf)
            if least <= 2000:
                want.add((k, s["service_id"]))
                r = found[k, s["service_id"]]
                at = [(sum(lengths[:i]) + t * lengths[i]) / sum(lengths) if sum(lengths) else 0.0 for i, (g, t) in enumerate(gaps) if g <= least + 1e-6]
                assert abs(r["offset_m"] - least) < 0.011
                assert any(abs(r["fraction"] - x) < 2e-6 for x in at)
    assert set(found) == want
    assert any(k % 100 for k, _ in want)
    by_walk: dict = {}
    for r in found.values():
        by_walk.setdefault(r["route_id"], []).append((r["fraction"], r["offset_m"], r["service_id"]))
    ranks = {(k, x[2], i + 1) for k, own in by_walk.items() for i, x in enumerate(sorted(own)[:12])}
    assert {(r["route_id"], r["service_id"], r["rank"]) for r in QUERIES["top_05_along_order"](spark, small).collect()} == ranks


def test_a_walk_without_length_has_services_along_it(spark):
    from cairn.operators import spatial

    legs = spatial.segments(spark.createDataFrame([(1, 1, 53.5, 24.0), (1, 2, 53.5, 24.0)], "route_id long, ordinal int, lat double, lon double"), "route_id", "ordinal")
    points = spark.createDataFrame([(5, 53.501, 24.0)], "service_id long, lat double, lon double")
    assert spatial.along_lines(points, legs, "route_id", 2000.0, id_="service_id").first()["fraction"] == 0.0


def test_detours_of_every_walk(spark, small, walks, services):
    found = {(r["route_id"], r["service_id"]): r for r in QUERIES["j_27_detours"](spark, small).collect()}
    point = lambda r: (r["lat"], r["lon"])
    want = set()
    for k, w in walks.items():
        legs = [(a, b, metres(point(a), point(b))) for a, b in pairwise(w)]
        for s in services:
            extra = [(metres(point(a), point(s)) + metres(point(s), point(b)) - m) / SPEED for a, b, m in legs]
            if extra and round(min(extra), 3) <= 1800:
                want.add((k, s["service_id"]))
                r = found[k, s["service_id"]]
                assert abs(r["extra"] - min(extra)) < 2e-3
                assert r["ordinal"] in [a["ordinal"] for (a, _, _), x in zip(legs, extra, strict=True) if x <= min(extra) + 2e-3]
    assert set(found) == want
    assert any(k % 100 for k, _ in want)


def test_every_walk_of_up_to_six_stops_is_tried_in_all_orders(spark, small, walks):
    found = {r["route_id"]: r["seconds"] for r in QUERIES["opt_02_exhaustive"](spark, small).collect()}
    assert set(found) == {k for k, w in walks.items() if len(w) <= tours.EXHAUSTIVE}
    for k in sorted(found)[::10]:  # all orders of all walks would take the test minutes
        w = walks[k]
        m = [[metres((a["lat"], a["lon"]), (b["lat"], b["lon"])) / SPEED for b in w] for a in w]
        assert abs(found[k] - min(sum(m[i][j] for i, j in pairwise(o)) for o in permutations(range(len(w))))) < 0.011


def test_all_redirects_are_followed(spark):
    folder = "/root/testdata/sf0.01"
    found = {r["id"]: (r["target"], r["hops"]) for r in QUERIES["src_25_redirects"](spark, folder).collect()}
    want = {}
    for (k,) in views.read(spark, folder, "part").select("p_partkey").collect():
        at, hops = k, 0
        while at % 3 == 0 and at > 0 and hops < 5:
            at, hops = at // 3, hops + 1
        want[k] = (at, hops)
    assert found == want
    assert max(want) > 400


def test_vectors_belong_to_their_content(spark):
    from cairn.operators import catalogue

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "bad"), (6, ""), (7, "none")], "id int, text string")

    def embed(texts):
        if "passage: bad" in texts:
            raise ValueError("no model")
        return [[float(len(t))] if t != "passage: none" else [] for t in texts]

    before, catalogue.BATCH = catalogue.BATCH, 1
    try:
        none = spark.createDataFrame([], "hash string, vector array<double>")
        done, new = catalogue.content_vectors(rows, none, embed)
        assert {r["id"]: r["vector"] for r in done.collect()} == {1: [10.0], 2: [10.0], 3: [10.0], 4: None, 5: None, 6: [9.0], 7: None}
        known = new.withColumn("vector", F.array(F.lit(0.5)))
        assert known.count() == 3
        again, more = catalogue.content_vectors(rows, known, embed)
        assert {r["id"]: r["vector"] for r in again.collect()} == {1: [0.5], 2: [0.5], 3: [0.5], 4: None, 5: None, 6: [0.5], 7: None} and more.isEmpty()
        asked, _ = catalogue.content_vectors(rows.where("id = 1"), known, embed, prefix=catalogue.QUESTION)
        assert asked.first()["vector"] == [8.0]
    finally:
        catalogue.BATCH = before


def test_query_vectors_in_blocks(spark, small):
    """Several blocks give what one does, and no vector is dealt out by a block."""
    from cairn.operators import retrieval

    asked, held = views.query_vectors(spark, small), views.place_vectors(spark, small)
    one, some = (retrieval.vector_top_k(asked, held, 7, block_bytes=n) for n in (retrieval.BLOCK_BYTES, 3000))
    same = lambda df: sorted((r["query_id"], r["rank"], r["place_id"], round(r["distance"], 9)) for r in df.collect())
    assert same(one) == same(some)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastNestedLoopJoin") > 1 and "SortMergeJoin" not in plan and "hashpartitioning(block" not in plan


def test_vectors_are_ranked_pack_by_pack_as_pair_by_pair(spark, monkeypatch):
    """Copies, ties, odd vectors and packs of a few rows; only what may be among the nearest leaves a pack."""
    from cairn.operators import retrieval

    rng = np.random.default_rng(7)
    held = rng.normal(size=(600, 5))
    held[100:400] = held[100]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(held)] + [(700, [float("nan")] * 5), (701, [1e200] * 5)]
    asked = [(i, (-v if i % 2 else v).tolist()) for i, v in enumerate(held[95:110])] + [(50, [1e200] * 5)]
    monkeypatch.setattr(retrieval, "PACK_ROWS", 64)
    passed, near = [], retrieval._nearest_in_packs
    monkeypatch.setattr(retrieval, "_nearest_in_packs", lambda *a: passed.append(near(*a)) or passed[-1])
    got = retrieval.vector_top_k(spark.createDataFrame(asked, "query_id long, vector array<double>"), spark.createDataFrame(rows, "place_id long, vector array<double>").coalesce(1), 7).collect()

    def far(a, b):
        dot, n_a, n_b = (sum(x * y for x, y in zip(p, q, strict=True)) for p, q in ((a, b), (a, a), (b, b)))
        d = 1.0 - dot / (math.sqrt(n_a) * math.sqrt(n_b))
        return math.inf if math.isnan(d) else d

    want = {(q, k + 1): i for q, v in asked for k, (_, i) in enumerate(sorted((far(w, v), i) for i, w in rows)[:7])}
    assert {(r["query_id"], r["rank"]): r["place_id"] for r in got} == want
    assert passed[0].count() < 15 * 602 / 4
