"""Operators that SQL can't express, against brute force on small fixtures."""

from __future__ import annotations

import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn import views
from cairn.operators import fragments, measures, resolve, stacks, tours
from cairn.operators import walks as walking
from cairn.operators.walks import shortest
from cairn.queries import QUERIES

STOPS = "route_id long, ordinal int, place_id long, lat double, lon double"


def metres(a, b):
    p = math.radians
    h = math.sin(p(b[0] - a[0]) / 2) ** 2 + math.cos(p(a[0])) * math.cos(p(b[0])) * math.sin(p(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(min(1.0, math.sqrt(h)))


def walks(n_walks, n, seed):
    rng = np.random.default_rng(seed)
    return [(w, i + 1, 100 * w + i, 53.5 + float(rng.uniform(0, 0.1)), 24.0 + float(rng.uniform(0, 0.1))) for w in range(n_walks) for i in range(n)]


def seconds(walk, order):
    at = {r[2]: (r[3], r[4]) for r in walk}
    return sum(metres(at[a], at[b]) for a, b in zip(order, order[1:])) / (4 / 3.6)  # noqa: B905


@pytest.mark.parametrize("method", ["tour", "shortest_reference"])
def test_short_walks_are_ordered_as_by_trying_all(spark, method):
    rows = walks(6, 6, 1)
    got = tours.ordered(spark.createDataFrame(rows, STOPS), method=method).collect()
    for w in range(6):
        own = [r for r in rows if r[0] == w]
        least = min(seconds(own, o) for o in permutations([r[2] for r in own]))
        found = [r["place_id"] for r in sorted((r for r in got if r["route_id"] == w), key=lambda r: r["position"])]
        assert sorted(found) == sorted(r[2] for r in own)
        assert math.isclose(seconds(own, found), least, rel_tol=1e-6)


@pytest.mark.parametrize("method", ["tour", "insertion_tour", "nearest_tours"])
def test_longer_walks_keep_their_stops_and_are_near_the_shortest(spark, method):
    rows = walks(4, 9, 2)
    best = {r["route_id"]: r["seconds"] for r in tours.ordered(spark.createDataFrame(rows, STOPS), method="shortest_reference").collect()}
    got = tours.ordered(spark.createDataFrame(rows, STOPS), method=method).collect()
    for w in range(4):
        own = [r for r in got if r["route_id"] == w]
        assert sorted(r["place_id"] for r in own) == [100 * w + i for i in range(9)]
        assert own[0]["seconds"] >= best[w] - 1e-6
        assert method == "insertion_tour" or own[0]["seconds"] <= 1.25 * best[w]


def test_shortest_walks_are_the_first_of_the_cheapest():
    """Against all orders, with equal legs and stops in one place; many walks at once, in small tables too."""
    rng = np.random.default_rng(7)
    for n in range(1, 8):
        legs = rng.integers(0, 4, (40, n, n)).astype(float)
        legs = legs + legs.transpose(0, 2, 1)
        got = shortest(legs)
        for own, order in zip(legs, got.tolist(), strict=True):
            cost = lambda o, own=own: sum(own[a, b] for a, b in zip(o, o[1:]))  # noqa: E731, B905
            assert tuple(order) == min(permutations(range(n)), key=lambda o: (cost(o), o))
    legs = rng.random((3, 12, 12))
    table, walking.TABLE_BYTES = walking.TABLE_BYTES, 1
    try:
        small = shortest(legs)
    finally:
        walking.TABLE_BYTES = table
    assert (small == shortest(legs)).all() and all(sorted(o) == list(range(12)) for o in small.tolist())


def test_long_walks_go_on_to_the_nearest_from_the_first():
    legs = np.random.default_rng(8).integers(0, 9, (20, 15, 15)).astype(float)
    for own, order in zip(legs, shortest(legs).tolist(), strict=True):
        want = [0]
        while len(want) < 15:
            want.append(min((j for j in range(15) if j not in want), key=lambda j: (own[want[-1], j], j)))
        assert order == want


def least_line(at):
    """The shortest open walk through all points, in metres, by trying all."""
    d = [[metres(a, b) for b in at] for a in at]
    return min(sum(d[a][b] for a, b in zip(o, o[1:])) for o in permutations(range(len(at))) if o[0] <= o[-1])  # noqa: B905


def test_the_shortest_of_all_walks(spark, small):
    own: dict = {}
    for r in views.stops(spark, small).orderBy("route_id", "ordinal").collect():
        own.setdefault(r["route_id"], []).append((r["lat"], r["lon"]))
    got = {r["route_id"]: r["seconds"] for r in QUERIES["opt_16_reference"](spark, small).collect()}
    assert got.keys() == own.keys()
    for k in [k for k in own if k % 3 == 0 and len(own[k]) < 7]:
        assert math.isclose(got[k], least_line(own[k]) / (4 / 3.6), abs_tol=0.02)


def foot_m(at, a, b):
    """Metres from a point to a segment, on a plane about the point."""
    c = math.cos(math.radians(at[0]))
    (ay, ax), (by, bx) = ((y - at[0], (x - at[1]) * c) for y, x in (a, b))
    span = (bx - ax) ** 2 + (by - ay) ** 2
    t = min(1.0, max(0.0, -(ax * (bx - ax) + ay * (by - ay)) / span)) if span else 0.0
    return math.radians(1) * 6_371_000 * math.hypot(ax + t * (bx - ax), ay + t * (by - ay))


def test_the_price_of_walks_without_steps(spark):
    """Short walks: the cheapest order of all on legs without stairways, against the cheapest on any."""
    rng = random.Random(4)
    rows = [(w, i + 1, 100 * w + i, 53.5 + rng.uniform(0, 0.02), 24.0 + rng.uniform(0, 0.03), i == 4 or w == 9, w == 3 and i == 4) for w in range(10) for i in range(5)]
    stairs = [(53.5 + rng.uniform(0, 0.02), 24.0 + rng.uniform(0, 0.03)) for _ in range(14)]
    df = spark.createDataFrame(rows, STOPS + ", service boolean, must boolean").withColumn("visit_minutes", F.lit(10))
    got = {r["route_id"]: r for r in tours.step_free_price(df, spark.createDataFrame(stairs, "lat double, lon double"), near_m=100.0).collect()}
    seen = set()
    for w in range(10):
        at = [r[3:5] for r in rows if r[0] == w and (not r[5] or r[6])]
        assert got[w]["services"] == 5 - len(at)
        if len(at) < 2:
            assert got[w]["walk_minutes"] is None and got[w]["detour_minutes"] is None
            continue
        leg = lambda i, j, at=at: metres(at[i], at[j]) / (4 / 3.6)
        bad = {(i, j) for i in range(len(at)) for j in range(len(at)) if i != j and any(foot_m(s, at[i], at[j]) <= 100 for s in stairs)}
        orders = list(permutations(range(len(at))))
        cost = lambda o: sum(map(leg, o, o[1:]))
        plain = min(map(cost, orders))
        free = [cost(o) for o in orders if not any(p in bad for p in zip(o, o[1:]))]  # noqa: B905
        assert got[w]["without_steps_minutes"] == round(plain / 60) and got[w]["kept_plain"] == len(at)
        if free:
            assert got[w]["walk_minutes"] == round(min(free) / 60) and got[w]["kept"] == len(at)
            assert got[w]["detour_minutes"] == max(0, round(min(free) / 60) - round(plain / 60))
            seen.add(got[w]["detour_minutes"] > 0)
    assert seen == {True, False}


def test_one_stop_and_no_stop(spark):
    assert tours.ordered(spark.createDataFrame(walks(1, 1, 3), STOPS)).count() == 1
    assert tours.ordered(spark.createDataFrame([], STOPS)).count() == 0


def test_trimmed_walks_fit_and_keep_what_must_be_visited(spark):
    rows = [(*r, 60, r[1] == 1) for r in walks(5, 8, 4)]
    df = spark.createDataFrame(rows, STOPS + ", visit_minutes int, must boolean")
    got = tours.fitted(df, budget_minutes=240.0).collect()
    for w in range(5):
        found = [r["place_id"] for r in sorted((r for r in got if r["route_id"] == w), key=lambda r: r["position"])]
        assert 100 * w in found
        assert len(found) == 1 or seconds([r[:5] for r in rows if r[0] == w], found) + 3600 * len(found) <= 240 * 60


BOUND = STOPS + ", visit_minutes double, must boolean, relevance double, budget_minutes double, origin_lat double, origin_lon double, round_trip boolean"


def bound_walks(n_walks, n, seed, budget=None, scale=1.0):
    """Walks of which every second has an origin, every third a way back, and every fourth a stop that must be visited."""
    rng = random.Random(seed)
    rows = []
    for r in walks(n_walks, n, seed):
        w = r[0]
        home = (53.5 + (w % 7) / 100, 24.05) if w % 2 else (None, None)
        r = (*r[:3], 53.5 + (r[3] - 53.5) * scale, 24.0 + (r[4] - 24.0) * scale)
        rows.append((*r, float(rng.randint(5, 30)), w % 4 == 0 and r[1] == 2, float(rng.randint(0, 9)), budget, *home, w % 3 == 0))
    return rows


def whole_seconds(own, order):
    """Of an order of rows: visits as planned, legs, and the ways from and to the origin or back to the first."""
    walk = lambda a, b: metres(a, b) / (4 / 3.6)
    at = [r[3:5] for r in order]
    budget, home, back = own[0][8], own[0][9:11], own[0][11]
    cap = max(10.0, 0.4 * budget) if budget else math.inf
    total = sum(min(r[5], cap) * 60 for r in order) + sum(walk(a, b) for a, b in zip(at, at[1:]))  # noqa: B905
    if home[0] is not None:
        total += walk(home, at[0])
    if back and len(at) > 1:
        total += walk(at[-1], home if home[0] is not None else at[0])
    return total


def legs_of(own, order):
    at = [r[3:5] for r in order]
    pairs = list(zip(order, order[1:]))  # noqa: B905
    if own[0][11] and own[0][9] is None and len(at) > 1:
        pairs.append((order[-1], order[0]))
    return [(metres(a[3:5], b[3:5]) / (4 / 3.6), a, b) for a, b in pairs]


def found_of(got, w, own):
    by_id = {r[2]: r for r in own}
    return [by_id[r["place_id"]] for r in sorted((r for r in got if r["route_id"] == w), key=lambda r: r["position"])]


@pytest.mark.parametrize("n", [3, 5, 6])
def test_plans_without_a_budget_are_the_cheapest_orders(spark, n):
    rows = bound_walks(12, n, 11, scale=0.3)
    got = tours.planned(spark.createDataFrame(rows, BOUND)).collect()
    for w in range(12):
        own = [r for r in rows if r[0] == w]
        assert max(x for x, _, _ in legs_of(own, own)) < 4500  # below the cap of a walk without a budget, so that nothing is dropped
        least = min(whole_seconds(own, o) for o in permutations(own))
        found = found_of(got, w, own)
        assert len(found) == n and math.isclose(whole_seconds(own, found), least, rel_tol=1e-6)
        assert all(math.isclose(r["seconds"], least, rel_tol=1e-6) and r["fits"] and r["dropped"] == 0 for r in got if r["route_id"] == w)


def plainly_trimmed(own, order, budget_s):
    """The trimming rule, said with rows: the longest leg's end, else any stop, that saves most."""
    order = list(order)
    cap = min(budget_s * 0.25, 5000 / (4 / 3.6))
    while len(order) > 1:
        longest, a, b = max(legs_of(own, order), key=lambda x: x[0])
        fits = whole_seconds(own, order) <= budget_s
        if fits and longest <= cap:
            break
        free = [r for r in order if not r[6]]
        ends = [r for r in (a, b) if r in free] if longest > cap else []
        if not free or (fits and not ends):
            break
        gone = min(ends or free, key=lambda r: whole_seconds(own, [x for x in order if x != r]))
        order.remove(gone)
    return order


@pytest.mark.parametrize(("n", "minutes"), [(5, 60.0), (6, 110.0), (6, 160.0)])
def test_plans_are_trimmed_to_budget_and_longest_leg(spark, n, minutes):
    rows = bound_walks(12, n, 12, minutes)
    got = tours.planned(spark.createDataFrame(rows, BOUND)).collect()
    cut = 0
    for w in range(12):
        own = [r for r in rows if r[0] == w]
        best = min(permutations(own), key=lambda o: whole_seconds(own, o))
        want = plainly_trimmed(own, best, minutes * 60)
        found = found_of(got, w, own)
        cut += len(found) < n
        assert {r[2] for r in found} == {r[2] for r in want}
        assert whole_seconds(own, found) <= whole_seconds(own, want) + 1e-6
        assert {r[2] for r in own if r[6]} <= {r[2] for r in found}
        own_rows = [r for r in got if r["route_id"] == w]
        assert all(r["dropped"] == n - len(found) and r["fits"] == (whole_seconds(own, found) <= minutes * 60) for r in own_rows)
    assert cut


def test_longer_plans_keep_the_rules(spark):
    rows = bound_walks(10, 11, 13, 200.0)
    got = tours.planned(spark.createDataFrame(rows, BOUND)).collect()
    for w in range(10):
        own = [r for r in rows if r[0] == w]
        found = found_of(got, w, own)
        assert found and {r[2] for r in own if r[6]} <= {r[2] for r in found}
        assert len(found) == 1 or whole_seconds(own, found) <= 12_000
        assert all(x <= 3000 for x, _, _ in legs_of(own, found))


def test_a_measured_walk_leaves_out_what_cannot_be_walked_to(spark):
    far = (0, 9, 9, 55.0, 26.0, 10.0, False, 1.0, None, None, None, False)
    rows = [r for r in bound_walks(1, 5, 14)] + [far]
    got = tours.planned(spark.createDataFrame(rows, BOUND), unreachable_s=20_000.0).collect()
    assert {r["place_id"] for r in got} == {0, 1, 2, 3, 4} and {r["dropped"] for r in got} == {1}
    bound = [r[:6] + (True,) + r[7:] if r[2] == 9 else r for r in rows]
    got = tours.planned(spark.createDataFrame(bound, BOUND), unreachable_s=20_000.0).collect()
    assert 9 in {r["place_id"] for r in got}


def test_pruned_stops_are_over_the_cap(spark):
    rows = walks(5, 7, 5)
    got = {(r["route_id"], r["ordinal"]): r["kept"] for r in tours.pruned_unreachable(spark.createDataFrame(rows, STOPS), 4000.0).collect()}
    for w in range(5):
        own = [r for r in rows if r[0] == w]
        last = own[0]
        for r in own[1:]:
            near = metres(last[3:], r[3:]) / (4 / 3.6) <= 4000.0
            assert got[w, r[1]] == near
            last = r if near else last


def test_thinned_places_keep_their_distance(spark):
    rows = [(f"town {r[0]}", r[2], r[3], r[4]) for r in walks(2, 40, 6)]
    got = tours.thinned(spark.createDataFrame(rows, "town string, place_id long, lat double, lon double"), gap_m=1500.0, most=10, key="town").collect()
    at = {r[1]: r[2:] for r in rows}
    for t in ("town 0", "town 1"):
        kept = [r["place_id"] for r in got if r["town"] == t]
        assert 0 < len(kept) <= 10
        assert all(metres(at[a], at[b]) >= 1500 for a in kept for b in kept if a != b)
        own = [r for r in rows if r[0] == t]
        c = [sum(r[k] for r in own) / len(own) for k in (2, 3)]
        greedy = []
        for r in sorted(own, key=lambda r: ((r[2] - c[0]) ** 2 + (r[3] - c[1]) ** 2, r[1])):
            if len(greedy) < 10 and all(metres(r[2:], at[k]) >= 1500 for k in greedy):
                greedy.append(r[1])
        assert sorted(kept) == sorted(greedy)


def test_greedy_matches_follow_the_order_of_the_reference(spark):
    a, b = walks(8, 5, 7), [r for r in walks(9, 4, 8) if r[0] != 3]
    got = {(r["route_id"], r["ordinal"]): r["matched"] for r in measures.greedy_matches(spark.createDataFrame(a, STOPS), spark.createDataFrame(b, STOPS), key="route_id", metres=4000.0).collect()}
    want = {}
    for w in range(8):
        free = [r for r in b if r[0] == w]
        for r in (r for r in a if r[0] == w):
            near = sorted((metres(r[3:], s[3:]), s[1], s) for s in free if metres(r[3:], s[3:]) <= 4000.0)
            want[w, r[1]] = near[0][1] if near else None
            if near:
                free.remove(near[0][2])
    assert got == want
    assert any(v is None for v in want.values()) and any(v for v in want.values())


def test_bootstrap_interval_is_near_the_normal_one(spark):
    rng = np.random.default_rng(9)
    values = rng.normal(10, 2, 200)
    df = spark.createDataFrame([("all", i, float(v)) for i, v in enumerate(values)], "k string, i int, v double")
    got = measures.bootstrap(df, "k", "v", resamples=1000).first()
    half = 1.96 * values.std(ddof=1) / math.sqrt(200)
    assert math.isclose(got["mean"], values.mean(), rel_tol=1e-9)
    assert abs(got["low"] - (values.mean() - half)) < 0.15 * half and abs(got["high"] - (values.mean() + half)) < 0.15 * half


def test_draws_are_dealt_out_whole_and_as_by_chance():
    """A tree of eight blocks: in every resample their draws sum up to all, and each block's are binomial."""
    weights, n, resamples = [5, 0, 1, 30, 7, 7, 2, 48], 100, 4000
    sums = {(d, k): sum(w for leaf, w in enumerate(weights) if leaf >> 3 - d == k) for d in range(4) for k in range(1 << d)}
    got = {}
    for leaf, w in enumerate(weights):
        if w:
            way = [{"level": d, "node": leaf >> 3 - d, "parent": leaf >> 4 - d, "left": sums[d, leaf >> 4 - d << 1], "both": sums[d - 1, leaf >> 4 - d]} for d in (1, 2, 3)]
            got[leaf] = measures._block_totals({"n": n, "hash": -5, "leaf": leaf, "way": way, "held": [{"v": 1.0, "times": w}]}, resamples, 7)
    assert (sum(got.values()) == n).all()
    for leaf, own in got.items():
        p = weights[leaf] / n
        assert abs(own.mean() - n * p) < 5 * math.sqrt(n * p * (1 - p) / resamples) and abs(own.var() / (n * p * (1 - p)) - 1) < 0.15


@pytest.mark.parametrize("block", [measures.BLOCK, 8])
def test_resampled_means_spread_as_multinomial_ones(spark, block):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(3, 1, 300).round(2), None: np.array([1.0, 1.0, 2.0]), "one": np.array([4.5])}
    df = spark.createDataFrame([(k, float(v)) for k, own in values.items() for v in own], "k string, v double")
    means: dict = {}
    for r in measures._resampled(df, "k", "v", 2000, 11, block).collect():
        means.setdefault(r["k"], {})[r["resample"]] = r["m"]
    assert means.keys() == values.keys()
    for k, own in values.items():
        m = np.array([means[k][i] for i in range(2000)])
        sd = own.std() / math.sqrt(len(own))
        assert abs(m.mean() - own.mean()) <= 5 * sd / math.sqrt(2000) + 1e-9 and abs(m.std() - sd) <= 0.08 * sd + 1e-9
    assert {round(m, 6) for m in means[None].values()} == {1.0, round(4 / 3, 6), round(5 / 3, 6), 2.0}
    again = {(r["k"], r["resample"]): r["m"] for r in measures._resampled(df.repartition(5), "k", "v", 2000, 11, block).collect()}
    assert all(math.isclose(again[k, i], m, rel_tol=1e-12) for k, own in means.items() for i, m in own.items())


def test_resamples_of_one_case_and_none(spark):
    a = spark.createDataFrame([(1, 2.0)], "case int, v double")
    got = measures.paired(a, a, "case", "v", resamples=50).first()
    assert (got["difference"], got["low"], got["p"], got["cases"]) == (0.0, None, None, 1)
    assert measures.paired(a.limit(0), a, "case", "v", resamples=50).first()["cases"] == 0
    row = measures.bootstrap(a, "case", "v", resamples=50).first()
    assert (row["low"], row["mean"], row["high"]) == (2.0, 2.0, 2.0)


def test_paired_difference(spark):
    a = spark.createDataFrame([(i, float(i % 7)) for i in range(60)], "case int, v double")
    b = spark.createDataFrame([(i, float(i % 7) + 1 + (i % 3) / 10) for i in range(5, 70)], "case int, v double")
    got = measures.paired(a, b, "case", "v", resamples=500).first()
    assert got["cases"] == 55 and math.isclose(got["difference"], 1.1, abs_tol=0.02)
    assert got["low"] <= got["difference"] <= got["high"] and got["p"] == 1 / 500


def _plain(t):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ").lower()


@pytest.mark.parametrize(("chars", "slice_chars"), [(40, 1_000_000), (40, 300), (None, 1_000_000)])
def test_passages_are_found_in_all_texts_as_by_trying_all(spark, chars, slice_chars):
    rng = random.Random(11)
    words = ["ab", "ring", "стена", "Ö", "x" * 30, "tower", "of"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, say(30)) for k in range(8)] + [(8, "short one"), (9, " \n "), (10, None), (11, "𐐀"), (12, "z" * 100)]
    texts = [(k, say(rng.randint(0, 60))) for k in range(60)] + [(60, None), (61, ""), (62, "y𐐀y"), (63, "SHORT\n\tone."), (64, "z" * 40), (65, "z" * 39)]
    texts += [(70 + k, say(3) + "q" + items[k][1][50:50 + 38 + k].upper() + "q " + say(3)) for k in range(8)]  # a later passage, within words
    got = fragments.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"), chars=chars, slice_chars=slice_chars).collect()
    want = set()
    for i, t in items:
        own = _plain(t or "")
        k = min(chars or len(own), len(own))
        parts = {own[a : a + k] for a in range(len(own) - k + 1)} - {""}
        want |= {(i, d) for d, x in texts if x is not None and any(p in _plain(x) for p in parts)}
    assert len(got) == len({tuple(r) for r in got}) and {(r["item_id"], r["doc_id"]) for r in got} == want
    assert (11, 62) in want and (8, 63) in want and (chars is None or any(d % 10 for _, d in want))


def test_a_text_is_hashed_by_powers_of_two_however_many_lengths_there_are():
    rng = random.Random(5)
    items = ["".join(rng.choice("ab") for _ in range(n)) for n in range(1, 150)]
    held = fragments.Passages(items, 149)
    assert sorted(held.by_power) == [1, 2, 4, 8, 16, 32, 64, 128]
    for t in ["", "a", items[100][:60], items[130], "b" + items[70] + "a" + items[149 - 2]]:
        assert held.of(t) == [i for i, own in enumerate(items) if own in t]


def test_passage_query_searches_every_document(spark, small):
    found = {tuple(r) for r in QUERIES["str_15_passages"](spark, small).collect()}
    assert {tuple(r) for r in QUERIES["str_15_fragments"](spark, small).collect()} <= found
    assert any(d % 10 for _, d in found)


def test_resampling_queries_draw_the_fixed_number(spark, small):
    r = views.runs(spark, small)
    mean = lambda d: d.groupBy("case_id").agg(F.avg("recall").alias("recall"))
    whole = measures.bootstrap(mean(r).withColumn("half", F.col("case_id") % 2), "half", "recall", resamples=10_000)
    near = lambda a, b: all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a, b, strict=True))
    for a, b in zip(*(sorted(map(tuple, x.collect())) for x in (QUERIES["agg_18_bootstrap"](spark, small), whole)), strict=True):
        assert near(a, b)
    pair = measures.paired(mean(r.where("repeat % 2 = 0")), mean(r.where("repeat % 2 = 1")), "case_id", "recall", resamples=10_000)
    assert near(QUERIES["agg_19_paired"](spark, small).first(), pair.first())


def test_only_the_isolated_stop_goes(spark):
    # The first stop is far from the rest: all others stay.
    rows = [(1, 1, 10, 55.0, 24.0, 1.0)] + [(1, k, 10 + k, 53.5, 24.0 + k / 1000, 1.0) for k in (2, 3, 4)]
    # Nothing is linked: the two most relevant; of equals the first.
    rows += [(2, k, 20 + k, 50.0 + k, 24.0, (1.0, 5.0, 2.0, 5.0)[k - 1]) for k in (1, 2, 3, 4)] + [(3, k, 30 + k, 50.0 + k, 24.0, 0.0) for k in (1, 2)]
    got = tours.both_ways_reachable(spark.createDataFrame(rows, STOPS + ", relevance double"), 4000.0).where("kept").collect()
    assert sorted(r["place_id"] for r in got) == [12, 13, 14, 22, 24, 31, 32]


def test_reachable_stops_are_the_largest_set_that_holds():
    rng = random.Random(5)
    few = 0
    for _ in range(400):
        n = rng.randint(3, 6)
        legs = [[rng.random() < 0.25 for _ in range(n)] for _ in range(n)]
        worth = [float(rng.randint(0, 3)) for _ in range(n)]
        holds = lambda own: all(any(legs[i][j] for j in own - {i}) and any(legs[j][i] for j in own - {i}) for i in own)  # noqa: E731, B023
        sets = [own for k in range(1 << n) if holds(own := {i for i in range(n) if k >> i & 1})]
        want = sorted(max(sets, key=len))
        if len(want) < 2:
            few += 1
            pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
            worths = [(legs[i][j] or legs[j][i], worth[i] + worth[j]) for i, j in pairs]
            want = list(pairs[worths.index(max(worths))])
        assert tours.reachable_stops(legs, worth) == want
    assert 0 < few < 400


def test_pruning_keeps_what_must_be_visited(spark):
    rows = [(1, 1, 10, 53.5, 24.0, False), (1, 2, 11, 55.0, 24.0, True), (1, 3, 12, 55.001, 24.0, None), (1, 4, 13, 53.5, 24.0, False)]
    got = tours.pruned_unreachable(spark.createDataFrame(rows, STOPS + ", must boolean"), 4000.0, must="must").where("kept").collect()
    assert sorted(r["place_id"] for r in got) == [10, 11, 12]


def test_groups_that_go_over_many_batches(spark):
    from cairn.operators.groups import by_group

    rows = [(None if k == 3 else k, i) for k, n in enumerate([1, 70, 2, 35, 1, 20]) for i in range(n)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        out = by_group(spark.createDataFrame(rows, "k long, i int"), "k", ["i"], lambda own: {"n": np.array([len(own["i"])]), "last": own["i"][-1:]}, "n long, last int").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(tuple(r) for r in out) == sorted((n, n - 1) for n in [1, 70, 2, 35, 1, 20])


def test_stacks_of_walks_are_solved_as_one_by_one():
    """With visits, budgets, caps, origins, ways back, legs that can't be walked or weren't measured: the same orders, stop by stop."""
    rng = np.random.default_rng(3)

    def some(n, odd):
        at = rng.random((n, 2)) * 50_000
        legs = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1))
        if odd > 1:
            legs[legs > 30_000] = walking.UNREACHABLE
        if odd > 2:
            legs[rng.random((n, n)) < 0.1] = np.nan
        bound = lambda most: float(rng.random() * most) if odd and rng.random() < 0.7 else math.inf
        ends = rng.random(n) * 50_000 if odd and rng.random() < 0.5 else None
        return walking.Walk(legs, rng.random(n) * 3000 * (odd > 0), rng.random(n) < 0.2 * (odd > 0), np.floor(rng.random(n) * 4), bound(200_000), bound(40_000), ends, ends, bool(odd and rng.random() < 0.4))

    for odd in range(4):
        for n in range(1, 11):
            many = [some(n, odd) for _ in range(8)]
            stack = stacks.stacked(many)
            for name in ("tour", "planned", *(("insertion", "nearest") if n > 2 else ())):
                got = getattr(stacks, name)(stack)
                assert [got.stops[i, : got.length[i]].tolist() for i in range(8)] == [getattr(walking, name)(w) for w in many], (odd, n, name)
            pruned = stacks.pruned(stack, stacks.planned(stack))
            assert [pruned.stops[i, : pruned.length[i]].tolist() for i in range(8)] == [walking.pruned(w, walking.planned(w)) for w in many]
