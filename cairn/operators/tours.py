"""Walks: legs, cost matrices, ordering, trimming, detours. One problem is small; problems are spread over tasks."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import stacks, walks
from .groups import Columns, by_group, dealt, least_of_runs
from .spatial import crowding, fitting_size, meet_legs, points_on_legs, reach_size
from .staging import settle
from .walks import EXHAUSTIVE, UNREACHABLE, Walk

#: Limits of a leg by profile, in metres, and its share of the time budget.
LEG_METRES = {"foot": 5000.0, "bicycle": 20000.0}
LEG_SHARE = 0.25
#: Least minutes and share of the budget that a visit's cap is made of, minutes of a visit that has none, and bounds of those shown.
VISIT_LEAST, VISIT_SHARE = 10.0, 0.4
DEFAULT_MINUTES = 15.0
SHOWN = (5, 480)


def legs(stops: DataFrame, key: str = "route_id") -> DataFrame:
    """key, ordinal, place_id, next_id, metres, seconds: consecutive stops."""
    w = Window.partitionBy(key).orderBy("ordinal")
    nxt = stops.select(key, "ordinal", "place_id", "lat", "lon", F.lead("place_id").over(w).alias("next_id"), F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2")).where("next_id is not null")
    m = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return nxt.select(key, "ordinal", "place_id", "next_id", m.alias("metres"), geo.leg_seconds(m).alias("seconds"))


def matrix(stops: DataFrame, key: str = "route_id") -> DataFrame:
    """key, i, j, seconds for each two stops of a problem; the diagonal is zero. A problem's stops are few."""
    a = stops.select(key, F.col("ordinal").alias("i"), F.col("lat").alias("la"), F.col("lon").alias("lo"))
    b = stops.select(key, F.col("ordinal").alias("j"), F.col("lat").alias("lb"), F.col("lon").alias("lp"))
    m = geo.haversine_m(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp"))
    return a.join(b, key).select(key, "i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(geo.leg_seconds(m)).alias("seconds"))


def walk_seconds(per_leg: DataFrame, key: str = "route_id") -> DataFrame:
    """key, seconds (saturating at 1e9; a leg not measured adds nothing), measured (without it, but with what is unreachable), unknown, longest."""
    s = F.col("seconds")
    return per_leg.groupBy(key).agg(
        F.least(F.lit(UNREACHABLE), F.sum(F.when(F.isnan(s), 0.0).otherwise(s))).alias("seconds"),
        F.sum(F.when(~F.isnan(s), s)).alias("measured"),
        F.count_if(F.isnan(s)).alias("unknown"),
        F.max(F.when(~F.isnan(s), s)).alias("longest"),
    )


def leg_cap_seconds(profile: Column, budget_minutes: Column) -> Column:
    """A quarter of the budget, at most so many metres at the profile's speed; others the whole budget, or four hours."""
    quarter = budget_minutes * 60 * LEG_SHARE
    capped = lambda p: F.least(quarter, F.lit(LEG_METRES[p] / (geo.SPEEDS[p] / 3.6)))
    return F.when(profile == "foot", capped("foot")).when(profile == "bicycle", capped("bicycle")).otherwise(F.coalesce(budget_minutes * 60, F.lit(4 * 3600.0)))


#: From here on a plan is too far or too long to walk or cycle.
TOO_FAR_M, TOO_LONG_S = 15_000.0, 14_400.0


def alternatives(profile: Column, metres: Column, seconds: Column) -> Column:
    """Other means of travel for a plan that outgrows its own: array of struct(profile, reason).

    Walkers are offered a bicycle and a car, cyclists a car, anyone else nothing. A plan that is too far is not too long.
    """
    far = F.coalesce(metres, F.lit(0.0)) >= TOO_FAR_M
    reason = F.when(far, "too_far_to_walk").otherwise("too_long_to_walk")
    offer = lambda *names: F.array(*(F.struct(F.lit(n).alias("profile"), reason.alias("reason")) for n in names))
    none = F.array().cast("array<struct<profile:string,reason:string>>")
    outgrown = far | F.coalesce(seconds >= TOO_LONG_S, F.lit(False))
    return F.when(outgrown & (profile == "foot"), offer("bicycle", "car")).when(outgrown & (profile == "bicycle"), offer("car")).otherwise(none)


def visit_cap_minutes(budget_minutes: Column) -> Column:
    """A visit takes at most two fifths of the budget in a plan, but ten minutes are never cut; null without a budget."""
    return F.when(budget_minutes.isNotNull(), F.greatest(F.lit(VISIT_LEAST), budget_minutes * VISIT_SHARE))


def planned_minutes(visit_minutes: Column, budget_minutes: Column) -> Column:
    """Minutes of a visit in a plan: those given, else fifteen, under the cap of the budget."""
    return F.least(F.coalesce(visit_minutes, F.lit(DEFAULT_MINUTES)), visit_cap_minutes(budget_minutes))


def shown_minutes(visit_minutes: Column, estimate: Column) -> Column:
    """Minutes of a visit as shown: those given, else the estimate, within five and 480."""
    low, high = SHOWN
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(visit_minutes, estimate))).cast("int")


def walk_totals(stops: DataFrame, origins: DataFrame, key: str = "route_id") -> DataFrame:
    """key, seconds, closing: legs in order, the way from the origin, and (closing) the way back where the walk is round.

    origins: key, origin_lat, origin_lon (null: the walk begins at its first stop), round_trip.
    """
    line = legs(stops, key).groupBy(key).agg(F.sum("seconds").alias("between"))
    point = F.struct("lat", "lon")
    ends = stops.groupBy(key).agg(F.count("*").alias("n"), F.min_by(point, "ordinal").alias("a"), F.max_by(point, "ordinal").alias("b"))
    all_ = ends.join(line, key, "left").join(origins, key, "left")
    leg = lambda p, q: geo.leg_seconds(geo.haversine_m(*p, *q))
    first, last, home = (F.col("a.lat"), F.col("a.lon")), (F.col("b.lat"), F.col("b.lon")), (F.col("origin_lat"), F.col("origin_lon"))
    known = F.col("origin_lat").isNotNull()
    out = F.when(known, leg(home, first)).otherwise(0.0)
    back = F.when(F.col("round_trip") & (F.col("n") > 1), F.when(known, leg(last, home)).otherwise(leg(last, first))).otherwise(0.0)
    return all_.select(key, (F.coalesce("between", F.lit(0.0)) + out + back).alias("seconds"), back.alias("closing"))


def _seconds(lat: np.ndarray, lon: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """On foot in a straight line; arguments in radians."""
    h = np.sin((lat2 - lat) / 2) ** 2 + np.cos(lat) * np.cos(lat2) * np.sin((lon2 - lon) / 2) ** 2
    return 2 * geo.EARTH_M * np.arcsin(np.minimum(1, np.sqrt(h))) / (geo.SPEEDS["foot"] / 3.6)


def _problem(own: Columns) -> np.ndarray:
    """Seconds on foot between the stops of a walk."""
    lat, lon = np.radians(own["lat"].astype(float)), np.radians(own["lon"].astype(float))
    return _seconds(lat[:, None], lon[:, None], lat, lon)


def _walks(own: Columns, unreachable_s: float) -> stacks.Walks:
    """The stops of walks as problems: visits in seconds, budget and cap of the first row, ways to and from an origin."""
    lat, lon, from_lat, from_lon = (np.radians(own[c].astype(float)) for c in ("lat", "lon", "origin_lat", "origin_lon"))
    legs_ = _seconds(lat[:, :, None], lon[:, :, None], lat[:, None, :], lon[:, None, :])
    legs_ = np.where(legs_ > unreachable_s, UNREACHABLE, legs_)
    blocked = np.frompyfunc(lambda those: those is not None, 1, 1)(own["blocked"]).astype(bool)
    for w, i in np.argwhere(blocked).tolist():
        legs_[w, i, np.isin(own["ordinal"][w], own["blocked"][w, i])] = UNREACHABLE
    limit = lambda c: np.where(np.isnan(own[c][:, 0].astype(float)), np.inf, own[c][:, 0].astype(float))
    return stacks.Walks(legs_, own["visit_s"].astype(float), own["must"].astype(bool), own["relevance"].astype(float), limit("budget_s"), limit("cap_s"), _seconds(lat, lon, from_lat, from_lon), ~np.isnan(from_lat[:, 0]), own["round_trip"][:, 0].astype(bool))


def _plans(own: Columns, key: str, unreachable_s: float) -> Columns:
    """The plans of walks of as many stops: see planned."""
    whole = _walks(own, unreachable_s)
    many, n = whole.visits.shape
    linked = np.isnan(whole.legs) | (whole.legs < UNREACHABLE)
    kept = np.ones((many, n), bool)
    for w in np.flatnonzero(~linked.all(axis=(1, 2))).tolist():
        kept[w] = whole.must[w]
        kept[w, reachable_stops(linked[w].tolist(), whole.relevance[w].tolist())] = True
    sizes, out = kept.sum(axis=1), []
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        alive = np.nonzero(kept[rows])[1].reshape(len(rows), size)
        some = whole.part(rows, alive)
        orders = stacks.pruned(some, stacks.planned(some))
        for w, order in orders.by_length(np.arange(len(rows))):
            k, stops = order.shape[1], alive[w[:, None], order]
            seconds, at = some.totals(order, w), rows[w]
            every = lambda x: np.repeat(x, k)  # noqa: B023, E731
            out.append({
                key: every(own[key][at, 0]), "position": np.tile(np.arange(k), len(w)), "place_id": own["place_id"][at[:, None], stops].ravel(), "seconds": every(seconds),
                "fits": every(some.measured(order, w) <= some.budget[w]), "dropped": np.full(stops.size, n - k), "walk_s": every(seconds - some.visits[w[:, None], order].sum(axis=1)),
            })
    return {c: np.concatenate([o[c] for o in out]) for c in out[0]}


def ordered(stops: DataFrame, *, method: str = "tour", key: str = "route_id") -> DataFrame:
    """key, position, place_id, seconds (of the whole walk): each problem ordered by tour, shortest_reference, insertion_tour or nearest_tours."""

    def solve(own: Columns) -> Columns:
        legs_ = _problem(own)
        none = np.zeros(len(legs_))
        walk = Walk(legs_, none, none.astype(bool), none)
        order = way(walk)
        return {key: own[key][: len(order)], "position": np.arange(len(order)), "place_id": own["place_id"][order], "seconds": np.full(len(order), walk.total(order))}

    def solve_many(own: Columns) -> Columns:
        lat, lon = np.radians(own["lat"].astype(float)), np.radians(own["lon"].astype(float))
        legs_ = _seconds(lat[:, :, None], lon[:, :, None], lat[:, None, :], lon[:, None, :])
        orders = walks.shortest(legs_)
        every = np.arange(len(orders))[:, None]
        total = legs_[every, orders[:, :-1], orders[:, 1:]].sum(axis=1, keepdims=True)
        return {key: own[key], "position": np.broadcast_to(np.arange(orders.shape[1]), orders.shape), "place_id": own["place_id"][every, orders], "seconds": np.broadcast_to(total, orders.shape)}

    def solve_stack(own: Columns) -> Columns:
        lat, lon = np.radians(own["lat"].astype(float)), np.radians(own["lon"].astype(float))
        many, n = lat.shape
        none, free = np.zeros((many, n)), np.full(many, np.inf)
        orders = []
        for k in stacks.chunks(many, n):
            legs_ = _seconds(lat[k, :, None], lon[k, :, None], lat[k, None, :], lon[k, None, :])
            some = stacks.Walks(legs_, none[k], none[k].astype(bool), none[k], free[k], free[k], none[k], np.zeros(len(legs_), bool), np.zeros(len(legs_), bool))
            order = stacks.tour(some).stops
            orders.append((order, some.totals(order, np.arange(len(order)))))
        order, total = (np.concatenate(x) for x in zip(*orders, strict=True))
        return {key: own[key], "position": np.broadcast_to(np.arange(n), order.shape), "place_id": np.take_along_axis(own["place_id"], order, 1), "seconds": np.broadcast_to(total[:, None], order.shape)}

    own, schema = stops.select(key, "ordinal", "place_id", "lat", "lon"), f"{key} long, position int, place_id long, seconds double"
    if method == "shortest_reference":
        return by_group(own, key, ["ordinal"], solve_many, schema, stacked=True)
    if method == "tour":
        return by_group(own, key, ["ordinal"], solve_stack, schema, stacked=True)
    way = {"insertion_tour": walks.insertion, "nearest_tours": walks.nearest}[method]
    return by_group(own, key, ["ordinal"], solve, schema)


#: What a plan may be bound by, and what holds without it.
BINDING = {"visit_minutes": "double", "must": "boolean", "relevance": "double", "budget_minutes": "double", "origin_lat": "double", "origin_lon": "double", "round_trip": "boolean", "profile": "string", "blocked": "array<int>"}


def planned(stops: DataFrame, *, key: str = "route_id", unreachable_s: float = UNREACHABLE) -> DataFrame:
    """key, position, place_id, seconds, fits, dropped: the whole measurement of each walk.

    Stops that no leg of less than unreachable_s links both ways are left out, the rest is ordered and trimmed to the
    budget and the profile's longest leg, and stops that still can't be walked to are pruned. seconds and fits are
    those of the plan, walk_s is its walking alone; dropped counts the stops left out. stops: key, ordinal, place_id, lat,
    lon and any of BINDING; budget, origin, round_trip and profile are those of a walk's first stop; blocked are ordinals
    of stops that can't be walked to from one, nor back.
    """
    bound = stops.select(key, "ordinal", "place_id", "lat", "lon", *((F.col(c) if c in stops.columns else F.lit(None)).cast(t).alias(c) for c, t in BINDING.items()))
    minutes = planned_minutes(F.col("visit_minutes"), F.col("budget_minutes"))
    cap = leg_cap_seconds(F.coalesce("profile", F.lit("foot")), F.col("budget_minutes"))
    rows = bound.select(
        *(key, "ordinal", "place_id", "lat", "lon", "origin_lat", "origin_lon"),
        (minutes * 60).alias("visit_s"), F.coalesce("must", F.lit(False)).alias("must"), F.coalesce("relevance", F.lit(0.0)).alias("relevance"),
        (F.col("budget_minutes") * 60).alias("budget_s"), cap.alias("cap_s"), F.coalesce("round_trip", F.lit(False)).alias("round_trip"), "blocked",
    )

    def solve(own: Columns) -> Columns:
        parts = [_plans({c: v[k] for c, v in own.items()}, key, unreachable_s) for k in stacks.chunks(*own["lat"].shape)]
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    return by_group(rows, key, ["ordinal"], solve, f"{key} long, position int, place_id long, seconds double, fits boolean, dropped int, walk_s double", stacked=True)


#: Stairways that a leg's first part is to hold, and how many times as far each later round looks.
FIRST_STEPS, FARTHER = 3.0, 6.0


def stepped_legs(stops: DataFrame, stairways: DataFrame, *, near_m: float = 15.0, key: str = "route_id") -> DataFrame:
    """key, i, j: legs between any two stops (ordinals, i < j) of a walk that a stairway (lat, lon) stands on. A walk's stops are few.

    Where stairways are many, each round looks along a part of the legs, some times as long as the one before; legs with a
    stairway are done, so the work doesn't grow with how many stand on them.
    """
    a = stops.select(key, F.col("ordinal").alias("i"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    b = stops.select(key, F.col("ordinal").alias("j"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    metres = geo.equirect_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")).alias("metres")
    left = settle(a.join(b, key).where("i < j").select("*", metres), "legs")
    usual, points = left.agg(F.avg("metres")).first()[0] or 0.0, stairways.select("lat", "lon")
    start, far, out = 0.0, FIRST_STEPS * 2 * near_m / max(crowding(points, reach_size(2 * near_m)), 1e-9), []
    at = lambda c, m: (F.col(f"a_{c}") + (F.col(f"b_{c}") - F.col(f"a_{c}")) * F.least(F.lit(1.0), F.lit(m) / F.greatest("metres", F.lit(1e-9))))
    while True:
        whole = 2 * far >= usual
        if whole and not start:
            parts, ends = left, {}
        else:
            to = [F.col(f"b_{c}").alias(f"_to_{c}") if whole else at(c, far).alias(f"_to_{c}") for c in ("lat", "lon")]
            parts = left.select("*", *(at(c, start).alias(f"_from_{c}") for c in ("lat", "lon")), *to)
            ends = {"a": ("_from_lat", "_from_lon"), "b": ("_to_lat", "_to_lon")}
        found = points_on_legs(points, dealt(parts, key), near_m, **ends)[0].select(key, "i", "j").distinct()
        if whole:
            return reduce(DataFrame.unionByName, [*out, found])
        out.append(settle(found, "stepped"))
        # What ends before far was looked at to its end.
        left = settle(left.where(F.col("metres") > far).join(out[-1], [key, "i", "j"], "left_anti"), "legs")
        start, far = far, far * FARTHER


def step_free_price(stops: DataFrame, stairways: DataFrame, *, near_m: float = 15.0, key: str = "route_id", unreachable_s: float = UNREACHABLE) -> DataFrame:
    """key, walk_minutes, without_steps_minutes, detour_minutes, fits, kept, kept_plain, services: what a walk without steps costs.

    Services are where a walk rests, not its stops, unless they must be visited: they are counted and left out. What is
    left is planned twice, as planned() does: on any leg (without_steps_minutes), and on none that a stairway stands on
    (walk_minutes), each in an order of its own; the second plan's fit to the budget and the stops of either are given.
    The detour is the difference, and never below nothing. A walk of fewer than two stops has no plan. stops: also
    service (boolean).
    """
    is_stop = ~F.coalesce("service", F.lit(False)) | F.coalesce("must", F.lit(False))
    counts = stops.groupBy(key).agg(F.count_if(~is_stop).alias("services"), F.count_if(is_stop).alias("n"))
    sights = settle(stops.where(is_stop).join(counts.where("n >= 2").select(key), key, "left_semi"), "sights")
    found = settle(stepped_legs(sights, stairways, near_m=near_m, key=key), "stepped")
    both = found.select(key, F.col("i").alias("ordinal"), F.col("j").alias("to")).unionByName(found.select(key, F.col("j").alias("ordinal"), F.col("i").alias("to")))
    masked = sights.join(both.groupBy(key, "ordinal").agg(F.collect_set("to").alias("blocked")), [key, "ordinal"], "left")
    minutes = lambda df, name, kept: df.groupBy(key).agg(F.round(F.first("walk_s") / 60).cast("int").alias(name), F.count("*").alias(kept), F.first("fits").alias(f"fits_{name}"))
    free = minutes(planned(masked, key=key, unreachable_s=unreachable_s), "walk_minutes", "kept")
    plain = minutes(planned(sights, key=key, unreachable_s=unreachable_s), "without_steps_minutes", "kept_plain")
    out = counts.join(free, key, "left").join(plain, key, "left")
    detour = F.greatest(F.lit(0), F.col("walk_minutes") - F.col("without_steps_minutes")).alias("detour_minutes")
    return out.select(key, "walk_minutes", "without_steps_minutes", F.when(F.col("walk_minutes").isNotNull(), detour).alias("detour_minutes"), F.col("fits_walk_minutes").alias("fits"), "kept", "kept_plain", "services")


def fitted(stops: DataFrame, *, budget_minutes: float, key: str = "route_id") -> DataFrame:
    """key, position, place_id: walks planned within one budget. stops: also visit_minutes, must."""
    return planned(stops.withColumn("budget_minutes", F.lit(float(budget_minutes))), key=key).select(key, "position", "place_id")


#: About half the breadth of the ellipse that a long leg's detours lie in: what its cells are fitted to.
WIDE_M = 10_000.0


def detours(per_leg: DataFrame, services: DataFrame, *, most_seconds: float, key: str = "route_id") -> DataFrame:
    """key, service_id, ordinal, extra: the leg where a service costs least, if no more than most_seconds.

    per_leg: key, ordinal, la, lo, lb, lp (ends), seconds. What costs so many seconds at most lies in an ellipse about
    the leg; services meet the leg along the ellipse's breadth, which allows for the bend of a great circle. Ways
    straight through the globe, which cost no sines, tell most of the others apart.
    """
    speed = geo.SPEEDS["foot"] / 3.6
    direct, whole = F.col("seconds") * F.lit(speed), F.col("seconds") * F.lit(speed) + F.lit(most_seconds * speed)
    north = F.greatest(F.abs("la"), F.abs("lb"))
    aside = F.sqrt(whole * whole - direct * direct) * F.lit(0.55) + direct * direct * F.tan(F.radians(north)) / F.lit(4 * geo.EARTH_M)
    at = lambda name, lat, lon: dict(zip((f"{name}x", f"{name}y", f"{name}z", f"{name}c"), (*geo.on_globe(F.col(lat), F.col(lon)), F.cos(F.radians(lat))), strict=True))
    ends = per_leg.select(key, "ordinal", "la", "lo", "lb", "lp", "seconds").withColumns(at("_a", "la", "lo") | at("_b", "lb", "lp") | {"_whole": (whole + 0.01) / geo.EARTH_M, "_reach": aside / 0.9})
    points = services.select("service_id", "lat", "lon").withColumns(at("_s", "lat", "lon"))
    through = lambda p: F.sqrt(sum(((F.col(f"_s{i}") - F.col(f"{p}{i}")) * (F.col(f"_s{i}") - F.col(f"{p}{i}")) for i in "xyz"), F.lit(0.0)))
    size = fitting_size(points, WIDE_M, size=0.05)
    met = meet_legs(points, ends, ("la", "lo"), ("lb", "lp"), F.col("_reach"), size=size, near=through("_a") + through("_b") <= F.col("_whole"), together=(key, "ordinal"))
    there = geo.leg_seconds(geo.haversine_m(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon"), (F.col("_ac"), F.col("_sc"))))
    back = geo.leg_seconds(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("lb"), F.col("lp"), (F.col("_sc"), F.col("_bc"))))
    # Thousandths and ordinal in one number.
    both = F.shiftleft(F.floor((there + back - F.col("seconds")) * 1000 + 0.5).cast("long"), 32) + F.col("ordinal")
    best = least_of_runs(met.select(key, "service_id", both.alias("m")), key, "service_id", "m").where(F.shiftright("m", 32) <= F.lit(math.floor(most_seconds * 1000 + 1e-6)))
    return best.select(key, "service_id", F.col("m").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("ordinal"), (F.shiftright("m", 32) / 1000.0).alias("extra"))


def pruned_unreachable(stops: DataFrame, cap_seconds: float, *, key: str = "route_id", must: str | None = None) -> DataFrame:
    """key, ordinal, place_id, kept: a stop whose leg from the last kept one is over the cap is left out, in order.

    must names a column of stops that have to be visited: they are kept, and the leg goes on from them.
    """

    def solve(own: Columns) -> Columns:
        m = _problem(own).tolist()
        bound = own["must"].astype(bool) if must else np.zeros(len(m), bool)
        last, kept = 0, [True] + [False] * (len(m) - 1)
        for i in range(1, len(m)):
            if m[last][i] <= cap_seconds or bound[i]:
                last, kept[i] = i, True
        return {key: own[key], "ordinal": own["ordinal"], "place_id": own["place_id"], "kept": np.array(kept)}

    cols = [key, "ordinal", "place_id", "lat", "lon"] + ([F.coalesce(must, F.lit(False)).alias("must")] if must else [])
    return by_group(stops.select(*cols), key, ["ordinal"], solve, f"{key} long, ordinal int, place_id long, kept boolean")


def reachable_stops(legs: list[list[bool]], relevance: list[float]) -> list[int]:
    """Stops that can reach a surviving stop and be reached from one, to a fixpoint; if fewer than two, the best pair: linked first, then relevance, then order."""
    n = len(legs)
    if n < 3:
        return list(range(n))
    alive = set(range(n))
    while True:
        gone = {i for i in alive if not (any(legs[i][j] for j in alive if j != i) and any(legs[j][i] for j in alive if j != i))}
        if not gone:
            break
        alive -= gone
    if len(alive) >= 2:
        return sorted(alive)
    pairs = ((i, j) for i in range(n) for j in range(i + 1, n))
    return list(min(pairs, key=lambda p: (not (legs[p[0]][p[1]] or legs[p[1]][p[0]]), -(relevance[p[0]] + relevance[p[1]]), p)))


def both_ways_reachable(stops: DataFrame, cap_seconds: float, *, key: str = "route_id") -> DataFrame:
    """key, ordinal, place_id, kept: reachable_stops() of each walk, by legs of at most so many seconds. stops: also relevance."""

    def solve(own: Columns) -> Columns:
        kept = np.zeros(len(own[key]), bool)
        kept[reachable_stops((_problem(own) <= cap_seconds).tolist(), own["relevance"].astype(float).tolist())] = True
        return {key: own[key], "ordinal": own["ordinal"], "place_id": own["place_id"], "kept": kept}

    return by_group(stops.select(key, "ordinal", "place_id", "lat", "lon", "relevance"), key, ["ordinal"], solve, f"{key} long, ordinal int, place_id long, kept boolean")


def thinned(points: DataFrame, *, gap_m: float, most: int, key: str) -> DataFrame:
    """key, place_id: nearest to the group's centre first, each kept if it is far enough from those kept; at most so many.

    A group may be large, so no task holds one: each round keeps the first place left of every group, by partial
    minima where the rows lie, and drops what is too near to it. There are as many rounds as places kept at most.
    """
    centre = points.groupBy(key).agg(F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"))
    far = F.pow(F.col("lat") - F.col("c_lat"), 2) + F.pow(F.col("lon") - F.col("c_lon"), 2)
    left = settle(points.select(key, "place_id", "lat", "lon").join(centre, key).select(key, "place_id", "lat", "lon", far.alias("far")), "to-thin")
    kept = None
    for _ in range(most):
        first = settle(left.groupBy(key).agg(F.min(F.struct("far", "place_id", "lat", "lon")).alias("f")).select(key, "f.place_id", F.col("f.lat").alias("k_lat"), F.col("f.lon").alias("k_lon")), "thinned")
        kept = first if kept is None else kept.unionByName(first)
        gap = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("k_lat"), F.col("k_lon"))
        left = settle(left.join(first.select(key, F.col("place_id").alias("k_id"), "k_lat", "k_lon"), key).where((gap >= gap_m) & (F.col("place_id") != F.col("k_id"))).drop("k_id", "k_lat", "k_lon"), "to-thin")
        if left.isEmpty():
            break
    return kept.select(key, "place_id")
