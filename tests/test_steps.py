"""Resolution, scores, map elements and texts on small fixtures, against plain code."""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F
from test_solvers import least_line, metres

from cairn import views
from cairn.functions import geo, text
from cairn.operators import etl, measures, resolve
from cairn.queries import QUERIES
from cairn.sources import elements


def test_curated_rows_are_laid_over_what_they_mean(spark):
    rows = spark.createDataFrame(
        [(1, "Old Mill", "mill", 53.1, 24.0, "auto", "v1"), (2, "old tower", "tower", 53.2, 24.1, "manual", "v2"), (3, "twin", "x", 53.0, 24.0, "auto", "v3"), (4, "twin", "x", 54.0, 25.0, "auto", "v4")],
        "place_id long, name string, category string, lat double, lon double, owner string, vector string",
    )
    curated = spark.createDataFrame([(1, "old mill", "museum"), (2, "old tower", "tower"), (3, "twin", "y"), (4, "no such thing", "z"), (5, "OLD MILL", "later")], "curated_id int, name string, category string")
    laid, aliases, verdicts = resolve.curated_overlay(rows, curated, columns=["name", "category"])
    assert {r["place_id"]: tuple(r)[1:3] + tuple(r)[5:] for r in laid.collect()} == {
        1: ("old mill", "museum", "curated", None), 2: ("old tower", "tower", "curated", "v2"), 3: ("twin", "x", "auto", "v3"), 4: ("twin", "x", "auto", "v4"),
    }
    assert {tuple(r) for r in aliases.collect()} == {(1, "old mill"), (1, "OLD MILL"), (2, "old tower")}
    assert {r["curated_id"]: r["verdict"] for r in verdicts.collect()} == {1: "matched", 2: "matched", 3: "ambiguous", 4: "unmatched", 5: "matched"}


def test_few_places_that_are_met_leave_the_catalogue_where_it_lies(spark, monkeypatch):
    """Many curated rows mean one place; neither these nor the catalogue's rows are gathered by name or place."""
    plan, judged, far = (lambda df: df._jdf.queryExecution().executedPlan().toString()), [], resolve._far_apart
    monkeypatch.setattr(resolve, "_far_apart", lambda points, *a: judged.append(plan(points)) or far(points, *a))
    rows = spark.createDataFrame([(i, "gate" if i % 2 else f"hill {i}", "x", 53.0, 24.0, "auto", f"v{i}") for i in range(40)], "place_id long, name string, category string, lat double, lon double, owner string, vector string")
    curated = spark.createDataFrame([(9 - i, "GATE" if i else "gate", None if i == 9 else f"c{i}") for i in range(10)], "curated_id int, name string, category string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        laid = resolve.curated_overlay(rows, curated, columns=["name", "category"])[0]
        got = {r["place_id"]: r for r in laid.collect()}
        assert "SortMergeJoin" not in judged[0] and not re.search("SortMergeJoin|Window", plan(laid))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert tuple(got[1])[1:3] == ("GATE", None) and got[1]["owner"] == "curated" and got[1]["vector"] is None
    assert len(got) == 40 and all(got[i]["owner"] == "auto" and got[i]["vector"] == f"v{i}" for i in range(40) if i != 1)


def test_scores_of_a_match(spark):
    kind = "route_id long, ordinal int, lat double, lon double"
    reference = [(1, 1, 53.5, 24.0), (1, 2, 53.51, 24.0), (2, 1, 53.5, 24.0), (3, 1, 53.5, 24.0)]
    answer = [(1, 1, 53.5, 24.001), (1, 2, 53.6, 24.0), (1, 3, 53.5, 24.0), (3, 1, 53.9, 24.0)]
    plans = [(1, 1800.0, 25.0, 20.0, True), (3, None, 12.0, None, False)]
    df = measures.match_scores(spark.createDataFrame(reference, kind), spark.createDataFrame(answer, kind), spark.createDataFrame(plans, "route_id long, walk_seconds double, walk_minutes double, est_walk_minutes double, fits boolean"), key="route_id")
    got = {r["route_id"]: r for r in df.collect()}
    line = lambda rows: sum(metres(a[2:], b[2:]) for a, b in zip(rows, rows[1:])) / 1000  # noqa: E731, B905
    assert (got[1]["recall"], got[1]["precision"], got[1]["walk_diff_min"], got[1]["budget_fit"]) == (0.5, 1 / 3, 10.0, True)
    assert math.isclose(got[1]["detour_km"], line(answer[:3]) - line(reference[:2]), rel_tol=1e-9)
    assert (got[2]["recall"], got[2]["precision"], got[2]["detour_km"], got[2]["budget_fit"]) == (0.0, 0.0, None, False)
    assert (got[3]["recall"], got[3]["detour_km"], got[3]["walk_diff_min"], got[3]["budget_fit"]) == (0.0, 0.0, 0.0, False)


def test_scores_of_all_walks(spark, small):
    got = {r["route_id"]: r for r in QUERIES["agg_27_match_scores"](spark, small).collect()}
    own: dict = {}
    for r in views.stops(spark, small).orderBy("route_id", "ordinal").collect():
        own.setdefault(r["route_id"], []).append((r["lat"], r["lon"]))
    line = lambda rows: sum(metres(a, b) for a, b in zip(rows, rows[1:])) / 1000  # noqa: E731, B905
    assert got.keys() == own.keys()
    for k, asked in own.items():
        given = own.get(k + 1, [])
        free, met = list(range(len(given))), 0
        for a in asked:
            near = sorted((metres(a, given[j]), j) for j in free if metres(a, given[j]) <= 15_000)
            if near:
                free.remove(near[0][1])
                met += 1
        assert math.isclose(got[k]["recall"], met / len(asked), abs_tol=1e-6)
        assert math.isclose(got[k]["precision"], met / len(given) if given else 0.0, abs_tol=1e-6)
        assert (got[k]["detour_km"] is None) == (not given)
        if given:
            if len(asked) < 7 and k % 3 == 0:
                assert math.isclose(got[k]["detour_km"], line(given) - least_line(asked) / 1000, abs_tol=2e-6)
            minutes = len(given) * (15.0 if k % 2 == 0 else 14.0)
            assert math.isclose(got[k]["walk_diff_min"], minutes - (40.0 if k % 3 else len(given) * 14.0), abs_tol=1e-6)


def test_tags_name_the_category(spark):
    cases = [
        ({"amenity": "place_of_worship"}, "храм"),
        ({"amenity": "place_of_worship", "religion": "christian", "denomination": "orthodox"}, "церковь"),
        ({"amenity": "place_of_worship", "religion": "christian"}, "костёл"),
        ({"building": "chapel"}, "храм"),
        ({"building": "church", "religion": "christian"}, "церковь"),
        ({"building": "church", "religion": "christian", "denomination": "catholic"}, "костёл"),
        ({"building": "castle", "historic": "fort"}, "замок"),
        ({"building": "palace"}, "дворец"),
        ({"historic": "fort"}, "укрепление"),
        ({"name": "Старый ДОТ № 5", "historic": "memorial"}, "укрепление"),
        ({"name": "Анекдот", "historic": "memorial"}, "памятник"),
        ({"historic": "manor", "tourism": "museum"}, "усадьба"),
        ({"tourism": "museum"}, "музей"),
        ({"natural": "rock"}, "валун"),
        ({"historic": "ruins"}, "архитектура"),
        ({"tourism": "attraction"}, "архитектура"),
        ({"tourism": "artwork"}, None),
        ({}, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, tags map<string,string>")
    got = {r[0]: r[1] for r in df.select("id", elements.sight_category(F.col("tags"))).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_compatible_texts(spark):
    df = spark.createDataFrame([(1, "ﬁne Ｃａｆｅ"), (2, "plain"), (3, "Ўсё"), (4, None), (5, "ﬁne Ｃａｆｅ")], "id int, name string")
    assert {r["id"]: r["name"] for r in text.compatible(df, "name").collect()} == {1: "fine Cafe", 2: "plain", 3: "Ўсё", 4: None, 5: "fine Cafe"}


def test_areas_as_text_and_fence(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    rings = [square(0.0, 0.0, 4.0), square(10.0, 0.0, 4.0)]
    df = spark.createDataFrame([("a", rings, [square(11.0, 1.0, 1.0)]), ("b", rings[:1], None), ("c", None, None)], "code string, rings array<array<struct<lon:double,lat:double>>>, holes array<array<struct<lon:double,lat:double>>>")
    said = {r[0]: r[1] for r in df.select("code", geo.as_wkt(F.col("rings"), F.col("holes"), 0)).collect()}
    assert said == {
        "a": "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0)), ((10 0, 14 0, 14 4, 10 4, 10 0), (11 1, 12 1, 12 2, 11 2, 11 1)))",
        "b": "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0)))",
        "c": None,
    }
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.5, 11.5), (3, 3.0, 13.0), (4, 9.0, 9.0)], "id int, lat double, lon double")
    assert {r["id"]: r["fenced"] for r in etl.fenced(points, df.where("code = 'a'"), "id").collect()} == {1: True, 2: False, 3: True, 4: False}


def test_deletes_go_on_to_all_that_hangs_on_a_row(spark):
    """Over a table that refers to itself, and to another in a circle; other references are emptied."""
    from cairn.operators import store

    rng = random.Random(3)
    users = [(i, rng.choice([None, *range(40)])) for i in range(40)]  # user, their favourite thread
    threads = [(i, rng.randrange(45), rng.choice([None, *range(40)])) for i in range(40)]  # thread, owner, parent
    turns = [(i, rng.choice([None, *range(40)])) for i in range(100)]
    tables = {"u": spark.createDataFrame(users, "user int, likes int"), "t": spark.createDataFrame(threads, "thread int, owner int, parent int"), "x": spark.createDataFrame(turns, "turn int, within int")}
    links = [store.Reference("t", "owner", "u"), store.Reference("t", "parent", "t"), store.Reference("x", "within", "t"), store.Reference("u", "likes", "t", cascade=False)]
    got = store.cascaded(tables, {"u": "user", "t": "thread", "x": "turn"}, links, {"u": spark.createDataFrame([(3,), (8,), (999,)], "user int")})
    gone_t: set = set()
    while True:
        more = {t for t, owner, parent in threads if owner in (3, 8) or parent in gone_t} - gone_t
        if not more:
            break
        gone_t |= more
    assert len(gone_t) > 5
    assert sorted(map(tuple, got["t"].collect()), key=repr) == sorted((t for t in threads if t[0] not in gone_t), key=repr)
    assert sorted(map(tuple, got["x"].collect()), key=repr) == sorted((x for x in turns if x[1] not in gone_t), key=repr)
    assert sorted(map(tuple, got["u"].collect()), key=repr) == sorted(((u, None if likes in gone_t else likes) for u, likes in users if u not in (3, 8)), key=repr)


def test_a_log_of_changes_and_what_each_did(spark):
    from cairn.operators import store

    rows = spark.createDataFrame([(1, "a", "k", "auto", [1.0]), (2, "b", "k", "auto", [2.0])], "id long, name string, category string, owner string, vector array<double>")
    log = [(1, "update", 1, None, None, ["name"]), (2, "update", 2, None, "new", ["category"]), (3, "delete", 1, None, None, None), (4, "update", 1, "x", None, ["name"]), (5, "create", 1, "c", None, None), (6, "create", 1, "d", None, None), (7, "update", 1, "ignored", "kind", []), (8, "delete", 9, None, None, None), (9, "create", 9, None, None, None)]
    out, done = store.applied(rows, spark.createDataFrame(log, "change_id int, op string, id long, name string, category string, sets array<string>"), key="id", columns=["name", "category"], embedded=["name"])
    assert {r["id"]: tuple(r)[1:] for r in out.collect()} == {1: ("c", None, "curated", None), 2: ("b", "new", "curated", [2.0]), 9: (None, None, "curated", None)}
    got = {r["change_id"]: (r["outcome"], r["before"] and r["before"]["name"], r["after"] and (r["after"]["name"], r["after"]["vector"])) for r in done.collect()}
    assert got == {1: ("updated", "a", (None, None)), 2: ("updated", "b", ("b", [2.0])), 3: ("deleted", None, None), 4: ("missing", None, None), 5: ("created", None, ("c", None)), 6: ("duplicate", "c", ("c", None)), 7: ("updated", "c", ("c", None)), 8: ("missing", None, None), 9: ("created", None, (None, None))}


def test_trajectories_against_expectations(spark):
    import json

    from cairn.operators import trajectories

    def within(wanted, actual):
        return all(k in actual and within(v, actual[k]) for k, v in wanted.items()) if isinstance(wanted, dict) and isinstance(actual, dict) else wanted == actual

    steps = [
        (1, 1, "find", {"near": {"lat": 1.5, "lon": 2}, "k": 3}, {"ok": True, "ids": [1, 2]}, None), (1, 2, "plan", {"ids": [1, 2]}, {"ok": False}, "no_route"),
        (1, 3, "plan", {"ids": [2]}, {"ok": True}, None), (1, 4, "submit_plan", {}, None, None), (2, 1, "find", {"near": None}, None, None),
    ]
    expect = [
        (1, ["find", "plan", "plan", "submit_plan"], 3, {"find": {"near": {"lat": 1.5}}, "plan": {"ids": [2]}}, {"plan": {"ok": False}, "find": {"ids": [1]}}, {"plan": "no_route"}, True, ["done"]),
        (2, ["find", "plan"], 0, {"find": {"near": {"lat": 1}}, "plan": {}}, {"find": {"a": 1}}, {"find": "x"}, True, None),
        (3, ["find"], 0, {}, None, None, False, ["done"]),
        (4, None, None, None, None, None, None, None),
    ]
    text_of = lambda m: m and {k: json.dumps(v) for k, v in m.items()}
    df = spark.createDataFrame([(c, s, n, json.dumps(a), r and json.dumps(r), e) for c, s, n, a, r, e in steps], "case_id int, seq int, name string, args string, result string, error string")
    asked = spark.createDataFrame([(c, t, m, text_of(a), text_of(r), e, s, st) for c, t, m, a, r, e, s, st in expect], "case_id int, tools array<string>, max_calls int, args map<string,string>, results map<string,string>, errors map<string,string>, submitted boolean, status array<string>")
    runs = spark.createDataFrame([(1, True, "done"), (2, False, None)], "case_id int, submitted boolean, status string")
    checks = trajectories.checked(df, runs, asked)
    ends, want = {1: (True, "done"), 2: (False, None)}, {}
    for c, tools, most, args, results, errors, submitted, status in expect:
        own = [s for s in steps if s[0] == c]
        first = lambda tool, own=own: next((s for s in own if s[2] == tool), None)
        if tools is not None:
            want[c, "tools"] = [s[2] for s in own] == tools
        if most is not None:
            want[c, "max_tool_calls"] = sum(s[2] != "submit_plan" for s in own) <= most
        want |= {(c, f"args:{t}"): any(s[2] == t and within(a, s[3]) for s in own) for t, a in (args or {}).items()}
        want |= {(c, f"result:{t}"): first(t) is not None and within(a, first(t)[4]) for t, a in (results or {}).items()}
        want |= {(c, f"error:{t}"): first(t) is not None and first(t)[5] == a for t, a in (errors or {}).items()}
        if submitted is not None:
            want[c, "submitted"] = ends.get(c, (False, None))[0] == submitted
        if status is not None:
            want[c, "status"] = ends.get(c, (False, None))[1] in status
    assert {(r["case_id"], r["name"]): r["ok"] for r in checks.collect()} == want
    failed = {r["case_id"]: (r["passed"], r["failed"]) for r in trajectories.verdicts(checks).collect()}
    assert failed == {c: (all(ok for (k, _), ok in want.items() if k == c), sorted(n for (k, n), ok in want.items() if k == c and not ok)) for c in (1, 2, 3)}


def test_encoded_lines_hold_all_lines_of_a_batch(spark):
    """The format's own example, odd rows, and digits beyond seven groups; one pass over Arrow batches, not a step a character."""
    line = "array<struct<lon:double,lat:double>>"
    own = [(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)]
    rows = spark.createDataFrame([(1, own), (2, []), (3, None), (4, [(179.999999999, -89.000000001)]), (5, [(0.0, 0.0), (0.0, 0.0)]), (6, [(1.0, None), (2.0, 2.0), (3.0, 3.0), (4.0, 5.0)])], f"k long, line {line}").coalesce(1)
    texts = {r["k"]: r["t"] for r in rows.select("k", geo.encode_line(F.col("line"), 5).alias("t")).collect()}
    assert texts[1] == "_p~iF~ps|U_ulLnnqC_mqNvxq`@" and texts[2] == texts[3] == "" and texts[5] == "????"
    back = rows.where("k < 6").select("k", geo.decode_line(geo.encode_line(F.col("line"), 9), 9).alias("line"))
    assert "ArrowEvalPython" in back._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: [tuple(p) for p in r["line"]] for r in back.collect()}
    assert got == {1: own, 2: [], 3: [], 4: [(179.999999999, -89.000000001)], 5: [(0.0, 0.0)] * 2}
    cut = spark.createDataFrame([(1, "_p~iF~ps|U_ulL"), (2, "_p~iF~ps|U_ulLnnq"), (3, None), (4, ""), (5, "_"), (6, "??")], "k long, t string").coalesce(1)
    got = {r["k"]: r["line"] and [tuple(p) for p in r["line"]] for r in cut.select("k", geo.decode_line(F.col("t"), 5).alias("line")).collect()}
    assert got == {1: [(-120.2, 38.5)], 2: [(-120.2, 38.5)], 3: None, 4: [], 5: [], 6: [(0.0, 0.0)]}


def test_cases_of_as_many_stops_are_matched_at_once(spark, monkeypatch):
    """Against plain code: equal spots, missing coordinates, cases without reference or answer; cells of few cases and of many."""
    ways, by_group = [], measures.by_group
    monkeypatch.setattr(measures, "by_group", lambda *a, **kw: ways.append(kw.get("stacked", False)) or by_group(*a, **kw))
    r, kind = random.Random(5), "route_id long, ordinal int, lat double, lon double"
    spots = [(53.0 + r.random() * 0.05, 24.0 + r.random() * 0.05) for _ in range(25)]
    spot = lambda: (None, 24.0) if r.random() < 0.05 else r.choice(spots)
    asked, given = ({k: [spot() for _ in range(r.randint(0, 5))] for k in range(150)} for _ in range(2))
    asked[150], given[150] = [spot() for _ in range(70)], [spot() for _ in range(90)]
    frame = lambda own: spark.createDataFrame([(k, i + 1, *p) for k, ps in own.items() for i, p in enumerate(ps)], kind)
    want = {}
    for k, own in asked.items():
        free = list(range(len(given[k])))
        for i, p in enumerate(own):
            near = [j for j in free if None not in (*p, *given[k][j]) and metres(p, given[k][j]) <= 1500]
            best = min(near, key=lambda j: (round(metres(p, given[k][j]), 6), j), default=None)
            want[k, i + 1] = None if best is None else best + 1
            free = [j for j in free if j != best]
    for cells in (1 << 20, 40):
        monkeypatch.setattr(measures, "CELLS", cells)
        got = measures.greedy_matches(frame(asked), frame(given), key="route_id", metres=1500.0).collect()
        assert {(x["route_id"], x["ordinal"]): x["matched"] for x in got} == want
        assert all((x["metres"] is None) == (x["matched"] is None) for x in got)
    assert ways == [True, True]
