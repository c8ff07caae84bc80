"""Entity rules against plain code that states them one row at a time."""

from __future__ import annotations

import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_solvers import metres

from cairn import views
from cairn.operators import resolve
from cairn.queries import QUERIES
from cairn.queries.spatial import _pairs

PROTECTED = ("curated", "dataset", "manual")
KIND = "place_id long, name string, category string, lat double, lon double, owner string, source_url string, blurb string, visit_minutes int"


def norm(name):
    return re.sub("[^0-9a-zа-яёіў]+", " ", unicodedata.normalize("NFKC", name or "").lower()).strip()


def gap(a, b):
    return metres((a["lat"], a["lon"]), (b["lat"], b["lon"]))


def placed(r):
    return r["lat"] is not None and r["lon"] is not None


def plain_shadowed(rows, aliases, radius):
    out = {}
    answers = {r["place_id"]: {norm(r["name"]), *(norm(a) for i, a in aliases if i == r["place_id"])} - {""} for r in rows}
    for r in rows:
        if r["owner"] in PROTECTED or not norm(r["name"]) or not placed(r):
            continue
        near = [(gap(r, k), k["place_id"]) for k in rows if k["owner"] in PROTECTED and placed(k) and norm(r["name"]) in answers[k["place_id"]]]
        near = [x for x in near if x[0] < radius]
        if near:
            out[r["place_id"]] = min(near)[1]
    return out


def plain_twins(rows, radius, telling):
    out, buckets = {}, {}
    for r in sorted(rows, key=lambda r: r["place_id"]):
        if r["owner"] == "auto" and norm(r["name"]) and placed(r):
            buckets.setdefault((norm(r["name"]), r["category"] or ""), []).append(r)
    for own in buckets.values():
        while own:
            group = [r for r in own if r is own[0] or gap(own[0], r) < radius]
            own = [r for r in own if r not in group]
            best = max(group, key=lambda r: (sum(bool(r.get(f)) for f in telling), -r["place_id"]))
            out |= {r["place_id"]: best["place_id"] for r in group if r is not best}
    return out


def plain_collapsed(rows, aliases, pairs, shadow_m, twin_m, telling):
    out = {i: (k, "shadowed") for i, k in plain_shadowed(rows, aliases, shadow_m).items()}
    left = [r for r in rows if r["place_id"] not in out]
    out |= {i: (k, "twin") for i, k in plain_twins(left, twin_m, telling).items()}
    at = {r["source_url"]: r for r in sorted(left, key=lambda r: r["place_id"]) if r["place_id"] not in out}
    for keep, drop in pairs:
        if keep in at and drop in at and at[drop]["owner"] not in PROTECTED:
            i = at[drop]["place_id"]
            out[i] = (min(at[keep]["place_id"], out.get(i, (at[keep]["place_id"],))[0]), "declared")
    return out


def plain_named(asked, rows, spread):
    n = asked.lower()
    rows = sorted(rows, key=lambda r: (r["owner"] not in ("dataset", "manual"), r["place_id"]))
    low = [(r["name"] or "").lower() for r in rows]
    same = [r for r, name in zip(rows, low, strict=True) if name.strip() == n]
    if same:
        if same[0]["owner"] in ("dataset", "manual") or max(gap(a, b) for a in same for b in same) <= spread:
            return same[0]["place_id"], "exact"
        return None, "ambiguous"
    held = [r for r, name in zip(rows, low, strict=True) if n in name]
    if len(held) == 1:
        return held[0]["place_id"], "contains"
    short = n.replace("бывший", "").replace("в гродно", "").strip()
    held = [r for r, name in zip(rows, low, strict=True) if short in name]
    return (held[0]["place_id"], "fuzzy") if held else (None, "none")


@pytest.fixture(scope="module")
def rows():
    """Places metres apart, in few names, with what the rules tell apart."""
    rng = random.Random(5)
    names = ["Old Mill", "old  mill!", "OLD MILL", "Ёлка", "ёлка", "ﬁne  Café", "fine cafe", "йод", "Йод", "«»", "", None]
    out = []
    for i in range(300):
        y, x = rng.choice([(53.5, 24.0), (53.5003, 24.0), (53.6, 24.1)])
        lat, lon = y + rng.randint(0, 6) * 3e-5, x + rng.randint(0, 4) * 3e-5
        out.append((i, rng.choice(names), rng.choice(["mill", "cafe", None]), lat if i % 37 else None, lon, rng.choice(["auto"] * 5 + ["curated", "manual", None]), f"src:{i}", rng.choice([None, "", "told"]), rng.choice([None, 0, 20])))
    return [dict(zip(re.findall(r"(\w+) \w+,?", KIND), r, strict=True)) for r in out]


def frame(spark, rows, kind=KIND):
    return spark.createDataFrame([tuple(r.values()) for r in rows], kind)


def test_shadowed_rows_answer_to_their_own_name_only(spark, rows):
    aliases = [(i, rng_name) for i, rng_name in ((3, "Mill"), (7, "old mill"), (11, "iod"), *((i, "Old-Mill") for i in range(0, 300, 6)), (5000, "x"), (8, None))]
    got = resolve.shadowed(frame(spark, rows), spark.createDataFrame(aliases, "place_id long, alias string"), metres=12.0)
    want = plain_shadowed(rows, aliases, 12.0)
    assert {r["place_id"]: r["keeper"] for r in got.collect()} == want and len(want) > 20


def test_twins_are_automatic_rows_and_the_fullest_stays(spark, rows):
    got = {r["place_id"]: r["keeper"] for r in resolve.twins(frame(spark, rows), metres=5.0).collect()}
    want = plain_twins(rows, 5.0, ("blurb", "visit_minutes"))
    owner = {r["place_id"]: r["owner"] for r in rows}
    assert got == want and len(want) > 30
    assert {owner[i] for pair in got.items() for i in pair} == {"auto"}
    # A chain of four rows 4 m apart: the second is the first's twin, the third begins a group of its own.
    step = 4 / 111_195
    chain = [dict(rows[0], place_id=i, name="Mill" if i % 2 else "mill", owner="auto", lat=53.5 + i * step, lon=24.0, blurb="told" if i == 1 else None, visit_minutes=None) for i in range(4)]
    assert {r["place_id"]: r["keeper"] for r in resolve.twins(frame(spark, chain)).collect()} == {0: 1, 3: 2}
    curated = [dict(r, owner="curated") for r in chain]
    assert resolve.twins(frame(spark, curated)).isEmpty() and resolve.twins(frame(spark, rows).limit(0)).isEmpty()


def test_suspected_duplicates_share_name_and_category(spark, rows):
    labels = ["ёлка"]
    got = {(r["a"], r["b"]): r["close"] for r in resolve.suspected_duplicates(frame(spark, rows), labels=labels, metres=20.0, close=8.0).collect()}
    ok = [r for r in rows if norm(r["name"]) and placed(r) and (r["name"] or "").split("(")[0].strip().lower() not in labels]
    want = {(a["place_id"], b["place_id"]): gap(a, b) <= 8 for a in ok for b in ok if a["place_id"] < b["place_id"] and norm(a["name"]) == norm(b["name"]) and (a["category"] or "") == (b["category"] or "") and gap(a, b) < 20}
    assert got == want and set(want.values()) == {True, False}


def test_declared_merges_refuse_protected_losers(spark):
    rows = spark.createDataFrame([(1, "a", "auto"), (2, "m", "manual"), (3, "c", "curated"), (4, "n", None), (5, "a", "curated")], "place_id long, source_url string, owner string")
    pairs = spark.createDataFrame([("a", "m"), ("a", "c"), ("m", "n"), ("m", "a"), ("x", "n"), ("a", "x")], "keep string, drop string")
    got = {(r["keep"], r["drop"]): r["verdict"] for r in resolve.declared_merges(pairs, rows).collect()}
    assert got == {("a", "m"): "refused", ("a", "c"): "refused", ("m", "n"): "merged", ("m", "a"): "refused", ("x", "n"): "stale", ("a", "x"): "stale"}


def test_rules_in_order(spark, rows):
    aliases = [(i, "Old-Mill") for i in range(0, 300, 6)]
    pairs = [(f"src:{i}", f"src:{i * 7 % 310}") for i in range(0, 300, 3)] + [("src:1", "src:1")]
    left, gone = resolve.collapsed(frame(spark, rows), spark.createDataFrame(aliases, "place_id long, alias string"), spark.createDataFrame(pairs, "keep string, drop string"), shadow_m=6.0)
    want = plain_collapsed(rows, aliases, pairs, 6.0, 5.0, ("blurb", "visit_minutes"))
    assert {r["place_id"]: (r["keeper"], r["rule"]) for r in gone.collect()} == want and {w[1] for w in want.values()} == {"shadowed", "twin", "declared"}
    kept = {r["place_id"] for r in left.collect()}
    assert kept == {r["place_id"] for r in rows} - want.keys()
    assert kept >= {r["place_id"] for r in rows if r["owner"] in PROTECTED}


def test_queries_are_the_rules(spark):
    folder = "/root/testdata/sf0.01"
    rows = [r.asDict() for r in views.places(spark, folder).collect()]
    telling = [c for c in resolve.TELLING if c in rows[0]]
    assert {r["place_id"]: r["keeper"] for r in QUERIES["j_11_twins"](spark, folder).collect()} == plain_twins(rows, 60_000.0, telling)
    aliases = [tuple(r) for r in views.aliases(spark, folder).select("place_id", "alias").collect()]
    pairs = [tuple(r) for r in _pairs(spark, folder, 4, 3).select("keep", "drop").collect()]
    want = plain_collapsed(rows, aliases, pairs, 6000.0, 9000.0, telling)
    got = {r["place_id"]: (r["keeper"], r["rule"]) for r in QUERIES["set_04_collapsed"](spark, folder).collect()}
    assert got == want and {rule for _, rule in got.values()} == {"shadowed", "twin", "declared"}


def test_chains_of_keepers_end_where_one_stays(spark):
    rng = random.Random(3)
    lost = {i: i + rng.randint(1, 3) for i in range(100) if rng.random() < 0.9} | {200: 201, 201: 202, 202: 200, 203: 200, 300: 300}

    def end(i):
        seen = set()
        while i in lost:
            if i in seen:
                return None
            seen.add(i)
            i = lost[i]
        return i

    got = resolve.final_keepers(spark.createDataFrame(list(lost.items()), "place_id long, keeper long"))
    assert {r["place_id"]: r["keeper"] for r in got.collect()} == {i: end(i) for i in lost}
    assert resolve.final_keepers(spark.createDataFrame([], "place_id long, keeper long")).isEmpty()


def test_names_in_cascade(spark):
    rng = random.Random(9)
    near, far = (53.5, 24.0), (53.6, 24.0)
    named = [("Northlighthouse", near, "auto"), ("Ring", near, "auto"), (" ring ", near, "auto"), ("Dom", near, "auto"), ("dom", far, "auto"), ("Hall", near, "auto"), ("hall", far, "auto"), ("HALL", far, "manual"), ("Старый замок", near, "auto"), ("Новый замок", far, "curated"), ("замок", far, None), ("ab", near, "auto"), (None, near, "auto"), ("x", near, "auto")]
    named += [(f"{rng.choice(['big', 'small', 'Old', 'new'])} {rng.choice(['gate', 'mill', 'tower'])} {rng.randint(1, 30)}", (53.5 + rng.random() / 100, 24.0 + rng.random() / 100), rng.choice(["auto", "auto", "dataset", "curated"])) for _ in range(200)]
    rows = [{"place_id": 1000 - i, "name": n, "lat": at[0], "lon": at[1], "owner": o} for i, (n, at, o) in enumerate(named)]
    wanted = ["lighthouse", "ring", "RING", "dom", "hall", "Бывший замок", "старый замок в Гродно", "бывший старый", "замок", "ill", "LD GATE", "te 7", "b", "zz", "бывший", "", "в гродно x", "nothing like it", "l t", *(n[0] for n in named[14:60]), *((n[0] or "")[2:9] for n in named[20:90])]
    got = resolve.named_in_cascade(spark.createDataFrame([*enumerate(wanted)], "wanted_id int, wanted string"), spark.createDataFrame([tuple(r.values()) for r in rows], "place_id long, name string, lat double, lon double, owner string"))
    want = {i: plain_named(w, rows, 2000.0) for i, w in enumerate(wanted)}
    assert {r["wanted_id"]: (r["place_id"], r["how"]) for r in got.collect()} == want
    assert want[0] == (1000, "contains") and {how for _, how in want.values()} == {"exact", "ambiguous", "contains", "fuzzy", "none"}
    none = spark.createDataFrame([], "place_id long, name string, lat double, lon double, owner string")
    assert {r["how"] for r in resolve.named_in_cascade(spark.createDataFrame([(1, "a"), (2, None)], "wanted_id int, wanted string"), none).collect()} == {"none"}


def test_a_name_that_is_asked_for_often_meets_its_rows_once(spark, monkeypatch):
    rows_of, settle = {}, resolve.settle
    monkeypatch.setattr(resolve, "settle", lambda df, name: rows_of.update({name: df.count()}) or settle(df, name))
    rows = spark.createDataFrame([(i, " Gate" if i % 2 else "gate", 53.5 + i / 1e6, 24.0, "auto") for i in range(40)], "place_id long, name string, lat double, lon double, owner string")
    wanted = spark.createDataFrame([(i, "GATE" if i % 2 else "gate") for i in range(50)], "wanted_id int, wanted string")
    assert {tuple(r) for r in resolve.named_in_cascade(wanted, rows).collect()} == {(i, 0, "exact") for i in range(50)}
    assert rows_of["same"] == 40 and rows_of["exact"] == 1


def test_the_widest_gap_of_namesakes(spark):
    """Just within and just beyond: the box doesn't tell, corners of the hull do."""
    rng = np.random.default_rng(4)
    points, want = [], set()
    for k in range(12):
        turn = rng.random(60) * 2 * math.pi
        r = 0.0088 * (1 + (k - 6) / 100) * np.where(rng.random(60) < 0.5, 1, rng.random(60))
        own = [(k, 53.5 + a, 24.0 + b) for a, b in zip((r * np.sin(turn)).tolist(), (r * np.cos(turn) / math.cos(math.radians(53.5))).tolist(), strict=True)]
        points += own + own[:5]
        if max(metres(a[1:], b[1:]) for a in own for b in own) > 1950:
            want.add(k)
    got = resolve._far_apart(spark.createDataFrame(points, "wanted_id int, lat double, lon double"), 1950.0)
    assert {r["wanted_id"] for r in got.collect()} == want and 0 < len(want) < 12


def test_names_in_compatibility_form(spark):
    df = spark.createDataFrame([(n,) for n in ("ﬁne Café", "Йод й", None, "ＡＢ①", "plain")], "n string")
    from cairn.functions import text

    assert [r[0] for r in df.select(text.answered_name(F.col("n"))).collect()] == [norm("ﬁne Café"), norm("Йод й"), None, "ab1", "plain"]


def test_shadowing_looks_near_first_and_broadcasts_no_dealt_rows(spark, monkeypatch):
    """Many keepers of one name: the first radius is small, farther keepers are still found, ties go to the smaller id."""
    from cairn.operators import spatial

    radii, join = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda left, right, metres, **kw: radii.append(metres) or join(left, right, metres, **kw))
    cols = ("place_id", "name", "lat", "lon", "owner")
    kept = [(i, "hill", 53.0 + i * 1e-4, 24.0, "curated") for i in range(300)]
    auto = [(1000, "hill", 53.0101, 24.0, "auto"), (1001, "hill", 53.00015, 24.0, "auto"), (1002, "hill", 52.99, 24.0, "auto"), (1003, "hill", 52.9, 24.0, "auto"), (1004, "dale", 53.0, 24.0, "auto")]
    rows = spark.createDataFrame(kept + auto, ", ".join(f"{c} {t}" for c, t in zip(cols, ("long", "string", "double", "double", "string"), strict=True)))
    got = resolve.shadowed(rows, spark.createDataFrame([], "place_id long, alias string"), metres=2000.0)
    assert radii[0] < 300 and radii[-1] == 2000.0
    found = {r["place_id"]: r["keeper"] for r in got.collect()}
    assert found[1000] == 101 and found[1001] in (1, 2) and found[1002] == 0 and set(found) == {1000, 1001, 1002}
    assert "Broadcast" not in spatial.radius_join(rows, rows.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), "name"), 500.0, on=("name",))._jdf.queryExecution().executedPlan().toString()
