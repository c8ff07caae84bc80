"""Geometry on columns: distances, rings, segments, cells, legs and encoded lines."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import polyline

EARTH_M = 6_371_000.0
DEGREE_M = EARTH_M * math.pi / 180
#: Travel speeds in km/h.
SPEEDS = {"foot": 4.0, "bicycle": 15.0, "car": 45.0}


def _f(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, cosines: tuple[Column, Column] | None = None) -> Column:
    """Great-circle metres; null where a coordinate is. cosines: those of the latitudes, if they are at hand."""
    cos1, cos2 = cosines or (F.cos(F.radians(lat1)), F.cos(F.radians(lat2)))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + cos1 * cos2 * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.when(a > 1.0, 1.0).otherwise(a)))


def half_up(x: Column, digits: int) -> Column:
    """x, not below zero, to so many digits; as SQL's round(), which Spark's does by way of a decimal, at some twenty times the cost."""
    return F.floor(x * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)


def equirect_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a plane at the middle latitude."""
    x = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.lit(DEGREE_M) * F.sqrt(x * x + (lat2 - lat1) * (lat2 - lat1))


def segment_m(lat: Column, lon: Column, a: tuple[Column, Column], b: tuple[Column, Column], cosine: Column | None = None) -> Column:
    """struct(metres, along): distance from a point to a segment (lat, lon ends) on the point's plane; along from 0 to 1.

    cosine: that of lat, if it is at hand.
    """
    k = F.cos(F.radians(lat)) if cosine is None else cosine
    ax, ay = (a[1] - lon) * k, a[0] - lat
    dx, dy = (b[1] - a[1]) * k, b[0] - a[0]
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / size))).otherwise(0.0)
    x, y = ax + t * dx, ay + t * dy
    return F.struct((F.lit(DEGREE_M) * F.sqrt(x * x + y * y)).alias("metres"), t.alias("along"))


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether a point lies in a ring of struct(lon, lat), by ray casting; the ring may be open or closed. Null for a null ring."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.element_at(ring, i.cast("int")), F.element_at(ring, (i % n + 1).cast("int"))
        over = (a["lat"] > lat) != (b["lat"] > lat)
        at = a["lon"] + (lat - a["lat"]) / F.when(over, b["lat"] - a["lat"]).otherwise(1.0) * (b["lon"] - a["lon"])
        return (over & (lon < at)).cast("int")

    odd = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + crosses(i)) % 2 == 1
    return F.when(ring.isNotNull() & (n > 2), odd)


def in_polygon(lat: Column, lon: Column, rings: Column, holes: Column) -> Column:
    """In one of the rings and in none of the holes; null without rings."""
    inside = F.exists(rings, lambda r: F.coalesce(in_ring(lat, lon, r), F.lit(False)))
    out = F.exists(F.coalesce(holes, F.array().cast("array<array<struct<lon:double,lat:double>>>")), lambda r: F.coalesce(in_ring(lat, lon, r), F.lit(False)))
    return inside & ~out


def as_wkt(rings: Column, holes: Column, digits: int = 4) -> Column:
    """MULTIPOLYGON text: each shell closed, with the holes whose first point it holds; null without rings."""
    point = lambda p: F.format_string(f"%.{digits}f %.{digits}f", p["lon"], p["lat"])
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(F.concat(r, F.slice(r, 1, 1)), point), ", "), F.lit(")"))
    first = lambda h: F.element_at(h, 1)
    every = F.coalesce(holes, F.array().cast("array<array<struct<lon:double,lat:double>>>"))
    own = lambda shell: F.filter(every, lambda h: F.coalesce(in_ring(first(h)["lat"], first(h)["lon"], shell), F.lit(False)))
    part = lambda shell: F.concat(F.lit("("), F.array_join(F.concat(F.array(ring(shell)), F.transform(own(shell), ring)), ", "), F.lit(")"))
    return F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(rings, part), ", "), F.lit(")"))


def ring_edges(ring: Column) -> Column:
    """Array of struct(a, b): the sides of a ring, the closing one included."""
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, i % n + 1).alias("b")))


def cell(lat: Column, lon: Column, size: float) -> Column:
    """struct(cy, cx) on a grid of so many degrees; floors on both sides of zero."""
    return F.struct(F.floor(lat / size).cast("int").alias("cy"), F.floor(lon / size).cast("int").alias("cx"))


def cells_around(lat: Column, lon: Column, size: float, reach: int = 1) -> Column:
    """The cell and its neighbours."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    own = cell(lat, lon, size)
    return F.flatten(F.transform(span, lambda dy: F.transform(span, lambda dx: F.struct((own["cy"] + dy).alias("cy"), (own["cx"] + dx).alias("cx")))))


def cells_of_segment(a: tuple[Column, Column], b: tuple[Column, Column], size: float) -> Column:
    """All cells of the box around a segment, which cover it."""
    low, high = cell(F.least(a[0], b[0]), F.least(a[1], b[1]), size), cell(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), size)
    rows = F.sequence(low["cy"], high["cy"])
    return F.flatten(F.transform(rows, lambda y: F.transform(F.sequence(low["cx"], high["cx"]), lambda x: F.struct(y.alias("cy"), x.alias("cx")))))


def leg_seconds(metres: Column, profile: Column | str = "foot") -> Column:
    """Straight-line travel time."""
    if isinstance(profile, str):
        return metres / F.lit(SPEEDS[profile] / 3.6)
    speed = F.element_at(F.create_map(*(F.lit(x) for kv in SPEEDS.items() for x in kv)), profile)
    return metres / (speed / 3.6)


def on_globe(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """The point in space, one earth's radius from its centre; straight distances there are not above those over the globe."""
    y, x = F.radians(lat), F.radians(lon)
    return F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)


def box(lat: Column, lon: Column, radius_km: Column | float) -> tuple[Column, Column]:
    """Half sides in degrees of the box around a point; longitude is not widened beyond five times."""
    r = _f(radius_km)
    return r / 111.0, r / (F.lit(111.0) * F.greatest(F.lit(0.2), F.cos(F.radians(lat))))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: A point farther from a line than this isn't on it, and one this near to a vertex is the vertex, in metres.
OFF_LINE_M = 500.0
AT_VERTEX_M = 0.5


def _legs_of(line: Column) -> Column:
    """Of an array of struct(lon, lat): struct(a, b) of each two points in a row."""
    n = F.size(line)
    return F.when(n > 1, F.zip_with(F.slice(line, F.lit(1), n - 1), F.slice(line, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast("array<struct<a:struct<lon:double,lat:double>,b:struct<lon:double,lat:double>>>"))


def line_metres(line: Column) -> Column:
    """Great-circle length of an array of struct(lon, lat); 0 for fewer than two points, null for none at all."""
    each = F.transform(_legs_of(line), lambda s: haversine_m(s["a"]["lat"], s["a"]["lon"], s["b"]["lat"], s["b"]["lon"]))
    return F.when(line.isNotNull(), F.aggregate(each, F.lit(0.0), lambda x, y: x + y))


def located(line: Column, lat: Column, lon: Column) -> Column:
    """struct(metres, leg, lat, lon, along, total): the point of a line nearest to another, and how far along it lies.

    line: array of struct(lon, lat). The foot of a leg is found on the plane of degrees, metres are great-circle ones; of
    equally near legs (from 1) the first. A line of fewer than two points, or a missing coordinate, gives null.
    """

    def foot(s: Column) -> Column:
        x, y = s["b"]["lon"] - s["a"]["lon"], s["b"]["lat"] - s["a"]["lat"]
        span = x * x + y * y
        t = F.when(span > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((lon - s["a"]["lon"]) * x + (lat - s["a"]["lat"]) * y) / span))).otherwise(0.0)
        return F.struct(t.alias("t"), (s["a"]["lat"] + y * t).alias("lat"), (s["a"]["lon"] + x * t).alias("lon"), haversine_m(s["a"]["lat"], s["a"]["lon"], s["b"]["lat"], s["b"]["lon"]).alias("length"))

    def nearest(feet: Column) -> Column:
        best = F.array_min(F.transform(feet, lambda f, i: F.struct(haversine_m(lat, lon, f["lat"], f["lon"]).alias("metres"), i.alias("i"))))
        lengths = F.transform(feet, lambda f: f["length"])
        summed = lambda own: F.aggregate(own, F.lit(0.0), lambda x, y: x + y)

        def at(b: Column) -> Column:
            f = F.get(feet, b["i"])
            return F.struct(b["metres"].alias("metres"), (b["i"] + 1).alias("leg"), f["lat"].alias("lat"), f["lon"].alias("lon"), (summed(F.slice(lengths, F.lit(1), b["i"])) + f["length"] * f["t"]).alias("along"), summed(lengths).alias("total"))

        return _once(best, at)

    ok = (F.size(line) > 1) & lat.isNotNull() & lon.isNotNull()
    return F.when(ok, _once(F.transform(_legs_of(line), foot), nearest))


def split_at(line: Column, lat: Column, lon: Column, most_m: float = OFF_LINE_M) -> Column:
    """struct(walked, remaining, travelled, total): a line cut where a point stands on it; null beyond most_m.

    Both parts hold the point of the line that is nearest; where that is a vertex (by less than half a metre), the vertex.
    """

    def near(a: Column, b: Column) -> Column:
        return haversine_m(a["lat"], a["lon"], b["lat"], b["lon"]) < AT_VERTEX_M

    def cut(at: Column) -> Column:
        point = F.array(F.struct(at["lon"].alias("lon"), at["lat"].alias("lat")))
        before, after = F.slice(line, F.lit(1), at["leg"]), F.slice(line, at["leg"] + 1, F.size(line))
        walked = F.when(near(at, F.element_at(before, -1)), before).otherwise(F.concat(before, point))
        remaining = F.when(near(at, F.element_at(after, 1)), after).otherwise(F.concat(point, after))
        return F.when(at["metres"] <= most_m, F.struct(walked.alias("walked"), remaining.alias("remaining"), at["along"].alias("travelled"), at["total"].alias("total")))

    return _once(located(line, lat, lon), cut)


def share_along(line: Column, lat: Column, lon: Column) -> Column:
    """From 0 to 1, how far along a line the point nearest to another lies, all on the plane of degrees; 0 on a line without length."""
    flat = lambda s: F.sqrt(F.pow(s["b"]["lon"] - s["a"]["lon"], 2) + F.pow(s["b"]["lat"] - s["a"]["lat"], 2))

    def foot(s: Column) -> Column:
        x, y = s["b"]["lon"] - s["a"]["lon"], s["b"]["lat"] - s["a"]["lat"]
        span = x * x + y * y
        t = F.when(span > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((lon - s["a"]["lon"]) * x + (lat - s["a"]["lat"]) * y) / span))).otherwise(0.0)
        off = F.pow(s["a"]["lon"] + x * t - lon, 2) + F.pow(s["a"]["lat"] + y * t - lat, 2)
        return F.struct(off.alias("off"), t.alias("t"), flat(s).alias("length"))

    def along(feet: Column) -> Column:
        lengths = F.transform(feet, lambda f: f["length"])
        total = F.aggregate(lengths, F.lit(0.0), lambda x, y: x + y)
        best = F.array_min(F.transform(feet, lambda f, i: F.struct(f["off"].alias("off"), i.alias("i"))))
        upto = lambda b: F.aggregate(F.slice(lengths, F.lit(1), b["i"]), F.lit(0.0), lambda x, y: x + y) + F.get(feet, b["i"])["length"] * F.get(feet, b["i"])["t"]
        return F.when(total > 0, _once(best, upto) / total).otherwise(0.0)

    ok = (F.size(line) > 1) & lat.isNotNull() & lon.isNotNull()
    return F.when(ok, _once(F.transform(_legs_of(line), foot), along))


def encode_line(points: Column, digits: int = 6) -> Column:
    """Polyline text of an array of struct(lon, lat)."""

    @F.arrow_udf("string")
    def run(lines: pa.Array) -> pa.Array:
        return polyline.encoded(lines, digits)

    return run(points)


def decode_line(text: Column, digits: int = 6) -> Column:
    """Array of struct(lon, lat) from polyline text."""

    @F.arrow_udf("array<struct<lon:double,lat:double>>")
    def run(texts: pa.Array) -> pa.Array:
        return polyline.decoded(texts, digits)

    return run(text)


def heading(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees clockwise from north, from 0 up to 360."""
    return F.pmod(F.degrees(F.atan2((lon2 - lon1) * F.cos(F.radians(lat1)), lat2 - lat1)), F.lit(360.0))
