"""Geometry scalars (GEO, CLI) and calendar, prices (DAT, PRC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import views
from ..functions import calendar, geo
from ..operators.groups import dealt
from ..operators.staging import small_side
from .registry import query

ROUTE = "area-0"


@query(views.sql(f"""SELECT s.service_id, t.service_id AS other, round({views.haversine_sql("s.lat", "s.lon", "t.lat", "t.lon")}, 2) AS great_circle,
  round(CAST(111194.92664455873 AS DOUBLE) * sqrt(pow((t.lon - s.lon) * cos(radians((s.lat + t.lat) / 2)), 2) + pow(t.lat - s.lat, 2)), 2) AS planar
FROM services s JOIN services t ON t.service_id = s.service_id + 1""", "services"))
def geo_01_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.services(spark, sf_dir).select("service_id", "lat", "lon")
    t = s.select((F.col("service_id") - 1).alias("service_id"), F.col("service_id").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    ends = (F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return s.join(t, "service_id").select("service_id", "other", F.round(geo.haversine_m(*ends), 2).alias("great_circle"), F.round(geo.equirect_m(*ends), 2).alias("planar"))


@query(views.sql(f"""SELECT p.place_id, a.code, {views.in_area_sql("p.lat", "p.lon", "a")} AS inside FROM places p, areas a WHERE a.rings IS NOT NULL""", "places", "areas"))
def geo_02_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place against the few areas that have a polygon; holes count as outside."""
    p, a = views.places(spark, sf_dir).select("place_id", "lat", "lon"), views.areas(spark, sf_dir).where("rings is not null").select("code", "rings", "holes")
    return p.join(small_side(a), F.lit(True)).select("place_id", "code", geo.in_polygon(F.col("lat"), F.col("lon"), F.col("rings"), F.col("holes")).alias("inside"))


RING_TEXT = "'(' || array_to_string(list_transform(list_append({r}, {r}[1]), lambda p: printf('%.4f %.4f', p.lon, p.lat)), ', ') || ')'"
SHELL_TEXT = f"""SELECT code, n, '(' || {RING_TEXT.format(r="shell")} || coalesce((SELECT string_agg(', ' || {RING_TEXT.format(r="hole")}, '' ORDER BY k) FROM (SELECT unnest(holes) AS hole, generate_subscripts(holes, 1) AS k) WHERE {views.in_ring_sql("hole[1].lat", "hole[1].lon", "shell")}), '') || ')' AS part
  FROM (SELECT code, holes, unnest(rings) AS shell, generate_subscripts(rings, 1) AS n FROM areas WHERE rings IS NOT NULL)"""


@query(views.sql(f"SELECT code, 'MULTIPOLYGON (' || string_agg(part, ', ' ORDER BY n) || ')' AS wkt FROM ({SHELL_TEXT}) GROUP BY code", "areas"))
def geo_03_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas as well-known text, each hole in the shell that holds it."""
    return views.areas(spark, sf_dir).where("rings is not null").select("code", geo.as_wkt(F.col("rings"), F.col("holes")).alias("wkt"))


SEG = """SELECT service_id, round(CAST(111194.92664455873 AS DOUBLE) * sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)), 2) AS metres, round(t, 6) AS along FROM (
  SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), -(ax * dx + ay * dy) / (dx * dx + dy * dy))) ELSE CAST(0 AS DOUBLE) END AS t FROM (
    SELECT service_id, (CAST(24.0 AS DOUBLE) - lon) * cos(radians(lat)) AS ax, CAST(53.2 AS DOUBLE) - lat AS ay, (CAST(25.5 AS DOUBLE) - CAST(24.0 AS DOUBLE)) * cos(radians(lat)) AS dx, CAST(54.1 AS DOUBLE) - CAST(53.2 AS DOUBLE) AS dy FROM services))"""


@query(views.sql(SEG, "services"))
def geo_04_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to one segment, and how far along it the nearest point lies."""
    hit = geo.segment_m(F.col("lat"), F.col("lon"), (F.lit(53.2), F.lit(24.0)), (F.lit(54.1), F.lit(25.5)))
    return views.services(spark, sf_dir).select("service_id", F.round(hit["metres"], 2).alias("metres"), F.round(hit["along"], 6).alias("along"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * 100 / (4.0 / 3.6), 3) AS foot, round(l_quantity * 100 / (15.0 / 3.6), 3) AS bicycle, round(l_quantity * 100 / (45.0 / 3.6), 3) AS car FROM lineitem")
def geo_05_leg_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("l_quantity") * 100
    return views.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(F.round(geo.leg_seconds(m, p), 3).alias(p) for p in geo.SPEEDS))


@query(views.sql("SELECT CAST(floor((lat - CAST(53.7 AS DOUBLE)) / CAST(0.004 AS DOUBLE)) AS INTEGER) AS cy, CAST(floor((lon - CAST(25.0 AS DOUBLE)) / CAST(0.004 AS DOUBLE)) AS INTEGER) AS cx, count(*) AS n FROM places GROUP BY 1, 2", "places"))
def geo_06_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid cells, on both sides of zero."""
    own = geo.cell(F.col("lat") - F.lit(53.7), F.col("lon") - F.lit(25.0), 0.004)
    return views.places(spark, sf_dir).select(own.alias("c")).groupBy("c.cy", "c.cx").agg(F.count("*").alias("n"))


@query(views.sql("SELECT route_id, ordinal, round(lon, 6) AS lon, round(lat, 6) AS lat FROM stops", "stops"))
def geo_08_encoded_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks as encoded lines and back: what is decoded is what was encoded, to six digits."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "lon", "lat"))), lambda s: F.struct(s["lon"].alias("lon"), s["lat"].alias("lat")))
    coded = dealt(views.stops(spark, sf_dir), "route_id").groupBy("route_id").agg(line.alias("line")).select("route_id", geo.encode_line(F.col("line")).alias("text"))
    back = coded.select("route_id", F.posexplode(geo.decode_line(F.col("text"))).alias("k", "p"))
    return back.select("route_id", (F.col("k") + 1).alias("ordinal"), F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@query(views.sql("SELECT category, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, round((min(lat) + max(lat)) / 2, 6) AS mid_lat, round((min(lon) + max(lon)) / 2, 6) AS mid_lon FROM places GROUP BY category", "places"))
def geo_09_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroid and centre of the bounding box (also CLI-05)."""
    mid = lambda c: F.round((F.min(c) + F.max(c)) / 2, 6)
    return views.places(spark, sf_dir).groupBy("category").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"), mid("lat").alias("mid_lat"), mid("lon").alias("mid_lon"))


@query(views.sql("SELECT route_id, count(*) >= 2 AS usable FROM stops GROUP BY route_id", "stops"))
def geo_10_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = views.stops(spark, sf_dir).groupBy("route_id").agg(F.collect_list(F.struct("lon", "lat")).alias("line"))
    return line.select("route_id", (F.size("line") >= 2).alias("usable"))


@query(views.sql("""SELECT service_id, other, round(CASE WHEN d < 0 THEN d + 360 ELSE d END, 6) AS heading FROM (
  SELECT s.service_id, t.service_id AS other, degrees(atan2((t.lon - s.lon) * cos(radians(s.lat)), t.lat - s.lat)) AS d FROM services s JOIN services t ON t.service_id = s.service_id + 1)""", "services"))
def geo_11_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.services(spark, sf_dir).select("service_id", "lat", "lon")
    t = s.select((F.col("service_id") - 1).alias("service_id"), F.col("service_id").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return s.join(t, "service_id").select("service_id", "other", F.round(geo.heading(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 6).alias("heading"))


DAY_NUMBERS = "map {" + ", ".join(f"'{d}': {i}" for i, d in enumerate(calendar.DAYS[0])) + "}"
WINDOWS_SQL = f""", rules AS (
  SELECT DISTINCT opening_hours, unnest(string_split(opening_hours, ';')) AS rule FROM places WHERE opening_hours <> '24/7'
), parsed AS (
  SELECT opening_hours, rule, regexp_matches(rule, '^\\s*[a-z, -]+\\s+\\d{{1,2}}:\\d{{2}}-\\d{{1,2}}:\\d{{2}}\\s*$') AS sound, trim(regexp_extract(rule, '^\\s*([a-z, -]+?)\\s+\\d', 1)) AS days,
    TRY_CAST(regexp_extract(rule, '(\\d{{1,2}}):\\d{{2}}-', 1) AS INTEGER) * 60 + TRY_CAST(regexp_extract(rule, '\\d{{1,2}}:(\\d{{2}})-', 1) AS INTEGER) AS start,
    TRY_CAST(regexp_extract(rule, '-(\\d{{1,2}}):', 1) AS INTEGER) * 60 + TRY_CAST(regexp_extract(rule, '-\\d{{1,2}}:(\\d{{2}})', 1) AS INTEGER) AS stop FROM rules
), spans AS (
  SELECT opening_hours, start, stop, {DAY_NUMBERS}[string_split(trim(d), '-')[1]] AS a, {DAY_NUMBERS}[string_split(trim(d), '-')[-1]] AS b
  FROM (SELECT *, unnest(string_split(days, ',')) AS d FROM parsed WHERE opening_hours NOT IN (SELECT opening_hours FROM parsed WHERE NOT sound))
), windows AS (
  SELECT opening_hours, (a + k) % 7 AS day, start, stop FROM (SELECT *, unnest(range(0, (b - a + 7) % 7 + 1)) AS k FROM spans)
  UNION ALL SELECT '24/7', unnest(range(0, 7)), 0, 1440
)"""


@query(views.sql(WINDOWS_SQL + " SELECT place_id, CAST(day AS INTEGER) AS day, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM places JOIN windows USING (opening_hours)", "places"))
def dat_01_opening_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.places(spark, sf_dir)
    p = p.join(calendar.parsed_hours(p, "opening_hours"), "opening_hours").select("place_id", F.explode("windows").alias("w"))
    return p.select("place_id", "w.day", "w.start", "w.stop")


OPEN_SQL = """(start + day * 1440 <= {m} AND {m} < day * 1440 + stop + CASE WHEN stop <= start THEN 1440 ELSE 0 END) OR (start + day * 1440 <= {m} + 10080 AND {m} + 10080 < day * 1440 + stop + CASE WHEN stop <= start THEN 1440 ELSE 0 END)"""


@query(views.sql(WINDOWS_SQL + f""" SELECT place_id, minute, bool_or({OPEN_SQL.format(m="minute")}) AS open FROM (SELECT place_id, opening_hours, CAST(place_id * 61 % 10080 AS INTEGER) AS minute FROM places) LEFT JOIN windows USING (opening_hours) GROUP BY place_id, minute""", "places"))
def dat_02_open_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, closed or unknown at a minute of the week; windows go over midnight and the week's end."""
    minute = (F.col("place_id") * 61 % 10080).cast("int")
    p = views.places(spark, sf_dir)
    return p.join(calendar.parsed_hours(p, "opening_hours"), "opening_hours", "left").select("place_id", minute.alias("minute"), calendar.open_at(F.col("windows"), minute).alias("open"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('second', ts) - INTERVAL 3 HOUR ELSE date_trunc('second', ts) END AS moment FROM events")
def dat_03_moment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time without a zone is local, three hours ahead; one with a zone is itself."""
    said = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "").otherwise("Z"))
    return views.read(spark, sf_dir, "events").select("event_id", calendar.moment(said).cast("timestamp_ntz").alias("moment"))


@query(views.sql("""SELECT place_id, CASE WHEN place_id % 9 = 0 THEN true WHEN place_id % 11 = 0 THEN false WHEN contains(ticket, 'free') THEN true WHEN contains(ticket, 'paid') THEN false WHEN regexp_matches(ticket, '\\d') THEN false END AS free FROM places""", "places"))
def prc_01_free_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    fee = F.when(F.col("place_id") % 9 == 0, "no").when(F.col("place_id") % 11 == 0, "yes")
    return views.places(spark, sf_dir).select("place_id", calendar.free_entry(fee, F.col("ticket")).alias("free"))


@query(views.sql("SELECT place_id, CASE WHEN place_id % 2 = 0 AND ticket <> '' THEN ticket ELSE town END AS said FROM places", "places"))
def prc_02_ticket_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("place_id") % 2 == 0, F.col("ticket")).otherwise(" — ")
    return views.places(spark, sf_dir).select("place_id", calendar.ticket_text(first, F.col("town")).alias("said"))


@query(views.sql(WINDOWS_SQL + f""", asked AS (SELECT event_id, CAST((isodow(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts) AS INTEGER) AS m FROM events WHERE kind_ok), held AS (
  SELECT DISTINCT opening_hours, day, start, stop FROM windows)
SELECT opening_hours, count(DISTINCT event_id) AS n FROM held JOIN asked ON {OPEN_SQL.format(m="m")} GROUP BY opening_hours""".replace("WHERE kind_ok", "WHERE event_type = 'purchase'"), "places"))
def open_01_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many purchases fall into each kind of opening hours: moments by minute of the week, windows spread over theirs."""
    kinds = views.places(spark, sf_dir).select("opening_hours").distinct().select("opening_hours", F.explode(calendar.opening_windows(F.col("opening_hours"))).alias("w"))
    start = F.col("w.day") * 1440 + F.col("w.start")
    length = F.when(F.col("w.stop") <= F.col("w.start"), F.col("w.stop") + 1440).otherwise(F.col("w.stop")) - F.col("w.start")
    hours = kinds.select("opening_hours", start.alias("a"), length.alias("n")).select("opening_hours", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"), "a").select("opening_hours", ((F.col("a") + F.col("k")) % calendar.WEEK).alias("minute")).distinct()
    asked = views.read(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(calendar.minute_of_week(F.col("ts")).alias("minute")).agg(F.count("*").alias("n"))
    return asked.join(hours, "minute").groupBy("opening_hours").agg(F.sum("n").alias("n"))


#: Where the walker of each walk stands: aside of its first leg (one in three far off it), or at its first stop.
AT = """, line AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, count(*) OVER (PARTITION BY route_id) AS n FROM stops WINDOW w AS (PARTITION BY route_id ORDER BY ordinal)),
stood AS (SELECT route_id, CASE WHEN route_id % 3 = 0 THEN lat ELSE lat + (lat2 - lat) * CAST(0.3 AS DOUBLE) + CASE WHEN route_id % 3 = 1 THEN CAST(0.001 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END END AS p,
  CASE WHEN route_id % 3 = 0 THEN lon ELSE lon + (lon2 - lon) * CAST(0.3 AS DOUBLE) END AS q FROM line WHERE ordinal = 1 AND lat2 IS NOT NULL),
foot AS (SELECT l.*, p, q, CASE WHEN pow(lon2 - lon, 2) + pow(lat2 - lat, 2) > 0 THEN least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), ((q - lon) * (lon2 - lon) + (p - lat) * (lat2 - lat)) / (pow(lon2 - lon, 2) + pow(lat2 - lat, 2)))) ELSE CAST(0 AS DOUBLE) END AS t FROM line l JOIN stood USING (route_id) WHERE lat2 IS NOT NULL)"""


def walk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """route_id, line, p, q: walks as lines, and where their walkers stand."""
    r = F.col("route_id")
    own = views.stops(spark, sf_dir).groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "lon", "lat"))).alias("s"))
    own = own.select("route_id", F.transform("s", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("line")).where(F.size("line") > 1)
    a, b = F.element_at("line", 1), F.element_at("line", 2)
    aside = F.when(r % 3 == 1, 0.001).otherwise(1.0)
    p = F.when(r % 3 == 0, a["lat"]).otherwise(a["lat"] + (b["lat"] - a["lat"]) * F.lit(0.3) + aside)
    q = F.when(r % 3 == 0, a["lon"]).otherwise(a["lon"] + (b["lon"] - a["lon"]) * F.lit(0.3))
    return own.select("route_id", "line", p.alias("p"), q.alias("q"))


@query(views.sql(AT + f""", far AS (SELECT *, {views.haversine_sql("p", "q", "lat + (lat2 - lat) * t", "lon + (lon2 - lon) * t")} AS off, {views.haversine_sql("lat", "lon", "lat2", "lon2")} AS m FROM foot),
run AS (SELECT *, sum(m) OVER (PARTITION BY route_id ORDER BY ordinal) - m + m * t AS along, sum(m) OVER (PARTITION BY route_id) AS total FROM far),
best AS (SELECT *, {views.haversine_sql("lat", "lon", "lat + (lat2 - lat) * t", "lon + (lon2 - lon) * t")} < 0.5 AS at_a, {views.haversine_sql("lat2", "lon2", "lat + (lat2 - lat) * t", "lon + (lon2 - lon) * t")} < 0.5 AS at_b FROM run QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY off, ordinal) = 1)
SELECT route_id, CASE WHEN off <= 500 THEN CAST(ordinal + CASE WHEN at_a THEN 0 ELSE 1 END AS INTEGER) END AS walked, CASE WHEN off <= 500 THEN CAST(n - ordinal + CASE WHEN at_b THEN 0 ELSE 1 END AS INTEGER) END AS remaining,
  CASE WHEN off <= 500 THEN round(along, 1) END AS travelled, CASE WHEN off <= 500 THEN round(total - along, 1) END AS left_m, CASE WHEN off <= 500 THEN round(lat + (lat2 - lat) * t, 6) END AS cut_lat FROM best""", "stops"))
def cli_01_split_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks cut where their walkers stand: points of either part, metres walked and left; nothing beyond 500 m."""
    own = walk_lines(spark, sf_dir).select("route_id", geo.split_at(F.col("line"), F.col("p"), F.col("q")).alias("cut"))
    size = lambda c: F.when(F.col("cut").isNotNull(), F.size(c))
    return own.select("route_id", size("cut.walked").alias("walked"), size("cut.remaining").alias("remaining"), F.round("cut.travelled", 1).alias("travelled"), F.round(F.col("cut.total") - F.col("cut.travelled"), 1).alias("left_m"), F.round(F.element_at("cut.walked", -1)["lat"], 6).alias("cut_lat"))


@query(views.sql(AT + f""", far AS (SELECT *, pow(lon + (lon2 - lon) * t - q, 2) + pow(lat + (lat2 - lat) * t - p, 2) AS off, sqrt(pow(lon2 - lon, 2) + pow(lat2 - lat, 2)) AS d, {views.haversine_sql("lat", "lon", "lat2", "lon2")} AS m FROM foot),
run AS (SELECT *, (sum(d) OVER (PARTITION BY route_id ORDER BY ordinal) - d + d * t) / nullif(sum(d) OVER (PARTITION BY route_id), 0) AS share, sum(m) OVER (PARTITION BY route_id) AS metres FROM far)
SELECT route_id, round(coalesce(share, 0), 9) AS share, round(metres, 1) AS metres FROM run QUALIFY row_number() OVER (PARTITION BY route_id ORDER BY off, ordinal) = 1""", "stops"))
def geo_07_share_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far along its walk a walker stands, and the walk's length."""
    own = walk_lines(spark, sf_dir)
    return own.select("route_id", F.round(geo.share_along(F.col("line"), F.col("p"), F.col("q")), 9).alias("share"), F.round(geo.line_metres(F.col("line")), 1).alias("metres"))


@query(views.sql("SELECT route_id, array_to_string(list_sort(list(place_id)), '-') AS key FROM stops GROUP BY route_id", "stops"))
def cli_10_route_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key that doesn't depend on the order of the stops."""
    return views.stops(spark, sf_dir).groupBy("route_id").agg(F.array_join(F.array_sort(F.collect_list("place_id")), "-").alias("key"))


@query(views.sql("""SELECT route_id, bool_and(abs(lat - lat2) <= CAST(1e-6 AS DOUBLE) AND abs(lon - lon2) <= CAST(1e-6 AS DOUBLE)) AS same FROM (
  SELECT route_id, lat, lon, lat + CASE WHEN route_id % 3 = 0 AND ordinal = 1 THEN CAST(0.00001 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS lat2, lon AS lon2 FROM stops) GROUP BY route_id""", "stops"))
def cli_03_same_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of stops, place by place within a millionth of a degree."""
    moved = F.col("lat") + F.when((F.col("route_id") % 3 == 0) & (F.col("ordinal") == 1), 0.00001).otherwise(0.0)
    s = views.stops(spark, sf_dir)
    line = lambda y: F.array_sort(F.collect_list(F.struct("ordinal", y.alias("lat"), "lon")))
    both = s.groupBy("route_id").agg(line(F.col("lat")).alias("a"), line(moved).alias("b"))
    near = lambda x, y: (F.abs(x["lat"] - y["lat"]) <= 1e-6) & (F.abs(x["lon"] - y["lon"]) <= 1e-6)
    return both.select("route_id", ((F.size("a") == F.size("b")) & F.forall(F.zip_with("a", "b", near), lambda t: t)).alias("same"))


@query(views.sql("SELECT route_id, count(*) AS n FROM (SELECT route_id, CASE WHEN ordinal % 4 = 0 THEN CAST('NaN' AS DOUBLE) ELSE lat END AS lat, CASE WHEN ordinal % 5 = 0 THEN NULL ELSE lon END AS lon FROM stops) WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon) GROUP BY route_id", "stops"))
def cli_04_finite_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.stops(spark, sf_dir).withColumn("lat", F.when(F.col("ordinal") % 4 == 0, float("nan")).otherwise(F.col("lat"))).withColumn("lon", F.when(F.col("ordinal") % 5 != 0, F.col("lon")))
    line = s.groupBy("route_id").agg(F.collect_list(F.struct("lon", "lat")).alias("line"))
    fine = F.filter("line", lambda p: p["lat"].isNotNull() & p["lon"].isNotNull() & ~F.isnan(p["lat"]) & ~F.isnan(p["lon"]))
    return line.select("route_id", F.size(fine).cast("long").alias("n")).where("n > 0")


@query(views.sql("SELECT route_id, first(lat ORDER BY ordinal) AS x, first(lon ORDER BY ordinal) AS y FROM stops GROUP BY route_id", "stops"))
def cli_09_swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = views.stops(spark, sf_dir).groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "lon", "lat"))).alias("line"))
    swapped = F.transform("line", lambda p: F.struct(p["lat"].alias("x"), p["lon"].alias("y")))
    return line.select("route_id", F.element_at(swapped, 1).alias("p")).select("route_id", "p.x", "p.y")
