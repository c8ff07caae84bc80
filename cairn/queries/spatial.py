"""Spatial joins (J-02 to J-05, J-10 to J-12, J-17 to J-20, J-22) and resolution (J-13 to J-16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import geo
from ..operators import catalogue, resolve, spatial
from ..operators.staging import small_side
from .registry import query


@query(views.sql(f"SELECT p.place_id, a.code FROM places p, areas a WHERE a.rings IS NOT NULL AND {views.in_area_sql('p.lat', 'p.lon', 'a')}", "places", "areas"))
def j_02_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places with the areas that hold them."""
    p = views.places(spark, sf_dir).select("place_id", "lat", "lon")
    return spatial.inside(p, views.areas(spark, sf_dir).select("code", "rings", "holes")).select("place_id", "code")


@query(views.sql(f"SELECT p.place_id, a.code FROM places p, areas a WHERE a.code IN ('area-1', 'area-4') AND (a.rings IS NULL OR NOT {views.in_area_sql('p.lat', 'p.lon', 'a')})", "places", "areas"))
def j_03_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places not inside a given area; of an area without a polygon, all are outside."""
    p = views.places(spark, sf_dir).select("place_id", "lat", "lon")
    a = views.areas(spark, sf_dir).where("code in ('area-1', 'area-4')").select("code", "rings", "holes")
    held = spatial.inside(p, a).select("place_id", "code")
    return p.select("place_id", F.explode(F.array(F.lit("area-1"), F.lit("area-4"))).alias("code")).join(held, ["place_id", "code"], "left_anti")


LINE = """, legs AS (SELECT route_id, ordinal, lat AS a_lat, lon AS a_lon, lead(lat) OVER w AS b_lat, lead(lon) OVER w AS b_lon, CAST(row_number() OVER w AS INTEGER) AS seq FROM stops WINDOW w AS (PARTITION BY route_id ORDER BY ordinal)),
path AS (SELECT *, sum(metres) OVER (PARTITION BY route_id ORDER BY seq) - metres AS before, sum(metres) OVER (PARTITION BY route_id) AS length FROM (
  SELECT *, CAST(111194.92664455873 AS DOUBLE) * sqrt(pow((b_lon - a_lon) * cos(radians((a_lat + b_lat) / 2)), 2) + pow(b_lat - a_lat, 2)) AS metres FROM legs WHERE b_lat IS NOT NULL)),
met AS (SELECT route_id, service_id, seq, before, metres, length, (a_lon - lon) * cos(radians(lat)) AS ax, a_lat - lat AS ay, (b_lon - a_lon) * cos(radians(lat)) AS dx, b_lat - a_lat AS dy FROM path, services),
hit AS (SELECT *, CAST(111194.92664455873 AS DOUBLE) * sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)) AS gap FROM (
  SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), -(ax * dx + ay * dy) / (dx * dx + dy * dy))) ELSE CAST(0 AS DOUBLE) END AS t FROM met)),
best AS (SELECT route_id, service_id, first(gap ORDER BY gap, seq) AS gap, CASE WHEN max(length) > 0 THEN first((before + t * metres) / length ORDER BY gap, seq) ELSE 0 END AS fraction FROM hit WHERE gap <= 2000 GROUP BY route_id, service_id)"""


def _along(spark: SparkSession, sf_dir: str, stops: DataFrame) -> DataFrame:
    return spatial.along_lines(views.services(spark, sf_dir), spatial.segments(stops, "route_id", "ordinal"), "route_id", 2000.0, id_="service_id")


def _offsets(found: DataFrame) -> DataFrame:
    return found.select("route_id", "service_id", geo.half_up(F.col("offset"), 2).alias("offset_m"), geo.half_up(F.col("fraction"), 6).alias("fraction"))


@query(views.sql(LINE + " SELECT route_id, service_id, round(gap, 2) AS offset_m, round(fraction, 6) AS fraction FROM best", "stops", "services"))
def j_04_along_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services within two kilometres of a walk's line, with offset and position."""
    return _offsets(_along(spark, sf_dir, views.stops(spark, sf_dir)))


@query(views.sql(LINE + " SELECT route_id, service_id, CAST(row_number() OVER (PARTITION BY route_id ORDER BY round(fraction, 6), round(gap, 2), service_id) AS INTEGER) AS rank FROM best QUALIFY rank <= 12", "stops", "services"))
def top_05_along_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve services along a walk."""
    legs = spatial.segments(views.stops(spark, sf_dir), "route_id", "ordinal")
    return spatial.first_along(views.services(spark, sf_dir), legs, "route_id", 2000.0, 12, id_="service_id")


@query(views.sql(f"""SELECT service_id, place_id, round(metres, 2) AS metres, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY service_id ORDER BY metres, place_id) AS rank FROM (
  SELECT s.service_id, p.place_id, {views.haversine_sql("s.lat", "s.lon", "p.lat", "p.lon")} AS metres FROM services s, places p) WHERE metres <= 8000) WHERE rank <= 5""", "places", "services"))
def j_05_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest places within eight kilometres of each service."""
    right = views.places(spark, sf_dir).select("place_id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    found = spatial.nearest_k(views.services(spark, sf_dir).select("service_id", "lat", "lon"), right, 5, 8000.0, key=["service_id"], order=[F.col("place_id")])
    return found.select("service_id", "place_id", F.round("metres", 2).alias("metres"), "rank")


NORM = "trim(regexp_replace(lower({}), '[^0-9a-zа-яёіў]+', ' ', 'g'))"
PROTECTED_SQL = "IN ('curated', 'dataset', 'manual')"


@query(views.sql(f""", answers AS (SELECT place_id, lat, lon, {NORM.format("name")} AS norm FROM places WHERE owner {PROTECTED_SQL}
  UNION SELECT p.place_id, p.lat, p.lon, {NORM.format("a.alias")} FROM places p JOIN aliases a USING (place_id) WHERE p.owner {PROTECTED_SQL})
SELECT place_id, first(keeper ORDER BY metres, keeper) AS keeper, round(min(metres), 2) AS metres FROM (
  SELECT a.place_id, k.place_id AS keeper, {views.haversine_sql("a.lat", "a.lon", "k.lat", "k.lon")} AS metres FROM places a JOIN answers k ON {NORM.format("a.name")} = k.norm AND k.norm <> '' WHERE a.owner = 'auto') WHERE metres < 6000 GROUP BY place_id""", "places", "aliases"))
def j_10_shadowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic rows shadowed by the nearest protected row that answers to their name."""
    found = resolve.shadowed(views.places(spark, sf_dir), views.aliases(spark, sf_dir), metres=6000.0)
    return found.select("place_id", "keeper", F.round("metres", 2).alias("metres"))


@query()
def j_11_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head-anchored groups: their order decides, so SQL can't say it; a test walks them by brute force."""
    return resolve.twins(views.places(spark, sf_dir), metres=60_000.0)


@query(views.sql(f""", own AS (SELECT place_id, lat, lon, {NORM.format("name")} AS norm, coalesce(category, '') AS category FROM places WHERE lower(trim(split_part(name, '(', 1))) NOT IN ('small ring', 'red widget'))
SELECT a, b, round(metres, 2) AS metres, metres <= 8000 AS close FROM (
  SELECT x.place_id AS a, y.place_id AS b, {views.haversine_sql("x.lat", "x.lon", "y.lat", "y.lon")} AS metres FROM own x JOIN own y ON x.norm = y.norm AND x.norm <> '' AND x.category = y.category AND x.place_id < y.place_id) WHERE metres < 15000""", "places"))
def j_12_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one name and category near each other, generated labels aside."""
    found = resolve.suspected_duplicates(views.places(spark, sf_dir), labels=list(views.LABELS), metres=15_000.0, close=8000.0)
    return found.select("a", "b", F.round("metres", 2).alias("metres"), "close")


@query(views.sql(f""", pairs AS (SELECT 'src:' || p_partkey AS keep, 'src:' || (p_partkey * 7 + 1) AS drop FROM part WHERE p_partkey % 10 = 0)
SELECT p.keep, p.drop, CASE WHEN a.place_id IS NULL OR b.place_id IS NULL THEN 'stale' WHEN b.owner {PROTECTED_SQL} THEN 'refused' ELSE 'merged' END AS verdict FROM pairs p LEFT JOIN places a ON a.source_url = p.keep LEFT JOIN places b ON b.source_url = p.drop""", "places"))
def j_13_declared_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth row declared the keeper of another: merged, refused (a protected loser) or stale (no such row)."""
    return resolve.declared_merges(_pairs(spark, sf_dir, 10, 1), views.places(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str, every: int, add: int) -> DataFrame:
    i = F.col("p_partkey")
    named = lambda c: F.concat(F.lit("src:"), c.cast("string"))
    return views.read(spark, sf_dir, "part").where(i % every == 0).select(named(i).alias("keep"), named(i * 7 + add).alias("drop"))


@query()
def set_04_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three collapse rules in order, and which of them each row went by; a test applies them one by one in plain code."""
    return resolve.collapsed(views.places(spark, sf_dir), views.aliases(spark, sf_dir), _pairs(spark, sf_dir, 4, 3), shadow_m=6000.0, twin_m=9000.0)[1]


#: What is asked for: whole names in another case, pieces of names, pieces with a filler, first words, and longer names.
WANTED_SQL = """SELECT p_partkey AS wanted_id, CASE (p_partkey // 13) % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN substr(p_name, 2, 8) WHEN 2 THEN 'Бывший ' || substr(p_name, 3, 7) || ' в Гродно'
  WHEN 3 THEN split_part(p_name, ' ', 1) ELSE p_name || '?' END AS wanted FROM part WHERE p_partkey % 13 = 0"""


def wanted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """wanted_id, wanted: as WANTED_SQL."""
    k, name = F.col("p_partkey"), F.col("p_name")
    kind = F.floor(k / 13) % 5
    wanted = F.when(kind == 0, F.upper(name)).when(kind == 1, F.substring(name, 2, 8)).when(kind == 2, F.concat(F.lit("Бывший "), F.substring(name, 3, 7), F.lit(" в Гродно")))
    wanted = wanted.when(kind == 3, F.split_part(name, F.lit(" "), F.lit(1))).otherwise(F.concat(name, F.lit("?")))
    return views.read(spark, sf_dir, "part").where(k % 13 == 0).select(k.alias("wanted_id"), wanted.alias("wanted"))


CASCADE = f""", wanted AS ({WANTED_SQL}), asked AS (
  SELECT wanted_id, lower(wanted) AS n, trim(replace(replace(lower(wanted), 'бывший', ''), 'в гродно', '')) AS short FROM wanted
), known AS (
  SELECT place_id, lower(name) AS name, lat, lon, owner NOT IN ('dataset', 'manual') AS later FROM places
), same AS (
  SELECT wanted_id, k.* FROM asked JOIN known k ON trim(k.name) = n
), exact AS (
  SELECT wanted_id, first(place_id ORDER BY later, place_id) AS place_id, bool_and(later) AS open FROM same GROUP BY wanted_id
), gaps AS (
  SELECT a.wanted_id, max({views.haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")}) AS gap FROM same a JOIN same b USING (wanted_id) GROUP BY a.wanted_id
), held AS (
  SELECT wanted_id, count(*) FILTER (WHERE contains(k.name, n)) AS n_held, first(place_id ORDER BY later, place_id) FILTER (WHERE contains(k.name, n)) AS one,
    first(place_id ORDER BY later, place_id) FILTER (WHERE contains(k.name, short)) AS other
  FROM asked, known k WHERE contains(k.name, n) OR contains(k.name, short) GROUP BY wanted_id
)
SELECT wanted_id, CASE WHEN e.wanted_id IS NOT NULL THEN CASE WHEN NOT open OR gap <= 20000 THEN e.place_id END WHEN n_held = 1 THEN one ELSE other END AS place_id,
  CASE WHEN e.wanted_id IS NOT NULL THEN CASE WHEN NOT open OR gap <= 20000 THEN 'exact' ELSE 'ambiguous' END WHEN n_held = 1 THEN 'contains' WHEN other IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS how
FROM asked LEFT JOIN exact e USING (wanted_id) LEFT JOIN gaps USING (wanted_id) LEFT JOIN held USING (wanted_id)"""


@query(views.sql(CASCADE, "places"))
def j_14_name_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names resolved exactly, by containment, by containment without fillers."""
    return resolve.named_in_cascade(wanted_names(spark, sf_dir), views.places(spark, sf_dir), spread_m=20_000.0)


@query(views.sql("""SELECT a.place_id AS asked, coalesce(u.place_id, l.place_id) AS place_id FROM (SELECT place_id, CASE WHEN place_id % 4 = 0 THEN source_url ELSE 'gone:' || place_id END AS url, 'node/' || place_id AS ext FROM places WHERE place_id % 10 < 5) a
LEFT JOIN places u ON u.source_url = a.url LEFT JOIN (SELECT place_id, 'node/' || place_id AS ext FROM places WHERE place_id % 3 = 0) l ON l.ext = a.ext""", "places"))
def j_15_two_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alias finds its place by address, else by lineage."""
    p = views.places(spark, sf_dir)
    k = F.col("place_id")
    asked = p.where(k % 10 < 5).select(k.alias("asked"), F.when(k % 4 == 0, F.col("source_url")).otherwise(F.concat(F.lit("gone:"), k.cast("string"))).alias("url"), F.concat(F.lit("node/"), k.cast("string")).alias("ext"))
    by_url = p.select(F.col("source_url").alias("url"), k.alias("one"))
    by_ext = p.where(k % 3 == 0).select(F.concat(F.lit("node/"), k.cast("string")).alias("ext"), k.alias("two"))
    return asked.join(by_url, "url", "left").join(by_ext, "ext", "left").select("asked", F.coalesce("one", "two").alias("place_id"))


@query(views.sql("""SELECT route_id, CAST(count(*) AS INTEGER) AS n, array_to_string(list(place_id ORDER BY ordinal), ',') AS ids, CAST(count(*) FILTER (WHERE name IS NULL) AS INTEGER) AS missing, CAST(coalesce(sum(visit_minutes), 0) AS BIGINT) AS minutes
FROM stops LEFT JOIN (SELECT place_id, name, visit_minutes FROM places WHERE place_id % 9 <> 0) USING (place_id) GROUP BY route_id""", "stops", "places"))
def j_16_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks with their stops in order, what is missing, and minutes summed."""
    p = views.places(spark, sf_dir).where("place_id % 9 <> 0").select("place_id", "name", "visit_minutes")
    s = views.stops(spark, sf_dir).join(p, "place_id", "left").groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "place_id"))).alias("s"), F.count_if(F.col("name").isNull()).cast("int").alias("missing"), F.coalesce(F.sum("visit_minutes"), F.lit(0)).alias("minutes"))
    return s.select("route_id", F.size("s").alias("n"), F.array_join(F.col("s.place_id"), ",").alias("ids"), "missing", "minutes")


ROADS = """, roads AS (SELECT CASE WHEN service_id % 4 = 0 THEN 'М' || (service_id % 40) ELSE 'road of ' || (service_id % 40) END AS road, lat AS a_lat, lon AS a_lon, lat + CAST(0.01 AS DOUBLE) AS b_lat, lon + CAST(0.02 AS DOUBLE) AS b_lon FROM services),
met AS (SELECT place_id, road, (a_lon - lon) * cos(radians(lat)) AS ax, a_lat - lat AS ay, (b_lon - a_lon) * cos(radians(lat)) AS dx, b_lat - a_lat AS dy FROM places, roads),
each AS (SELECT place_id, road, min(CAST(111194.92664455873 AS DOUBLE) * sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2))) AS metres FROM (
  SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), -(ax * dx + ay * dy) / (dx * dx + dy * dy))) ELSE CAST(0 AS DOUBLE) END AS t FROM met) GROUP BY place_id, road),
ranked AS (SELECT *, row_number() OVER w AS rank, lead(metres) OVER w AS next FROM each WINDOW w AS (PARTITION BY place_id ORDER BY metres, road))
SELECT place_id, road, round(metres, 2) AS metres FROM ranked WHERE rank = 1 AND metres <= 500 AND (next IS NULL OR next > 1500) AND road LIKE 'road%'"""


@query(views.sql(ROADS, "places", "services"))
def j_17_nearest_road(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest road by name, unless it is a number or one of another name is close as well."""
    label = F.concat(F.when(F.col("service_id") % 4 == 0, "М").otherwise("road of "), (F.col("service_id") % 40).cast("string"))
    roads = views.services(spark, sf_dir).select(label.alias("road"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), (F.col("lat") + F.lit(0.01)).alias("b_lat"), (F.col("lon") + F.lit(0.02)).alias("b_lon"))
    found = spatial.nearest_named_road(views.places(spark, sf_dir), roads, within=500.0, rival=1500.0, refused=catalogue.is_road_number)
    return found.select("place_id", "road", F.round("metres", 2).alias("metres"))


@query(views.sql(f"SELECT place_id, first(code ORDER BY kind <> 'city', code) AS code FROM (SELECT p.place_id, a.code, a.kind FROM places p, areas a WHERE a.rings IS NOT NULL AND {views.in_area_sql('p.lat', 'p.lon', 'a')}) GROUP BY place_id", "places", "areas"))
def j_18_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area of a point: a city before a district, then by code."""
    held = spatial.inside(views.places(spark, sf_dir).select("place_id", "lat", "lon"), views.areas(spark, sf_dir).select("code", "kind", "rings", "holes"))
    return held.groupBy("place_id").agg(F.min(F.struct(F.col("kind") != "city", "code")).alias("m")).select("place_id", "m.code")


@query(views.sql(f"""SELECT place_id, first(code ORDER BY d, code) AS code FROM (SELECT p.place_id, a.code, round({views.haversine_sql("p.lat", "p.lon", "a.lat", "a.lon")}, 3) AS d FROM places p,
  (SELECT code, (rings[1][1].lat + rings[1][3].lat) / 2 AS lat, (rings[1][1].lon + rings[1][3].lon) / 2 AS lon FROM areas WHERE rings IS NOT NULL) a) GROUP BY place_id""", "places", "areas"))
def j_19_nearest_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a small, fixed set of centres, the nearest."""
    ring = F.element_at("rings", 1)
    mid = lambda f: (F.element_at(ring, 1)[f] + F.element_at(ring, 3)[f]) / 2
    centres = views.areas(spark, sf_dir).where("rings is not null").select("code", mid("lat").alias("c_lat"), mid("lon").alias("c_lon"))
    d = F.round(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon")), 3)
    met = views.places(spark, sf_dir).select("place_id", "lat", "lon").join(small_side(centres), F.lit(True))
    return met.groupBy("place_id").agg(F.min(F.struct(d.alias("d"), "code")).alias("m")).select("place_id", "m.code")


@query(views.sql(f"""SELECT place_id FROM places p WHERE EXISTS (SELECT 1 FROM areas a WHERE a.code IN ('area-0', 'area-1') AND {views.in_area_sql('p.lat', 'p.lon', 'a')}) OR EXISTS (SELECT 1 FROM services s WHERE s.service_id < 3 AND {views.haversine_sql("p.lat", "p.lon", "s.lat", "s.lon")} <= 10000)""", "places", "areas", "services"))
def j_20_geofence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inside the project's areas, or near one of the listed exceptions."""
    p = views.places(spark, sf_dir).select("place_id", "lat", "lon")
    held = spatial.inside(p, views.areas(spark, sf_dir).where("code in ('area-0', 'area-1')").select("rings", "holes")).select("place_id")
    listed = views.services(spark, sf_dir).where("service_id < 3").select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    return held.unionByName(spatial.radius_join(p, listed, 10_000.0).select("place_id")).distinct()


@query(views.sql(f"""SELECT s.service_id, bool_or({views.haversine_sql("s.lat", "s.lon", "p.lat", "p.lon")} <= 1500) AS covered FROM services s, places p GROUP BY s.service_id""", "places", "services"))
def j_22_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any answer lies within a radius of each target."""
    s = views.services(spark, sf_dir).select("service_id", "lat", "lon")
    right = views.places(spark, sf_dir).select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    near = spatial.nearest_k(s, right, 1, 1500.0, key=["service_id"], order=[]).select("service_id").withColumn("covered", F.lit(True))
    return s.select("service_id").join(near, "service_id", "left").select("service_id", F.coalesce("covered", F.lit(False)).alias("covered"))


@query(views.sql(f"""SELECT place_id, photo FROM (SELECT p.place_id, s.service_id AS photo, row_number() OVER (PARTITION BY p.place_id ORDER BY s.service_id) AS r FROM places p JOIN services s ON p.place_id % 100 = s.service_id % 100 AND {views.haversine_sql("p.lat", "p.lon", "s.lat", "s.lon")} <= 40000) WHERE r = 1""", "places", "services"))
def j_30_gated_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match by key counts only near enough; the first acceptable one is taken."""
    s = views.services(spark, sf_dir).select(F.col("service_id").alias("photo"), (F.col("service_id") % 100).alias("k"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    return spatial.first_within(views.places(spark, sf_dir).withColumn("k", F.col("place_id") % 100), s, 40_000.0, on="k", id_="photo")
