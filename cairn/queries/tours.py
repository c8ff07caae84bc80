"""Walk building (J-26, J-27, WIN-04, WIN-05, WIN-08, AGG-08, AGG-09, OPT)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import views
from ..functions import geo
from ..operators import tours
from .registry import query

LEGS = f""", line AS (SELECT *, lead(place_id) OVER w AS next_id, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM stops WINDOW w AS (PARTITION BY route_id ORDER BY ordinal)),
legs AS (SELECT route_id, ordinal, place_id, next_id, lat, lon, lat2, lon2, {views.haversine_sql("lat", "lon", "lat2", "lon2")} AS metres FROM line WHERE next_id IS NOT NULL)"""
SPEED = "(CAST(4.0 AS DOUBLE) / CAST(3.6 AS DOUBLE))"


@query(views.sql(LEGS + f" SELECT route_id, ordinal, place_id, next_id, round(metres, 2) AS metres, round(metres / {SPEED}, 2) AS seconds FROM legs", "stops"))
def win_04_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tours.legs(views.stops(spark, sf_dir)).select("route_id", "ordinal", "place_id", "next_id", F.round("metres", 2).alias("metres"), F.round("seconds", 2).alias("seconds"))


@query(views.sql(LEGS + " SELECT route_id, ordinal, round(sum(metres) OVER (PARTITION BY route_id ORDER BY ordinal) - metres, 2) AS before FROM legs", "stops"))
def win_05_running_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.sum("metres").over(Window.partitionBy("route_id").orderBy("ordinal")) - F.col("metres")
    return tours.legs(views.stops(spark, sf_dir)).select("route_id", "ordinal", F.round(before, 2).alias("before"))


@query(views.sql(LEGS + f" SELECT route_id, ordinal, round(least(CAST(1e5 AS DOUBLE), sum(metres / {SPEED}) OVER (PARTITION BY route_id ORDER BY ordinal)), 2) AS upto FROM legs", "stops"))
def win_08_saturating_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    upto = F.least(F.lit(1e5), F.sum("seconds").over(Window.partitionBy("route_id").orderBy("ordinal")))
    return tours.legs(views.stops(spark, sf_dir)).select("route_id", "ordinal", F.round(upto, 2).alias("upto"))


@query(views.sql(f"""SELECT a.route_id, a.ordinal AS i, b.ordinal AS j, CASE WHEN a.ordinal = b.ordinal THEN CAST(0 AS DOUBLE) ELSE round({views.haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")} / {SPEED}, 2) END AS seconds FROM stops a JOIN stops b USING (route_id)""", "stops"))
def j_26_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost matrix of every walk in long form."""
    return tours.matrix(views.stops(spark, sf_dir)).select("route_id", "i", "j", F.round("seconds", 2).alias("seconds"))


ODD = f""", s AS (SELECT route_id, CASE WHEN (route_id + ordinal) % 13 = 0 THEN CAST('NaN' AS DOUBLE) WHEN (route_id + ordinal) % 29 = 0 THEN CAST(1e9 AS DOUBLE) ELSE metres / {SPEED} END AS seconds FROM legs)"""


def _odd_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.col("route_id") + F.col("ordinal")
    odd = F.when(mark % 13 == 0, float("nan")).when(mark % 29 == 0, 1e9).otherwise(F.col("seconds"))
    return tours.legs(views.stops(spark, sf_dir)).withColumn("seconds", odd)


@query(views.sql(LEGS + ODD + """ SELECT route_id, round(least(CAST(1e9 AS DOUBLE), sum(CASE WHEN isnan(seconds) THEN 0 ELSE seconds END)), 1) AS seconds, round(sum(seconds) FILTER (WHERE NOT isnan(seconds)), 1) AS measured,
  count(*) FILTER (WHERE isnan(seconds)) AS unknown, round(max(seconds) FILTER (WHERE NOT isnan(seconds)), 1) AS longest FROM s GROUP BY route_id""", "stops"))
def agg_08_09_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown legs add nothing, unreachable ones saturate (also OPT-06)."""
    t = tours.walk_seconds(_odd_legs(spark, sf_dir))
    return t.select("route_id", *(F.round(c, 1).alias(c) for c in ("seconds", "measured")), "unknown", F.round("longest", 1).alias("longest"))


@query(views.sql(LEGS + ODD + " SELECT route_id, count(*) FILTER (WHERE seconds < 1e9 AND NOT isnan(seconds)) AS strict_n, count(*) FILTER (WHERE isnan(seconds) OR seconds < 1e9) AS lenient_n FROM s GROUP BY route_id", "stops"))
def flt_23_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.filters import reachable

    s = F.col("seconds")
    return _odd_legs(spark, sf_dir).groupBy("route_id").agg(F.count_if(reachable(s, unknown_counts=False)).alias("strict_n"), F.count_if(reachable(s, unknown_counts=True)).alias("lenient_n"))


@query(views.sql("SELECT route_id, CAST(coalesce(sum(visit_minutes), 0) AS BIGINT) AS minutes, round(CAST(count(DISTINCT category) AS DOUBLE) / count(*), 6) AS diversity, coalesce(sum(visit_minutes), 0) <= 120 AS fits FROM stops JOIN places USING (place_id) GROUP BY route_id", "stops", "places"))
def agg_09_plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.places(spark, sf_dir).select("place_id", "category", "visit_minutes")
    minutes = F.coalesce(F.sum("visit_minutes"), F.lit(0))
    return views.stops(spark, sf_dir).join(p, "place_id").groupBy("route_id").agg(minutes.alias("minutes"), F.round(F.countDistinct("category") / F.count("*"), 6).alias("diversity"), (minutes <= 120).alias("fits"))


def _cheapest(stops: DataFrame, least: int, most: int) -> DataFrame:
    """route_id, seconds of walks of so many stops."""
    n = F.count("*").over(Window.partitionBy("route_id"))
    few = stops.withColumn("n", n).where(F.col("n").between(least, most))
    return tours.ordered(few).groupBy("route_id").agg(F.round(F.min("seconds"), 2).alias("seconds"))


@query("WITH RECURSIVE " + views.sql(""", small AS (SELECT * FROM stops WHERE route_id IN (SELECT route_id FROM stops GROUP BY route_id HAVING count(*) <= 6)), m AS (
  SELECT a.route_id, a.ordinal AS i, b.ordinal AS j, """ + views.haversine_sql("a.lat", "a.lon", "b.lat", "b.lon") + f""" / {SPEED} AS c FROM small a JOIN small b USING (route_id) WHERE a.ordinal <> b.ordinal),
sizes AS (SELECT route_id, count(*) AS n FROM small GROUP BY route_id),
path(route_id, seen, last, length, cost) AS (SELECT route_id, [ordinal], ordinal, 1, CAST(0 AS DOUBLE) FROM small
  UNION ALL SELECT p.route_id, list_append(seen, m.j), m.j, length + 1, cost + c FROM path p JOIN m ON m.route_id = p.route_id AND m.i = p.last AND NOT list_contains(seen, m.j))
SELECT path.route_id, round(min(cost), 2) AS seconds FROM path JOIN sizes ON sizes.route_id = path.route_id AND length = n GROUP BY path.route_id""", "stops").removeprefix("WITH "))
def opt_02_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest order of every walk of up to six stops, the operator's limit (also OPT-01); the SQL tries all orders."""
    return _cheapest(views.stops(spark, sf_dir), 1, tours.EXHAUSTIVE)


@query()
def opt_01_tours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All walks ordered (OPT-03 to OPT-05 inside); tests hold them against brute force."""
    return tours.ordered(views.stops(spark, sf_dir)).select("route_id", "position", "place_id", F.round("seconds", 2).alias("seconds"))


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops with visits, relevance, stops that must be visited, and for some walks a budget, an origin, the way back, or a bicycle."""
    r = F.col("route_id")
    p = views.places(spark, sf_dir).select("place_id", "visit_minutes")
    own = views.stops(spark, sf_dir).join(p, "place_id").withColumn("must", (F.col("ordinal") == 1) & (r % 3 == 0)).withColumn("relevance", (F.col("place_id") % 7).cast("double"))
    own = own.withColumn("budget_minutes", F.when(r % 4 != 0, (r % 40 * 60 + 480).cast("double"))).withColumn("round_trip", r % 5 == 0)
    own = own.withColumn("origin_lat", F.when(r % 2 == 0, views.lat_of(r))).withColumn("origin_lon", F.when(r % 2 == 0, views.lon_of(r)))
    return own.withColumn("profile", F.when(r % 3 == 1, "bicycle").when(r % 3 == 2, "car").otherwise("foot"))


@query()
def opt_07_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks planned within budget and longest leg (also OPT-03 and OPT-04 with budget and origin)."""
    return tours.planned(_bound(spark, sf_dir)).select("route_id", "position", "place_id", F.round("seconds", 2).alias("seconds"), "fits", "dropped")


@query()
def opt_17_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole measurement, where legs of over 20 000 seconds can't be walked."""
    return tours.planned(_bound(spark, sf_dir), unreachable_s=20_000.0).select("route_id", "position", "place_id", F.round("seconds", 2).alias("seconds"), "fits", "dropped")


@query()
def opt_17_step_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each walk costs without steps (stairways stand at the services' places), services aside."""
    kinds = views.categories(spark, sf_dir).select(F.col("code").alias("category"), (F.col("role") == "service").alias("service"))
    own = views.places(spark, sf_dir).select("place_id", "category").join(F.broadcast(kinds), "category").select("place_id", "service")  # a taxonomy
    return tours.step_free_price(_bound(spark, sf_dir).join(own, "place_id"), views.services(spark, sf_dir), near_m=400.0)


ORIGIN = f"CASE WHEN route_id % 2 = 0 THEN {views.lat_sql('route_id')} END AS olat, CASE WHEN route_id % 2 = 0 THEN {views.lon_sql('route_id')} END AS olon"


@query(views.sql(LEGS + f""", o AS (SELECT route_id, count(*) AS n, first(lat ORDER BY ordinal) AS la, first(lon ORDER BY ordinal) AS lo, last(lat ORDER BY ordinal) AS lb, last(lon ORDER BY ordinal) AS lp, {ORIGIN} FROM stops GROUP BY route_id),
c AS (SELECT route_id, CASE WHEN olat IS NULL THEN 0 ELSE {views.haversine_sql("olat", "olon", "la", "lo")} END AS way,
  CASE WHEN route_id % 5 = 0 AND n > 1 THEN CASE WHEN olat IS NULL THEN {views.haversine_sql("lb", "lp", "la", "lo")} ELSE {views.haversine_sql("lb", "lp", "olat", "olon")} END ELSE 0 END AS back FROM o)
SELECT c.route_id, round((coalesce(any_value(b), 0) + any_value(way) + any_value(back)) / {SPEED}, 2) AS seconds, round(any_value(back) / {SPEED}, 2) AS closing FROM c LEFT JOIN (SELECT route_id, sum(metres) AS b FROM legs GROUP BY route_id) USING (route_id) GROUP BY c.route_id""", "stops"))
def opt_06_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals with the ways from and to the origin, or back to the first stop."""
    s = views.stops(spark, sf_dir)
    r = F.col("route_id")
    origins = s.select("route_id").distinct().select("route_id", F.when(r % 2 == 0, views.lat_of(r)).alias("origin_lat"), F.when(r % 2 == 0, views.lon_of(r)).alias("origin_lon"), (r % 5 == 0).alias("round_trip"))
    return tours.walk_totals(s, origins).select("route_id", F.round("seconds", 2).alias("seconds"), F.round("closing", 2).alias("closing"))


@query()
def opt_11_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops that can't be reached from the last one kept are left out, in order."""
    return tours.pruned_unreachable(views.stops(spark, sf_dir), 20_000.0)


@query()
def opt_10_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops that can reach a surviving stop and be reached from one; a best pair by relevance (here by id) at least."""
    s = views.stops(spark, sf_dir).withColumn("relevance", (F.col("place_id") % 7).cast("double"))
    return tours.both_ways_reachable(s, 20_000.0)


@query()
def opt_16_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest open walk over given stops."""
    return tours.ordered(views.stops(spark, sf_dir), method="shortest_reference").groupBy("route_id").agg(F.round(F.max("seconds"), 2).alias("seconds"))


@query()
def top_09_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a town thinned for a map: greedy from the centre."""
    return tours.thinned(views.places(spark, sf_dir), gap_m=5000.0, most=30, key="town")


def _detours(spark: SparkSession, sf_dir: str, s: DataFrame) -> DataFrame:
    """Where along a walk a service costs least extra time, within half an hour."""
    w = Window.partitionBy("route_id").orderBy("ordinal")
    ends = s.select("route_id", "ordinal", F.col("lat").alias("la"), F.col("lon").alias("lo"), F.lead("lat").over(w).alias("lb"), F.lead("lon").over(w).alias("lp")).where("lb is not null")
    per_leg = ends.withColumn("seconds", geo.leg_seconds(geo.haversine_m(F.col("la"), F.col("lo"), F.col("lb"), F.col("lp"))))
    return tours.detours(per_leg, views.services(spark, sf_dir), most_seconds=1800.0)


@query(views.sql(LEGS + f""", d AS (SELECT l.route_id, s.service_id, l.ordinal, round({views.haversine_sql("l.lat", "l.lon", "s.lat", "s.lon")} / {SPEED} + {views.haversine_sql("s.lat", "s.lon", "l.lat2", "l.lon2")} / {SPEED} - metres / {SPEED}, 3) AS extra FROM legs l, services s)
SELECT route_id, service_id, first(ordinal ORDER BY extra, ordinal) AS ordinal, min(extra) AS extra FROM d WHERE extra <= 1800 GROUP BY route_id, service_id""", "stops", "services"))
def j_27_detours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detours(spark, sf_dir, views.stops(spark, sf_dir))


@query("SELECT o_orderkey, round(CASE o_orderkey % 3 WHEN 0 THEN least(b * 60 * 0.25, CAST(5000 AS DOUBLE) / (4.0 / 3.6)) WHEN 1 THEN least(b * 60 * 0.25, CAST(20000 AS DOUBLE) / (15.0 / 3.6)) ELSE coalesce(b * 60, CAST(14400 AS DOUBLE)) END, 3) AS cap FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 600 AS DOUBLE) END AS b FROM orders)")
def opt_08_leg_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    budget = F.when(k % 5 != 0, (k % 600).cast("double"))
    profile = F.when(k % 3 == 0, "foot").when(k % 3 == 1, "bicycle").otherwise("car")
    return views.read(spark, sf_dir, "orders").select("o_orderkey", F.round(tours.leg_cap_seconds(profile, budget), 3).alias("cap"))


@query(views.sql(LEGS + f""", t AS (SELECT route_id, sum(metres) AS m, sum(metres) / CASE route_id % 3 WHEN 0 THEN {SPEED} WHEN 1 THEN CAST(15.0 AS DOUBLE) / CAST(3.6 AS DOUBLE) ELSE CAST(30.0 AS DOUBLE) END AS s FROM legs GROUP BY route_id)
SELECT route_id, CASE WHEN m >= 15000 OR s >= 14400 THEN CASE route_id % 3 WHEN 0 THEN 'bicycle,car' WHEN 1 THEN 'car' ELSE '' END ELSE '' END AS suggested,
  CASE WHEN route_id % 3 < 2 THEN CASE WHEN m >= 15000 THEN 'too_far_to_walk' WHEN s >= 14400 THEN 'too_long_to_walk' END END AS reason FROM t""", "stops"))
def opt_18_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other means of travel for plans that outgrow their own: a third each walk, cycle and drive."""
    r = F.col("route_id")
    profile = F.when(r % 3 == 0, "foot").when(r % 3 == 1, "bicycle").otherwise("car")
    speed = F.when(r % 3 == 0, F.lit(geo.SPEEDS["foot"] / 3.6)).when(r % 3 == 1, F.lit(15.0 / 3.6)).otherwise(30.0)
    total = tours.legs(views.stops(spark, sf_dir)).groupBy("route_id").agg(F.sum("metres").alias("m")).withColumn("s", F.col("m") / speed)
    offers = total.select("route_id", tours.alternatives(profile, F.col("m"), F.col("s")).alias("o"))
    return offers.select("route_id", F.array_join("o.profile", ",").alias("suggested"), F.get("o", 0)["reason"].alias("reason"))


@query(views.sql("SELECT route_id, CAST((ordinal - 1) // 3 + 1 AS INTEGER) AS chunk, min(ordinal) AS first, least(max(ordinal) + 1, max(n)) AS last FROM (SELECT *, count(*) OVER (PARTITION BY route_id) AS n FROM stops) WHERE ordinal < n OR n = 1 GROUP BY route_id, chunk", "stops"))
def opt_19_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk's stops in chunks of four that overlap by one."""
    n = views.stops(spark, sf_dir).groupBy("route_id").agg(F.max("ordinal").alias("n"))
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - 1), F.lit(3)))
    return n.select("route_id", "n", start.alias("first")).select("route_id", ((F.col("first") - 1) / 3 + 1).cast("int").alias("chunk"), "first", F.least(F.col("first") + 3, F.col("n")).cast("long").alias("last"))


@query(views.sql("SELECT place_id, CAST(greatest(10, least(visit_minutes, 40)) AS INTEGER) AS capped, CAST(least(480, greatest(5, coalesce(visit_minutes, 20))) AS INTEGER) AS shown FROM places", "places"))
def opt_12_visit_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits in the matrix are capped by the budget (100 minutes here); those shown are clamped (VIS-01)."""
    v = F.col("visit_minutes")
    capped = F.when(v.isNull(), tours.visit_cap_minutes(F.lit(100))).otherwise(F.greatest(F.lit(10), F.least(v, tours.visit_cap_minutes(F.lit(100)))))
    return views.places(spark, sf_dir).select("place_id", capped.cast("int").alias("capped"), tours.shown_minutes(v, F.lit(20)).alias("shown"))


@query(views.sql("SELECT route_id, list_concat(list_concat([CAST(-1 AS BIGINT)], list(place_id ORDER BY ordinal)), [first(place_id ORDER BY ordinal)]) AS vertices FROM stops GROUP BY route_id", "stops"))
def msc_18_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The origin first, the first stop again last."""
    ids = F.array_sort(F.collect_list(F.struct("ordinal", "place_id")))["place_id"]
    return views.stops(spark, sf_dir).groupBy("route_id").agg(ids.alias("ids")).select("route_id", F.concat(F.array(F.lit(-1).cast("long")), "ids", F.slice("ids", 1, 1)).alias("vertices"))


@query(views.sql(LEGS + f" SELECT route_id, round(max(metres), 2) AS longest_hop, round(sum(metres) / count(*), 2) AS mean_hop, max(metres) > 100000 AS breach, count(*) - count(DISTINCT next_id) AS repeats FROM legs GROUP BY route_id", "stops"))
def agg_28_leg_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("metres")
    return tours.legs(views.stops(spark, sf_dir)).groupBy("route_id").agg(F.round(F.max(m), 2).alias("longest_hop"), F.round(F.sum(m) / F.count("*"), 2).alias("mean_hop"), (F.max(m) > 100_000).alias("breach"), (F.count("*") - F.countDistinct("next_id")).alias("repeats"))


@query(views.sql(LEGS + " SELECT part, count(*) AS legs, round(sum(metres), 0) AS metres FROM (SELECT route_id % 100 AS part, metres FROM legs) GROUP BY part", "stops"))
def cli_02_merged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a route merged: legs and lengths summed."""
    return tours.legs(views.stops(spark, sf_dir)).groupBy((F.col("route_id") % 100).alias("part")).agg(F.count("*").alias("legs"), F.round(F.sum("metres"), 0).alias("metres"))
