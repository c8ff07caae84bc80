"""Verification (VER, AGG-10 to AGG-12, MSC-06 to MSC-08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import calendar
from ..operators import verify
from .geometry import OPEN_SQL, WINDOWS_SQL
from .registry import query

FREE = "CASE WHEN contains(ticket, 'free') THEN true WHEN contains(ticket, 'paid') THEN false WHEN regexp_matches(ticket, '\\d') THEN false END"
EVERY = "CASE WHEN coalesce(bool_or(NOT {f}), false) THEN 'unmet' WHEN bool_or({f} IS NULL) THEN 'uncertain' ELSE 'satisfied' END"
SOME = "CASE WHEN coalesce(bool_or({f}), false) THEN 'satisfied' WHEN bool_or({f} IS NULL) THEN 'uncertain' ELSE 'unmet' END"


def _route_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.stops(spark, sf_dir).select("route_id", "ordinal", "place_id").join(views.places(spark, sf_dir), "place_id")


@query(views.sql(f"SELECT route_id, {EVERY.format(f='free')} AS status, {SOME.format(f='free')} AS any_status FROM (SELECT route_id, {FREE} AS free FROM stops JOIN places USING (place_id)) GROUP BY route_id", "stops", "places"))
def ver_04_07_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free admission at every stop, and at some stop."""
    free = calendar.free_entry(F.lit(None).cast("string"), F.col("ticket"))
    return _route_places(spark, sf_dir).withColumn("free", free).groupBy("route_id").agg(verify.every(F.col("free")).alias("status"), verify.some(F.col("free")).alias("any_status"))


@query(views.sql(WINDOWS_SQL + f""", o AS (SELECT opening_hours, bool_or({OPEN_SQL.format(m="8000")}) AS open FROM (SELECT DISTINCT opening_hours FROM places) LEFT JOIN windows USING (opening_hours) GROUP BY opening_hours)
SELECT route_id, {EVERY.format(f="open")} AS status FROM stops JOIN places USING (place_id) JOIN o USING (opening_hours) GROUP BY route_id""", "stops", "places"))
def ver_05_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open at a moment (minute 8 000 of the week) at every stop."""
    said = calendar.parsed_hours(views.places(spark, sf_dir), "opening_hours").select("opening_hours", calendar.open_at(F.col("windows"), F.lit(8000)).alias("open"))
    return _route_places(spark, sf_dir).select("route_id", "opening_hours").join(said, "opening_hours", "left").groupBy("route_id").agg(verify.every(F.col("open")).alias("status"))


@query(views.sql("SELECT route_id, CASE WHEN bool_or(category = 'promo') THEN 'satisfied' ELSE 'unmet' END AS interest, CASE WHEN bool_or(category = 'large') THEN 'unmet' ELSE 'satisfied' END AS avoid FROM stops JOIN places USING (place_id) GROUP BY route_id", "stops", "places"))
def ver_03_interest_avoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda c: F.bool_or(F.col("category") == c)
    return _route_places(spark, sf_dir).groupBy("route_id").agg(F.when(has("promo"), "satisfied").otherwise("unmet").alias("interest"), F.when(has("large"), "unmet").otherwise("satisfied").alias("avoid"))


REQUIRED = ", req AS (SELECT DISTINCT o_orderkey AS route_id, CAST(o_orderkey * 7 % 2000 AS BIGINT) AS place_id FROM orders UNION SELECT route_id, min(place_id) FROM stops GROUP BY route_id)"


@query(views.sql(REQUIRED + """ SELECT r.route_id, r.place_id, CASE WHEN r.place_id % 11 = 0 THEN 'outside' WHEN r.place_id % 7 = 0 THEN 'unroutable' WHEN s.place_id IS NOT NULL THEN 'on route' ELSE 'absent' END AS status
FROM req r LEFT JOIN (SELECT DISTINCT route_id, place_id FROM stops) s USING (route_id, place_id)""", "stops"))
def ver_01_must_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["route_id", "place_id"]
    s = views.stops(spark, sf_dir)
    asked = views.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("route_id"), (F.col("o_orderkey") * 7 % 2000).alias("place_id"))
    req = asked.unionByName(s.groupBy("route_id").agg(F.min("place_id").alias("place_id"))).distinct()
    return verify.must_visit(req, s, req.where("place_id % 11 = 0"), req.where("place_id % 7 = 0"), keys)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' OR l_quantity > 45 THEN 'satisfied' WHEN l_tax = 0 THEN 'uncertain' WHEN l_linestatus = 'F' THEN 'unmet' ELSE 'uncertain' END AS status FROM lineitem")
def ver_02_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = verify.service(F.col("l_returnflag") == "R", F.col("l_quantity") > 45, F.col("l_tax") != 0, F.col("l_linestatus") == "F")
    return views.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", status.alias("status"))


VERDICTS = """, v AS (SELECT l_orderkey AS route_id, CASE WHEN l_returnflag = 'R' THEN 'hard' ELSE 'soft' END AS strength, CASE WHEN l_quantity > 42 THEN 'unmet' WHEN l_quantity > 25 THEN 'uncertain' ELSE 'satisfied' END AS status,
  CASE WHEN l_linenumber % 2 = 0 THEN 'free' ELSE 'open' END AS kind FROM lineitem)"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    status = F.when(q > 42, "unmet").when(q > 25, "uncertain").otherwise("satisfied")
    return views.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("route_id"), F.when(F.col("l_returnflag") == "R", "hard").otherwise("soft").alias("strength"), status.alias("status"), F.when(F.col("l_linenumber") % 2 == 0, "free").otherwise("open").alias("kind"))


@query(views.sql(VERDICTS + " SELECT route_id, CASE WHEN bool_or(strength = 'hard' AND status = 'unmet') THEN 'infeasible' WHEN bool_or(strength <> 'hard' AND status = 'unmet') THEN 'degraded' WHEN bool_or(status = 'uncertain') THEN 'pending' ELSE 'ready' END AS status FROM v GROUP BY route_id", "places"))
def agg_10_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.rolled_up(_verdicts(spark, sf_dir), "route_id")


@query(views.sql(VERDICTS + " SELECT route_id, array_to_string(list_sort(list(kind) FILTER (WHERE status = 'unmet')), ',') AS unmet, array_to_string(list_sort(list(DISTINCT kind) FILTER (WHERE status = 'uncertain')), ',') AS uncertain FROM v GROUP BY route_id", "places"))
def agg_11_12_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles by status; codes once each, sorted. Empty lists are null, as SQL has them."""
    of = lambda s: F.when(F.col("status") == s, F.col("kind"))
    text = lambda a: F.when(F.size(a) > 0, F.array_join(F.array_sort(a), ","))
    return _verdicts(spark, sf_dir).groupBy("route_id").agg(text(F.collect_list(of("unmet"))).alias("unmet"), text(F.collect_set(of("uncertain"))).alias("uncertain"))


@query(views.sql(VERDICTS + " SELECT route_id, count(*) FILTER (WHERE strength = 'hard' AND status IN ('unmet', 'uncertain')) AS problems, count(*) FILTER (WHERE status = 'satisfied' AND route_id % 3 <> 0) AS held FROM v GROUP BY route_id", "places"))
def msc_06_ver_08_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard requirements not met; without sound geometry (each third walk) nothing is satisfied."""
    v = _verdicts(spark, sf_dir).withColumn("after", verify.gated(F.col("status"), F.col("route_id") % 3 != 0))
    hard = (F.col("strength") == "hard") & F.col("status").isin("unmet", "uncertain")
    return v.groupBy("route_id").agg(F.count_if(hard).alias("problems"), F.count_if(F.col("after") == "satisfied").alias("held"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 300 AS INTEGER) WHEN o_orderkey % 4 = 1 THEN CAST(o_orderkey % 90 + o_orderkey % 45 AS INTEGER) END AS minutes, CAST(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 END, o_orderkey % 2) AS INTEGER) AS children FROM orders")
def msc_07_08_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is declared wins, else the sum, else unknown."""
    k = F.col("o_orderkey")
    declared, total = F.when(k % 4 == 0, k % 300), F.when(k % 4 == 1, k % 90 + k % 45)
    return views.read(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(declared, total).cast("int").alias("minutes"), F.coalesce(F.when(k % 3 == 0, k % 5), k % 2).cast("int").alias("children"))


@query(views.sql("SELECT category, count(*) AS n, sum(coalesce(visit_minutes, 15)) AS minutes, CAST(row_number() OVER (ORDER BY count(*) DESC, category) AS INTEGER) AS rank FROM places GROUP BY category", "places"))
def agg_33_34_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by size; a place without minutes counts for fifteen."""
    from pyspark.sql import Window

    by = views.places(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.sum(F.coalesce("visit_minutes", F.lit(15))).cast("decimal(38,0)").alias("minutes"))
    return by.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "category")))  # a row for each category
