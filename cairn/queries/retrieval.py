"""Batches of place searches (MSC-01, TOP, FLT point lookups)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import geo
from ..operators import retrieval
from ..plans.search import find_places as plan_find_places
from ..operators.staging import small_side
from .registry import query

VECTOR = """, near AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, place_id) AS rank FROM (
    SELECT q.query_id, v.place_id, 1 - list_sum(list_transform(list_zip(v.vector, q.vector), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(v.vector, lambda x: x * x))) * sqrt(list_sum(list_transform(q.vector, lambda x: x * x)))) AS distance
    FROM query_vectors q, place_vectors v) QUALIFY rank <= 50
)"""
CATEGORY = """, by_category AS (
  SELECT query_id, place_id, row_number() OVER (PARTITION BY query_id ORDER BY place_id) AS rank FROM query_vectors JOIN places USING (category) QUALIFY rank <= 50
)"""
NEARBY = """, by_box AS (
  SELECT q.query_id, p.place_id, row_number() OVER (PARTITION BY q.query_id ORDER BY pow(p.lat - q.lat, 2) + pow(p.lon - q.lon, 2), p.place_id) AS rank FROM query_vectors q JOIN places p
  ON abs(p.lat - q.lat) <= CAST(20 AS DOUBLE) / 111 AND abs(p.lon - q.lon) <= CAST(20 AS DOUBLE) / (CAST(111 AS DOUBLE) * greatest(CAST(0.2 AS DOUBLE), cos(radians(q.lat)))) QUALIFY rank <= 50
)"""
FUSED = """, fused AS (
  SELECT query_id, place_id, round(sum(CAST(1 AS DOUBLE) / (60 + rank)), 9) AS score, min([signal, rank]) AS seen FROM ({signals}) GROUP BY query_id, place_id
)
SELECT query_id, place_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, place_id) AS rank FROM fused) WHERE rank <= 8"""


@query(views.sql(VECTOR + CATEGORY + NEARBY + FUSED.format(signals="SELECT query_id, place_id, rank, 0 AS signal FROM near UNION ALL SELECT query_id, place_id, rank, 2 FROM by_category UNION ALL SELECT query_id, place_id, rank, 3 FROM by_box"), "places", "query_vectors", "place_vectors"))
def find_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a batch of searches by vector, category and nearness, fused by reciprocal rank."""
    return plan_find_places(views.query_vectors(spark, sf_dir), views.places(spark, sf_dir), views.place_vectors(spark, sf_dir))


@query(views.sql(VECTOR + " SELECT query_id, place_id, round(distance, 9) + CAST(0 AS DOUBLE) AS distance, CAST(rank AS INTEGER) AS rank FROM near", "query_vectors", "place_vectors"))
def top_01_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.vector_top_k(views.query_vectors(spark, sf_dir), views.place_vectors(spark, sf_dir))
    return found.select("query_id", "place_id", (F.round("distance", 9) + F.lit(0.0)).alias("distance"), "rank")


ALIAS = """, asked AS (SELECT * FROM (VALUES (1, 'small ring'), (2, 'widget red'), (3, 'larg bolt'), (4, 'gear')) t(query_id, words)),
g AS (SELECT alias, place_id FROM aliases GROUP BY alias, place_id),
t AS (SELECT DISTINCT alias, {grams_alias} AS tg FROM aliases), q AS (SELECT query_id, {grams_words} AS tg FROM asked),
s AS (SELECT query_id, alias, CAST(len(list_intersect(q.tg, t.tg)) AS DOUBLE) / (len(q.tg) + len(t.tg) - len(list_intersect(q.tg, t.tg))) AS score FROM q, t),
best AS (SELECT query_id, place_id, max(score) AS score FROM s JOIN g USING (alias) WHERE score >= 0.45 GROUP BY query_id, place_id)
SELECT query_id, place_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place_id) AS rank FROM best) WHERE rank <= 50"""


def _alias_sql() -> str:
    from .texts import grams

    return views.sql(ALIAS.format(grams_alias=grams("alias"), grams_words=grams("words")), "aliases")


@query(_alias_sql())
def top_02_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by the best trigram similarity of their aliases (also J-01, AGG-04)."""
    asked = spark.createDataFrame([(1, "small ring"), (2, "widget red"), (3, "larg bolt"), (4, "gear")], "query_id int, words string")
    found = retrieval.alias_signal(asked, views.aliases(spark, sf_dir))
    return found.select("query_id", "place_id", F.round("score", 9).alias("score"), "rank")


@query(views.sql(""", asked AS (SELECT * FROM (VALUES (1, 'small'), (2, 'bolt'), (3, 'brand#1')) t(query_id, needle)), hit AS (
  SELECT query_id, place_id, CAST(contains(lower(name), needle) AS INTEGER) * 2 + CAST(contains(lower(town), needle) AS INTEGER) AS score FROM asked, places WHERE contains(lower(name), needle) OR contains(lower(town), needle))
SELECT query_id, place_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place_id) AS INTEGER) AS rank FROM hit QUALIFY rank <= 20""", "places"))
def top_03_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.broadcast(spark.createDataFrame([(1, "small"), (2, "bolt"), (3, "brand#1")], "query_id int, needle string"))
    in_ = lambda c: F.contains(F.lower(c), F.col("needle"))
    hit = views.places(spark, sf_dir).join(asked, in_("name") | in_("town")).select("query_id", "place_id", (in_("name").cast("int") * 2 + in_("town").cast("int")).alias("score"))
    return retrieval.top_per(hit, ["query_id"], [F.desc("score"), F.col("place_id")], 20)


@query(views.sql(NEARBY + " SELECT query_id, place_id, CAST(rank AS INTEGER) AS rank FROM by_box", "places", "query_vectors"))
def top_04_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the box around a point, by squared degrees with unscaled longitude (also FLT-06)."""
    found = retrieval.nearby_signal(views.query_vectors(spark, sf_dir), views.places(spark, sf_dir))
    return found.select("query_id", "place_id", "rank")


@query(views.sql("SELECT category, place_id, CAST(row_number() OVER (PARTITION BY category ORDER BY price DESC, place_id) AS INTEGER) AS rank FROM places QUALIFY rank <= 50", "places"))
def win_03_top_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each code is ranked alone, so that none crowds out another."""
    found = retrieval.top_per(views.places(spark, sf_dir).select("category", "place_id", "price"), ["category"], [F.desc("price"), F.col("place_id")], 50)
    return found.select("category", "place_id", "rank")


@query(views.sql("SELECT code, kind, CAST(row_number() OVER (ORDER BY kind, code) AS INTEGER) AS rank FROM areas", "areas"))
def top_07_area_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return views.areas(spark, sf_dir).select("code", "kind", F.row_number().over(Window.orderBy("kind", "code")).alias("rank"))


@query(views.sql("SELECT case_id, min_by(repeat, [CAST(failure IS NOT NULL AS DOUBLE), -coalesce(recall, 0), -coalesce(precision, 0), CAST(repeat AS DOUBLE)]) AS repeat FROM runs GROUP BY case_id", "runs"))
def top_08_better_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of several outcomes by a rank of several parts; the first of equals."""
    rank = F.struct(F.col("failure").isNotNull(), -F.coalesce("recall", F.lit(0.0)), -F.coalesce("precision", F.lit(0.0)), F.col("repeat"))
    return views.runs(spark, sf_dir).groupBy("case_id").agg(F.min_by("repeat", rank).alias("repeat"))


@query(views.sql("SELECT place_id, category, town, name FROM (SELECT * FROM places ORDER BY category, town, name, place_id LIMIT 5000)", "places"))
def flt_02_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue in its order, at most 5 000 rows: a feature of the page."""
    p = views.places(spark, sf_dir).where("lat is not null and lon is not null")
    return p.orderBy("category", "town", "name", "place_id").limit(5000).select("place_id", "category", "town", "name")


ASKED = [90, 3, 77, 999_999_999, 3_000_000, 12, 45]


@query(views.sql(f"SELECT CAST(pos AS INTEGER) AS pos, place_id, name FROM (SELECT unnest({ASKED}) AS place_id, unnest(range(0, {len(ASKED)})) AS pos) JOIN places USING (place_id)", "places"))
def flt_03_lookup_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked ids keep their order; missing ones drop out (also J-36, FLT-04 for what is found)."""
    asked = spark.createDataFrame(list(enumerate(ASKED)), "pos int, place_id long")
    return views.places(spark, sf_dir).join(asked, "place_id").select("pos", "place_id", "name").orderBy("pos")


@query(f"SELECT place_id FROM (SELECT unnest({ASKED}) AS place_id) WHERE place_id NOT IN (SELECT p_partkey FROM part)")
def flt_04_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(x,) for x in ASKED], "place_id long")
    return asked.join(views.places(spark, sf_dir), "place_id", "left_anti")


@query(views.sql("SELECT place_id, category FROM places WHERE category IN ('economy', 'promo') AND visit_minutes IS NOT NULL", "places"))
def flt_05_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.places(spark, sf_dir).where(F.col("category").isin("economy", "promo") & F.col("visit_minutes").isNotNull()).select("place_id", "category")


@query(views.sql("SELECT place_id FROM places WHERE name ILIKE '%RING%' OR town ILIKE '%#2%'", "places"))
def flt_07_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring over several columns, case aside; an empty needle would switch the filter off (FLT-08)."""
    from ..operators.filters import any_column_contains

    p = views.places(spark, sf_dir)
    return p.where(any_column_contains({"name": "RING", "town": "#2", "category": ""})).select("place_id")


@query(views.sql("SELECT DISTINCT place_id FROM aliases WHERE alias ILIKE '%ed%'", "aliases"))
def flt_09_any_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any alias matches, aliases held as an array."""
    own = views.aliases(spark, sf_dir).groupBy("place_id").agg(F.collect_list("alias").alias("aliases"))
    return own.where(F.exists("aliases", lambda a: a.ilike("%ed%"))).select("place_id")


@query(views.sql("SELECT place_id FROM places WHERE starts_with(source_url, 'src:1') AND NOT list_contains(['src:10', 'src:11'], source_url)", "places"))
def flt_10_12_prefix_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.places(spark, sf_dir).select("place_id", "source_url")
    out = spark.createDataFrame([("src:10",), ("src:11",)], "source_url string")
    return p.where(F.col("source_url").startswith("src:1")).join(out, "source_url", "left_anti").select("place_id")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'signup' AND ts + CAST(floor(value) AS INTEGER) * INTERVAL 1 MINUTE > TIMESTAMP '2024-01-20 00:00:00'")
def flt_11_live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that have not expired at a given moment (also J-06)."""
    e = views.read(spark, sf_dir, "events").where("event_type = 'signup'")
    expires = F.timestamp_add("MINUTE", F.floor("value").cast("int"), F.col("ts"))
    return e.where(expires > F.lit("2024-01-20 00:00:00").cast(e.schema["ts"].dataType)).select("event_id", "user_id")


@query(views.sql("SELECT place_id FROM places WHERE lower(trim(split_part(name, '(', 1))) IN ('small ring', 'red widget')", "places"))
def flt_17_generated_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import generated_label

    return views.places(spark, sf_dir).where(generated_label(F.col("name"), list(views.LABELS))).select("place_id")


@query(views.sql("SELECT role, count(*) AS n, count(*) FILTER (WHERE pinned) AS n_pinned FROM (SELECT CASE WHEN place_id % 50 = 0 THEN 'sight' ELSE role END AS role, place_id % 50 = 0 AS pinned FROM places JOIN categories ON category = code) GROUP BY role", "places", "categories"))
def flt_18_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sights and services; pinned places are sights whatever their category."""
    from ..operators.filters import with_role

    own = with_role(views.places(spark, sf_dir), views.categories(spark, sf_dir), pinned=F.col("place_id") % 50 == 0)
    return own.groupBy("role").agg(F.count("*").alias("n"), F.count_if("pinned").alias("n_pinned"))


@query(views.sql("SELECT 'default' AS asked, list_sort(list(code) FILTER (WHERE highlight)) AS codes FROM categories UNION ALL SELECT 'some', list_sort(list(code) FILTER (WHERE code IN ('small', 'promo', 'zoo'))) FROM categories", "categories"))
def flt_19_service_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.categories(spark, sf_dir).agg(F.collect_list("code").alias("known"), F.array_sort(F.collect_list(F.when(F.col("highlight"), F.col("code")))).alias("shown"))
    some = F.array_sort(F.array_intersect(F.col("known"), F.array(F.lit("small"), F.lit("promo"), F.lit("zoo"))))
    return c.select(F.explode(F.array(F.struct(F.lit("default").alias("asked"), F.col("shown").alias("codes")), F.struct(F.lit("some").alias("asked"), some.alias("codes")))).alias("r")).select("r.asked", "r.codes")


@query("SELECT event_id, CAST(least(20, greatest(1, floor(value / 10))) AS INTEGER) AS held, NOT (floor(value / 10) BETWEEN 1 AND 20) AS clamped FROM events")
def flt_22_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.filters import clamped

    got = clamped(F.floor(F.col("value") / 10), 1, 20)
    return views.read(spark, sf_dir, "events").select("event_id", got["held"].cast("int").alias("held"), got["clamped"].alias("clamped"))


@query(views.sql("SELECT route_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(list(place_id), lambda x: x % 10 <> 0), [1, 2]))), ',') AS ids FROM stops GROUP BY route_id", "stops"))
def flt_24_excluded_and_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded ids go, base ids are appended once (also CLI-13, SET-02)."""
    s = views.stops(spark, sf_dir).groupBy("route_id").agg(F.collect_list("place_id").alias("ids"))
    kept = F.array_distinct(F.concat(F.filter("ids", lambda x: x % 10 != 0), F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    return s.select("route_id", F.array_join(F.array_sort(kept), ",").alias("ids"))


@query(views.sql("SELECT code, rings IS NOT NULL AS has_polygon FROM areas", "areas"))
def flt_25_has_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.areas(spark, sf_dir).select("code", F.col("rings").isNotNull().alias("has_polygon"))


@query(views.sql("SELECT place_id, CAST(coalesce(m, CASE WHEN category = 'promo' THEN 15 ELSE 20 END) AS INTEGER) AS minutes FROM (SELECT place_id, category, coalesce(p.visit_minutes, c.visit_minutes) AS m FROM places p LEFT JOIN (SELECT * FROM categories WHERE code <> 'promo' AND code <> 'large') c ON code = category)", "places", "categories"))
def map_03_default_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place's own minutes, its category's, or a fallback."""
    c = views.categories(spark, sf_dir).where("code not in ('promo', 'large')").select(F.col("code").alias("category"), F.col("visit_minutes").alias("usual"))
    p = views.places(spark, sf_dir).join(c, "category", "left")
    fallback = F.when(F.col("category") == "promo", 15).otherwise(20)
    return p.select("place_id", F.coalesce("visit_minutes", "usual", fallback).cast("int").alias("minutes"))


TAGS = {
    "amenity": ("size % 10 = 0", "place_of_worship"),
    "religion": ("size % 20 = 0", "christian"),
    "denomination": ("size % 40 = 0", "orthodox"),
    "building": ("size % 11 = 0", "church"),
    "historic": ("size % 7 = 0", "manor"),
    "military": ("size % 13 = 0", "bunker"),
    "tourism": ("size % 3 = 0", "museum"),
    "natural": ("size % 17 = 0", "stone"),
}


@query(views.sql("""SELECT place_id, CASE WHEN size % 40 = 0 THEN 'церковь' WHEN size % 20 = 0 THEN 'костёл' WHEN size % 10 = 0 THEN 'храм' WHEN size % 11 = 0 THEN 'храм' WHEN size % 13 = 0 THEN 'укрепление'
  WHEN size % 7 = 0 THEN 'усадьба' WHEN size % 3 = 0 THEN 'музей' WHEN size % 17 = 0 THEN 'валун' END AS code FROM places""", "places"))
def map_01_02_tag_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tag rule that fits names the category."""
    from ..sources.elements import sight_category

    tags = F.map_filter(F.create_map(*(x for k, (when, v) in TAGS.items() for x in (F.lit(k), F.when(F.expr(when), v).otherwise("")))), lambda k, v: v != "")
    return views.places(spark, sf_dir).select("place_id", sight_category(tags).alias("code"))


@query(views.sql("SELECT p.place_id, round(p.lat, 6) AS lat FROM places p, (SELECT lat, lon FROM query_vectors WHERE query_id = 100) q WHERE abs(p.lat - q.lat) <= CAST(15 AS DOUBLE) / 111 AND abs(p.lon - q.lon) <= CAST(15 AS DOUBLE) / (CAST(111 AS DOUBLE) * greatest(CAST(0.2 AS DOUBLE), cos(radians(q.lat))))", "places", "query_vectors"))
def flt_06_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = views.query_vectors(spark, sf_dir).where("query_id = 100").select(F.col("lat").alias("qlat"), F.col("lon").alias("qlon"))
    dy, dx = geo.box(F.col("qlat"), F.col("qlon"), 15)
    near = (F.abs(F.col("lat") - F.col("qlat")) <= dy) & (F.abs(F.col("lon") - F.col("qlon")) <= dx)
    return views.places(spark, sf_dir).join(small_side(q), near).select("place_id", F.round("lat", 6).alias("lat"))
