"""Categories from words, road names, lines, vectors and step-free walks (STR-08, STR-10, FLT-20, FLT-21, SNK-13, MSC-14, VER-06, AGG-07, TOP-06)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..operators import catalogue, retrieval, spatial, verify
from .registry import query
from .retrieval import CATEGORY, FUSED, NEARBY

TERM = "CASE p_partkey % 6 WHEN 0 THEN p_type WHEN 1 THEN '  ' || lower(p_type) || 's ' WHEN 2 THEN 'the ' || p_type || ' house' WHEN 3 THEN 'ring' WHEN 4 THEN 'Замками' ELSE '' END"
ENDING = "[" + ", ".join(f"{{'i': {i * 3 + j}, 'e': '{e}', 'r': '{r}'}}" for i, e in enumerate(catalogue.ENDINGS) for j, r in enumerate(catalogue.REPLACEMENTS)) + "]"


@query(f"""WITH forms AS (SELECT DISTINCT lower(p_type) AS form, lower(p_type) AS code, lower(p_type) AS raw FROM part UNION ALL SELECT 'замок', 'castle', 'замок' UNION ALL SELECT 'замк', 'castle', 'замк' UNION ALL SELECT 'castle', 'castle', 'castle'),
terms AS (SELECT DISTINCT {TERM} AS term FROM part), t AS (SELECT term, translate(lower(trim(term)), 'ё', 'е') AS own FROM terms),
lemmas AS (SELECT term, e.i AS n, substr(own, 1, length(own) - length(e.e)) || e.r AS form FROM (SELECT term, own, unnest({ENDING}) AS e FROM t) WHERE ends_with(own, e.e) AND length(own) - length(e.e) >= 3),
met AS (SELECT term, code, -1 AS step, 0 AS n, form FROM t JOIN forms ON trim(term) = raw UNION ALL SELECT term, code, 0, 0, form FROM t JOIN forms ON own = form
  UNION ALL SELECT term, code, 1, n, form FROM lemmas JOIN forms USING (form) UNION ALL SELECT term, code, 2, -length(form), form FROM t JOIN forms ON length(form) >= 4 AND contains(own, form))
SELECT term, (SELECT first(code ORDER BY step, n, form) FROM met WHERE met.term = t.term) AS code FROM t""")
def str_08_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to category codes: as written, folded, as a lemma, or contained."""
    own = views.categories(spark, sf_dir).select("code", F.array().cast("array<string>").alias("forms"))
    castle = spark.createDataFrame([("castle", ["замок", "замк"])], "code string, forms array<string>")
    forms = catalogue.surface_forms(own.unionByName(castle))
    return catalogue.resolved(views.read(spark, sf_dir, "part").select(F.expr(TERM).alias("term")), forms)


@query(r"""SELECT c_custkey, coalesce(nullif(trim(ru), ''), nullif(trim(name), ''), nullif(trim(be), '')) AS road,
  coalesce(regexp_matches(trim(coalesce(nullif(trim(ru), ''), nullif(trim(name), ''), nullif(trim(be), ''))), '^[A-Za-zА-Яа-яЁёІіЎў]{1,4}[\s\-–]?\d{1,5}(?:-[A-Za-zА-Яа-я]{1,3})?$'), false) AS numbered
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ' М' || c_custkey || ' ' WHEN c_custkey % 3 = 1 THEN ' ' END AS ru, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS name, CASE WHEN c_custkey % 5 = 0 THEN 'Р-' || c_custkey || '-а' END AS be FROM customer)""")
def str_10_road_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which spelling names a road, and whether it is only a number."""
    k = F.col("c_custkey")
    ru = F.when(k % 3 == 0, F.concat(F.lit(" М"), k.cast("string"), F.lit(" "))).when(k % 3 == 1, " ")
    be = F.when(k % 5 == 0, F.concat(F.lit("Р-"), k.cast("string"), F.lit("-а")))
    road = catalogue.road_name(ru, F.when(k % 2 == 0, F.col("c_mktsegment")), be)
    return views.read(spark, sf_dir, "customer").select("c_custkey", road.alias("road")).select("c_custkey", "road", catalogue.is_road_number(F.col("road")).alias("numbered"))


PROFILE = "CASE c_custkey % 6 WHEN 0 THEN 'bicycle' WHEN 1 THEN ' AUTO' WHEN 2 THEN 'any' WHEN 3 THEN 'bus' WHEN 4 THEN 'sledge' END"


@query(f"""SELECT c_custkey, CAST(CASE WHEN c_custkey % 10 = 0 THEN 75 ELSE CASE lower(trim({PROFILE})) WHEN 'bicycle' THEN 250 WHEN 'auto' THEN 400 WHEN 'any' THEN 250 WHEN 'bus' THEN 400 ELSE 150 END END AS DOUBLE) AS metres FROM customer""")
def flt_20_off_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far off a line services may lie, by profile, or as the caller says."""
    own = F.when(F.col("c_custkey") % 10 == 0, F.lit(75))
    return views.read(spark, sf_dir, "customer").select("c_custkey", catalogue.off_line_m(F.expr(PROFILE), own).alias("metres"))


@query("""SELECT l_orderkey AS route_id, CASE WHEN l_orderkey % 11 = 0 THEN 'shape_not_linestring' WHEN count(*) < 2 THEN 'shape_needs_two_points' WHEN bool_or(l_partkey % 97 = 0) THEN 'shape_bad_point' END AS problem
FROM lineitem GROUP BY l_orderkey""")
def flt_21_line_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that can't be used, and why."""
    lon = F.when(F.col("place_id") % 97 != 0, F.col("lon"))
    lines = views.stops(spark, sf_dir).groupBy("route_id").agg(F.collect_list(F.array(lon, "lat")).alias("points"))
    kind = F.when(F.col("route_id") % 11 == 0, "Point").otherwise("LineString")
    return lines.select("route_id", catalogue.line_problem(kind, F.col("points")).alias("problem"))


def hashed_vectors(texts: list[str]) -> list[list[float]]:
    """Stand-in for an embedding model: four numbers out of a hash."""
    return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:4]] for t in texts]


@query(views.sql(""", m AS (SELECT p.place_id, v.vector IS NULL AS made, sha256(p.name || '. ' || p.category || '. ' || p.town || '.') AS h FROM places p LEFT JOIN place_vectors v USING (place_id))
SELECT m.place_id, made, CASE WHEN made THEN round(list_sum(list_transform([1, 3, 5, 7], lambda i: CAST(('0x' || substr(h, i, 2)) AS INTEGER) / CAST(255 AS DOUBLE))), 6)
  ELSE round(list_sum(v.vector), 6) END AS total FROM m LEFT JOIN place_vectors v USING (place_id)""", "places", "place_vectors"))
def snk_13_backfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places without a vector get one from their text, 64 texts at a time."""
    p = views.places(spark, sf_dir).select("place_id", "name", "category", "town")
    rows = p.join(views.place_vectors(spark, sf_dir), "place_id", "left").withColumn("made", F.col("vector").isNull())
    text = F.concat("name", F.lit(". "), "category", F.lit(". "), "town", F.lit("."))
    done = catalogue.backfilled(rows, text, hashed_vectors)
    return done.select("place_id", "made", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(views.sql(""", m AS (SELECT place_id, name, sha256('passage: ' || name) AS h FROM places)
SELECT place_id, CASE WHEN NOT contains(name, 'ring') THEN round(list_sum(list_transform([1, 3, 5, 7], lambda i: CAST(('0x' || substr(sha256('passage: ' || name), i, 2)) AS INTEGER) / CAST(255 AS DOUBLE))), 6) ELSE CAST(-1 AS DOUBLE) END AS total,
  (SELECT count(DISTINCT name) FROM places WHERE NOT contains(name, 'ring')) AS learned FROM m""", "places"))
def msc_02_content_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by content: names that are known (those of rings, as -1) aren't embedded again, any other once."""
    p = views.places(spark, sf_dir).select("place_id", F.col("name").alias("text"))
    rings = p.where(F.contains("text", F.lit("ring"))).select(F.sha2(F.concat(F.lit(catalogue.PASSAGE), "text"), 256).alias("hash"), F.array(F.lit(-1.0)).alias("vector")).distinct()
    rows, new = catalogue.content_vectors(p, rings, hashed_vectors)
    return rows.select("place_id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.lit(new.count()).cast("long").alias("learned"))


def _step_free(spark: SparkSession, sf_dir: str, stops: DataFrame) -> DataFrame:
    """Whether walks are free of steps on their line; not measured (every seventh) is uncertain, so steps on it tell nothing."""
    steps, measured = views.services(spark, sf_dir).where("kind = 'toilet'"), F.col("route_id") % 7 != 0
    on_line = spatial.paths_met(steps, spatial.segments(stops.where(measured), "route_id", "ordinal"), "route_id", 1.0)
    own = stops.groupBy("route_id").agg(F.count("*").alias("points")).join(on_line.withColumn("hit", F.lit(True)), "route_id", "left")
    return own.select("route_id", verify.step_free(F.coalesce("hit", F.lit(False)), F.col("points") >= 2, measured).alias("status"))


@query(views.sql(""", legs AS (SELECT route_id, lat AS a_lat, lon AS a_lon, lead(lat) OVER w AS b_lat, lead(lon) OVER w AS b_lon FROM stops WINDOW w AS (PARTITION BY route_id ORDER BY ordinal)),
hit AS (SELECT DISTINCT route_id FROM (SELECT route_id, (a_lon - lon) * cos(radians(lat)) AS ax, a_lat - lat AS ay, (b_lon - a_lon) * cos(radians(lat)) AS dx, b_lat - a_lat AS dy FROM legs, services WHERE b_lat IS NOT NULL AND kind = 'toilet')
  WHERE CAST(111194.92664455873 AS DOUBLE) * sqrt(pow(ax + CASE WHEN dx * dx + dy * dy > 0 THEN least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), -(ax * dx + ay * dy) / (dx * dx + dy * dy))) ELSE 0 END * dx, 2)
    + pow(ay + CASE WHEN dx * dx + dy * dy > 0 THEN least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), -(ax * dx + ay * dy) / (dx * dx + dy * dy))) ELSE 0 END * dy, 2)) <= 1)
SELECT route_id, CASE WHEN count(*) < 2 THEN 'uncertain' WHEN route_id % 7 = 0 THEN 'uncertain' WHEN route_id IN (SELECT route_id FROM hit) THEN 'unmet' ELSE 'satisfied' END AS status
FROM stops GROUP BY route_id""", "stops", "services"))
def ver_06_step_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a walk has steps on its line."""
    return _step_free(spark, sf_dir, views.stops(spark, sf_dir))


@query(views.sql(CATEGORY + NEARBY + FUSED.format(signals="SELECT query_id, place_id, rank, 0 AS signal FROM by_category UNION ALL SELECT query_id, place_id, rank, 1 FROM by_box"), "places", "query_vectors"))
def agg_07_top_06_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two signals fused by reciprocal rank; ties keep the order in which they were seen."""
    asked, places = views.query_vectors(spark, sf_dir), views.places(spark, sf_dir)
    fused = retrieval.fuse([retrieval.category_signal(asked, places), retrieval.nearby_signal(asked, places)])
    return fused.select("query_id", "place_id", F.round("score", 9).alias("score"), "rank")
