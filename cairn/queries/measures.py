"""Measurement (AGG-13 to AGG-31, J-21, J-23, J-25, J-28, J-29)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import views
from ..functions import geo
from ..operators import measures, trajectories
from ..operators.staging import settle
from .registry import query


@query(views.sql("SELECT case_id, count(recall) AS n, round(avg(recall), 9) AS mean, round((max(recall) - min(recall)) / 2, 9) AS half_range, round(stddev_samp(recall), 9) AS sd FROM runs WHERE failure IS NULL GROUP BY case_id", "runs"))
def agg_13_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = measures.spread(views.runs(spark, sf_dir), "case_id", "recall")
    return s.select("case_id", "n", *(F.round(c, 9).alias(c) for c in ("mean", "half_range", "sd")))


@query(views.sql("SELECT case_id, 'recall' AS metric, round(avg(recall), 9) AS score FROM runs GROUP BY case_id UNION ALL SELECT case_id, 'precision', round(avg(precision), 9) FROM runs GROUP BY case_id", "runs"))
def agg_14_case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as rows, averaged by case (also MSC-13)."""
    long = views.runs(spark, sf_dir).unpivot("case_id", ["recall", "precision"], "metric", "value")
    return long.groupBy("case_id", "metric").agg(F.round(F.avg("value"), 9).alias("score"))


@query(views.sql("SELECT round(avg(h), 9) AS noise, count(*) AS cases FROM (SELECT (max(recall) - min(recall)) / 2 AS h FROM runs WHERE failure IS NULL GROUP BY case_id HAVING count(recall) >= 2)", "runs"))
def agg_15_noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = measures.spread(views.runs(spark, sf_dir), "case_id", "recall").where("n >= 2")
    return s.agg(F.round(F.avg("half_range"), 9).alias("noise"), F.count("*").alias("cases"))


@query(views.sql("SELECT failure, count(*) AS n, count(*) FILTER (WHERE status = 'F') AS gated FROM runs WHERE failure IS NOT NULL GROUP BY failure", "runs"))
def agg_16_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.runs(spark, sf_dir).where("failure is not null").groupBy("failure").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "F").alias("gated"))


@query("SELECT user_id, round(list_sort(list(value))[least(count(*) - 1, CAST(floor(count(*) * CAST(0.9 AS DOUBLE)) AS BIGINT)) + 1], 6) AS p90 FROM events GROUP BY user_id")
def agg_17_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("value").alias("v"))
    return e.select("user_id", F.round(measures.nearest_rank(F.col("v"), 0.9), 6).alias("p90"))


@query()
def agg_18_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the mean recall by status; draws are hash-seeded, so reruns agree."""
    r = views.runs(spark, sf_dir).groupBy("case_id").agg(F.avg("recall").alias("recall")).withColumn("half", F.col("case_id") % 2)
    return measures.bootstrap(r, "half", "recall")


@query()
def agg_19_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two sets of runs over shared cases (also J-28)."""
    r = views.runs(spark, sf_dir)
    by = lambda k: r.where(F.col("repeat") % 2 == k).groupBy("case_id").agg(F.avg("recall").alias("recall"))
    return measures.paired(by(0), by(1), "case_id", "recall")


@query(views.sql(""", r AS (SELECT route_id, ordinal AS a, row_number() OVER (PARTITION BY route_id ORDER BY place_id, ordinal) AS b FROM stops),
p AS (SELECT x.route_id, sum(sign((y.a - x.a) * (y.b - x.b))) AS s, count(*) AS pairs FROM r x JOIN r y ON x.route_id = y.route_id AND x.a < y.a GROUP BY x.route_id)
SELECT r.route_id, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(max(s) / max(pairs), 9) END AS tau FROM r LEFT JOIN p USING (route_id) GROUP BY r.route_id""", "stops"))
def agg_20_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the order walked with the order of ids."""
    b = F.row_number().over(Window.partitionBy("route_id").orderBy("place_id", "ordinal"))
    t = measures.kendall_tau(views.stops(spark, sf_dir).select("route_id", F.col("ordinal").alias("a"), b.alias("b")), "route_id")
    return t.select("route_id", "n", F.round("tau", 9).alias("tau"))


CHECKS = """CASE WHEN failure IS NOT NULL THEN 'failed' WHEN recall IS NULL THEN 'no recall' WHEN recall < CAST(0.2 AS DOUBLE) THEN 'recall' WHEN coalesce(precision < CAST(0.1 AS DOUBLE), true) THEN 'precision' END"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = measures.first_failure((F.col("failure").isNull(), "failed"), (F.col("recall").isNotNull(), "no recall"), (F.col("recall") >= 0.2, "recall"), (F.col("precision") >= 0.1, "precision"))
    return views.runs(spark, sf_dir).withColumn("reason", reason)


@query(views.sql(f"SELECT case_id, repeat, {CHECKS} AS reason FROM runs", "runs"))
def agg_21_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks in order; the first that fails is the reason."""
    return _checked(spark, sf_dir).select("case_id", "repeat", "reason")


@query(views.sql(f", c AS (SELECT case_id, repeat, {CHECKS} AS reason FROM runs) SELECT case_id, NOT bool_or(reason IS NOT NULL) AS passed, first(reason ORDER BY repeat) FILTER (WHERE reason IS NOT NULL) AS reason FROM c GROUP BY case_id", "runs"))
def agg_22_merged_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.merged_repeats(_checked(spark, sf_dir), "case_id")


@query(views.sql(f", c AS (SELECT case_id, {CHECKS} AS reason FROM runs), m AS (SELECT case_id, NOT bool_or(reason IS NOT NULL) AS ok FROM c GROUP BY case_id) SELECT round(avg(CAST(ok AS INTEGER)), 9) AS rate, count(*) AS cases, count(*) FILTER (WHERE case_id % 10 <> 0) AS counted, round(avg(CAST(ok AS INTEGER)) FILTER (WHERE case_id % 10 <> 0), 9) AS known_aside FROM m", "runs"))
def agg_23_24_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cases passed, with and without known gaps (each tenth case)."""
    m = measures.merged_repeats(_checked(spark, sf_dir), "case_id").withColumn("ok", F.col("passed").cast("int"))
    counted = F.when(F.col("case_id") % 10 != 0, F.col("ok"))
    return m.agg(F.round(F.avg("ok"), 9).alias("rate"), F.count("*").alias("cases"), F.count(counted).alias("counted"), F.round(F.avg(counted), 9).alias("known_aside"))


@query(views.sql("SELECT case_id, round(sum(CAST(w AS DOUBLE) * v) FILTER (WHERE v IS NOT NULL) / nullif(sum(w) FILTER (WHERE v IS NOT NULL), 0), 12) AS total FROM (SELECT case_id, 3 AS w, recall AS v FROM runs UNION ALL SELECT case_id, 1, precision FROM runs) GROUP BY case_id", "runs"))
def agg_24_26_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted total over the stages that were measured."""
    long = views.runs(spark, sf_dir).unpivot("case_id", ["recall", "precision"], "metric", "v").withColumn("w", F.when(F.col("metric") == "recall", 3).otherwise(1)).withColumn("w", F.when(F.col("v").isNotNull(), F.col("w")))
    return long.groupBy("case_id").agg(F.round(F.sum(F.col("w") * F.col("v")) / F.sum("w"), 12).alias("total"))


@query(views.sql("SELECT s.route_id, round(avg(CAST(p.place_id IS NOT NULL AS INTEGER)), 9) AS share, bool_and(p.place_id IS NOT NULL) AS whole FROM stops s LEFT JOIN (SELECT place_id FROM places WHERE category IN ('economy', 'promo', 'small', 'medium')) p USING (place_id) GROUP BY s.route_id", "stops", "places"))
def agg_25_pool_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a walk a pool of candidates covers."""
    pool = views.places(spark, sf_dir).where(F.col("category").isin("economy", "promo", "small", "medium")).select("place_id", F.lit(True).alias("hit"))
    hit = F.coalesce("hit", F.lit(False))
    return views.stops(spark, sf_dir).join(pool, "place_id", "left").groupBy("route_id").agg(F.round(F.avg(hit.cast("int")), 9).alias("share"), F.bool_and(hit).alias("whole"))


@query()
def j_21_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops of a walk matched to those of the next: the order decides, so a test holds it against brute force."""
    s = views.stops(spark, sf_dir)
    answer = s.withColumn("route_id", F.col("route_id") - 1)
    return measures.greedy_matches(s, answer, key="route_id", metres=15_000.0)


@query()
def agg_27_match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of the match, by walk; a test works them out in plain code."""
    s = settle(views.stops(spark, sf_dir), "stops")
    answer = s.withColumn("route_id", F.col("route_id") - 1)
    r = F.col("route_id")
    plans = answer.groupBy("route_id").agg(F.count("*").alias("n")).select("route_id", F.when(r % 2 == 0, F.col("n") * 900.0).alias("walk_seconds"), (F.col("n") * 14.0).alias("walk_minutes"), F.when(r % 3 != 0, 40.0).alias("est_walk_minutes"), (r % 5 != 0).alias("fits"))
    got = measures.match_scores(s, answer, plans, key="route_id", metres=15_000.0)
    return got.select("route_id", *(F.round(c, 6).alias(c) for c in ("recall", "precision", "detour_km", "walk_diff_min")), "budget_fit")


@query(views.sql(f"""SELECT a.route_id, a.ordinal AS i, b.ordinal AS j, CASE WHEN a.place_id = b.place_id THEN 'same id' ELSE 'near' END AS rule FROM stops a JOIN stops b ON a.route_id = b.route_id AND a.ordinal < b.ordinal
WHERE (a.place_id = b.place_id OR {views.haversine_sql("a.lat", "a.lon", "b.lat", "b.lon")} < 3000) AND least(a.place_id, b.place_id) % 10 <> 0""", "stops"))
def j_23_duplicate_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of stops in one answer that are the same place or too near; listed exceptions aside."""
    s = views.stops(spark, sf_dir)
    a = s.select("route_id", F.col("ordinal").alias("i"), F.col("place_id").alias("a"), "lat", "lon")
    b = s.select("route_id", F.col("ordinal").alias("j"), F.col("place_id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    near = geo.haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) < 3000
    pairs = a.join(b, "route_id").where("i < j").where((F.col("a") == F.col("b")) | near).where(F.least("a", "b") % 10 != 0)
    return pairs.select("route_id", "i", "j", F.when(F.col("a") == F.col("b"), "same id").otherwise("near").alias("rule"))


@query(views.sql("SELECT CAST(case_id // 2 AS BIGINT) AS pair, count(DISTINCT coalesce(recall, -1)) = 1 AS agree FROM runs WHERE repeat = 1 GROUP BY 1", "runs"))
def j_29_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of a group must give the same answer."""
    r = views.runs(spark, sf_dir).where("repeat = 1")
    return r.groupBy(F.floor(F.col("case_id") / 2).alias("pair")).agg((F.countDistinct(F.coalesce("recall", F.lit(-1.0))) == 1).alias("agree"))


@query(views.sql("SELECT coalesce(a.case_id, b.case_id) AS case_id, CASE WHEN a.case_id IS NULL THEN 'only b' WHEN b.case_id IS NULL THEN 'only a' ELSE 'shared' END AS side FROM (SELECT DISTINCT case_id FROM runs WHERE status = 'P') a FULL JOIN (SELECT DISTINCT case_id FROM runs WHERE failure IS NOT NULL) b ON a.case_id = b.case_id", "runs"))
def j_28_shared_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.runs(spark, sf_dir)
    a = r.where("status = 'P'").select("case_id").distinct().withColumn("a", F.lit(1))
    b = r.where("failure is not null").select("case_id").distinct().withColumn("b", F.lit(1))
    return a.join(b, "case_id", "full_outer").select("case_id", F.when(F.col("a").isNull(), "only b").when(F.col("b").isNull(), "only a").otherwise("shared").alias("side"))


@query(views.sql("SELECT failure AS problem, count(DISTINCT case_id) AS cases, CAST(row_number() OVER (ORDER BY count(DISTINCT case_id) DESC, failure) AS INTEGER) AS rank FROM (SELECT failure, case_id FROM runs WHERE failure IS NOT NULL UNION ALL SELECT 'no recall', case_id FROM runs WHERE recall IS NULL) GROUP BY failure", "runs"))
def agg_29_known_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems ranked by the cases they affect."""
    r = views.runs(spark, sf_dir)
    all_ = r.where("failure is not null").select(F.col("failure").alias("problem"), "case_id").unionByName(r.where("recall is null").select(F.lit("no recall").alias("problem"), "case_id"))
    by = all_.groupBy("problem").agg(F.countDistinct("case_id").alias("cases"))
    return by.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cases"), "problem")))  # a row for each kind of problem


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events),
u AS (SELECT user_id, count(*) FILTER (WHERE event_type <> 'purchase') AS work, list(event_type ORDER BY ts, event_id) AS names, bool_or(event_type = 'purchase') AS bought, bool_or(event_type = 'click' AND floor(value / 20) = user_id % 3) AS clicked,
  coalesce(bool_or(event_type = 'view' AND nth = 1 AND value > 5), false) AS seen, coalesce(bool_or(event_type = 'error' AND nth = 1 AND value < 20), false) AS late FROM s GROUP BY user_id),
f AS (SELECT user_id, list_filter([CASE WHEN NOT clicked THEN 'args:click' END, CASE WHEN NOT late THEN 'error:error' END, CASE WHEN work > 60 THEN 'max_tool_calls' END, CASE WHEN NOT seen THEN 'result:view' END,
  CASE WHEN user_id % 4 = 0 AND names[1] = 'error' THEN 'status' END, CASE WHEN bought <> (user_id % 2 = 0) THEN 'submitted' END, CASE WHEN user_id % 3 = 0 THEN 'tools' END], lambda x: x IS NOT NULL) AS failed FROM u)
SELECT user_id, len(failed) = 0 AS passed, array_to_string(failed, ',') AS failed FROM f""")
def agg_30_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of calls (a user's events) against expectations: names in order, work, arguments and results as parts, errors, the end."""
    e, u, v = views.read(spark, sf_dir, "events"), F.col("case_id"), F.col("value")
    body = lambda *c: F.to_json(F.struct(*c))
    args = body(F.struct(F.floor(v / 20).alias("band"), F.lit("x").alias("more")).alias("at"), F.col("event_id").alias("id"))
    kind = F.col("event_type")
    steps = e.select(F.col("user_id").alias("case_id"), F.struct("ts", "event_id").alias("seq"), kind.alias("name"), args.alias("args"), body((v > 5).alias("ok"), F.array(v).alias("list")).alias("result"), F.when(kind == "error", F.when(v < 20, "late").otherwise("lost")).alias("error"))
    runs = steps.groupBy("case_id").agg(F.bool_or(F.col("name") == "purchase").alias("submitted"), F.min_by("name", "seq").alias("status"), F.array_sort(F.collect_list(F.struct("seq", "name")))["name"].alias("names"))
    strings = lambda *c: F.array(*(F.lit(x) for x in c))
    expected = runs.select(
        u, F.when(u % 3 == 0, strings("none")).otherwise(F.col("names")).alias("tools"), F.lit(60).alias("max_calls"),
        F.create_map(F.lit("click"), body(F.struct((u % 3).alias("band")).alias("at"))).alias("args"), F.create_map(F.lit("view"), F.lit('{"ok": true}')).alias("results"), F.create_map(F.lit("error"), F.lit("late")).alias("errors"),
        (u % 2 == 0).alias("submitted"), F.when(u % 4 == 0, F.array_except(F.array_distinct("names"), strings("error"))).alias("status"),
    )
    found = trajectories.verdicts(trajectories.checked(steps, runs, expected, terminal="purchase"))
    return found.select(u.alias("user_id"), "passed", F.array_join("failed", ",").alias("failed"))


@query("SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (WHERE value < t) AS below, count(*) FILTER (WHERE value >= t) AS above FROM events, (SELECT unnest([10, 50, 100]) AS t) GROUP BY t")
def agg_31_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts on either side of each of a few thresholds."""
    e = views.read(spark, sf_dir, "events").select("value", F.explode(F.array(F.lit(10.0), F.lit(50.0), F.lit(100.0))).alias("threshold"))
    return e.groupBy("threshold").agg(F.count_if(F.col("value") < F.col("threshold")).alias("below"), F.count_if(F.col("value") >= F.col("threshold")).alias("above"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round_even(l_quantity / 2, 0) AS DOUBLE) AS half FROM lineitem")
def rnd_01_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.bround(F.col("l_quantity") / 2, 0).alias("half"))
