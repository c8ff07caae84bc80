"""Streams run to their end over the event log, as files come (STM-01, STM-04 to STM-06, STM-10, STM-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..operators.staging import settle
from ..operators.store import latest
from ..streaming import journal, positions
from ..streaming.runs import latest_batch, run_to_end
from .registry import query


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.read_events(spark, f"{sf_dir}/event[s].parquet", like=views.read(spark, sf_dir, "events").schema)


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'error' ELSE max_by(event_type, [epoch_us(ts), event_id]) END AS stage, bool_or(event_type = 'error') AS finished FROM events GROUP BY user_id")
def stm_01_run_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage that each run is left in; what comes after its last mark is ignored."""
    out = run_to_end(journal.stages(_feed(spark, sf_dir)), "stages", mode="update")
    return latest(out, ["user_id"], ["batch"]).select("user_id", "stage", "finished")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS revision FROM events")
def stm_04_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered per user as they come."""
    return run_to_end(journal.revisions(_feed(spark, sf_dir)), "revisions").select("user_id", "event_id", "revision")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY date_trunc('hour', ts), event_type")
def stm_04_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind and hour."""
    return latest_batch(run_to_end(journal.counts(_feed(spark, sf_dir)), "counts", mode="complete")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, s""")
def stm_05_session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions end after six hours without an event."""
    return latest_batch(run_to_end(journal.sessions(_feed(spark, sf_dir)), "sessions", mode="complete")).withColumn("start", F.col("start").cast("timestamp_ntz"))


NEAR = f"{views.haversine_sql('e.lat', 'e.lon', 's.lat', 's.lon')} <= 20000"


@query(views.sql(f"SELECT e.user_id, ts, ordinal FROM (SELECT user_id, ts, {views.lat_sql('event_id * 17')} AS lat, {views.lon_sql('event_id * 17')} AS lon FROM events) e JOIN stops s ON s.route_id = e.user_id AND {NEAR}", "stops"))
def stm_06_arrival_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed joined to the stops of its user's walk that it is near to."""
    k = F.col("event_id") * 17
    feed = _feed(spark, sf_dir).select("user_id", "ts", views.lat_of(k).alias("lat"), views.lon_of(k).alias("lon"))
    stops = views.stops(spark, sf_dir).select(F.col("route_id").alias("user_id"), "ordinal", "lat", "lon")
    return run_to_end(positions.arrivals(feed, stops, 20_000.0), "arrivals").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "ordinal")


@query("SELECT DISTINCT user_id, CAST(CASE WHEN value <= 10 THEN 0 WHEN value <= 30 THEN 10 WHEN value <= 80 THEN 30 ELSE 80 END AS INTEGER) AS band FROM events WHERE event_type <> 'error'")
def stm_10_announced_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distance band is announced once to a user, never on a bad fix."""
    v = F.col("value")
    band = F.when(v <= 10, 0).when(v <= 30, 10).when(v <= 80, 30).otherwise(80)
    feed = _feed(spark, sf_dir).where("event_type <> 'error'").select("user_id", "ts", band.alias("band"))
    return run_to_end(positions.announced_once(feed, ["user_id", "band"], late="60 days"), "announced").select("user_id", "band")


@query("""WITH f AS (SELECT user_id, event_id, ts, value > 60 AS far FROM events WHERE event_type <> 'error')
SELECT user_id, event_id, far AND coalesce(lag(far) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS off FROM f""")
def stm_11_off_route_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Off the route only after two good fixes in a row that are too far."""
    feed = _feed(spark, sf_dir).where("event_type <> 'error'").select("user_id", "event_id", "ts", (F.col("value") > 60).alias("far"))
    return run_to_end(positions.off_route(feed), "off-route").select("user_id", "event_id", "off")


def _guided_parts(spark: SparkSession, sf_dir: str, feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A feed of fixes about the first leg of their user's walk, one in four off it; and the walks of its users as lines.

    Each batch of a stream works out a fixed side anew, also those that only let time pass, so the walks are settled.
    """
    users = views.read(spark, sf_dir, "events").select(F.col("user_id").alias("route_id")).distinct()
    own = views.stops(spark, sf_dir).join(users, "route_id", "left_semi").groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "lon", "lat"))).alias("s"))
    line = F.transform("s", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    walks = own.where(F.size("s") > 1).select(F.col("route_id").alias("user_id"), line.alias("line"))
    walks = settle(walks, "walks").withColumn("stops", F.col("line"))
    k, a, b = F.col("event_id"), F.element_at("line", 1), F.element_at("line", 2)
    share = (k * 37 % 101) / F.lit(100.0)
    aside = F.when(k % 4 == 0, 0.01).otherwise(0.0)
    fixes = feed.join(walks.select("user_id", "line"), "user_id")
    fixes = fixes.select("user_id", "event_id", "ts", (a["lat"] + (b["lat"] - a["lat"]) * share + aside).alias("lat"), (a["lon"] + (b["lon"] - a["lon"]) * share).alias("lon"), (F.col("event_type") != "error").alias("good"))
    return fixes, walks


@query()
def stm_06_progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a guide knows after each fix: how far the walk has come, whether it is off its line, which stop it has reached (also STM-11)."""
    feed, walks = _guided_parts(spark, sf_dir, _feed(spark, sf_dir))
    got = run_to_end(positions.guided(feed, walks, late="60 days"), "guided")
    return got.select("user_id", "event_id", F.round("off_line_m", 1).alias("off_line_m"), F.round("travelled", 1).alias("travelled"), "off", "arrived")
