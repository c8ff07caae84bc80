"""The operational store (J-06 to J-09, J-32, J-33, WIN-01, WIN-02, WIN-07, WIN-09, SNK-14 to SNK-16, AGG-02, AGG-03, AGG-05, CLI, STM in batch)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import views
from ..operators import measures, store
from ..operators.staging import small_side
from .registry import query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "events")


@query("SELECT c_custkey, (SELECT count(DISTINCT event_id) FROM events WHERE user_id = c_custkey AND event_type = 'purchase') AS visited FROM customer")
def j_07_visited_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _events(spark, sf_dir).where("event_type = 'purchase'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.countDistinct("event_id").alias("visited"))
    return views.read(spark, sf_dir, "customer").select("c_custkey").join(by, "c_custkey", "left").select("c_custkey", F.coalesce("visited", F.lit(0)).alias("visited"))


@query("""SELECT user_id, place_id, min(ts) AS ts FROM (SELECT user_id, CAST(event_id % 2500 AS BIGINT) AS place_id, ts FROM events WHERE event_type = 'purchase'
UNION ALL SELECT user_id, CAST(event_id % 2500 AS BIGINT), ts FROM events e WHERE event_type = 'click' AND event_id % 2500 IN (SELECT p_partkey FROM part) AND NOT EXISTS (
  SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.event_id % 2500 = e.event_id % 2500)) GROUP BY user_id, place_id""")
def j_09_bulk_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idempotent marks: unknown ids skipped, the first time kept (also SNK-15)."""
    e = _events(spark, sf_dir).select("user_id", (F.col("event_id") % 2500).alias("place_id"), "ts", "event_type")
    old = e.where("event_type = 'purchase'").groupBy("user_id", "place_id").agg(F.min("ts").alias("ts"))
    known = views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("place_id"))
    return store.marked(old, e.where("event_type = 'click'"), known, ["user_id", "place_id"])


@query(views.sql("SELECT user_id, CAST(count(*) AS INTEGER) AS turns, max(revision) AS last, max_by(kind, revision) AS last_kind, array_to_string(list(kind ORDER BY revision DESC)[1:3], ',') AS newest FROM journal GROUP BY user_id", "journal"))
def j_32_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thread with its turns, newest first (also STM-04)."""
    turns = F.sort_array(F.collect_list(F.struct("revision", "kind")), asc=False)
    by = views.journal(spark, sf_dir).groupBy("user_id").agg(turns.alias("t"), F.max("revision").alias("last"), F.max_by("kind", "revision").alias("last_kind"))
    return by.select("user_id", F.size("t").alias("turns"), "last", "last_kind", F.array_join(F.slice(F.col("t.kind"), 1, 3), ",").alias("newest"))


@query(views.sql(""", recorded AS (SELECT user_id, event_id % 50 AS item, min(revision) AS since FROM journal WHERE revision < 20 GROUP BY user_id, item),
given AS (SELECT user_id, event_id % 60 AS item, min(revision) AS since FROM journal WHERE revision >= 15 GROUP BY user_id, item), excluded AS (SELECT DISTINCT user_id, event_id % 70 AS item FROM journal WHERE revision < 5),
every AS (SELECT *, 0 AS source FROM recorded UNION ALL SELECT g.*, 1 FROM given g ANTI JOIN recorded r ON r.user_id = g.user_id AND r.item = g.item)
SELECT user_id, item, CAST(row_number() OVER (PARTITION BY user_id ORDER BY source, since) - 1 AS INTEGER) AS place FROM every e WHERE NOT EXISTS (SELECT 1 FROM excluded x WHERE x.user_id = e.user_id AND x.item = e.item)""", "journal"))
def j_33_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops of a recorded turn and of the client, without the excluded ones."""
    j = views.journal(spark, sf_dir)
    own = lambda rows, n: rows.groupBy("user_id", (F.col("event_id") % n).alias("item")).agg(F.min("revision").alias("at"))
    return store.reconciled(own(j.where("revision < 20"), 50), own(j.where("revision >= 15"), 60), own(j.where("revision < 5"), 70), key="user_id", item="item", order="at")


@query(views.sql("""SELECT user_id, CAST(CASE WHEN user_id % 3 = 0 AND bool_or(revision = 4) THEN 4 ELSE max(revision) END AS INTEGER) AS revision,
  (user_id % 3 = 0 AND bool_or(revision = 4)) OR count(*) > CASE WHEN user_id % 2 = 0 THEN 60 ELSE 0 END AS adopt FROM journal GROUP BY user_id""", "journal"))
def cli_12_adopted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn shown: the one chosen, else the last; adopted only if chosen or if the journal grew."""
    j = views.journal(spark, sf_dir)
    users = j.select("user_id").distinct()
    held = users.where("user_id % 2 = 0").withColumn("turns", F.lit(60))
    wanted = users.where("user_id % 3 = 0").withColumn("wanted", F.lit(4))
    return store.adopted(j, held, key="user_id", wanted=wanted)


@query(views.sql("SELECT user_id, revision, ts, event_id, kind FROM journal QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY revision DESC) = 1", "journal"))
def win_02_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest(views.journal(spark, sf_dir), ["user_id"], ["revision"]).select("user_id", "revision", "ts", "event_id", "kind")


@query(views.sql("SELECT user_id, event_id, revision FROM journal WHERE event_id % 4 = 3", "journal"))
def snk_14_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns appended to a journal go on from its last revision (also AGG-05)."""
    j = views.journal(spark, sf_dir)
    all_ = j.withColumn("mark", F.col("event_id") % 4 == 3)
    # The journal so far is everything before a user's first marked turn; the rest is appended at once.
    first = F.min(F.when(F.col("mark"), F.col("revision"))).over(Window.partitionBy("user_id"))
    split = all_.withColumn("first", first)
    old, new = split.where("first is null or revision < first"), split.where("revision >= first").drop("revision")
    done = store.appended(old.select("user_id", "revision"), new.select("user_id", "ts", "event_id", "mark"), "user_id", ["ts", "event_id"])
    return done.where("mark").select("user_id", "event_id", "revision")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 25 OFFSET 50")
def win_09_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.page(views.read(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 2, 25)


@query("SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM part) AS places, (SELECT count(*) FROM events WHERE event_type = 'purchase') AS visits, (SELECT count(DISTINCT user_id) FROM events) AS active")
def agg_02_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda df, agg: df.agg(agg)
    e = _events(spark, sf_dir)
    a = one(e, F.struct(F.count_if(F.col("event_type") == "purchase").alias("visits"), F.countDistinct("user_id").alias("active")).alias("e"))
    users = one(views.read(spark, sf_dir, "customer"), F.count("*").alias("users"))
    places = one(views.read(spark, sf_dir, "part"), F.count("*").alias("places"))
    return users.join(places, F.lit(True)).join(a, F.lit(True)).select("users", "places", "e.visits", "e.active")  # one row each


@query("SELECT event_type, count(*) FILTER (WHERE value > 50) AS dear, count(*) AS total FROM events GROUP BY event_type")
def agg_03_filtered_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("dear"), F.count("*").alias("total"))


@query(views.sql("SELECT route_id, place_id, CAST(row_number() OVER (PARTITION BY route_id ORDER BY ordinal) - 1 AS INTEGER) AS rank FROM stops WHERE place_id % 5 <> 0", "stops"))
def win_01_07_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in a list counted from 0; excluded ones close up."""
    rank = F.row_number().over(Window.partitionBy("route_id").orderBy("ordinal")) - 1
    return views.stops(spark, sf_dir).where("place_id % 5 <> 0").select("route_id", "place_id", rank.alias("rank"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100) AND lower(c_name) IN (SELECT lower(c_name) FROM customer GROUP BY lower(c_name) HAVING count(*) = 1)")
def snk_16_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts left after some are deleted; names must be unique."""
    c = views.read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    gone = _events(spark, sf_dir).where("event_type = 'signup' and value > 100").select(F.col("user_id").alias("c_custkey")).distinct()
    once = c.groupBy(F.lower("c_name").alias("low")).agg(F.count("*").alias("n")).where("n = 1").select("low")
    left = store.without(c, gone, "c_custkey", [])[0]
    return left.withColumn("low", F.lower("c_name")).join(once, "low", "left_semi").select("c_custkey", "c_name")


@query("SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'unavailable' WHEN event_type = 'signup' THEN 'waiting' WHEN value > 200 THEN 'stale' WHEN value > 60 THEN 'poor' ELSE 'good' END AS quality FROM events")
def stm_08_fix_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.positions import fix_quality

    q = fix_quality(available=F.col("user_id") % 7 != 0, fixed=F.col("event_type") != "signup", age_s=F.col("value"), accuracy_m=F.col("value"), most_age_s=200, most_accuracy_m=60)
    return _events(spark, sf_dir).select("event_id", q.alias("quality"))


@query(views.sql("""SELECT user_id, revision FROM (SELECT user_id, revision, max(CASE WHEN kind = 'purchase' THEN revision END) OVER (PARTITION BY user_id) AS reached FROM journal) WHERE revision <= reached""", "journal"))
def stm_09_back_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving at a stop marks all stops before it."""
    reached = F.max(F.when(F.col("kind") == "purchase", F.col("revision"))).over(Window.partitionBy("user_id"))
    return views.journal(spark, sf_dir).withColumn("reached", reached).where("revision <= reached").select("user_id", "revision")


@query("SELECT user_id, band, min(ts) AS said FROM (SELECT user_id, ts, CASE WHEN value <= 10 THEN 0 WHEN value <= 30 THEN 10 WHEN value <= 80 THEN 30 ELSE 80 END AS band FROM events WHERE event_type <> 'error') GROUP BY user_id, band")
def stm_10_announced_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distance band is announced once, never on a bad fix."""
    v = F.col("value")
    band = F.when(v <= 10, 0).when(v <= 30, 10).when(v <= 80, 30).otherwise(80)
    return _events(spark, sf_dir).where("event_type <> 'error'").groupBy("user_id", band.alias("band")).agg(F.min("ts").alias("said"))


@query(views.sql(""", f AS (SELECT *, CASE WHEN value > 60 THEN 1 ELSE 0 END AS off FROM journal WHERE kind <> 'error'), b AS (SELECT *, sum(1 - off) OVER (PARTITION BY user_id ORDER BY revision) AS block FROM f)
SELECT user_id, revision, CAST(sum(off) OVER (PARTITION BY user_id, block ORDER BY revision) AS BIGINT) AS run, sum(off) OVER (PARTITION BY user_id, block ORDER BY revision) >= 2 AS off_route FROM b""", "journal"))
def stm_11_off_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Off the route only after two good fixes in a row that are too far."""
    good = views.journal(spark, sf_dir).where("kind <> 'error'")
    return measures.run_lengths(good, "user_id", ["revision"], F.col("value") > 60).select("user_id", "revision", "run", (F.col("run") >= 2).alias("off_route"))


@query("SELECT user_id, max_by(event_type, [epoch_us(ts), event_id]) AS stage, max(ts) AS seen, bool_or(event_type = 'error') AS finished FROM events GROUP BY user_id")
def stm_01_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage of each run as the stream would leave it, in batch."""
    e = _events(spark, sf_dir)
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("stage"), F.max("ts").alias("seen"), F.bool_or(F.col("event_type") == "error").alias("finished"))


@query("SELECT user_id, min(ts) AS started, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, s")
def stm_05_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions end after six hours without an event."""
    e = _events(spark, sf_dir)
    by = e.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.min("ts").alias("started"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return by.select("user_id", "started", "last", "n")


@query(views.sql(f"SELECT j.event_id, s.service_id, round({views.haversine_sql('j.lat', 'j.lon', 's.lat', 's.lon')}, 1) AS metres FROM (SELECT event_id, {views.lat_sql('event_id * 17')} AS lat, {views.lon_sql('event_id * 17')} AS lon FROM events) j JOIN services s ON {views.haversine_sql('j.lat', 'j.lon', 's.lat', 's.lon')} <= 400", "services"))
def stm_06_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of a feed joined to the stops that they have arrived at."""
    from ..operators import spatial

    k = F.col("event_id") * 17
    feed = _events(spark, sf_dir).select("event_id", views.lat_of(k).alias("lat"), views.lon_of(k).alias("lon"))
    right = views.services(spark, sf_dir).select("service_id", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    return spatial.radius_join(feed, right, 400.0).select("event_id", "service_id", F.round("metres", 1).alias("metres"))


@query("SELECT user_id, key, max(ts) AS ts FROM (SELECT user_id, ts, sha256(user_id || '|' || event_type || '|' || CAST(floor(value) AS BIGINT)) AS key FROM events) GROUP BY user_id, key")
def stm_02_03_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements by a key of all that they depend on; the latest of a key is what a cache would hold."""
    key = F.sha2(F.concat_ws("|", "user_id", "event_type", F.floor("value").cast("long")), 256)
    return _events(spark, sf_dir).groupBy("user_id", key.alias("key")).agg(F.max("ts").alias("ts"))


@query(views.sql("SELECT place_id FROM places WHERE contains(lower(name), 'ri') OR contains(lower(town), 'ri') OR contains(category, 'ri') ORDER BY place_id LIMIT 200", "places"))
def cli_06_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search on a page shows the first two hundred (also MSC-19)."""
    from ..operators.filters import any_column_contains

    return views.places(spark, sf_dir).where(any_column_contains({"name": "ri", "town": "ri", "category": "ri"})).orderBy("place_id").limit(200).select("place_id")


@query(views.sql("SELECT place_id FROM places WHERE contains(lower(name), 'bolt') AND place_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase') ORDER BY name, place_id LIMIT 30", "places"))
def cli_07_unvisited(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("user_id").alias("place_id")).distinct()
    return views.places(spark, sf_dir).where(F.contains(F.lower("name"), F.lit("bolt"))).join(seen, "place_id", "left_anti").orderBy("name", "place_id").limit(30).select("place_id")


@query(views.sql("SELECT user_id, min_by(event_id, [value, event_id]) AS next_hint FROM events WHERE value > 20 AND value <= 140 AND event_type <> 'view' GROUP BY user_id", "places"))
def cli_08_next_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest ahead within a hundred and twenty metres that was not hinted yet."""
    ahead = _events(spark, sf_dir).where("value > 20 and value <= 140 and event_type <> 'view'")
    return ahead.groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("next_hint"))


@query("SELECT user_id, event_type, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS INTEGER) AS place FROM (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY user_id, event_type) QUALIFY place <= 3")
def cli_11_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest of a user's queries, each once."""
    from ..operators.retrieval import top_per

    once = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max("ts").alias("ts"))
    return top_per(once, ["user_id"], [F.desc("ts"), F.col("event_type")], 3, "place")


@query("SELECT user_id, count(*) AS n, max(ts) AS last FROM events WHERE event_type = 'purchase' GROUP BY user_id ORDER BY last DESC, user_id")
def msc_05_visited_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last")).orderBy(F.desc("last"), "user_id")


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'unknown case' ELSE 'scored' END AS verdict, CASE WHEN c_custkey IS NOT NULL THEN o_totalprice / 2 END AS score FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 13 <> 0) ON c_custkey = o_custkey")
def msc_09_rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers scored anew; those of an unknown case are errors, not dropped (also MSC-17)."""
    c = views.read(spark, sf_dir, "customer").where("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    o = views.read(spark, sf_dir, "orders").join(c, "o_custkey", "left")
    return o.select("o_orderkey", F.when(F.col("known").isNull(), "unknown case").otherwise("scored").alias("verdict"), F.when(F.col("known").isNotNull(), F.col("o_totalprice") / 2).alias("score"))


@query(views.sql("SELECT place_id, json_extract_string(j, '$.name') AS name, json_extract_string(j, '$.at[0]') AS lat FROM (SELECT place_id, '{\"name\":\"' || name || '\",\"at\":[\"' || printf('%.3f', lat) || '\"]}' AS j FROM places)", "places"))
def msc_03_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested payloads to JSON and read back (also MSC-04)."""
    body = F.to_json(F.struct("name", F.array(F.format_string("%.3f", "lat")).alias("at")))
    return views.places(spark, sf_dir).select("place_id", body.alias("j")).select("place_id", F.get_json_object("j", "$.name").alias("name"), F.get_json_object("j", "$.at[0]").alias("lat"))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type) FILTER (WHERE event_type <> 'error' OR value > 50)), ',') AS reading, bool_or(event_type = 'error' AND value > 50) AS forbidden FROM events GROUP BY user_id")
def msc_10_11_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading against what is forbidden."""
    kept = F.when((F.col("event_type") != "error") | (F.col("value") > 50), F.col("event_type"))
    by = _events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_set(kept)).alias("r"), F.bool_or((F.col("event_type") == "error") & (F.col("value") > 50)).alias("forbidden"))
    return by.select("user_id", F.when(F.size("r") > 0, F.array_join("r", ",")).alias("reading"), "forbidden")


@query(views.sql("SELECT q.query_id, p.place_id, CASE WHEN a.rings IS NULL THEN 'unscoped' ELSE 'scoped' END AS provenance FROM (SELECT 1 AS query_id, 'area-1' AS code UNION ALL SELECT 2, 'area-4') q JOIN areas a USING (code), places p WHERE p.category = 'promo' AND (a.rings IS NULL OR " + views.in_area_sql("p.lat", "p.lon", "a") + ")", "places", "areas"))
def msc_16_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search scoped by an area; one without a polygon is searched unscoped, and says so."""
    from ..operators import spatial

    p = views.places(spark, sf_dir).where("category = 'promo'").select("place_id", "lat", "lon")
    asked = spark.createDataFrame([(1, "area-1"), (2, "area-4")], "query_id int, code string").join(views.areas(spark, sf_dir), "code")
    scoped = spatial.inside(p, asked.select("query_id", "rings", "holes")).select("query_id", "place_id", F.lit("scoped").alias("provenance"))
    open_ = asked.where("rings is null").select("query_id")
    return scoped.unionByName(p.join(small_side(open_), F.lit(True)).select("query_id", "place_id", F.lit("unscoped").alias("provenance")))


@query(views.sql("SELECT route_id, ordinal, round(along, 1) AS metres FROM (SELECT route_id, ordinal, sum(m) OVER (PARTITION BY route_id ORDER BY ordinal) - m + m / 2 AS along FROM (SELECT route_id, ordinal, CAST(111194.92664455873 AS DOUBLE) * sqrt(pow((lon2 - lon) * cos(radians((lat + lat2) / 2)), 2) + pow(lat2 - lat, 2)) AS m FROM (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM stops WINDOW w AS (PARTITION BY route_id ORDER BY ordinal)) WHERE lat2 IS NOT NULL))", "stops"))
def msc_20_manoeuvres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where along the walk the middle of each leg lies."""
    from ..operators import spatial

    legs = spatial.segments(views.stops(spark, sf_dir), "route_id", "ordinal")
    return legs.select("route_id", F.col("seq").alias("ordinal"), F.round(F.col("before") + F.col("metres") / 2, 1).alias("metres"))


CHANGES_SQL = """changes AS (SELECT event_id + 1 AS change_id, (event_id * 31) % (SELECT 2 * count(*) // 3 FROM part) AS place_id, CASE event_id % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'delete' ELSE 'update' END AS op,
  CASE WHEN event_id % 7 <> 0 THEN 'name ' || event_id END AS name, 'kind ' || event_id % 4 AS category, 'town ' || event_id % 3 AS town, CASE event_id % 4 WHEN 0 THEN ['name'] WHEN 1 THEN ['category', 'town'] WHEN 2 THEN ['town'] ELSE ['name', 'category'] END AS sets FROM events)"""
#: One change after another: of each key the last row so far, and what the change makes of it.
APPLIED_SQL = f""", {CHANGES_SQL}, ordered AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY change_id) AS n FROM changes),
start AS (SELECT place_id, name, category, town, owner, 'v' || place_id AS vector FROM places),
steps AS (SELECT k.place_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS change_id, CAST(NULL AS VARCHAR) AS outcome, s.place_id IS NOT NULL AS here, s.name, s.category, s.town, s.owner, s.vector, false AS was, CAST(NULL AS VARCHAR) AS old_name
    FROM (SELECT DISTINCT place_id FROM changes UNION SELECT place_id FROM start) k LEFT JOIN start s USING (place_id)
  UNION ALL SELECT p.place_id, c.n, c.change_id,
    CASE WHEN c.op = 'create' THEN CASE WHEN p.here THEN 'duplicate' ELSE 'created' END WHEN NOT p.here THEN 'missing' ELSE c.op || 'd' END, c.op = 'create' OR (p.here AND c.op = 'update'),
    CASE WHEN c.op = 'create' AND NOT p.here OR c.op = 'update' AND p.here AND list_contains(c.sets, 'name') THEN c.name ELSE p.name END,
    CASE WHEN c.op = 'create' AND NOT p.here OR c.op = 'update' AND p.here AND list_contains(c.sets, 'category') THEN c.category ELSE p.category END,
    CASE WHEN c.op = 'create' AND NOT p.here OR c.op = 'update' AND p.here AND list_contains(c.sets, 'town') THEN c.town ELSE p.town END,
    CASE WHEN c.op = 'create' AND NOT p.here OR c.op = 'update' AND p.here AND list_contains(c.sets, 'category') THEN 'curated' ELSE p.owner END,
    CASE WHEN c.op = 'create' AND NOT p.here OR c.op = 'update' AND p.here THEN NULL ELSE p.vector END, p.here, p.name
  FROM steps p JOIN ordered c ON c.place_id = p.place_id AND c.n = p.n + 1)"""


def _changed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = F.col("event_id")
    n = views.read(spark, sf_dir, "part").count() * 2 // 3
    sets = lambda *names: F.array(*(F.lit(c) for c in names))
    log = views.read(spark, sf_dir, "events").select(
        (e + 1).alias("change_id"), (e * 31 % n).alias("place_id"), F.when(e % 5 == 0, "create").when(e % 5 == 1, "delete").otherwise("update").alias("op"),
        F.when(e % 7 != 0, F.concat(F.lit("name "), e.cast("string"))).alias("name"), F.concat(F.lit("kind "), (e % 4).cast("string")).alias("category"), F.concat(F.lit("town "), (e % 3).cast("string")).alias("town"),
        F.when(e % 4 == 0, sets("name")).when(e % 4 == 1, sets("category", "town")).when(e % 4 == 2, sets("town")).otherwise(sets("name", "category")).alias("sets"),
    )
    rows = views.places(spark, sf_dir).select("place_id", "name", "category", "town", "owner", F.concat(F.lit("v"), F.col("place_id").cast("string")).alias("vector"))
    return store.applied(rows, log, key="place_id", columns=["name", "category", "town"], embedded=["name", "category", "town"])


@query("WITH RECURSIVE " + views.sql(APPLIED_SQL + " SELECT place_id, name, category, town, owner, vector FROM steps WHERE here QUALIFY n = max(n) OVER (PARTITION BY place_id)", "places").removeprefix("WITH ").replace("FROM steps WHERE here QUALIFY n = max(n) OVER (PARTITION BY place_id)", "FROM (SELECT * FROM steps QUALIFY n = max(n) OVER (PARTITION BY place_id)) WHERE here"))
def snk_12_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places after a log of creates, updates and deletes."""
    return _changed(spark, sf_dir)[0]


@query("WITH RECURSIVE " + views.sql(APPLIED_SQL + " SELECT change_id, place_id, outcome, CASE WHEN was THEN old_name END AS before, CASE WHEN here THEN name END AS after, CASE WHEN here THEN owner END AS owner FROM steps WHERE n > 0", "places").removeprefix("WITH "))
def snk_12_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every change of the log did, and the names before and after it."""
    return _changed(spark, sf_dir)[1].select("change_id", "place_id", "outcome", F.col("before.name").alias("before"), F.col("after.name").alias("after"), "after.owner")


@query("""WITH n AS (SELECT * FROM nation WHERE n_regionkey <> 1), c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
s AS (SELECT s_suppkey, CASE WHEN s_nationkey IN (SELECT n_nationkey FROM n) THEN s_nationkey END AS s_nationkey FROM supplier)
SELECT 'region' AS kind, count(*) AS n, sum(r_regionkey) AS keys FROM region WHERE r_regionkey <> 1 UNION ALL SELECT 'nation', count(*), sum(n_nationkey) FROM n UNION ALL SELECT 'customer', count(*), sum(c_custkey) FROM c
UNION ALL SELECT 'orders', count(*), sum(o_orderkey) FROM o UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) UNION ALL SELECT 'supplier', count(*), sum(s_nationkey) FROM s""")
def snk_16_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region deleted with its nations, their customers, orders and lines; its suppliers stay, without a nation."""
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "supplier": "s_suppkey"}
    tables = {t: views.read(spark, sf_dir, t) for t in keys}
    links = [("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("orders", "o_custkey", "customer"), ("lineitem", "l_orderkey", "orders")]
    links = [store.Reference(*x) for x in links] + [store.Reference("supplier", "s_nationkey", "nation", cascade=False)]
    left = store.cascaded(tables, keys, links, {"region": tables["region"].where("r_regionkey = 1").select("r_regionkey")})
    each = [df.agg(F.lit(t).alias("kind"), F.count("*").alias("n"), F.sum("s_nationkey" if t == "supplier" else keys[t]).alias("keys")) for t, df in left.items()]
    return reduce(DataFrame.unionByName, each)
