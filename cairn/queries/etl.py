"""Seeding the catalogue (SRC shapes over tables, FLT-13 to FLT-16, SNK, AGG-01, AGG-06, SET)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import text
from ..operators import etl
from .registry import query

RAW = """SELECT p_partkey AS place_id, CASE WHEN p_partkey % 23 = 0 THEN ' ' ELSE p_name END AS name, p_partkey % 19 <> 0 AS category_known,
  CASE WHEN p_partkey % 17 = 0 THEN 'x' WHEN p_partkey % 29 = 0 THEN '95.5' ELSE '53.5' END AS lat, '24.25' AS lon,
  CASE WHEN p_partkey % 13 = 0 THEN '[1' WHEN p_partkey % 2 = 0 THEN '["a"]' END AS facts, CASE WHEN p_partkey % 31 = 0 THEN 'bad:' ELSE 'src:' END || p_partkey AS source_url,
  CASE WHEN p_partkey % 11 = 0 THEN '1.5h' WHEN p_partkey % 3 = 0 THEN '40' END AS visit_minutes FROM part"""
FOUND = """, found AS (SELECT place_id, list_filter([CASE WHEN trim(name) = '' THEN 'name missing' END, CASE WHEN NOT category_known THEN 'unknown category' END, CASE WHEN lat = 'x' THEN 'coordinates not numeric' END,
  CASE WHEN lat = '95.5' THEN 'coordinates out of range' END, CASE WHEN facts IS NOT NULL AND NOT json_valid(facts) THEN 'facts not JSON' END, CASE WHEN NOT starts_with(source_url, 'src:') THEN 'key prefix' END,
  CASE WHEN visit_minutes = '1.5h' THEN 'minutes not whole' END], lambda x: x IS NOT NULL) AS p FROM raw)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.read(spark, sf_dir, "part").createOrReplaceTempView("part_rows")
    return spark.sql(RAW.replace("FROM part", "FROM part_rows"))


@query(f"WITH raw AS ({RAW}){FOUND} SELECT place_id, array_to_string(p, '; ') AS problems FROM found")
def flt_13_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("place_id", F.array_join(etl.row_problems(), "; ").alias("problems"))


@query("WITH " + views.sql("", "areas").removeprefix("WITH ").rstrip() + f""", raw AS ({RAW}){FOUND}, placed AS (SELECT place_id, {views.lat_sql("place_id")} AS lat, {views.lon_sql("place_id")} AS lon FROM raw),
binned AS (SELECT len(p) AS n, EXISTS (SELECT 1 FROM areas a WHERE a.rings IS NOT NULL AND a.kind = 'district' AND {views.in_area_sql("l.lat", "l.lon", "a")}) AS inside FROM found JOIN placed l USING (place_id))
SELECT bin, count(*) AS n FROM (SELECT CASE WHEN NOT inside THEN 'geofence' WHEN n = 0 THEN 'valid' ELSE 'invalid' END AS bin FROM binned) GROUP BY bin""")
def flt_14_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by bin; a point outside the project's areas (here the districts) is a bin of its own."""
    k = F.col("place_id")
    at = etl.fenced(_raw(spark, sf_dir).select("place_id", views.lat_of(k).alias("lat"), views.lon_of(k).alias("lon")), views.areas(spark, sf_dir).where("kind = 'district'"), "place_id")
    rows = _raw(spark, sf_dir).join(at.select("place_id", "fenced"), "place_id")
    return etl.quarantined(rows, etl.row_problems(), F.col("fenced")).groupBy("bin").agg(F.count("*").alias("n"))


@query(f"WITH raw AS ({RAW}) SELECT place_id, nullif(trim(name), '') AS name, TRY_CAST(visit_minutes AS INTEGER) AS minutes, TRY_CAST(lat AS DOUBLE) AS lat FROM raw")
def flt_15_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed, empty to null, cast; a zero stays a zero."""
    return _raw(spark, sf_dir).select("place_id", text.blank_to_null(F.col("name")).alias("name"), F.expr("try_cast(visit_minutes as int)").alias("minutes"), F.expr("try_cast(lat as double)").alias("lat"))


@query(views.sql("SELECT place_id FROM places WHERE name NOT IN ('small ring', 'blue bolt')", "places"))
def flt_16_excluded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.createDataFrame([(" Small  RING!",), ("blue bolt",)], "name string").select(text.matched_name(F.col("name")).alias("norm"))
    return views.places(spark, sf_dir).withColumn("norm", text.matched_name(F.col("name"))).join(out, "norm", "left_anti").select("place_id")


OLD_NEW = """, old AS (SELECT source_url, name, category, owner, 'v' || place_id AS vector FROM places WHERE place_id % 4 <> 0),
new AS (SELECT source_url, CASE WHEN place_id % 6 = 0 THEN name || ' new' ELSE name END AS name, CASE WHEN place_id % 9 = 0 THEN 'changed' ELSE category END AS category, CASE WHEN place_id % 2 = 0 THEN 'auto' ELSE owner END AS owner FROM places WHERE place_id % 5 <> 0)"""


@query(views.sql(OLD_NEW + """, b AS (SELECT source_url, o.name AS o_name, o.category AS o_category, o.owner AS o_owner, o.vector, n.name AS n_name, n.category AS n_category, n.owner AS n_owner, o.owner IS NOT NULL AND n.owner IS NOT NULL AND o.owner <> 'auto' AND n.owner = 'auto' AS guarded
  FROM old o FULL JOIN new n USING (source_url)), r AS (SELECT source_url, coalesce(n_name, o_name) AS name, CASE WHEN n_name IS NOT NULL AND NOT guarded THEN n_category ELSE o_category END AS category, CASE WHEN n_name IS NOT NULL AND NOT guarded THEN n_owner ELSE o_owner END AS owner, b.* EXCLUDE (source_url) FROM b)
SELECT source_url, name, category, owner, CASE WHEN name = o_name AND category = o_category THEN vector END AS vector, CASE WHEN o_name IS NULL THEN 'inserted' WHEN n_name IS NULL OR (name = o_name AND category = o_category AND owner = o_owner) THEN 'kept' ELSE 'updated' END AS change FROM r""", "places"))
def snk_01_guarded_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A protected category survives an automatic writer; a stale vector goes (also SNK-12, SNK-17)."""
    p, k = views.places(spark, sf_dir), F.col("place_id")
    old = p.where(k % 4 != 0).select("source_url", "name", "category", "owner", F.concat(F.lit("v"), k.cast("string")).alias("vector"))
    new = p.where(k % 5 != 0).select("source_url", F.when(k % 6 == 0, F.concat("name", F.lit(" new"))).otherwise(F.col("name")).alias("name"), F.when(k % 9 == 0, "changed").otherwise(F.col("category")).alias("category"), F.when(k % 2 == 0, "auto").otherwise(F.col("owner")).alias("owner"))
    return etl.guarded_upsert(old, new, "source_url")


@query(views.sql("SELECT split_part(source_url, ':', 1) AS provider, split_part(source_url, ':', 2) AS external_id, max(place_id) AS place_id FROM places GROUP BY ALL", "places"))
def snk_02_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage by provider and outer id."""
    part = lambda n: F.split_part("source_url", F.lit(":"), F.lit(n))
    return views.places(spark, sf_dir).groupBy(part(1).alias("provider"), part(2).alias("external_id")).agg(F.max("place_id").alias("place_id"))


LOST = """, lost AS (SELECT place_id AS loser, CASE WHEN place_id % 10 = 0 THEN place_id + 1 WHEN place_id % 30 = 1 THEN place_id + 6 ELSE place_id - 3 END AS keeper FROM places WHERE place_id % 10 = 0 OR place_id % 30 = 1 OR place_id % 90 = 7),
  chains AS (SELECT loser, keeper, 1 AS n FROM lost UNION ALL SELECT c.loser, l.keeper, n + 1 FROM chains c JOIN lost l ON l.loser = c.keeper)
SELECT p.source_url, coalesce(l.keeper, p.place_id) AS place_id FROM places p LEFT JOIN (SELECT loser, max_by(keeper, n) AS keeper FROM chains GROUP BY loser) l ON l.loser = p.place_id"""


@query("WITH RECURSIVE " + views.sql(LOST, "places").removeprefix("WITH "))
def snk_03_repointed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage of losers points to the survivors at the end of their chains."""
    from ..operators import resolve

    k = F.col("place_id")
    p = views.places(spark, sf_dir).select("place_id", "source_url")
    keeper = F.when(k % 10 == 0, k + 1).when(k % 30 == 1, k + 6).otherwise(k - 3)
    lost = resolve.final_keepers(p.where((k % 10 == 0) | (k % 30 == 1) | (k % 90 == 7)).select("place_id", keeper.alias("keeper")))
    return p.join(lost, "place_id", "left").select("source_url", F.coalesce("keeper", "place_id").alias("place_id"))


@query(views.sql("SELECT owner, count(*) AS n, count(*) FILTER (WHERE file IS NULL) AS unknown FROM (SELECT CASE WHEN owner = 'curated' THEN CASE WHEN place_id % 3 <> 0 THEN 'manual' END ELSE owner END AS owner, CASE WHEN place_id % 3 <> 0 THEN 'f' END AS file FROM places) GROUP BY owner", "places"))
def snk_05_reset_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated rows go back to their file's owner; those without a file are counted."""
    p = views.places(spark, sf_dir)
    files = p.where("place_id % 3 <> 0").select("place_id", F.lit("manual").alias("file_owner"))
    back = F.when(F.col("owner") == "curated", F.col("file_owner")).otherwise(F.col("owner"))
    return p.join(files, "place_id", "left").groupBy(back.alias("owner")).agg(F.count("*").alias("n"), F.count_if(F.col("file_owner").isNull()).alias("unknown"))


@query(views.sql("""SELECT place_id, lower(alias) AS alias, locale, source FROM (SELECT *, row_number() OVER (PARTITION BY place_id, lower(alias), locale ORDER BY source <> 'file-a') AS r FROM (
  SELECT * FROM aliases WHERE source <> 'file-b' UNION ALL SELECT place_id, name, 'en', 'file-b' FROM places WHERE place_id % 4 = 0 UNION ALL SELECT place_id, split_part(name, ' ', 1), 'en', 'file-b' FROM places WHERE place_id % 8 = 0)) WHERE r = 1""", "aliases", "places"))
def snk_06_replace_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All aliases of one file replaced; one that another file has stays with that file."""
    p = views.places(spark, sf_dir)
    en, src = F.lit("en").alias("locale"), F.lit("file-b").alias("source")
    new = p.where("place_id % 4 = 0").select("place_id", F.col("name").alias("alias"), en, src).unionByName(p.where("place_id % 8 = 0").select("place_id", F.split("name", " ")[0].alias("alias"), en, src))
    low = lambda df: df.withColumn("alias", F.lower("alias"))
    return etl.replace_source(low(views.aliases(spark, sf_dir)), low(new), "file-b", ["place_id", "alias", "locale"]).select("place_id", "alias", "locale", "source")


@query(views.sql(""", declared AS (SELECT code FROM categories WHERE length(code) > 5 UNION ALL SELECT 'new')
SELECT coalesce(c.code, d.code) AS code, CASE WHEN d.code IS NULL THEN 'deleted' WHEN c.code IS NULL THEN 'inserted' ELSE 'kept' END AS change FROM categories c FULL JOIN declared d ON c.code = d.code""", "categories"))
def snk_07_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file is the whole truth."""
    old = views.categories(spark, sf_dir).select("code")
    new = old.where("length(code) > 5").unionByName(spark.createDataFrame([("new",)], "code string"))
    return etl.registry_write(old, new, "code")


@query(views.sql("SELECT place_id, CASE WHEN owner = 'auto' AND place_id % 3 = 0 THEN 'corrected' ELSE category END AS category FROM places", "places"))
def snk_08_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correction applies to automatic rows only (also SNK-09, J-31)."""
    p = views.places(spark, sf_dir)
    hints = p.where("place_id % 3 = 0").select("place_id", F.lit("corrected").alias("category"))
    return etl.overlay(p.select("place_id", "owner", "category"), hints, "place_id", "category", only=F.col("owner") == "auto").select("place_id", "category")


@query(views.sql("""SELECT place_id FROM places WHERE NOT (owner = 'auto' AND place_id % 4 <> 0 AND place_id NOT IN (SELECT place_id FROM stops WHERE route_id % 50 = 0) AND place_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase'))""", "places", "stops"))
def snk_10_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic rows in no file, not visited and in no walk go (also J-08)."""
    p = views.places(spark, sf_dir).select("place_id", "owner")
    walks = views.stops(spark, sf_dir).where("route_id % 50 = 0").select("place_id")
    seen = views.read(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("place_id"))
    return etl.pruned(p, p.where("place_id % 4 = 0"), [walks, seen], "place_id").select("place_id")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IS DISTINCT FROM substr(o_orderpriority, 1, 1) THEN TIMESTAMP '2024-01-01 00:00:00' ELSE o_orderdate END AS stamped FROM orders")
def snk_11_version_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A time stamp moves only if the version differs, nulls included."""
    o = views.read(spark, sf_dir, "orders")
    kind = o.schema["o_orderdate"].dataType
    same = F.col("o_orderstatus").eqNullSafe(F.substring("o_orderpriority", 1, 1))
    return o.select("o_orderkey", F.when(same, F.col("o_orderdate")).otherwise(F.lit("2024-01-01 00:00:00").cast(kind)).alias("stamped"))


@query(views.sql("SELECT owner, count(*) AS n, count(*) FILTER (WHERE visit_minutes IS NULL) AS no_minutes, sum(count(*)) OVER () AS total FROM places GROUP BY owner", "places"))
def agg_01_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by owner, nulls, and the total."""
    from pyspark.sql import Window

    by = views.places(spark, sf_dir).groupBy("owner").agg(F.count("*").alias("n"), F.count_if(F.col("visit_minutes").isNull()).alias("no_minutes"))
    return by.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))).cast("decimal(38,0)"))


@query(views.sql("SELECT coalesce(town, '—') AS town, count(*) AS n, round(count(visit_minutes) / count(*), 4) AS filled_minutes, round(count(*) FILTER (WHERE ticket <> '') / count(*), 4) AS filled_ticket FROM (SELECT CASE WHEN place_id % 37 <> 0 THEN town END AS town, visit_minutes, ticket FROM places) GROUP BY 1", "places"))
def agg_06_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.coverage(views.places(spark, sf_dir).withColumn("town", F.when(F.col("place_id") % 37 != 0, F.col("town"))), "town")


@query(views.sql("SELECT source_url, name, CAST(f AS INTEGER) AS f FROM (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY f) AS r FROM (SELECT source_url, name || '-a' AS name, 0 AS f FROM places WHERE place_id % 2 = 0 UNION ALL SELECT source_url, name || '-b', 1 FROM places WHERE place_id % 3 = 0)) WHERE r = 1", "places"))
def set_01_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets in the order they are applied; the first that has a key wins (also J-25, J-34, WIN-06)."""
    p = views.places(spark, sf_dir)
    a = p.where("place_id % 2 = 0").select("source_url", F.concat("name", F.lit("-a")).alias("name"), F.lit(0).alias("f"))
    b = p.where("place_id % 3 = 0").select("source_url", F.concat("name", F.lit("-b")).alias("name"), F.lit(1).alias("f"))
    return etl.first_wins([a, b], ["source_url"], []).select("source_url", "name", "f")


@query(views.sql("""SELECT a.route_id AS a, b.route_id AS b, CAST(len(list_intersect(a.s, b.s)) AS INTEGER) AS shared, round(CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 6) AS jaccard
FROM (SELECT route_id, list(DISTINCT place_id) AS s FROM stops GROUP BY route_id) a JOIN (SELECT route_id, list(DISTINCT place_id) AS s FROM stops GROUP BY route_id) b ON b.route_id = a.route_id + 1""", "stops"))
def set_03_05_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared stops of neighbouring walks, and their Jaccard share."""
    s = views.stops(spark, sf_dir).groupBy("route_id").agg(F.collect_set("place_id").alias("s"))
    t = s.select((F.col("route_id") - 1).alias("route_id"), F.col("route_id").alias("b"), F.col("s").alias("t"))
    return s.join(t, "route_id").select(F.col("route_id").alias("a"), "b", F.size(F.array_intersect("s", "t")).alias("shared"), F.round(text.jaccard(F.col("s"), F.col("t")), 6).alias("jaccard"))


@query(views.sql("SELECT coalesce(o.place_id, n.place_id) AS place_id, CASE WHEN o.place_id IS NULL THEN 'added' WHEN n.place_id IS NULL THEN 'removed' ELSE 'kept' END AS change FROM (SELECT place_id FROM places WHERE place_id % 3 <> 0) o FULL JOIN (SELECT place_id FROM places WHERE place_id % 4 <> 0) n USING (place_id)", "places"))
def j_24_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, removed, kept between two answers (also SET-02, J-28)."""
    p = views.places(spark, sf_dir)
    o = p.where("place_id % 3 <> 0").select("place_id", F.lit(1).alias("o"))
    n = p.where("place_id % 4 <> 0").select("place_id", F.lit(1).alias("n"))
    return o.join(n, "place_id", "full_outer").select("place_id", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("kept").alias("change"))


@query(views.sql("""SELECT p.place_id, coalesce(d.code, c.code, n.code) AS district FROM places p LEFT JOIN (SELECT place_id, 'derived' AS code FROM places WHERE place_id % 3 = 0) d USING (place_id) LEFT JOIN (SELECT place_id, 'carried' AS code FROM places WHERE place_id % 2 = 0) c USING (place_id), (SELECT 'nearest' AS code) n""", "places"))
def j_35_carried_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived, else carried over from the previous file, else the nearest."""
    p = views.places(spark, sf_dir).select("place_id")
    d = p.where("place_id % 3 = 0").withColumn("derived", F.lit("derived"))
    c = p.where("place_id % 2 = 0").withColumn("carried", F.lit("carried"))
    return p.join(d, "place_id", "left").join(c, "place_id", "left").select("place_id", F.coalesce("derived", "carried", F.lit("nearest")).alias("district"))


@query("SELECT substr(sha256(string_agg(h, '' ORDER BY item_id)), 1, 16) AS digest FROM (SELECT item_id, sha256(CAST(item_id AS VARCHAR) || ':' || text) AS h FROM benchmark)")
def agg_32_content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest over a small set of files, in a fixed order."""
    b = views.read(spark, sf_dir, "benchmark").select("item_id", F.sha2(F.concat(F.col("item_id").cast("string"), F.lit(":"), "text"), 256).alias("h"))
    return b.agg(F.array_join(F.array_sort(F.collect_list(F.struct("item_id", "h")))["h"], "").alias("all")).select(F.substring(F.sha2("all", 256), 1, 16).alias("digest"))


@query(views.sql("SELECT place_id, sha256(name || '|' || category || '|' || town) AS key FROM places", "places"))
def hsh_01_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.places(spark, sf_dir).select("place_id", F.sha2(F.concat_ws("|", "name", "category", "town"), 256).alias("key"))


@query(views.sql(f"SELECT place_id, EXISTS (SELECT 1 FROM areas a WHERE a.rings IS NOT NULL AND a.kind = 'region' AND {views.in_area_sql('lat', 'lon', 'a')}) AS fenced FROM places", "places", "areas"))
def flt_13_geofence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a place lies in the project's areas (here the regions)."""
    return etl.fenced(views.places(spark, sf_dir).select("place_id", "lat", "lon"), views.areas(spark, sf_dir).where("kind = 'region'"), "place_id").select("place_id", "fenced")


@query(views.sql("SELECT 1 AS asked, place_id FROM places WHERE category = 'promo' UNION ALL SELECT 2, place_id FROM places WHERE category = 'promo' AND town = 'Brand#1' UNION ALL SELECT 3, place_id FROM places", "places"))
def flt_08_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters that an empty text switches off: one, both, none."""
    from ..operators.filters import given

    p = views.places(spark, sf_dir)
    asked = [("promo", ""), ("promo", "Brand#1"), ("", "")]
    each = [p.where(given(category=c, town=t)).select(F.lit(i + 1).alias("asked"), "place_id") for i, (c, t) in enumerate(asked)]
    return each[0].unionByName(each[1]).unionByName(each[2])


CURATED = """, cascade AS ({cascade}), met AS (SELECT place_id, min(wanted_id) AS wanted_id FROM cascade WHERE place_id IS NOT NULL GROUP BY place_id)
SELECT p.place_id, CASE WHEN m.place_id IS NULL THEN p.name ELSE w.wanted END AS name, CASE WHEN m.place_id IS NULL THEN p.category ELSE 'curated sight' END AS category,
  CASE WHEN m.place_id IS NULL THEN p.owner ELSE 'curated' END AS owner, CASE WHEN m.place_id IS NULL OR (w.wanted = p.name AND p.category = 'curated sight') THEN 'v' || p.place_id END AS vector
FROM places p LEFT JOIN met m ON m.place_id = p.place_id LEFT JOIN wanted w ON w.wanted_id = m.wanted_id"""


def _curated_sql() -> str:
    from .spatial import CASCADE

    steps, _, cascade = CASCADE.rpartition("\n)\n")
    return views.sql(steps + "\n)" + CURATED.format(cascade=cascade), "places")


@query(_curated_sql())
def snk_04_curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated rows over the places that their names mean (J-14)."""
    from ..operators import resolve
    from .spatial import wanted_names

    p = views.places(spark, sf_dir).select("place_id", "name", "category", "lat", "lon", "owner", F.concat(F.lit("v"), F.col("place_id").cast("string")).alias("vector"))
    curated = wanted_names(spark, sf_dir).select(F.col("wanted_id").alias("curated_id"), F.col("wanted").alias("name"), F.lit("curated sight").alias("category"))
    rows, _, _ = resolve.curated_overlay(p, curated, columns=["name", "category"], spread_m=20_000.0)
    return rows.select("place_id", "name", "category", "owner", "vector")
