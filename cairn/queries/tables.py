"""Sources over driver tables: file formats read back from what was written (SRC, SNK-18 to SNK-20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..operators.staging import fresh_path
from ..sources import elements, files
from .registry import query


@query(views.sql("SELECT source_url, name, category, town, round(lat, 4) AS lat, visit_minutes FROM places", "places"))
def src_01_snk_18_place_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places written as a bar-separated file and read back (also FLT-01)."""
    path = fresh_path(spark, "places")
    p = views.places(spark, sf_dir)
    filled = p.select("name", "category", F.lit(None).alias("district"), "town", F.format_string("%.4f", "lat").alias("lat"), F.format_string("%.4f", "lon").alias("lon"), *(F.lit(None).alias(c) for c in ("blurb", "fun_fact", "fun_facts")), "opening_hours", F.col("ticket").alias("ticket_price"), "visit_minutes", F.lit(None).alias("links"), "source_url")
    files.write_places(filled, path)
    return files.read_places(spark, path).select("source_url", "name", "category", "town", F.col("lat").cast("double").alias("lat"), F.expr("try_cast(visit_minutes as int)").alias("visit_minutes"))


@query("SELECT n_regionkey AS parent, CAST(count(*) AS INTEGER) AS n, array_to_string(list(n_name ORDER BY n_name), ',') AS names FROM nation GROUP BY n_regionkey")
def src_18_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child rows attached to their parents; an orphan would be an error."""
    r = views.read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("parent"))
    n = views.read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    out = files.nest(r, n, "parent", "rows").where("rows is not null")
    return out.select("parent", F.size("rows").alias("n"), F.array_join(F.col("rows.name"), ",").alias("names"))


def _reread(spark: SparkSession, r: DataFrame) -> DataFrame:
    """Runs appended as JSON lines, with a torn line among them, and read back."""
    path = fresh_path(spark, "runs")
    files.jsonl_rows(r.select(F.lit("row").alias("record"), F.col("case_id").cast("string").alias("case"), "repeat", F.create_map(F.lit("recall"), F.coalesce("recall", F.lit(-1.0))).alias("metrics")), path)
    spark.createDataFrame([('{"record":"meta"}',), ('{"record":"row","case":"1',)], "value string").write.mode("append").text(path)
    rows = files.read_runs(spark, path)[1]
    return rows.select(F.col("case").cast("long").alias("case"), "repeat", F.round(F.col("metrics")["recall"], 6).alias("recall"))


@query(views.sql("SELECT case_id AS \"case\", repeat, round(coalesce(recall, -1), 6) AS recall FROM runs", "runs"))
def src_19_snk_20_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reread(spark, views.runs(spark, sf_dir))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'k2' END AS unknown FROM events")
def src_20_case_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a JSON text that are not allowed."""
    body = F.when(F.col("event_id") % 3 == 0, F.lit('{"k": 1, "k2": 2}')).otherwise(F.col("props"))
    own = files.unknown_keys(views.read(spark, sf_dir, "events").select("event_id", body.alias("body")), "body", ["k"])
    return own.select("event_id", F.get("unknown", F.lit(0)).alias("unknown"))


@query(views.sql("SELECT DISTINCT route_id, place_id FROM stops WHERE place_id NOT IN (SELECT place_id FROM places WHERE place_id % 9 <> 0)", "stops", "places"))
def src_21_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops of reference walks that no place answers to."""
    p = views.places(spark, sf_dir).where("place_id % 9 <> 0").select("place_id")
    return views.stops(spark, sf_dir).select("route_id", "place_id").join(p, "place_id", "left_anti").distinct()


@query("SELECT unnest([3, 5, 8]) AS id, unnest([53.1, 53.2, 53.3])::DOUBLE AS lat")
def src_23_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays given as parameters become rows."""
    one = spark.range(1).select(F.array(F.lit(3), F.lit(5), F.lit(8)).alias("id"), F.array(F.lit(53.1), F.lit(53.2), F.lit(53.3)).alias("lat"))
    return one.select(F.inline(F.arrays_zip("id", "lat")))


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("place_id")
    tags = F.map_filter(F.create_map(F.lit("name"), F.when(k % 5 != 0, F.col("name")), F.lit("name:ru"), F.when((k % 5 != 0) & (k % 7 != 0), F.concat(F.lit("Место "), "name")), F.lit("amenity"), F.when(k % 4 == 0, "cafe"), F.lit("addr:street"), F.when(k % 8 == 0, F.col("town")), F.lit("tourism"), F.when(k % 3 == 0, "museum").when(k % 3 == 1, "attraction")), lambda n, v: v.isNotNull())
    own = F.when(k % 2 == 0, F.col("lat"))
    return views.places(spark, sf_dir).select(F.when(k % 2 == 0, "node").otherwise("way").alias("type"), k.alias("id"), own.alias("lat"), F.when(k % 2 == 0, F.col("lon")).alias("lon"), F.struct("lat", "lon").alias("center"), tags.alias("tags"))


@query(views.sql("SELECT CASE WHEN place_id % 2 = 0 THEN 'node/' ELSE 'way/' END || place_id AS source_url, 'Место ' || name AS name, CASE WHEN place_id % 3 = 0 THEN 'музей' ELSE 'архитектура' END AS category, round(lat, 6) AS lat FROM places WHERE place_id % 5 <> 0 AND place_id % 7 <> 0 AND place_id % 4 <> 0 AND place_id % 3 < 2", "places"))
def src_12_sights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map elements to sights: own or centre coordinates, category by tags."""
    return elements.sights(_elements(spark, sf_dir)).select("source_url", "name", "category", F.round("lat", 6).alias("lat"))


@query(views.sql("SELECT 'node/' || place_id AS source_url, CASE WHEN place_id % 5 <> 0 AND place_id % 7 <> 0 THEN 'Место ' || name WHEN place_id % 5 <> 0 THEN name WHEN place_id % 8 = 0 THEN 'cafe (' || town || ')' ELSE 'cafe' END AS name, 'cafe' AS category FROM places WHERE place_id % 4 = 0", "places"))
def src_13_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map elements to services; those without a name get a label."""
    return elements.services(_elements(spark, sf_dir)).select("source_url", "name", "category")


@query(views.sql(""", ways AS (SELECT route_id AS way_id, ordinal AS seq, place_id AS node_id FROM stops), nodes AS (SELECT place_id AS node_id, lat, lon FROM places)
SELECT way_id, CAST(count(*) AS INTEGER) AS n, round(first(lat ORDER BY seq), 6) AS lat, round(last(lon ORDER BY seq), 6) AS lon FROM ways JOIN nodes USING (node_id) GROUP BY way_id""", "stops", "places"))
def src_16_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways as ordered references, resolved to their nodes and nested again."""
    ways = views.stops(spark, sf_dir).groupBy(F.col("route_id").alias("way_id")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "place_id")))["place_id"].alias("refs"))
    nodes = views.places(spark, sf_dir).select(F.col("place_id").alias("node_id"), "lat", "lon")
    line = ways.select("way_id", F.posexplode("refs").alias("seq", "node_id")).join(nodes, "node_id").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("line"))
    return line.select("way_id", F.size("line").alias("n"), F.round(F.element_at("line", 1)["lat"], 6).alias("lat"), F.round(F.element_at("line", -1)["lon"], 6).alias("lon"))


@query(views.sql("SELECT place_id, name FROM places WHERE place_id % 10 IN (1, 2) AND place_id < 500", "places"))
def src_17_by_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an extract for a stated list of identities."""
    wanted = spark.range(500).where("id % 10 in (1, 2)").withColumnRenamed("id", "place_id")
    return views.places(spark, sf_dir).select("place_id", "name").join(wanted, "place_id", "left_semi")


def _followed(pages: DataFrame) -> DataFrame:
    """Redirects followed five times at most, by repeated joins. pages: id."""
    to = pages.where("id % 3 = 0 and id > 0").select(F.col("id").alias("at"), F.floor(F.col("id") / 3).alias("next"))
    out = pages.select("id", F.col("id").alias("at"), F.lit(0).alias("hops"))
    for _ in range(5):
        out = out.join(to, "at", "left").select("id", F.coalesce("next", "at").alias("at"), (F.col("hops") + F.col("next").isNotNull().cast("int")).alias("hops"))
    return out.select("id", F.col("at").alias("target"), "hops")


@query("""WITH RECURSIVE r(id, now, hops) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT id, now // 3, hops + 1 FROM r WHERE now % 3 = 0 AND now > 0 AND hops < 5) SELECT id, max_by(now, hops) AS target, CAST(max(hops) AS INTEGER) AS hops FROM r GROUP BY id""")
def src_25_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every page leads."""
    return _followed(views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))


@query(views.sql("SELECT source_url, trim(name) AS name, town AS street, round(lat, 3) AS dist_m FROM places WHERE place_id % 5 <> 0 AND place_id % 7 <> 0", "places"))
def src_08_snk_19_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street hints written as documents and read back; incomplete ones are left out."""
    path, k = fresh_path(spark, "hints"), F.col("place_id")
    rows = views.places(spark, sf_dir).select("source_url", F.when(k % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "name")).alias("name"), F.when(k % 7 != 0, F.col("town")).alias("street"), F.round("lat", 3).alias("dist_m"))
    files.write_documents(rows, path, description="streets")
    return files.read_hints(spark, path, lines=True).select("source_url", "name", "street", "dist_m")


@query(views.sql("""SELECT 'way/' || place_id AS source_url, CASE WHEN place_id % 5 = 0 THEN name WHEN place_id % 4 = 0 THEN 'лестница (' || town || ')' ELSE 'лестница' END AS name, round(lat, 6) AS lat,
  '[' || array_to_string(list_filter([CASE WHEN place_id % 2 = 0 THEN '"handrail=yes (OpenStreetMap)"' END, CASE WHEN place_id % 9 = 0 THEN '"step_count=12 (OpenStreetMap)"' END], lambda x: x IS NOT NULL), ',') || ']' AS facts
FROM places WHERE place_id % 3 = 0 AND lat BETWEEN 53.3 AND 54.2 AND lon BETWEEN 24.0 AND 26.0""", "places"))
def src_14_stairways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map elements to stairways within a box."""
    k = F.col("place_id")
    said = {"highway": F.when(k % 3 == 0, "steps"), "name": F.when(k % 5 == 0, F.col("name")), "addr:street": F.when(k % 4 == 0, F.col("town")), "handrail": F.when(k % 2 == 0, " yes"), "ramp": F.lit(" "), "step_count": F.when(k % 9 == 0, "12")}
    tags = F.map_filter(F.create_map(*(x for n, v in said.items() for x in (F.lit(n), v))), lambda n, v: v.isNotNull())
    ways = views.places(spark, sf_dir).select(F.lit("way").alias("type"), k.alias("id"), F.struct("lat", "lon").alias("center"), tags.alias("tags"))
    found = elements.stairways(ways, south=53.3, west=24.0, north=54.2, east=26.0)
    return found.select("source_url", "name", F.round("lat", 6).alias("lat"), "facts")


SIGHTS = """, sights AS (SELECT CASE WHEN place_id % 2 = 0 THEN 'node/' ELSE 'way/' END || place_id AS source_url, 'Место ' || name AS name, lat, lon
  FROM places WHERE place_id % 5 <> 0 AND place_id % 7 <> 0 AND place_id % 4 <> 0 AND place_id % 3 < 2 AND name <> 'blue bolt')"""


@query(views.sql(SIGHTS + f""", held AS (SELECT source_url, min(code) AS district FROM sights p, areas a WHERE a.rings IS NOT NULL AND {views.in_area_sql('p.lat', 'p.lon', 'a')} GROUP BY source_url),
near AS (SELECT source_url, first(town ORDER BY metres, town) AS town FROM (SELECT source_url, s.name AS town, {views.haversine_sql('p.lat', 'p.lon', 's.lat', 's.lon')} AS metres FROM sights p, services s) WHERE metres <= 5000 GROUP BY source_url)
SELECT source_url, name, coalesce(district, '') AS district, coalesce(town, '') AS town, printf('%.6f', lat) AS lat FROM sights LEFT JOIN held USING (source_url) LEFT JOIN near USING (source_url)""", "places", "areas", "services"))
def msc_15_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, convert, exclude, districts, towns, write: the seed as one plan."""
    from ..plans.seeding import seeded

    towns = views.services(spark, sf_dir).select(F.col("name").alias("town"), "lat", "lon")
    out = spark.createDataFrame([(" Место  BLUE bolt!",)], "name string")
    rows = seeded(_elements(spark, sf_dir), out, views.areas(spark, sf_dir), towns, fresh_path(spark, "seeded"))
    return rows.select("source_url", "name", "district", "town", "lat")


def _as_documents(rows: DataFrame, name: str, *, each: int = 500) -> str:
    """The path of JSON files of one document each, whose one field (name) holds about so many of the rows."""
    path = fresh_path(rows.sparkSession, name)
    count = max(1, -(-rows.count() // each))
    dealt = rows.groupBy(F.pmod(F.xxhash64(*rows.columns), F.lit(count)).alias("k")).agg(F.collect_list(F.struct(*rows.columns)).alias(name))
    dealt.select(name).write.option("maxRecordsPerFile", 1).json(path)
    return path


@query("""SELECT CAST(p_partkey AS INTEGER) AS id, p_name AS name, CASE WHEN p_partkey % 5 <> 0 THEN lower(p_type) END AS category, CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS facts,
  CASE WHEN p_partkey % 2 = 0 THEN 'https://a.example/' || p_partkey || ' https://b.example' ELSE '' END AS links FROM part""")
def src_02_curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated rows written with tails of facts and links, however many, and read back."""
    path, k = fresh_path(spark, "curated"), F.col("p_partkey")
    own = views.read(spark, sf_dir, "part")
    tail = F.concat(F.when(k % 3 == 0, F.lit("|one fact|another")).otherwise(""), F.when(k % 2 == 0, F.concat(F.lit("|https://a.example/"), k.cast("string"), F.lit("|https://b.example"))).otherwise(""))
    line = F.concat(F.concat_ws("|", k.cast("string"), "p_name", F.when(k % 5 != 0, F.lower("p_type")).otherwise(" "), F.lit("blurb"), F.lit("")), tail)
    own.select(line.alias("value")).write.text(path)
    return files.read_curated(spark, path).select("id", "name", "category", F.size("facts").alias("facts"), F.array_join("links", " ").alias("links"))


@query(views.sql("SELECT code, role, CAST(CASE WHEN length(code) % 3 = 0 THEN 0 ELSE 2 END AS INTEGER) AS tags, CAST(visit_minutes AS INTEGER) AS visit_minutes, highlight FROM categories", "categories"))
def src_03_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A taxonomy written as a file with its header and read back: lists split, numbers and flags cast, codes unique."""
    path, code = fresh_path(spark, "taxonomy"), F.col("code")
    tags = F.when(F.length(code) % 3 != 0, F.concat(F.lit("historic="), code, F.lit("| tourism=yes |"))).otherwise("")
    own = views.categories(spark, sf_dir).select("code", code.alias("ru"), code.alias("en"), "role", tags.alias("osm_tags"), "visit_minutes", F.lit("").alias("aliases_ru"), F.lit("a|b").alias("aliases_en"), F.col("highlight").cast("string").alias("highlight"))
    own.write.option("header", True).csv(path)
    return files.read_taxonomy(spark, path).select("code", "role", F.size("osm_tags").alias("tags"), "visit_minutes", "highlight")


@query(views.sql("SELECT source_url, name, category FROM places", "places"))
def src_04_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A required file that is there, and an optional one that isn't."""
    path = fresh_path(spark, "required")
    own = views.places(spark, sf_dir).select(*(F.col(c).cast("string") if c in ("name", "category", "source_url") else F.lit("").alias(c) for c in files.PLACE_COLUMNS))
    files.write_places(own, path)
    there, absent = files.read_optional(spark, path, required=True), files.read_optional(spark, path + "-absent", required=False)
    return there.unionByName(absent).select("source_url", "name", "category")


@query(views.sql("SELECT 'src:' || place_id AS source_url, locale, alias AS name FROM aliases", "aliases"))
def src_05_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias files: names listed by place and locale, read as rows."""
    own = views.aliases(spark, sf_dir).groupBy(F.concat(F.lit("src:"), F.col("place_id").cast("string")).alias("source_url"), "locale").agg(F.collect_list("alias").alias("names"))
    return files.read_aliases(spark, _as_documents(own.withColumn("reason", F.lit("known as")), "places"))


@query("SELECT 'src:' || p_partkey AS keep, 'src:' || (p_partkey + 7) AS drop FROM part WHERE p_partkey % 4 <> 1 AND p_partkey % 6 <> 1")
def src_06_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared pairs; incomplete ones are left out."""
    k = F.col("p_partkey")
    named = lambda c: F.concat(F.lit("src:"), c.cast("string"))
    own = views.read(spark, sf_dir, "part").select(F.when(k % 4 != 1, named(k)).alias("keep"), F.when(k % 6 != 1, named(k + 7)).alias("drop"), F.lit("one object").alias("reason"))
    return files.read_merges(spark, _as_documents(own, "pairs"))


@query(views.sql("SELECT CAST(route_id AS VARCHAR) AS walk_id, 'walk ' || route_id AS title, ordinal, 'src:' || place_id AS source_url FROM stops", "stops"))
def src_09_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference walks as documents of ordered stops, read as a row for each stop."""
    own = views.stops(spark, sf_dir).groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "place_id")))["place_id"].alias("ids"))
    route = F.col("route_id").cast("string")
    own = own.select(route.alias("id"), F.concat(F.lit("walk "), route).alias("title"), F.transform("ids", lambda i: F.concat(F.lit("src:"), i.cast("string"))).alias("stops"))
    return files.read_walks(spark, _as_documents(own, "walks"))


@query(views.sql("SELECT case_id AS \"case\", count(*) AS runs FROM runs WHERE repeat = 2 GROUP BY case_id", "runs"))
def src_26_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two snapshots of runs, the one written last."""
    folder = fresh_path(spark, "snapshots")
    r = views.runs(spark, sf_dir).select(F.lit("row").alias("record"), F.col("case_id").cast("string").alias("case"), "repeat", F.create_map(F.lit("one"), F.lit(1.0)).alias("metrics"))
    for k in (1, 2):
        files.jsonl_rows(r.where(F.col("repeat") == k), f"{folder}/{k}")
    rows = files.read_runs(spark, files.newest_folder(spark, f"{folder}/*/*.json"))[1]
    return rows.groupBy(F.col("case").cast("long").alias("case")).agg(F.count("*").alias("runs"))


@query(views.sql("SELECT case_id, count(*) AS runs, round(avg(recall), 6) AS recall, count(failure) AS failed, bool_and(failure IS NULL) AS passed FROM runs GROUP BY case_id", "runs"))
def snk_21_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of all cases written as a table, a summary and a text; the table read back."""
    path, r = fresh_path(spark, "report"), views.runs(spark, sf_dir)
    rows = r.groupBy("case_id").agg(F.count("*").alias("runs"), F.round(F.avg("recall"), 6).alias("recall"), F.count("failure").alias("failed")).withColumn("passed", F.col("failed") == 0)
    summary = rows.agg(F.count("*").alias("cases"), F.round(F.avg(F.col("passed").cast("int")), 4).alias("pass_rate"))
    files.write_report(rows, summary, path, title="Cases", order=["case_id"])
    return spark.read.schema(rows.schema).option("header", True).csv(f"{path}/rows")
