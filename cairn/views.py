"""Place, area, walk and journal tables derived from the star schema, and the same as DuckDB SQL.

Real place tables have the same columns; the derivations only stand in for them, with arithmetic that both engines
do alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOURS = ("mo-fr 10:00-18:00", "tu-su 11:00-19:00; mo 12:00-14:00", "fr-mo 20:00-02:00", "24/7", "by arrangement", "sa, su 09:30-17:15")
TICKETS = ("free", "5 BYN", "", "paid on site", "ask at the desk")
LABELS = ("small ring", "red widget")
AREA_KINDS = ("city", "district", "region", "district", "quarter")
RINGS = "array<array<struct<lon:double,lat:double>>>"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat_of(key: Column) -> Column:
    return F.lit(53.0) + ((key * 7919) % 100003) / F.lit(100003.0) * F.lit(1.5)


def lon_of(key: Column) -> Column:
    return F.lit(23.5) + ((key * 104729) % 100019) / F.lit(100019.0) * F.lit(3.0)


def pick(key: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (key % len(values) + 1).cast("int"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        k.alias("place_id"),
        F.col("p_name").alias("name"),
        F.lower("p_type").alias("category"),
        F.col("p_brand").alias("town"),
        lat_of(k).alias("lat"),
        lon_of(k).alias("lon"),
        F.when(k % 7 != 0, (k % 50 + 10).cast("int")).alias("visit_minutes"),
        F.when(k % 5 == 0, "curated").when(k % 5 == 1, "manual").otherwise("auto").alias("owner"),
        pick(k, HOURS).alias("opening_hours"),
        pick(k, TICKETS).alias("ticket"),
        F.concat(F.lit("src:"), k.cast("string")).alias("source_url"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size").alias("size"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, role, visit_minutes, highlight."""
    code = F.col("code")
    return read(spark, sf_dir, "part").select(F.lower("p_type").alias("code")).distinct().select(code, F.when(F.length(code) % 2 == 0, "service").otherwise("sight").alias("role"), (F.length(code) * 5).alias("visit_minutes"), (F.ascii(code) % 2 == 0).alias("highlight"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place_id, alias, locale, source."""
    p = read(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    first = p.select(F.col("p_partkey").alias("place_id"), words[0].alias("alias"), F.lit("en").alias("locale"), F.lit("file-a").alias("source"))
    swapped = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("place_id"), F.concat_ws(" ", words[1], words[0]).alias("alias"), F.lit("ru").alias("locale"), F.lit("file-b").alias("source"))
    return first.unionByName(swapped)


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, kind, rings, holes: overlapping rectangles, one with a hole, one without a polygon."""
    k = F.col("r_regionkey")
    low, left = F.lit(53.0) + k * F.lit(0.2), F.lit(23.5) + k * F.lit(0.5)

    def rectangle(y: Column, x: Column, height: float, width: float) -> Column:
        corners = ((y, x), (y, x + F.lit(width)), (y + F.lit(height), x + F.lit(width)), (y + F.lit(height), x))
        return F.array(F.array(*(F.struct(b.alias("lon"), a.alias("lat")) for a, b in corners)))

    return read(spark, sf_dir, "region").select(
        F.concat(F.lit("area-"), k.cast("string")).alias("code"),
        F.lower("r_name").alias("name"),
        pick(k, AREA_KINDS).alias("kind"),
        F.when(k != 4, rectangle(low, left, 0.7, 0.9)).alias("rings"),
        F.when(k == 1, rectangle(low + F.lit(0.2), left + F.lit(0.3), 0.2, 0.3)).alias("holes"),
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, vector, category, lat, lon, radius_km: a batch of requests."""
    q = F.col("vec_id")
    return read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(
        q.alias("query_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.lower(pick(q / 100, ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE"))).alias("category"),
        lat_of(q * 13 + 7).alias("lat"),
        lon_of(q * 13 + 7).alias("lon"),
        F.lit(20.0).alias("radius_km"),
    )


def place_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place_id, vector: as many places as there are vectors have one."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("place_id"), F.col("embedding").cast("array<double>").alias("vector"))


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """route_id, ordinal, place_id, lat, lon: an order is a walk, its lines the stops."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    k = F.col("l_partkey")
    return read(spark, sf_dir, "lineitem").withColumn("ordinal", F.row_number().over(order)).select(F.col("l_orderkey").alias("route_id"), "ordinal", k.alias("place_id"), lat_of(k).alias("lat"), lon_of(k).alias("lon"))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, revision (from 0), ts, event_id, kind, value, props."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("user_id", (F.row_number().over(order) - 1).alias("revision"), "ts", "event_id", F.col("event_type").alias("kind"), "value", "props")


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """service_id, name, kind, lat, lon."""
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias("service_id"), F.col("s_name").alias("name"), pick(k, ("cafe", "toilet", "bench")).alias("kind"), lat_of(k * 11 + 3).alias("lat"), lon_of(k * 11 + 3).alias("lon"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, repeat, recall, precision, failed: an order is a run of its customer's case."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("case_id"),
        F.row_number().over(order).alias("repeat"),
        F.when(k % 11 != 0, (k * 37 % 101) / F.lit(100.0)).alias("recall"),
        F.when(k % 13 != 0, (k * 53 % 97) / F.lit(96.0)).alias("precision"),
        F.when(k % 17 == 0, "timeout").when(k % 19 == 0, "empty").alias("failure"),
        F.col("o_orderstatus").alias("status"),
    )


def lat_sql(k: str) -> str:
    return f"(CAST(53.0 AS DOUBLE) + CAST((({k}) * 7919) % 100003 AS DOUBLE) / CAST(100003.0 AS DOUBLE) * CAST(1.5 AS DOUBLE))"


def lon_sql(k: str) -> str:
    return f"(CAST(23.5 AS DOUBLE) + CAST((({k}) * 104729) % 100019 AS DOUBLE) / CAST(100019.0 AS DOUBLE) * CAST(3.0 AS DOUBLE))"


def _pick(k: str, values: tuple[str, ...]) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST(({k}) % {len(values)} AS INTEGER) + 1]"


def _rectangle(y: str, x: str, height: str, width: str) -> str:
    d = lambda v: f"CAST({v} AS DOUBLE)"
    corners = ((y, x), (y, f"{x} + {d(width)}"), (f"{y} + {d(height)}", f"{x} + {d(width)}"), (f"{y} + {d(height)}", x))
    return "[[" + ", ".join(f"{{'lon': {b}, 'lat': {a}}}" for a, b in corners) + "]]"


_Y, _X = "(CAST(53.0 AS DOUBLE) + r_regionkey * CAST(0.2 AS DOUBLE))", "(CAST(23.5 AS DOUBLE) + r_regionkey * CAST(0.5 AS DOUBLE))"

SQL = {
    "places": f"""SELECT p_partkey AS place_id, p_name AS name, lower(p_type) AS category, p_brand AS town, {lat_sql("p_partkey")} AS lat, {lon_sql("p_partkey")} AS lon,
  CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey % 50 + 10 AS INTEGER) END AS visit_minutes, CASE p_partkey % 5 WHEN 0 THEN 'curated' WHEN 1 THEN 'manual' ELSE 'auto' END AS owner,
  {_pick("p_partkey", HOURS)} AS opening_hours, {_pick("p_partkey", TICKETS)} AS ticket, 'src:' || p_partkey AS source_url, p_retailprice AS price, p_size AS size FROM part""",
    "categories": "SELECT code, CASE WHEN length(code) % 2 = 0 THEN 'service' ELSE 'sight' END AS role, length(code) * 5 AS visit_minutes, ascii(code) % 2 = 0 AS highlight FROM (SELECT DISTINCT lower(p_type) AS code FROM part)",
    "aliases": """SELECT p_partkey AS place_id, string_split(p_name, ' ')[1] AS alias, 'en' AS locale, 'file-a' AS source FROM part
  UNION ALL SELECT p_partkey, string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1], 'ru', 'file-b' FROM part WHERE p_partkey % 3 = 0""",
    "areas": f"""SELECT 'area-' || r_regionkey AS code, lower(r_name) AS name, {_pick("r_regionkey", AREA_KINDS)} AS kind,
  CASE WHEN r_regionkey <> 4 THEN {_rectangle(_Y, _X, "0.7", "0.9")} END AS rings,
  CASE WHEN r_regionkey = 1 THEN {_rectangle(f"({_Y} + CAST(0.2 AS DOUBLE))", f"({_X} + CAST(0.3 AS DOUBLE))", "0.2", "0.3")} END AS holes FROM region""",
    "query_vectors": f"""SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS vector, lower({_pick("vec_id // 100", ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE"))}) AS category,
  {lat_sql("vec_id * 13 + 7")} AS lat, {lon_sql("vec_id * 13 + 7")} AS lon, CAST(20.0 AS DOUBLE) AS radius_km FROM embeddings WHERE vec_id % 100 = 0""",
    "place_vectors": "SELECT vec_id AS place_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings",
    "stops": f"""SELECT l_orderkey AS route_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INTEGER) AS ordinal,
  l_partkey AS place_id, {lat_sql("l_partkey")} AS lat, {lon_sql("l_partkey")} AS lon FROM lineitem""",
    "journal": "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS revision, ts, event_id, event_type AS kind, value, props FROM events",
    "services": f"""SELECT s_suppkey AS service_id, s_name AS name, {_pick("s_suppkey", ("cafe", "toilet", "bench"))} AS kind, {lat_sql("s_suppkey * 11 + 3")} AS lat, {lon_sql("s_suppkey * 11 + 3")} AS lon FROM supplier""",
    "runs": """SELECT o_custkey AS case_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS repeat,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey * 37 % 101 AS DOUBLE) / CAST(100.0 AS DOUBLE) END AS recall, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey * 53 % 97 AS DOUBLE) / CAST(96.0 AS DOUBLE) END AS precision,
  CASE WHEN o_orderkey % 17 = 0 THEN 'timeout' WHEN o_orderkey % 19 = 0 THEN 'empty' END AS failure, o_orderstatus AS status FROM orders""",
}


def sql(body: str, *names: str) -> str:
    """A query over these views."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + ("," if body.lstrip().startswith(",") else "\n") + body.lstrip().removeprefix(",")


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(CAST(12742000.0 AS DOUBLE) * asin(least(CAST(1.0 AS DOUBLE), sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"
    )


def in_ring_sql(lat: str, lon: str, ring: str) -> str:
    """Whether a point lies in a ring, in DuckDB's list functions."""
    a, b = f"({ring})[i]", f"({ring})[i % len({ring}) + 1]"
    return (
        f"(len(list_filter(range(1, len({ring}) + 1), lambda i: (({a}).lat > {lat}) <> (({b}).lat > {lat}) AND {lon} < ({a}).lon + ({lat} - ({a}).lat) / "
        f"(CASE WHEN (({a}).lat > {lat}) <> (({b}).lat > {lat}) THEN ({b}).lat - ({a}).lat ELSE 1 END) * (({b}).lon - ({a}).lon))) % 2 = 1)"
    )


def in_area_sql(lat: str, lon: str, area: str) -> str:
    """Inside an area of one ring and at most one hole."""
    return f"({in_ring_sql(lat, lon, area + '.rings[1]')} AND NOT coalesce({in_ring_sql(lat, lon, area + '.holes[1]')}, false))"
