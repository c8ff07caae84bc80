"""Readers of place files. Each gives a DataFrame with a fixed schema; what breaks the format is an error, not a null."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

#: The columns of a place file.
PLACE_COLUMNS = ("name", "category", "district", "town", "lat", "lon", "blurb", "fun_fact", "fun_facts", "opening_hours", "ticket_price", "visit_minutes", "links", "source_url")
PLACE_TEXTS = T.StructType([T.StructField(c, T.StringType()) for c in PLACE_COLUMNS])
POINT = "struct<lon:double,lat:double>"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Bar-separated texts, comments and blank lines skipped; a row of another width fails."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')")
    parts = F.split("value", r"\|", -1)
    width = F.when(F.size(parts) == len(PLACE_COLUMNS), parts).otherwise(F.raise_error(F.concat(F.lit("a place row of another width: "), "value")))
    return lines.select(width.alias("p")).select(*(F.get("p", F.lit(i)).alias(c) for i, c in enumerate(PLACE_COLUMNS)))


def read_optional(spark: SparkSession, path: str, *, required: bool) -> DataFrame:
    """A missing file is an error if it is required, else no rows."""
    if exists(spark, path):
        return read_places(spark, path)
    if required:
        raise FileNotFoundError(path)
    return spark.createDataFrame([], PLACE_TEXTS)


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    """id, name, category, blurb, fun_fact, facts, links: five fixed fields, then facts, then links (which hold ``://``), however many."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')")
    p = lines.select(F.transform(F.split("value", r"\|", -1), lambda x: F.trim(x)).alias("p"))
    tail = F.filter(F.slice("p", 6, F.greatest(F.size("p") - 5, F.lit(0))), lambda x: x != "")
    # Links are the longest run of addresses at the end.
    n_links = F.aggregate(F.reverse(tail), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & F.contains(x, F.lit("://"))).cast("int")).alias("n"), (s["on"] & F.contains(x, F.lit("://"))).alias("on")), lambda s: s["n"])
    own = p.withColumn("tail", tail).withColumn("n", n_links)
    field = lambda i: F.get("p", F.lit(i))
    return own.select(field(0).cast("int").alias("id"), field(1).alias("name"), text.blank_to_null(field(2)).alias("category"), text.blank_to_null(field(3)).alias("blurb"), text.blank_to_null(field(4)).alias("fun_fact"), F.slice("tail", 1, F.size("tail") - F.col("n")).alias("facts"), F.slice("tail", F.size("tail") - F.col("n") + 1, F.greatest(F.col("n"), F.lit(0))).alias("links"))


TAXONOMY = ["code", "ru", "en", "role", "osm_tags", "visit_minutes", "aliases_ru", "aliases_en", "highlight"]


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Categories; the header must be the known one and codes unique."""
    raw = spark.read.option("header", True).csv(path)
    if raw.columns != TAXONOMY:
        raise ValueError(f"columns {raw.columns}")
    if twice := [r["code"] for r in raw.groupBy("code").count().where("count > 1").limit(5).collect()]:
        raise ValueError(f"codes given twice: {twice}")
    listed = lambda c: text.parts(F.coalesce(c, F.lit("")), "|").alias(c)
    return raw.select("code", "ru", "en", "role", listed("osm_tags"), F.col("visit_minutes").cast("int").alias("visit_minutes"), listed("aliases_ru"), listed("aliases_en"), (F.lower("highlight") == "true").alias("highlight"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """source_url, locale, name."""
    own = read_json(spark, path, "places array<struct<source_url:string,locale:string,names:array<string>,reason:string>>")
    return own.select(F.inline("places")).select("source_url", "locale", F.explode("names").alias("name"))


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """keep, drop; incomplete pairs are left out."""
    own = read_json(spark, path, "pairs array<struct<keep:string,drop:string,reason:string>>")
    return own.select(F.inline("pairs")).where("keep is not null and drop is not null").select("keep", "drop")


def read_hints(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """source_url, name, street, dist_m, source: streets for generated labels; incomplete ones are left out. lines: a document a line, as write_documents() leaves them."""
    return _entries(spark, path, "source_url:string,name:string,street:string,dist_m:double,source:string", ["source_url", "name", "street"], lines)


def read_corrections(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """source_url, category, visit_minutes: categories to lay on places; incomplete ones are left out."""
    return _entries(spark, path, "source_url:string,category:string,visit_minutes:int", ["source_url", "category"], lines)


def _entries(spark: SparkSession, path: str, fields: str, needed: list[str], lines: bool) -> DataFrame:
    own = spark.read.schema(f"places array<struct<{fields}>>").option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    rows = own.select(F.inline("places"))
    clean = rows.select(*(text.blank_to_null(F.col(c)).alias(c) if c in needed else F.col(c) for c in rows.columns))
    return clean.dropna(subset=needed)


def write_documents(rows: DataFrame, path: str, *, description: str, most: int = 1000) -> None:
    """Rows as documents of a description and so many places each at most, a document a line, dealt out by a hash of the row."""
    count = max(1, -(-rows.count() * 2 // most))
    dealt = rows.groupBy(F.pmod(F.xxhash64(*rows.columns), F.lit(count)).alias("k")).agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("places"))
    dealt.select(F.lit(description).alias("description"), "places").write.mode("overwrite").json(path)


def read_name_map(spark: SparkSession, path: str) -> DataFrame:
    """name, value: a JSON object of texts as rows."""
    lines = spark.read.option("wholetext", True).text(path)
    return lines.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "value"))


def read_walks(spark: SparkSession, path: str) -> DataFrame:
    """walk_id, title, ordinal (from 1), source_url."""
    own = read_json(spark, path, "walks array<struct<id:string,title:string,stops:array<string>>>")
    return own.select(F.inline("walks")).select(F.col("id").alias("walk_id"), "title", F.posexplode("stops").alias("k", "source_url")).select("walk_id", "title", (F.col("k") + 1).alias("ordinal"), "source_url")


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """code, kind, name, rings, holes: points as arrays of lon and lat become structs."""
    rings = "array<array<array<double>>>"
    own = read_json(spark, path, f"areas array<struct<slug:string,kind:string,name:string,rings:{rings},holes:{rings}>>")
    points = lambda c: F.transform(c, lambda r: F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))))
    return own.select(F.inline("areas")).select(F.col("slug").alias("code"), "kind", "name", points("rings").alias("rings"), points("holes").alias("holes"))


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Map elements of an extract."""
    own = read_json(spark, path, "elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>")
    return own.select(F.inline("elements"))


def read_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Meta records and run rows of a JSON-lines snapshot; a torn last line is left out."""
    raw = spark.read.text(path).withColumn("r", F.from_json("value", "record string, case string, repeat int, metrics map<string,double>")).where("r.record is not null")
    rows = raw.where("r.record = 'row'").select("r.case", "r.repeat", "r.metrics").orderBy("case", "repeat")
    return raw.where("r.record = 'meta'").select("value"), rows


def unknown_keys(cases: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Adds unknown: keys of a JSON text that are not allowed."""
    keys = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    return cases.withColumn("unknown", F.array_except(keys, F.array(*(F.lit(k) for k in allowed))))


def newest(spark: SparkSession, pattern: str) -> str | None:
    """Of files that fit a pattern, the last to be written."""
    found = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
    return found["p"] if found else None


def newest_folder(spark: SparkSession, pattern: str) -> str | None:
    """The folder of the file that newest() names: a snapshot of several files."""
    found = newest(spark, pattern)
    return found.rpartition("/")[0] if found else None


def jsonl_rows(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def write_places(df: DataFrame, path: str) -> None:
    """Bar-separated texts in the order of the key, in files that follow one another; the header, a comment, comes first."""
    line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in PLACE_COLUMNS))
    rows = df.select(F.lit(1).alias("k"), F.col("source_url").alias("o"), line.alias("value"))
    head = df.sparkSession.createDataFrame([(0, "", "#" + "|".join(PLACE_COLUMNS))], "k int, o string, value string")
    head.unionByName(rows).orderBy("k", "o").select("value").write.mode("overwrite").text(path)


def write_report(rows: DataFrame, summary: DataFrame, path: str, *, title: str, order: list[str]) -> None:
    """A report of scored cases, below path: ``rows`` (CSV with a header), ``summary`` (a JSON line a row) and ``text`` (Markdown).

    The text has the title, the summary as a list and the rows as a table, in their order; nulls are ``-``, and bars in
    texts are escaped. Rows are sorted and written by many tasks, in files that follow one another.
    """
    said = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("-"))
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    placed = rows.orderBy(*order)
    placed.write.mode("overwrite").option("header", True).csv(f"{path}/rows")
    summary.write.mode("overwrite").json(f"{path}/summary")
    totals = summary.select(F.explode(F.array(*(F.concat(F.lit(f"- {c}: "), said(c)) for c in summary.columns))).alias("value"))
    head = [f"# {title}", ""]
    table = ["", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns)]
    spark = rows.sparkSession
    fixed = lambda k, lines: spark.createDataFrame([(k, i, v) for i, v in enumerate(lines)], "part int, i int, value string")
    front = fixed(0, head).unionByName(totals.select(F.lit(1).alias("part"), F.lit(0).alias("i"), "value")).unionByName(fixed(2, table))
    front.orderBy("part", "i").coalesce(1).select("value").write.mode("overwrite").text(f"{path}/text")
    placed.select(line([said(c) for c in rows.columns]).alias("value")).write.mode("append").text(f"{path}/text")


def nest(parent: DataFrame, child: DataFrame, key: str, name: str) -> DataFrame:
    """Child rows as an array on their parent; a child without one is an error."""
    if orphan := child.join(parent, key, "left_anti").select(key).limit(1).collect():
        raise ValueError(f"no parent for {orphan[0][0]}")
    rows = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*(c for c in child.columns if c != key)))).alias(name))
    return parent.join(rows, key, "left")
