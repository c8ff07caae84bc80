"""Names, tokens, similarity, JSON columns (STR, JSN, ARR)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import text
from ..operators import fragments
from ..operators.staging import small_side
from .registry import query

GRAMS = """list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


def grams(c: str, *, distinct: bool = True) -> str:
    own = GRAMS.format(c=c)
    return own if distinct else own.removeprefix("list_distinct(")[:-1]


JACCARD = "CASE WHEN len({a}) + len({b}) > 0 THEN CAST(len(list_intersect({a}, {b})) AS DOUBLE) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) ELSE CAST(0 AS DOUBLE) END"


@query(f"""WITH n AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT name, {grams("name")} AS t FROM n)
SELECT a.name AS a, b.name AS b, round({JACCARD.format(a="a.t", b="b.t")}, 6) AS similarity FROM g a JOIN g b ON a.name < b.name""")
def str_01_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram similarity of all pairs of different names (a vocabulary, 64 of them here)."""
    n = views.read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("t", F.array_distinct(text.ordered_trigrams(F.col("name"))))
    a, b = n.select(F.col("name").alias("a"), F.col("t").alias("ta")), n.select(F.col("name").alias("b"), F.col("t").alias("tb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(text.jaccard(F.col("ta"), F.col("tb")), 6).alias("similarity"))


@query(f"""WITH n AS (SELECT DISTINCT p_name AS name, string_split(p_name, ' ')[1] AS w FROM part),
g AS (SELECT name, w, {grams("w")} AS own, {grams("name", distinct=False)} AS other FROM n),
runs AS (SELECT name, w, own, list_distinct(other[i:j]) AS run FROM (SELECT *, unnest(range(1, len(other) + 1)) AS i FROM g) s, LATERAL (SELECT unnest(range(s.i, len(s.other) + 1)) AS j))
SELECT name, w AS word, round(max({JACCARD.format(a="own", b="run")}), 6) AS similarity FROM runs GROUP BY name, w""")
def str_02_word_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.split("p_name", " ")[0].alias("word")).distinct()
    return n.select("name", "word", F.round(text.word_similarity(F.col("word"), F.col("name")), 6).alias("similarity"))


@query("""SELECT conv_id, turn, len(list_distinct(regexp_extract_all(lower(text), '([а-яёa-z]{3,}\\d*)', 1))) AS keywords,
  len(list_distinct(regexp_extract_all(lower(text), '([а-яёa-z]{2,})', 1))) AS alias_words FROM conversations""")
def str_03_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.size(text.keyword_tokens(F.col("text"))).cast("long").alias("keywords"), F.size(text.alias_tokens(F.col("text"))).cast("long").alias("alias_words"))


@query(r"""SELECT place_id, trim(regexp_replace(lower(n), '[^0-9a-zа-яёіў]+', ' ', 'g')) AS answered,
  trim(regexp_replace(regexp_replace(translate(lower(n), 'ё', 'е'), '[^\p{L}\p{N}\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS matched,
  trim(regexp_replace(lower(regexp_replace(n, '\([^)]*\)', ' ', 'g')), '[^\p{L}\p{N}]+', ' ', 'g')) AS title,
  trim(regexp_replace(regexp_replace(lower(n), '[^\p{L}\p{N}\s]+', '', 'g'), '\s+', ' ', 'g')) AS territory
FROM (SELECT p_partkey AS place_id, '  «' || p_name || '», Ёлка-' || p_brand || ' (' || p_type || ') ' AS n FROM part)""")
def str_04_07_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four ways of normalising a name."""
    p = views.read(spark, sf_dir, "part")
    n = p.select(F.col("p_partkey").alias("place_id"), F.concat(F.lit("  «"), "p_name", F.lit("», Ёлка-"), "p_brand", F.lit(" ("), "p_type", F.lit(") ")).alias("n"))
    own = F.col("n")
    return n.select("place_id", text.answered_name(own).alias("answered"), text.matched_name(own).alias("matched"), text.title_name(own).alias("title"), text.territory_name(own).alias("territory"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[А-Яа-яЁё]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[А-Яа-яЁё]') THEN 'ru'
  WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS script FROM documents""")
def str_09_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "documents").select("doc_id", text.script_of(F.col("text")).alias("script"))


@query(r"""WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), 'https?://\S+', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)
SELECT page_id, sha256(CASE WHEN length(t) % 2 = 1 AND length(t) > 2 AND substr(t, 1, (length(t) - 1) // 2) = substr(t, (length(t) - 1) // 2 + 2, (length(t) - 1) // 2) THEN substr(t, 1, (length(t) - 1) // 2) ELSE t END) AS plain FROM p""")
def str_11_without_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.read(spark, sf_dir, "pages").select("page_id", F.sha2(text.without_markup(F.col("html")), 256).alias("plain"))


@query(r"""SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '/([a-z]{2})/', 1), '') AS lang, nullif(regexp_extract(url, '/(\d+)', 1), '') AS title FROM pages""")
def str_12_link_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an article's address says: host, language, title."""
    part = lambda p: F.regexp_extract("url", p, 1)
    return views.read(spark, sf_dir, "pages").select("page_id", part("://([^/?#]+)").alias("host"), text.blank_to_null(part("/([a-z]{2})/")).alias("lang"), text.blank_to_null(part(r"/(\d+)")).alias("title"))


@query(r"""SELECT c_custkey, CASE WHEN regexp_matches(e, '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN e END AS email
FROM (SELECT c_custkey, lower(trim('  ' || c_name || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '@' END || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '.By ' END)) AS e FROM customer)""")
def str_13_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.concat(F.lit("  "), "c_name", F.when(k % 4 == 0, "").otherwise("@"), "c_mktsegment", F.when(k % 3 == 0, "").otherwise(".By "))
    return views.read(spark, sf_dir, "customer").select("c_custkey", text.email(raw).alias("email"))


@query(views.sql("SELECT place_id, array_to_string(list_filter([name, category, CASE WHEN place_id % 3 = 0 THEN NULL WHEN place_id % 3 = 1 THEN ' ' ELSE town END], lambda x: x IS NOT NULL AND trim(x) <> ''), '. ') || '.' AS embedded FROM places", "places"))
def str_14_embedded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("place_id")
    town = F.when(k % 3 == 0, None).when(k % 3 == 1, " ").otherwise(F.col("town"))
    return views.places(spark, sf_dir).select("place_id", text.embedded_text(F.col("name"), F.col("category"), town).alias("embedded"))


PLAIN = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"


@query(rf"""SELECT b.item_id, d.doc_id FROM (SELECT item_id, {PLAIN} AS f FROM benchmark) b JOIN (SELECT doc_id, {PLAIN} AS t FROM documents) d ON f <> '' AND contains(d.t, b.f)""")
def str_15_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the items of a stated set stand verbatim as a whole, blanks and case aside."""
    return fragments.repeated_passages(views.read(spark, sf_dir, "documents"), views.read(spark, sf_dir, "benchmark"), chars=None)


@query(rf"""WITH items AS (SELECT item_id, {PLAIN} AS f FROM benchmark), parts AS (SELECT DISTINCT item_id, substr(f, CAST(i AS INTEGER), 40) AS part FROM (SELECT item_id, f, unnest(range(1, greatest(1, length(f) - 39) + 1)) AS i FROM items WHERE f <> '')),
texts AS (SELECT doc_id, {PLAIN} AS t FROM documents), spots AS (SELECT doc_id, substr(t, CAST(i AS INTEGER), 40) AS part FROM (SELECT doc_id, t, unnest(range(1, length(t) - 38)) AS i FROM texts))
SELECT DISTINCT item_id, doc_id FROM parts JOIN spots USING (part) UNION SELECT DISTINCT item_id, doc_id FROM parts JOIN texts ON length(part) < 40 AND contains(t, part)""")
def str_15_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that repeat any 40 characters in a row of an item, blanks and case aside."""
    return fragments.repeated_passages(views.read(spark, sf_dir, "documents"), views.read(spark, sf_dir, "benchmark"), chars=40)


@query("""WITH codes AS (SELECT list(DISTINCT string_split(p_name, ' ')[2]) AS c FROM part)
SELECT DISTINCT p_name AS name, array_to_string(list_sort(list_intersect(string_split(p_name, ' '), c)), ',') AS codes FROM part, codes""")
def str_16_code_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a name that are codes of the vocabulary."""
    names = views.read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    codes = names.select(F.split("name", " ")[1].alias("code")).distinct()
    words = names.select("name", F.explode(F.split("name", " ")).alias("code"))
    own = words.join(codes, "code", "left_semi").groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    return names.join(own, "name", "left").select("name", F.coalesce("codes", F.lit("")).alias("codes"))


@query(views.sql("SELECT DISTINCT a.code AS a, b.code AS b, lower(trim(a.code)) = lower(trim(b.code)) OR contains(a.code, b.code) OR contains(b.code, a.code) AS agree FROM (SELECT code FROM categories UNION SELECT substr(code, 1, 3) FROM categories) a, categories b", "categories"))
def str_17_names_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = views.categories(spark, sf_dir).select("code")
    short = own.unionByName(own.select(F.substring("code", 1, 3).alias("code"))).distinct().select(F.col("code").alias("a"))
    return short.join(small_side(own.select(F.col("code").alias("b"))), F.lit(True)).select("a", "b", text.names_agree(F.col("a"), F.col("b")).alias("agree"))


@query("SELECT doc_id, length(nullif(substr(trim(text), 1, 240), '')) AS n, sha256(nullif(substr(trim(text), 1, 240), '')) AS blurb FROM documents")
def str_18_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = text.capped(F.col("text"))
    return views.read(spark, sf_dir, "documents").select("doc_id", F.length(own).cast("long").alias("n"), F.sha2(own, 256).alias("blurb"))


@query(views.sql("""SELECT place_id, CASE WHEN m >= 60 THEN CAST(m // 60 AS VARCHAR) || ' h ' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') || ' min' ELSE CAST(m AS VARCHAR) || ' min' END AS said,
  name || coalesce(', ' || town, '') AS line FROM (SELECT *, place_id % 200 AS m FROM places)""", "places"))
def str_19_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.places(spark, sf_dir).select("place_id", text.duration(F.col("place_id") % 200).alias("said"), F.concat_ws(", ", "name", "town").alias("line"))


FACTS = """CASE p_partkey % 3 WHEN 0 THEN '["' || p_name || '","' || p_brand || '","x","y"]' WHEN 1 THEN p_name || ' | ' || p_brand || ' || z|w' ELSE NULL END"""


@query(f"""SELECT place_id, array_to_string(CASE WHEN starts_with(t, '[') THEN CAST(from_json(t, '["VARCHAR"]') AS VARCHAR[]) ELSE list_filter(list_transform(string_split(t, '|'), lambda x: trim(x)), lambda x: x <> '') END[1:3], ';') AS facts
FROM (SELECT p_partkey AS place_id, {FACTS} AS t FROM part)""")
def jsn_01_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts from a JSON array or a text between bars; three at most."""
    facts = text.first_facts(F.expr(FACTS))
    return views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("place_id"), F.array_join(facts, ";").alias("facts"))


LINKS = """CASE p_partkey % 3 WHEN 0 THEN '[{"title":"' || p_name || '","url":"u' || p_partkey || '"}]' WHEN 1 THEN p_name || ' | u' || p_partkey ELSE 'none' END"""


@query("SELECT p_partkey AS place_id, CASE WHEN p_partkey % 3 <> 2 THEN p_name END AS title, CASE WHEN p_partkey % 3 <> 2 THEN 'u' || p_partkey END AS url FROM part")
def jsn_02_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = text.first_links(F.expr(LINKS))
    first = F.get(links, F.lit(0))
    return views.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("place_id"), first["title"].alias("title"), first["url"].alias("url"))


@query("SELECT p_partkey AS place_id, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN p_name || '/' || p_brand END AS photo FROM part")
def jsn_03_photo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A photo counts only with author and licence."""
    k = F.col("p_partkey")
    author, licence = text.blank_to_null(F.when(k % 2 == 0, F.col("p_name")).otherwise(" ")), text.blank_to_null(F.when(k % 3 == 0, F.col("p_brand")))
    photo = F.when(author.isNotNull() & licence.isNotNull(), F.struct(author.alias("author"), licence.alias("licence")))
    return views.read(spark, sf_dir, "part").select(k.alias("place_id"), F.concat_ws("/", photo["author"], photo["licence"]).alias("p"), photo.isNotNull().alias("has")).select("place_id", F.when(F.col("has"), F.col("p")).alias("photo"))


@query("SELECT event_id, json_valid(t) AS valid, CASE WHEN json_valid(t) THEN CAST(json_extract(t, '$.k') AS BIGINT) END AS k FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN substr(props, 1, 4) ELSE props END AS t FROM events)")
def jsn_04_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    v = F.try_parse_json(raw)
    return views.read(spark, sf_dir, "events").select("event_id", v.isNotNull().alias("valid"), F.try_variant_get(v, "$.k", "bigint").alias("k"))


@query("""SELECT conv_id, turn, len(list_filter(list_transform(string_split(text, ','), lambda x: trim(x)), lambda x: x <> '')) AS n_parts,
  len(list_distinct(string_split(lower(text), ' '))) AS n_words FROM conversations""")
def arr_01_02_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splitting with empty parts dropped; distinct in order."""
    c = views.read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.size(text.parts(F.col("text"), ",")).cast("long").alias("n_parts"), F.size(F.array_distinct(F.split(F.lower("text"), " "))).cast("long").alias("n_words"))
