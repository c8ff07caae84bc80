"""Map elements (tags as a map) to place rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Tags that name a service.
SERVICES = {"toilets": "toilet", "cafe": "cafe", "drinking_water": "water", "pharmacy": "pharmacy", "bench": "bench", "atm": "atm"}

#: Categories of sights, the tags that say them, and names that forts bear.
WORSHIP, EASTERN_CHURCH, WESTERN_CHURCH = "храм", "церковь", "костёл"
FORT, MUSEUM, BOULDER, GENERIC = "укрепление", "музей", "валун", "архитектура"
EASTERN = ("orthodox", "russian_orthodox", "old_believer")
CATHOLIC = ("catholic", "roman_catholic")
HISTORIC = {"castle": "замок", "palace": "дворец", "manor": "усадьба", "monastery": "монастырь", "monastic_architecture": "монастырь", "memorial": "памятник", "monument": "памятник"}
FORT_NAME = r"(?iuU)\bдот\b|\bдзот\b|блиндаж|бункер|\bфорт\b|окоп|оборонит|убежищ|опорн\w*\s+пункт"


def tag(tags: Column, name: str) -> Column:
    return F.try_element_at(tags, F.lit(name))


def sight_category(tags: Column) -> Column:
    """Places of worship by religion and rite, then buildings, forts by tag or name, named historic kinds, museums, boulders, and what is only worth seeing; null for all else."""
    historic, building = tag(tags, "historic"), tag(tags, "building")
    rite, christian = tag(tags, "denomination"), F.equal_null(tag(tags, "religion"), F.lit("christian"))
    said = lambda c: F.coalesce(c, F.lit(False))
    worship = F.when(~christian, WORSHIP).when(said(rite.isin(*EASTERN)), EASTERN_CHURCH).otherwise(WESTERN_CHURCH)
    church = F.when(~christian, WORSHIP).when(said(rite.isin(*CATHOLIC)), WESTERN_CHURCH).otherwise(EASTERN_CHURCH)
    named = F.create_map(*(F.lit(x) for kv in HISTORIC.items() for x in kv))
    return F.coalesce(
        F.when(tag(tags, "amenity") == "place_of_worship", worship),
        F.when(building.isin("church", "cathedral", "chapel"), church).when(building.isin("castle", "palace"), F.try_element_at(named, building)),
        F.when(said(tag(tags, "military") == "bunker") | said(historic == "fort") | said(name_of(tags).rlike(FORT_NAME)), FORT),
        F.try_element_at(named, historic),
        F.when(tag(tags, "tourism") == "museum", MUSEUM),
        F.when(tag(tags, "natural").isin("stone", "rock"), BOULDER),
        F.when(said(tag(tags, "tourism") == "attraction") | said(historic.isin("archaeological_site", "ruins")), GENERIC),
    )


def service_category(tags: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for kv in SERVICES.items() for x in kv))
    return F.try_element_at(kinds, tag(tags, "amenity"))


def name_of(tags: Column) -> Column:
    return F.coalesce(*(text.blank_to_null(tag(tags, k)) for k in ("name:ru", "name", "name:be")))


def located(elements: DataFrame) -> DataFrame:
    """Adds lat and lon: a node's own, or the centre of a way."""
    return elements.withColumn("lat", F.coalesce("lat", "center.lat")).withColumn("lon", F.coalesce("lon", "center.lon"))


def sights(elements: DataFrame) -> DataFrame:
    """source_url, name, category, lat, lon of elements that are no service, with a category and a name in Cyrillic letters."""
    own = located(elements).withColumn("name", name_of(F.col("tags"))).withColumn("category", sight_category(F.col("tags")))
    own = own.where(F.col("name").rlike(r"[\u0400-\u04FF]") & F.col("category").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return own.where(service_category(F.col("tags")).isNull()).select(F.concat_ws("/", "type", F.col("id").cast("string")).alias("source_url"), "name", "category", "lat", "lon")


#: The category of stairways, and the tags that are facts about one.
STAIRS = "лестница"
FACT_TAGS = ("handrail", "ramp", "step_count")


def stairways(elements: DataFrame, *, south: float, west: float, north: float, east: float) -> DataFrame:
    """source_url, name, category, lat, lon, facts (JSON) of stairways whose centre lies in the box; without a name they are labelled by street."""
    tags = F.col("tags")
    own = elements.where(tag(tags, "highway") == "steps").select("*", F.col("center.lat").alias("c_lat"), F.col("center.lon").alias("c_lon"))
    own = own.where(F.col("c_lat").between(south, north) & F.col("c_lon").between(west, east))
    facts = F.array_compact(F.array(*(F.when(text.blank_to_null(tag(tags, k)).isNotNull(), F.concat(F.lit(f"{k}="), F.trim(tag(tags, k)), F.lit(" (OpenStreetMap)"))) for k in FACT_TAGS)))
    street = text.blank_to_null(tag(tags, "addr:street"))
    label = F.when(street.isNotNull(), F.concat(F.lit(f"{STAIRS} ("), street, F.lit(")"))).otherwise(STAIRS)
    name = F.coalesce(text.blank_to_null(tag(tags, "name")), text.blank_to_null(tag(tags, "name:ru")), label)
    return own.select(F.concat_ws("/", F.coalesce("type", F.lit("way")), F.col("id").cast("string")).alias("source_url"), name.alias("name"), F.lit(STAIRS).alias("category"), F.col("c_lat").alias("lat"), F.col("c_lon").alias("lon"), F.to_json(facts).alias("facts"))


def services(elements: DataFrame) -> DataFrame:
    """The same of services; those without a name get a label made from kind and street. They have no visit minutes."""
    own = located(elements).withColumn("category", service_category(F.col("tags"))).where("category is not null and lat is not null and lon is not null")
    street = text.blank_to_null(tag(F.col("tags"), "addr:street"))
    label = F.when(street.isNotNull(), F.concat(F.col("category"), F.lit(" ("), street, F.lit(")"))).otherwise(F.col("category"))
    return own.select(F.concat_ws("/", "type", F.col("id").cast("string")).alias("source_url"), F.coalesce(name_of(F.col("tags")), label).alias("name"), "category", "lat", "lon", F.lit(None).cast("int").alias("visit_minutes"))
