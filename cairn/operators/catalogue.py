"""Terms to category codes, road names, lines and vectors of the catalogue."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import settle

#: Endings that a term may have beyond its lemma, in the order they are tried, and what may replace them.
ENDINGS = ("ами", "ями", "ах", "ях", "ов", "ев", "ей", "ам", "ям", "ой", "ом", "ем", "ы", "и", "а", "я", "у", "ю", "е", "ь", "es", "s")
REPLACEMENTS = ("", "й", "ь")
LEAST_STEM = 3
LEAST_CONTAINED = 4
#: How far off a line services may lie, in metres.
OFF_LINE_M = {"pedestrian": 150.0, "bicycle": 250.0, "car": 400.0, "any": 250.0}
#: Profiles that go by another name there.
PROFILES = {"auto": "car", "drive": "car", "truck": "car", "bus": "car", "motorcycle": "car", "motor_scooter": "car"}
LINE_POINTS = (2, 2000)
#: Fixed value: what the label of a numbered road looks like.
ROAD_NUMBER = r"^[A-Za-zА-Яа-яЁёІіЎў]{1,4}[\s\-–]?\d{1,5}(?:-[A-Za-zА-Яа-я]{1,3})?$"
BATCH = 64


def folded(c: Column) -> Column:
    """Trimmed, lower case, one letter folded."""
    return F.translate(F.lower(F.trim(c)), "ё", "е")


def surface_forms(categories: DataFrame) -> DataFrame:
    """code, form (folded), raw for each different form; a form of two codes is an error. categories: code, forms (array)."""
    each = categories.select("code", F.explode(F.array_distinct(F.concat(F.array("code"), "forms"))).alias("raw"))
    each = each.withColumn("form", folded(F.col("raw"))).where("form <> ''").distinct()
    if clash := each.groupBy("form").agg(F.countDistinct("code").alias("n")).where("n > 1").limit(1).collect():
        raise ValueError(f"a form of two categories: {clash[0]['form']}")
    return each


def _candidates(own: Column, longest: int) -> Column:
    """struct(step, n, form) of a folded term: itself, its lemmas in order, its parts by falling length."""
    lemmas = [
        F.when(own.endswith(e) & (F.length(own) - len(e) >= LEAST_STEM), F.struct(F.lit(1).alias("step"), F.lit(i * len(REPLACEMENTS) + j).alias("n"), F.concat(F.substring(own, F.lit(1), F.length(own) - len(e)), F.lit(r)).alias("form")))
        for i, e in enumerate(ENDINGS)
        for j, r in enumerate(REPLACEMENTS)
    ]
    sizes = F.sequence(F.lit(LEAST_CONTAINED), F.least(F.length(own), F.lit(longest)))
    starts = lambda n: F.sequence(F.lit(1), F.length(own) - n + 1)
    within = F.flatten(F.transform(sizes, lambda n: F.transform(starts(n), lambda i: F.struct(F.lit(2).alias("step"), (-n).alias("n"), F.substring(own, i, n).alias("form")))))
    parts = F.when((F.length(own) >= LEAST_CONTAINED) & F.lit(longest >= LEAST_CONTAINED), within).otherwise(F.array().cast("array<struct<step:int,n:int,form:string>>"))
    return F.array_distinct(F.concat(F.array(F.struct(F.lit(0).alias("step"), F.lit(0).alias("n"), own.alias("form"))), F.filter(F.array(*lemmas), lambda x: x.isNotNull()), parts))


def resolved(terms: DataFrame, forms: DataFrame) -> DataFrame:
    """term, code for each different term: a form as written, then folded, then as a lemma, then the longest form that the term contains; null if none.

    Terms meet forms by equality of candidates, never each with each. Of equally long contained forms the smallest decides.
    """
    each = terms.select("term").distinct()
    exact = forms.select(F.col("raw").alias("written"), F.col("code").alias("own")).groupBy("written").agg(F.min("own").alias("own"))
    longest = forms.agg(F.coalesce(F.max(F.length("form")), F.lit(0))).first()[0]
    tried = each.where("trim(term) <> ''").withColumn("c", F.explode(_candidates(folded(F.col("term")), longest)))
    met = tried.select("term", "c.step", "c.n", "c.form").join(forms.select("form", "code").distinct(), "form")
    best = met.groupBy("term").agg(F.min_by("code", F.struct("step", "n", "form")).alias("found"))
    written = each.join(exact, F.trim(each["term"]) == F.col("written"), "left").select("term", "own")
    return written.join(best, "term", "left").select("term", F.coalesce("own", "found").alias("code"))


def road_name(*spellings: Column) -> Column:
    """The first that isn't blank, trimmed."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in spellings))


def is_road_number(label: Column) -> Column:
    return F.coalesce(F.regexp_like(F.trim(label), F.lit(ROAD_NUMBER)), F.lit(False))


def off_line_m(profile: Column, own: Column) -> Column:
    """The caller's own limit, else that of the profile; an unknown profile goes on foot."""
    name = F.lower(F.trim(F.coalesce(profile, F.lit("pedestrian"))))
    limits = {**OFF_LINE_M, **{k: OFF_LINE_M[v] for k, v in PROFILES.items()}}
    known = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))
    return F.coalesce(own.cast("double"), F.try_element_at(known, name), F.lit(OFF_LINE_M["pedestrian"]))


def line_problem(kind: Column, points: Column) -> Column:
    """Why a line (an array of arrays of numbers) can't be used; null if it can."""
    least, most = LINE_POINTS
    sound = lambda p: F.coalesce((F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull(), F.lit(False))
    n = F.coalesce(F.size(points), F.lit(-1))
    return F.when(~F.equal_null(kind, F.lit("LineString")), "shape_not_linestring").when(n < least, "shape_needs_two_points").when(n > most, "shape_too_long").when(~F.forall(points, sound), "shape_bad_point")


#: What is put before a text that is searched, and one that is asked for.
PASSAGE, QUESTION = "passage: ", "query: "


def content_vectors(texts: DataFrame, known: DataFrame, embed: Callable[[list[str]], list[list[float]]], *, prefix: str = PASSAGE) -> tuple[DataFrame, DataFrame]:
    """texts with a vector each, and the vectors that known has to learn: hash, vector.

    A vector belongs to its content: the SHA-256 of prefix and text. Contents that known holds are not embedded again, any
    other once, however many rows have it, at most ``BATCH`` at a time. Where embed fails, or gives nothing for a text,
    the vector is null and isn't learned, so that it is tried again; a null text has none. texts: any columns, and text;
    known: hash, vector, each hash once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), BATCH):
                part = frame.iloc[i : i + BATCH]
                try:
                    made = embed([prefix + t for t in part["text"]])
                except Exception:  # noqa: BLE001  a model may fail in any way; its batch has no vectors
                    made = [None] * len(part)
                yield pd.DataFrame({"hash": part["hash"], "vector": [v if v is not None and len(v) else None for v in made]})

    keyed = texts.withColumn("hash", F.sha2(F.concat(F.lit(prefix), "text"), 256))
    # Equal contents come down to one a task before the shuffle.
    wanted = keyed.where("hash is not null").groupBy("hash").agg(F.first("text").alias("text")).join(known.select("hash"), "hash", "left_anti")
    new = settle(wanted.mapInPandas(run, "hash string, vector array<double>"), "vectors").where("vector is not null")
    return keyed.join(known.select("hash", "vector").unionByName(new), "hash", "left").select(*texts.columns, "vector"), new


def backfilled(rows: DataFrame, texts: Column, embed: Callable[[list[str]], list[list[float]]], *, id_: str = "place_id", column: str = "vector", clear: bool = False) -> DataFrame:
    """rows with a vector wherever it was null, or everywhere with clear; embed gets at most ``BATCH`` texts at once.

    Rows are told apart by id_, which each bears alone.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), BATCH):
                part = frame.iloc[i : i + BATCH]
                yield pd.DataFrame({id_: part[id_], column: embed(part["_text"].tolist())})

    whole = rows.withColumn(column, F.lit(None).cast("array<double>")) if clear else rows
    missing = whole.where(F.col(column).isNull()).withColumn("_text", F.coalesce(texts, F.lit(""))).select(id_, "_text")
    made = missing.mapInPandas(run, f"{id_} {dict(rows.dtypes)[id_]}, {column} array<double>")
    held = whole.where(F.col(column).isNotNull())
    return held.unionByName(whole.where(F.col(column).isNull()).drop(column).join(made, id_).select(*whole.columns))
