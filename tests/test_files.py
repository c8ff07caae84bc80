"""Readers and writers of place files, and catalogue operators that no driver table exercises."""

from __future__ import annotations

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairn.operators import catalogue
from cairn.queries.catalogue import hashed_vectors
from cairn.sources import elements, files


def written(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_place_rows_have_one_width(spark, tmp_path):
    row = "Old mill|museum|d|t|53.5|24.5|b|f|[]|mo-fr 10:00-18:00|free|40|[]|src:1"
    good = written(tmp_path, "good.csv", f"#{'|'.join(files.PLACE_COLUMNS)}\n\n{row}\n# note\n")
    assert [(r["name"], r["source_url"]) for r in files.read_places(spark, good).collect()] == [("Old mill", "src:1")]
    with pytest.raises(PySparkException):
        files.read_places(spark, written(tmp_path, "bad.csv", row + "|more\n")).collect()


def test_places_are_written_and_read_back(spark, tmp_path):
    rows = [tuple(f"{c}{i}" for c in files.PLACE_COLUMNS[:-1]) + (f"src:{3 - i}",) for i in range(3)]
    df = spark.createDataFrame(rows, files.PLACE_TEXTS)
    path = str(tmp_path / "out")
    files.write_places(df, path)
    assert sorted(map(tuple, files.read_places(spark, path).collect())) == sorted(rows)


def test_missing_files(spark, tmp_path):
    absent = str(tmp_path / "absent.csv")
    assert files.read_optional(spark, absent, required=False).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_optional(spark, absent, required=True)


def test_curated_tail_is_facts_then_links(spark, tmp_path):
    path = written(tmp_path, "curated.csv", "# id|name\n1|Mill|museum||said|one|two|https://a.b/c|https://d\n2|Hill||blurb||\n3|Lake|||f|https://x|late fact\n")
    got = {r["id"]: (r["category"], r["facts"], r["links"]) for r in files.read_curated(spark, path).collect()}
    assert got[1] == ("museum", ["one", "two"], ["https://a.b/c", "https://d"])
    assert got[2] == (None, [], [])
    assert got[3] == (None, ["https://x", "late fact"], [])


def test_taxonomy_has_its_header_and_unique_codes(spark, tmp_path):
    head = ",".join(files.TAXONOMY)
    good = written(tmp_path, "t.csv", f"{head}\ncastle,замок,castle,sight,historic=castle|historic=manor,45,замки|,castles,true\nbench,лавка,bench,service,,5,,,false\n")
    got = {r["code"]: r for r in files.read_taxonomy(spark, good).collect()}
    assert got["castle"]["osm_tags"] == ["historic=castle", "historic=manor"]
    assert got["castle"]["aliases_ru"] == ["замки"]
    assert got["castle"]["visit_minutes"] == 45
    assert (got["castle"]["highlight"], got["bench"]["highlight"]) == (True, False)
    assert got["bench"]["osm_tags"] == []
    with pytest.raises(ValueError, match="columns"):
        files.read_taxonomy(spark, written(tmp_path, "h.csv", "code,en\nx,y\n"))
    with pytest.raises(ValueError, match="twice"):
        files.read_taxonomy(spark, written(tmp_path, "d.csv", f"{head}\na,b,c,sight,,5,,,true\na,b,c,sight,,5,,,true\n"))


def test_nested_files(spark, tmp_path):
    aliases = written(tmp_path, "a.json", json.dumps({"places": [{"source_url": "s", "locale": "en", "names": ["x", "y"], "reason": "r"}]}))
    assert sorted(map(tuple, files.read_aliases(spark, aliases).collect())) == [("s", "en", "x"), ("s", "en", "y")]
    merges = written(tmp_path, "m.json", json.dumps({"pairs": [{"keep": "a", "drop": "b"}, {"keep": "c"}]}))
    assert list(map(tuple, files.read_merges(spark, merges).collect())) == [("a", "b")]
    names = written(tmp_path, "n.json", json.dumps({"g": "Grove", "h": "Hill"}))
    assert sorted(map(tuple, files.read_name_map(spark, names).collect())) == [("g", "Grove"), ("h", "Hill")]
    walks = written(tmp_path, "w.json", json.dumps({"walks": [{"id": "w", "title": "t", "stops": ["s2", "s1"]}]}))
    assert sorted(map(tuple, files.read_walks(spark, walks).collect())) == [("w", "t", 1, "s2"), ("w", "t", 2, "s1")]
    ring = [[[23.0, 53.0], [24.0, 53.0], [24.0, 54.0]]]
    areas = written(tmp_path, "r.json", json.dumps({"areas": [{"slug": "a", "kind": "city", "name": "A", "rings": ring, "holes": []}, {"slug": "b", "kind": "region"}]}))
    got = {r["code"]: r for r in files.read_areas(spark, areas).collect()}
    assert (got["a"]["rings"][0][1]["lon"], got["a"]["rings"][0][1]["lat"]) == (24.0, 53.0)
    assert got["b"]["rings"] is None
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.read_walks(spark, written(tmp_path, "torn.json", '{"walks": [{"id": ')).collect()


def test_elements_are_located(spark, tmp_path):
    path = written(tmp_path, "e.json", json.dumps({"elements": [{"type": "node", "id": 1, "lat": 53.1, "lon": 24.1, "tags": {"name": "x"}}, {"type": "way", "id": 2, "center": {"lat": 53.2, "lon": 24.2}, "tags": {}}]}))
    got = {r["id"]: (r["lat"], r["lon"]) for r in elements.located(files.read_elements(spark, path)).collect()}
    assert got == {1: (53.1, 24.1), 2: (53.2, 24.2)}


def test_torn_snapshot_and_newest(spark, tmp_path):
    path = written(tmp_path, "run.jsonl", '{"record": "meta", "case": null}\n{"record": "row", "case": "b", "repeat": 1, "metrics": {"m": 0.5}}\n{"record": "row", "case": "a", "repeat": 2, "metrics": {}}\n{"record": "ro')
    meta, rows = files.read_runs(spark, path)
    assert meta.count() == 1
    assert [(r["case"], r["repeat"]) for r in rows.collect()] == [("a", 2), ("b", 1)]
    assert files.newest(spark, f"{tmp_path}/*.jsonl").endswith("run.jsonl")


def test_terms_resolve_in_steps(spark):
    forms = catalogue.surface_forms(spark.createDataFrame([("castle", ["Замок", "замк", "fort"]), ("church", ["костёл", "kirk"]), ("bank", [])], "code string, forms array<string>"))
    want = {"castle": "castle", " Замок ": "castle", "КОСТЕЛ": "church", "костелы": "church", "замками": "castle", "forts": "castle", "an old kirk, ruined": "church", "the fort and the kirkyard": "castle", "ban": None, "": None, "riverbank": "bank"}
    terms = spark.createDataFrame([(t,) for t in [*want, "castle"]] + [(None,)], "term string")
    got = {r["term"]: r["code"] for r in catalogue.resolved(terms, forms).collect()}
    assert got == {**want, None: None}
    with pytest.raises(ValueError, match="two categories"):
        catalogue.surface_forms(spark.createDataFrame([("a", ["x"]), ("b", ["X "])], "code string, forms array<string>"))


def test_lines_vectors_and_limits(spark):
    lines = spark.createDataFrame(
        [(1, "LineString", [[1.0, 2.0], [3.0, 4.0]]), (2, None, [[1.0, 2.0], [3.0, 4.0]]), (3, "LineString", None), (4, "LineString", [[1.0, 2.0], [3.0]]), (5, "LineString", [[1.0, 2.0]] * 2001), (6, "LineString", [[1.0, 2.0], None])],
        "id int, kind string, points array<array<double>>",
    )
    got = {r["id"]: r["p"] for r in lines.select("id", catalogue.line_problem(F.col("kind"), F.col("points")).alias("p")).collect()}
    assert got == {1: None, 2: "shape_not_linestring", 3: "shape_needs_two_points", 4: "shape_bad_point", 5: "shape_too_long", 6: "shape_bad_point"}
    rows = spark.createDataFrame([(k, f"t{k}", [1.0] if k % 2 else None) for k in range(150)] + [(999, None, None)], "place_id long, text string, vector array<double>")
    own = {r["place_id"]: r["vector"] for r in catalogue.backfilled(rows, F.col("text"), hashed_vectors).collect()}
    assert len(own) == 151 and own[1] == [1.0] and own[2] == hashed_vectors(["t2"])[0] and own[999] == hashed_vectors([""])[0]
    anew = {r["place_id"]: r["vector"] for r in catalogue.backfilled(rows, F.col("text"), hashed_vectors, clear=True).collect()}
    assert anew[1] == hashed_vectors(["t1"])[0]
    limits = spark.createDataFrame([(None, None), ("Truck ", None), ("sledge", None), ("any", 10)], "profile string, own int")
    assert [r[0] for r in limits.select(catalogue.off_line_m(F.col("profile"), F.col("own"))).collect()] == [150.0, 400.0, 150.0, 10.0]


def test_a_report_is_a_table_a_summary_and_a_text(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b|c", None), (1, "a", 0.5), (3, None, 1.0)], "id int, name string, score double")
    path = str(tmp_path / "report")
    files.write_report(rows, rows.selectExpr("count(*) AS cases", "avg(score) AS mean"), path, title="All", order=["id"])
    assert [tuple(r) for r in spark.read.schema(rows.schema).option("header", True).csv(f"{path}/rows").orderBy("id").collect()] == [(1, "a", 0.5), (2, "b|c", None), (3, None, 1.0)]
    assert [r.asDict() for r in spark.read.json(f"{path}/summary").collect()] == [{"cases": 3, "mean": 0.75}]
    lines = {line for f in (tmp_path / "report" / "text").glob("part-*") for line in f.read_text().splitlines()}
    assert lines == {"# All", "", "- cases: 3", "- mean: 0.75", "| id | name | score |", "|-|-|-|", "| 1 | a | 0.5 |", "| 2 | b\\|c | - |", "| 3 | - | 1.0 |"}
