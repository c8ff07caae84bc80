"""Recorded runs of calls held against what a case expects of them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: A call that ends a run and is no work.
TERMINAL = "submit_plan"


def _within(wanted: object, actual: object) -> bool:
    if isinstance(wanted, dict):
        return isinstance(actual, dict) and all(k in actual and _within(v, actual[k]) for k, v in wanted.items())
    return wanted == actual


@F.pandas_udf(BooleanType())
def holds(actual: pd.Series, wanted: pd.Series) -> pd.Series:
    """Of JSON texts: whether all that the wanted one names, at any depth, is in the actual one. A list is equal or not; no text is null."""
    parsed = lambda t: None if t is None else json.loads(t)
    return pd.Series([_within(parsed(w), parsed(a)) for a, w in zip(actual, wanted, strict=True)])


def checked(steps: DataFrame, runs: DataFrame, expected: DataFrame, *, terminal: str = TERMINAL) -> DataFrame:
    """case_id, name, ok: every expectation of every case, by name.

    steps: case_id, seq, name, args, result (JSON), error. runs: case_id, submitted, status. expected: case_id, tools (the
    names of all calls, in order), max_calls (work calls at most), args, results (tool -> JSON), errors (tool -> text),
    submitted, status (those allowed); a null expectation is none. ``tools``, ``max_tool_calls``, ``submitted`` and
    ``status`` hold for the run; ``args:<tool>`` if any call of the tool has such arguments, ``result:<tool>`` and
    ``error:<tool>`` if its first call has. A case without a run fails what it expects of it.
    """
    calls = steps.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("seq", "name")))["name"].alias("names"), F.count_if(F.col("name") != terminal).alias("work"))
    whole = expected.select("case_id", "tools", "max_calls", F.col("submitted").alias("want_submitted"), F.col("status").alias("want_status")).join(calls, "case_id", "left").join(runs.select("case_id", "submitted", "status"), "case_id", "left")
    none = F.array().cast("array<string>")
    own = {
        "tools": (F.col("tools"), F.coalesce("names", none) == F.col("tools")),
        "max_tool_calls": (F.col("max_calls"), F.coalesce("work", F.lit(0)) <= F.col("max_calls")),
        "submitted": (F.col("want_submitted"), F.coalesce("submitted", F.lit(False)) == F.col("want_submitted")),
        "status": (F.col("want_status"), F.coalesce(F.array_contains("want_status", F.col("status")), F.lit(False))),
    }
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.when(given.isNotNull(), ok).alias("ok")) for n, (given, ok) in own.items()))
    of_run = whole.select("case_id", F.explode(F.filter(rows, lambda r: r["ok"].isNotNull())).alias("r")).select("case_id", "r.name", "r.ok")

    def per_tool(column: str, label: str, ok: Column, *, first: bool) -> DataFrame:
        asked = expected.select("case_id", F.explode(column).alias("tool", "wanted"))
        made = steps.withColumnRenamed("name", "tool")
        if first:
            made = made.groupBy("case_id", "tool").agg(F.min_by(F.struct("args", "result", "error"), "seq").alias("s")).select("case_id", "tool", "s.*")
        met = asked.join(made, ["case_id", "tool"], "left").withColumn("ok", F.coalesce(ok, F.lit(False)))
        return met.groupBy("case_id", "tool").agg(F.bool_or("ok").alias("ok")).select("case_id", F.concat(F.lit(f"{label}:"), "tool").alias("name"), "ok")

    args = per_tool("args", "args", holds("args", "wanted"), first=False)
    results = per_tool("results", "result", holds("result", "wanted"), first=True)
    errors = per_tool("errors", "error", F.col("error") == F.col("wanted"), first=True)
    return of_run.unionByName(args).unionByName(results).unionByName(errors)


def verdicts(checks: DataFrame) -> DataFrame:
    """case_id, passed, failed (names, sorted)."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name"))))
    return checks.groupBy("case_id").agg(F.bool_and("ok").alias("passed"), failed.alias("failed"))
