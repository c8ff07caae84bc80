"""Requirements of an answer, graded satisfied, uncertain or unmet; unknown is never taken for either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SATISFIED, UNCERTAIN, UNMET = "satisfied", "uncertain", "unmet"


def graded(violated: Column, unknown: Column) -> Column:
    """A violation decides, then anything unknown; only then is it satisfied."""
    return F.when(violated, UNMET).when(unknown, UNCERTAIN).otherwise(SATISFIED)


def every(fact: Column) -> Column:
    """Aggregate: all of a group's rows must have the fact (true, false or null)."""
    return graded(F.coalesce(F.bool_or(~fact), F.lit(False)), F.coalesce(F.bool_or(fact.isNull()), F.lit(False)))


def some(fact: Column) -> Column:
    """Aggregate: one of a group's rows suffices."""
    return F.when(F.coalesce(F.bool_or(fact), F.lit(False)), SATISFIED).when(F.coalesce(F.bool_or(fact.isNull()), F.lit(False)), UNCERTAIN).otherwise(UNMET)


def must_visit(required: DataFrame, stops: DataFrame, outside: DataFrame, unroutable: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status: outside the area, unroutable, on the route, or absent."""
    mark = lambda df, n: df.select(*keys).distinct().withColumn(n, F.lit(True))
    both = required.join(mark(stops, "on"), keys, "left").join(mark(outside, "out"), keys, "left").join(mark(unroutable, "cut"), keys, "left")
    status = F.when(F.col("out"), "outside").when(F.col("cut"), "unroutable").when(F.col("on"), "on route").otherwise("absent")
    return both.select(*keys, status.alias("status"))


def service(on_route: Column, beside: Column, measured: Column, hard: Column) -> Column:
    """On the route or beside the line; not measured is uncertain; a soft wish is never unmet."""
    return F.when(on_route | beside, SATISFIED).when(~measured, UNCERTAIN).when(hard, UNMET).otherwise(UNCERTAIN)


def step_free(on_line: Column, drawn: Column, measured: Column) -> Column:
    """Steps on the line break it; without a line, or data on steps, it is uncertain."""
    return F.when(~drawn | ~measured, UNCERTAIN).when(on_line, UNMET).otherwise(SATISFIED)


def gated(status: Column, geometry_ok: Column) -> Column:
    """Without sound geometry nothing is more than uncertain."""
    return F.when((status == SATISFIED) & ~geometry_ok, UNCERTAIN).otherwise(status)


def rolled_up(verdicts: DataFrame, key: str) -> DataFrame:
    """key, status: infeasible, degraded, pending or ready. verdicts: strength, status."""
    hard = F.col("strength") == "hard"
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    status = (
        F.when(any_(hard & (F.col("status") == UNMET)), "infeasible")
        .when(any_(~hard & (F.col("status") == UNMET)), "degraded")
        .when(any_(F.col("status") == UNCERTAIN), "pending")
        .otherwise("ready")
    )
    return verdicts.groupBy(key).agg(status.alias("status"))
