"""Opening hours and admission; null means unknown and is kept apart from false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Day names in two languages, Monday first.
DAYS = (("mo", "tu", "we", "th", "fr", "sa", "su"), ("пн", "вт", "ср", "чт", "пт", "сб", "вс"))
#: Texts that mean always open.
ALWAYS = ("24/7", "круглосуточно", "always")
FREE_WORDS = ("free", "бесплатно", "свободный вход", "no fee")
PAID_WORDS = ("paid", "платно", "платный")
WEEK = 7 * 1440
RULE = r"^\s*([\p{L}, -]+?)\s+(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})\s*$"
WINDOW = "struct<day:int,start:int,stop:int>"


def _day(name: Column) -> Column:
    numbers = F.create_map(*(F.lit(x) for days in DAYS for i, d in enumerate(days) for x in (d, i)))
    return F.element_at(numbers, F.lower(F.trim(name)))


def _days(part: Column) -> Column:
    """``mo-fr`` or ``su`` as day numbers, ranges going over the week's end; null if a name is unknown."""
    first, last = _day(F.substring_index(part, "-", 1)), _day(F.substring_index(part, "-", -1))
    span = F.when(first.isNotNull() & last.isNotNull(), F.pmod(last - first, F.lit(7)))
    return F.when(span.isNotNull(), F.transform(F.sequence(F.lit(0), span), lambda k: (first + k) % 7))


def _rule(text: Column) -> Column:
    """Windows of one rule; null if it is none."""
    at = lambda k: F.regexp_extract(text, RULE, k).cast("int")
    start, stop = at(2) * 60 + at(3), at(4) * 60 + at(5)
    days = F.flatten(F.transform(F.split(F.regexp_extract(text, RULE, 1), ","), _days))
    sound = text.rlike(RULE) & (start < 1440) & (stop <= 1440)
    return F.when(sound & days.isNotNull(), F.transform(days, lambda d: F.struct(d.cast("int").alias("day"), start.alias("start"), stop.alias("stop"))))


def opening_windows(text: Column) -> Column:
    """Array of (day from Monday 0, start, stop in minutes); stop at or before start is the next day. Null if any rule can't be read."""
    plain = F.regexp_replace(F.lower(text), "[–—−]", "-")
    rules = F.filter(F.split(plain, ";"), lambda r: F.trim(r) != "")
    always = F.array(*(F.struct(F.lit(d).alias("day"), F.lit(0).alias("start"), F.lit(1440).alias("stop")) for d in range(7)))
    return F.when(F.trim(plain).isin(*ALWAYS), always).when(F.size(rules) > 0, F.flatten(F.transform(rules, _rule)))


def parsed_hours(rows: DataFrame, column: str) -> DataFrame:
    """column, windows: each different text of rows once. Rows share few texts, and reading one costs much more than a join."""
    return rows.select(column).where(F.col(column).isNotNull()).distinct().withColumn("windows", opening_windows(F.col(column)))


def minute_of_week(ts: Column) -> Column:
    return F.weekday(ts) * 1440 + F.hour(ts) * 60 + F.minute(ts)


def open_at(windows: Column, minute: Column) -> Column:
    """Whether one of the windows holds the minute of the week; null if the windows are unknown."""

    def holds(w: Column) -> Column:
        start = w["day"] * 1440 + w["start"]
        stop = w["day"] * 1440 + w["stop"] + F.when(w["stop"] <= w["start"], 1440).otherwise(0)
        return ((start <= minute) & (minute < stop)) | ((start <= minute + WEEK) & (minute + WEEK < stop))

    return F.when(windows.isNotNull(), F.exists(windows, holds))


def moment(text: Column, offset_hours: int = 3) -> Column:
    """A moment without a zone is local time, so many hours ahead; one with a zone is itself."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    own = F.try_to_timestamp(text)
    return F.when(zoned, own).otherwise(own - F.expr(f"interval {offset_hours} hours"))


def free_entry(fee: Column, text: Column) -> Column:
    """True, false or null: the tag first, then words, then any digit means paid."""
    low = F.lower(F.coalesce(text, F.lit("")))
    any_of = lambda words: F.greatest(*(F.contains(low, F.lit(w)) for w in words))
    return F.when(F.lower(fee) == "no", True).when(F.lower(fee) == "yes", False).when(any_of(FREE_WORDS), True).when(any_of(PAID_WORDS), False).when(low.rlike(r"\d"), False)


def ticket_text(*choices: Column) -> Column:
    """The first that holds more than punctuation."""
    return F.coalesce(*(F.when(c.rlike(r"[\p{L}\p{N}]"), F.trim(c)) for c in choices))
