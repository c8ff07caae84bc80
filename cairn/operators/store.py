"""The operational store as tables: visits, threads, sessions, paging. State changes give a new snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import settle


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def appended(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, revision and order columns of new rows: revisions go on from the last one, from 0 for a new key."""
    last = old.groupBy(key).agg(F.max("revision").alias("last"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return new.withColumn("place", place).join(last, key, "left").withColumn("revision", (F.coalesce("last", F.lit(-1)) + F.col("place")).cast("int")).drop("place", "last")


def marked(visits: DataFrame, new: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """visits with new marks: unknown ids are skipped, and a mark that is there keeps its first time. keys: user, place."""
    fresh = new.groupBy(*keys).agg(F.min("ts").alias("ts")).join(known, keys[1], "left_semi").join(visits, keys, "left_anti")
    return visits.select(*keys, "ts").unionByName(fresh.select(*keys, "ts"))


def page(rows: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """A page of the ordered rows: the feature is the page."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def without(parent: DataFrame, gone: DataFrame, key: str, children: list[DataFrame]) -> list[DataFrame]:
    """Parents and children without those of a deleted key."""
    return [df.join(gone.select(key), key, "left_anti") for df in (parent, *children)]


@dataclass(frozen=True)
class Reference:
    """A column of child that names keys of parent; where one goes, the child's row goes too, or the column is null from then on."""

    child: str
    column: str
    parent: str
    cascade: bool = True


def cascaded(tables: dict[str, DataFrame], keys: dict[str, str], references: list[Reference], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables after the rows of these keys are deleted, with all that hangs on them, over any number of steps.

    Keys that go are gathered round by round, by joins of each child with what its parent lost in the last round, until a
    round finds none; tables may refer to one another or to themselves in circles. keys: of each table its key column;
    gone: of some tables the keys to delete (one column). Keys that no row has, and null references, do nothing.
    """
    lost = {t: settle(tables[t].join(df.toDF(keys[t]).distinct(), keys[t], "left_semi").select(keys[t]), "lost") for t, df in gone.items()}
    fresh = dict(lost)
    while fresh:
        found: dict[str, DataFrame] = {}
        for r in references:
            if r.cascade and r.parent in fresh:
                # A key is short beside its row, and each goes once.
                own = tables[r.child].join(fresh[r.parent].toDF(r.column), r.column, "left_semi").select(keys[r.child])
                found[r.child] = found[r.child].unionByName(own) if r.child in found else own
        fresh = {}
        for t, df in found.items():
            new = df.distinct()
            new = settle(new.join(lost[t], keys[t], "left_anti") if t in lost else new, "lost")
            if not new.isEmpty():
                fresh[t] = new
        for t, df in fresh.items():
            lost[t] = settle(lost[t].unionByName(df), "lost") if t in lost else df
    out = {t: df.join(lost[t], keys[t], "left_anti").select(*df.columns) if t in lost else df for t, df in tables.items()}
    for r in references:
        if not r.cascade and r.parent in lost:
            own = out[r.child]
            dead = lost[r.parent].select(F.col(keys[r.parent]).alias(r.column), F.lit(True).alias("_dead"))
            out[r.child] = own.join(dead, r.column, "left").withColumn(r.column, F.when(F.col("_dead").isNull(), F.col(r.column))).select(*own.columns)
    return out


def applied(rows: DataFrame, changes: DataFrame, *, key: str, columns: list[str], embedded: list[str], owned: str = "category") -> tuple[DataFrame, DataFrame]:
    """Rows after an ordered log of changes; and of each change what it did, with the row before and after it.

    rows: key, columns, owner, vector. changes: change_id (their order), op (create, update or delete), key, columns, and
    sets (array of the columns that an update sets, to null too). The second table: change_id, key, outcome, before and
    after (structs of columns, owner, vector; null where there is no row).

    A create of a key that is there is ``duplicate``, an update or delete of one that isn't is ``missing``; neither does
    anything. Who sets ``owned`` makes the row ``curated``; setting one of ``embedded`` clears the vector. Every column is
    the last value set since the row's last create, by windows over a key's own changes, so a log of any length is
    folded in one pass and no row is looked up.
    """
    w = Window.partitionBy(key).orderBy("change_id")
    state = [*columns, "owner", "vector"]
    base = rows.select(F.lit(None).cast("long").alias("change_id"), F.lit("create").alias("op"), key, *columns, F.array(*(F.lit(c) for c in columns)).alias("sets"), "owner", "vector")
    made = F.when(F.array_contains("sets", owned) | (F.col("op") == "create"), "curated")
    log = changes.select(F.col("change_id").cast("long").alias("change_id"), "op", key, *columns, F.coalesce("sets", F.array().cast("array<string>")).alias("sets"), made.alias("owner"), F.lit(None).cast(rows.schema["vector"].dataType).alias("vector"))
    all_ = base.unionByName(log)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    there = F.coalesce(F.last(F.when(F.col("op") == "create", True).when(F.col("op") == "delete", False), ignorenulls=True).over(before), F.lit(False))
    all_ = all_.withColumn("there", there)
    outcome = F.when(F.col("op") == "create", F.when(F.col("there"), "duplicate").otherwise("created")).when(~F.col("there"), "missing").otherwise(F.concat("op", F.lit("d")))
    all_ = all_.withColumn("outcome", outcome)
    all_ = all_.withColumn("life", F.count_if(F.col("outcome") == "created").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    new, held = F.col("outcome") == "created", F.col("outcome") == "updated"
    sets = {c: new | held & F.array_contains("sets", c) for c in columns}
    sets["owner"] = new | held & F.array_contains("sets", owned)
    sets["vector"] = new | held & F.arrays_overlap("sets", F.array(*(F.lit(c) for c in embedded)))
    life = Window.partitionBy(key, "life").orderBy("change_id")
    upto, past = life.rowsBetween(Window.unboundedPreceding, 0), life.rowsBetween(Window.unboundedPreceding, -1)
    value = lambda c, over: F.last(F.when(sets[c], F.struct(F.col(c).alias("v"))), ignorenulls=True).over(over)["v"].alias(c)
    after = F.when((new | F.col("there")) & (F.col("outcome") != "deleted"), F.struct(*(value(c, upto) for c in state)))
    done = all_.select("change_id", key, "outcome", F.when(F.col("there"), F.struct(*(value(c, past) for c in state))).alias("before"), after.alias("after"))
    last = done.groupBy(key).agg(F.max_by(F.struct("after"), F.coalesce("change_id", F.lit(-(1 << 62)))).alias("s")).where("s.after is not null")
    return last.select(key, "s.after.*"), done.where("change_id is not null")


def reconciled(recorded: DataFrame, given: DataFrame, excluded: DataFrame, *, key: str, item: str, order: str) -> DataFrame:
    """key, item, place (from 0): the stops that a change starts from.

    Recorded stops come first, then those that only the client gives, each in its order; excluded ones go. Keys
    without a record keep what the client gives.
    """
    first = recorded.select(key, item, F.lit(0).alias("from"), order)
    more = given.select(key, item, F.lit(1).alias("from"), order).join(recorded.select(key, item).distinct(), [key, item], "left_anti")
    kept = first.unionByName(more).join(excluded.select(key, item).distinct(), [key, item], "left_anti")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("from", order)) - 1).select(key, item, "place")


def adopted(journal: DataFrame, held: DataFrame, *, key: str, wanted: DataFrame | None = None) -> DataFrame:
    """key, revision, adopt: the turn of the journal that a client shows: the one wanted, if it is there, else the last.

    It is adopted if it was wanted, or if the journal has more turns than the client held. held: key, turns; wanted:
    key, wanted.
    """
    last = journal.groupBy(key).agg(F.max("revision").alias("last"), F.count("*").alias("n"))
    out = last.join(held.select(key, F.col("turns").alias("had")), key, "left").withColumn("grew", F.col("n") > F.coalesce("had", F.lit(0)))
    if wanted is None:
        return out.select(key, F.col("last").alias("revision"), F.col("grew").alias("adopt"))
    there = wanted.join(journal.select(key, F.col("revision").alias("wanted")), [key, "wanted"], "left_semi")
    return out.join(there, key, "left").select(key, F.coalesce("wanted", "last").alias("revision"), (F.col("wanted").isNotNull() | F.col("grew")).alias("adopt"))
