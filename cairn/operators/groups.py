"""Small groups that are solved in Python, many to a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Columns = dict[str, np.ndarray]


def dealt(df: DataFrame, *keys: str, known: bool = False) -> DataFrame:
    """Rows dealt out by keys to as many tasks as the session shuffles to.

    Adaptive execution merges small partitions by their bytes; what a group costs has little to do with those. Where
    rows lie by keys already the planner leaves out dealing by them, and merges, so they are dealt by a hash of the keys.
    known: by keys themselves, for steps that need not shuffle again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(keys if known else [F.xxhash64(*keys)]))


def by_group(df: DataFrame, key: str, order: list[str], solve: Callable[[Columns], Columns], schema: str, *, stacked: bool = False) -> DataFrame:
    """solve over the columns of every group of key, in this order; its columns become rows of schema.

    A task takes its groups batch by batch and holds one batch and one group at a time; it is for groups that are
    small by nature (the stops of a walk), however many there are. A null key is a group. stacked: solve gets all
    groups of a batch that have as many rows at once, as arrays of a row for each group, and gives back such arrays.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []  # parts of the last group seen
        for batch in batches:
            if not len(batch):
                continue
            ends = _ends(batch[key])
            fresh = bool(rest) and not _same(rest[-1][key].iloc[-1], batch[key].iloc[0])
            if not fresh and not len(ends):
                rest.append(batch)
                continue
            cut = int(ends[-1]) if len(ends) else 0
            yield _solved(pd.concat([*rest, batch.iloc[:cut]], ignore_index=True), key, solve, stacked)
            rest = [batch.iloc[cut:]]
        if rest:
            yield _solved(pd.concat(rest, ignore_index=True), key, solve, stacked)

    return dealt(df, key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


#: Rows that least_of_runs takes at once.
RUN_ROWS = 1 << 16


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of some RUN_ROWS rows that hold all rows of their keys, where those of a key come next to each other."""
    held, rows, enough = [], 0, RUN_ROWS
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = np.flatnonzero(np.diff(codes(table[key])))
        if not len(starts):
            held, enough = table.to_batches(), 2 * rows
            continue
        cut = int(starts[-1]) + 1
        yield table.slice(0, cut)
        held, rows, enough = table.slice(cut).to_batches(), len(table) - cut, RUN_ROWS
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def codes(values: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers that are equal where values are, nulls too."""
    if pa.types.is_integer(values.type) and not values.null_count:
        return values.to_numpy().astype(np.int64, copy=False)
    return pc.dictionary_encode(values, null_encoding="encode").combine_chunks().indices.to_numpy().astype(np.int64)


def least(table: pa.Table, key: str, id_: str, by: str) -> np.ndarray:
    """Rows with the least by of each key and id_, the first of equals; those of a key lie next to each other."""
    ids = codes(table[id_])
    runs = np.cumsum(np.r_[0, np.diff(codes(table[key])) != 0])
    span = int(ids.max()) - int(ids.min()) + 1
    if span * (int(runs[-1]) + 1) >= 1 << 62:
        ids = np.unique(ids, return_inverse=True)[1]
        span = int(ids.max()) + 1
    own = runs * span + (ids - ids.min())
    order = np.argsort(own)
    sorted_ = own[order]
    twin = np.r_[False, sorted_[1:] == sorted_[:-1]]
    several = twin | np.r_[twin[1:], False]
    some = np.sort(order[several])
    some = some[np.lexsort((table[by].to_numpy()[some], own[some]))]  # stable
    return np.sort(np.r_[order[~several], some[np.r_[True, np.diff(own[some]) != 0][: len(some)]]])


def least_of_runs(df: DataFrame, key: str, id_: str, by: str) -> DataFrame:
    """Of the rows of each key and id_ the one with the least by, the first of equals.

    Rows of a key must lie in one task and next to each other. A task holds RUN_ROWS rows, or those of one key if they
    are more, and spills nothing; an aggregate would hold all groups of the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, key):
            yield from table.take(least(table, key, id_, by)).to_batches()

    return df.mapInArrow(run, df.schema)


def _same(a: object, b: object) -> bool:
    return a == b or bool(pd.isna(a) and pd.isna(b))


def _ends(keys: pd.Series) -> np.ndarray:
    """Where another key begins."""
    codes, _ = pd.factorize(keys, use_na_sentinel=False)
    return np.flatnonzero(codes[1:] != codes[:-1]) + 1


def _solved(rows: pd.DataFrame, key: str, solve: Callable[[Columns], Columns], stacked: bool) -> pd.DataFrame:
    columns = {c: rows[c].to_numpy() for c in rows.columns}
    ends = [0, *_ends(rows[key]).tolist(), len(rows)]
    if stacked:
        sizes, out = np.diff(ends), []
        for n in np.unique(sizes):
            at = np.array(ends[:-1])[sizes == n][:, None] + np.arange(n)
            out.append({c: v.ravel() for c, v in solve({c: v[at] for c, v in columns.items()}).items()})
        return pd.concat([pd.DataFrame({c: np.concatenate([o[c] for o in out])}) for c in out[0]], axis=1)
    out = [solve({c: v[a:b] for c, v in columns.items()}) for a, b in zip(ends, ends[1:])]  # noqa: B905
    return pd.concat([pd.DataFrame({c: np.concatenate([o[c] for o in out])}) for c in out[0]], axis=1)
