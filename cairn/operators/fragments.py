"""Passages of a set of items that stand verbatim in texts (STR-15)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Characters of items that travel to the tasks at once; beyond that the items go in several slices, a pass each.
SLICE_CHARS = 1_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def _hashed(code: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """n and a hash of the n characters from each place on, for n = 1, 2, 4 and so on up to most."""
    n, h = 1, code.astype(np.uint64) * ODD
    while len(h) and n <= most:
        yield n, h
        own = h[: max(0, len(h) - n)]
        h = (own ^ (own >> np.uint64(29))) * ODD + h[n:]
        n *= 2


def _code(t: str) -> np.ndarray:
    return np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)


class Passages:
    """All passages of some characters of the items, whole items where they are shorter; made once a task.

    A passage is found by a hash of its first characters, as many as the largest power of two within its length, so that
    a text is hashed once for each power of two, however many lengths there are. A hash of its last characters, as
    many, is asked next; the characters decide.
    """

    def __init__(self, items: list[str], chars: int) -> None:
        self.items = items
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for i, t in enumerate(items):
            k = min(chars, len(t))
            n = 1 << (k.bit_length() - 1)
            h = dict(_hashed(_code(t), n))[n]
            last = len(t) - k + 1
            found.setdefault(n, []).append((h[:last], h[k - n : k - n + last], np.full(last, k), np.full(last, i), np.arange(last)))
        self.by_power = {}
        for n, parts in found.items():
            columns = [np.concatenate(p) for p in zip(*parts, strict=True)]
            order = np.lexsort((columns[2], columns[0]))
            self.by_power[n] = [c[order] for c in columns]

    def of(self, t: str) -> list[int]:
        """Items with a passage in the text."""
        hits: set[int] = set()
        code = _code(t)
        for n, own in _hashed(code, max(self.by_power, default=0)):
            if n not in self.by_power:
                continue
            first, end, length, item, at = self.by_power[n]
            low = np.minimum(np.searchsorted(first, own), len(first) - 1)
            place = np.flatnonzero(first[low] == own)
            if not len(place):
                continue
            place = place[np.argsort(low[place], kind="stable")]
            starts, cuts = np.unique(low[place], return_index=True)
            for s, spots in zip(starts.tolist(), np.split(place, cuts[1:]), strict=True):
                for j in range(s, int(np.searchsorted(first, first[s], "right"))):
                    i, k, a = int(item[j]), int(length[j]), int(at[j])
                    if i in hits:
                        continue
                    those = spots[spots + k <= len(code)]
                    those = those[own[those + k - n] == end[j]]
                    part = self.items[i][a : a + k]
                    if any(t[p : p + k] == part for p in those.tolist()):
                        hits.add(i)
        return sorted(hits)


def repeated_passages(docs: DataFrame, items: DataFrame, *, chars: int | None, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """item_id, doc_id: texts in which any so many characters in a row of an item stand, blanks and case aside.

    An item that is shorter, and any item if chars is None, has to stand there as a whole; a blank one stands
    nowhere. docs: doc_id, text; items: item_id, text. Items travel to the texts in slices of a checked size; texts
    are read once for each slice, and not shuffled.
    """
    spark = docs.sparkSession
    plain = lambda c: F.lower(text.squashed(F.col(c)))
    own = items.select("item_id", plain("text").alias("text")).where("text <> ''")
    total = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-total // slice_chars))
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c, df in (("item_id", items), ("doc_id", docs)))
    texts = docs.where("text is not null").select("doc_id", plain("text").alias("text"))

    def searched(held: Broadcast) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, known = held.value
            passages = Passages(known, len(max(known, key=len, default="")) if chars is None else chars)
            ids = np.array(ids, dtype=object)
            for batch in batches:
                hits = [passages.of(t) for t in batch["text"]]
                doc = batch["doc_id"].repeat([len(x) for x in hits])
                yield pd.DataFrame({"item_id": ids[[i for x in hits for i in x]], "doc_id": doc.to_numpy()})

        return texts.mapInPandas(run, kinds)

    out = None
    for k in range(slices):
        rows = own.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k).collect()  # one slice
        part = searched(spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows])))
        out = part if out is None else out.unionByName(part)
    return out
