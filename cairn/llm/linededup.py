"""Reversible line dedup: exact reference counts per line, and cuckoo filters over the lines that are common.

The state is a table of reference counts (in how many documents a line's key stands) and a cuckoo filter for each
shard of keys, which holds the keys at or over the limit. Counts and filters can be raised by new documents and
lowered again by deleted ones, a filter entry being removed when its count falls below the limit.

To drop lines, documents' keys are looked up in the filters first; only keys that a filter may hold are held against
the exact table, and only documents with a key that it confirms are rewritten. While the common keys are few enough
(``BROADCAST_KEYS``, counted first) they travel with the filters, and no text is shuffled. Beyond that, keys that a
filter may hold are joined to the table (the filters are broadcast while their checked size allows; past it all keys
are joined), and what is found is joined back to the texts. Frequent lines and texts are salted.

A key is 128 bits of two seeded hashes of the normalised line; the keys of a document are told apart before they are
hashed, in time linear in its lines. Counting is by row: repeated rows are documents of their own. A shard without a
filter, or whose filter overflowed (null), is decided by the exact table alone. A null text is one empty line, and
empty keys are never dropped; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, salted_join, settle

BLANK_BYTES = b" \t\n\x0b\x0c\r"
SLOTS = 4
LOAD = 0.8
#: Keys that one filter holds.
SHARD_KEYS = 200_000
#: Bytes of all filters that may be broadcast.
BROADCAST_BYTES = 32 << 20
#: Common keys, of 16 bytes each, that may be broadcast.
BROADCAST_KEYS = 1_000_000
MOVES = 500
#: Seeds of the two hashes of a key.
SEED, LINE_SEED = 42, 43


class CuckooFilter:
    """16-bit fingerprints in buckets of four; supports removal."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        need = max(1, int(np.ceil(keys / (SLOTS * LOAD))))
        return cls(np.zeros((1 << max(1, (need - 1).bit_length()), SLOTS), np.uint16))

    @classmethod
    def of(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint (never 0) and both buckets."""
        keys = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        print_ = (keys >> np.uint64(48)).astype(np.uint16)
        print_[print_ == 0] = 1
        one = (keys >> np.uint64(8)) & self.mask
        return print_, one, self._other(one, print_)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return (bucket ^ (print_.astype(np.uint64) * np.uint64(0x5BD1E995))) & self.mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, one, two = self._split(keys)
        return (self.table[one] == print_[:, None]).any(axis=1) | (self.table[two] == print_[:, None]).any(axis=1)

    def _put(self, bucket: int, print_: int) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if len(free):
            self.table[bucket, free[0]] = print_
        return bool(len(free))

    def insert(self, keys: np.ndarray) -> bool:
        """False if a key found no place: a larger filter has to be built."""
        for print_, one, two in zip(*self._split(keys), strict=True):
            if self._put(int(one), int(print_)) or self._put(int(two), int(print_)):
                continue
            bucket, held = int(two), np.uint16(print_)
            for move in range(MOVES):
                slot = (int(held) + move) % SLOTS
                held, self.table[bucket, slot] = self.table[bucket, slot], held
                bucket = int(self._other(np.array([bucket], np.uint64), np.array([held], np.uint16))[0])
                if self._put(bucket, int(held)):
                    break
            else:
                return False
        return True

    def remove(self, keys: np.ndarray) -> None:
        """Only keys that were inserted."""
        for print_, *buckets in zip(*self._split(keys), strict=True):
            for b in map(int, buckets):
                at = np.flatnonzero(self.table[b] == print_)
                if len(at):
                    self.table[b, at[0]] = 0
                    break


def build_filter(keys: np.ndarray) -> CuckooFilter:
    size = len(keys)
    while True:
        out = CuckooFilter.sized(size)
        if out.insert(keys):
            return out
        size *= 2


def _keys(text: str | None) -> list[bytes]:
    """The key text of every line: stripped and A-Z lower-cased; empty for lines that are never dropped."""
    return [line.strip(BLANK_BYTES) for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def _hashes(keys: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k, seed) for k in keys), np.uint64, len(keys)).view(np.int64)


def _document_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, n of the keys of each part's documents; a key counts once a document, and a part's documents are added up."""
    for batch in parts(batches):
        seen: Counter[bytes] = Counter()
        for text in batch.column("text").to_pylist():
            seen.update(set(_keys(text)))
        seen.pop(b"", None)
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array(_hashes(keys, SEED)), pa.array(_hashes(keys, LINE_SEED)), pa.array(seen.values(), pa.int64())], names=["a", "b", "n"])


def reference_counts(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """a, b (the key), n: in how many documents it stands."""
    keys = docs.select(F.col(text_col).alias("text")).mapInArrow(_document_keys, "a long, b long, n long")
    return keys.groupBy("a", "b").agg(F.sum("n").alias("n"))


def merge_counts(counts: DataFrame, delta: DataFrame, sign: int) -> DataFrame:
    """The table after documents with counts delta came (1) or went (-1)."""
    both = counts.unionByName(delta.select("a", "b", (F.col("n") * sign).alias("n")))
    return both.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0")


def build_filters(common: DataFrame) -> DataFrame:
    """common: a, b. shard, shards, filter: a cuckoo filter for each shard of keys."""
    shards = max(1, -(-common.count() // SHARD_KEYS))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        out = build_filter(np.sort(rows["a"].to_numpy(np.int64)))
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "shards": [shards], "filter": [out.to_bytes()]})

    dealt = common.select("a", F.pmod("a", F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInPandas(build, "shard long, shards long, filter binary")


def update_filters(filters: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """added, removed: keys a, b that became common or ceased to be. Without filters yet, they are built of added.

    A filter that overflows becomes null, and stays so until rebuild_filters().
    """
    known = filters.select("shards").first()
    if known is None:
        return build_filters(added)
    shards = known[0]
    changes = added.select("a", F.lit(1).alias("way")).unionByName(removed.select("a", F.lit(-1).alias("way"))).withColumn("shard", F.pmod("a", F.lit(shards)))

    def apply(held: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if held.empty:
            new = build_filter(np.sort(rows.loc[rows["way"] == 1, "a"].to_numpy(np.int64)))
            return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "shards": [shards], "filter": [new.to_bytes()]})
        if held["filter"].iloc[0] is None:
            return held[["shard", "shards", "filter"]]
        own = CuckooFilter.of(held["filter"].iloc[0])
        own.remove(rows.loc[rows["way"] == -1, "a"].to_numpy(np.int64))
        fits = own.insert(rows.loc[rows["way"] == 1, "a"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [held["shard"].iloc[0]], "shards": [shards], "filter": [own.to_bytes() if fits else None]})

    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(apply, "shard long, shards long, filter binary")


def rebuild_filters(filters: DataFrame, common: DataFrame) -> DataFrame:
    """common: a, b, all keys that are common now. Filters that are null are made anew of them; the others stay."""
    lost = filters.where("filter is null").select("shard", "shards")
    shards = lost.agg(F.coalesce(F.max("shards"), F.lit(1))).first()[0]

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        out = build_filter(np.sort(rows["a"].to_numpy(np.int64)))
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "shards": [shards], "filter": [out.to_bytes()]})

    own = common.select("a", F.pmod("a", F.lit(shards)).alias("shard")).join(lost.select("shard"), "shard", "left_semi")
    return filters.where("filter is not null").unionByName(own.groupBy("shard").applyInPandas(build, "shard long, shards long, filter binary"))


def revise(counts: DataFrame, filters: DataFrame, *, come: DataFrame | None = None, go: DataFrame | None = None, least: int = 10, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Counts and filters after documents came and went; both are written tables.

    counts and filters may be of no documents at all. Shards that have grown to more than twice their keys are dealt
    out anew, and overflowed ones rebuilt.
    """
    after = counts
    for docs, sign in ((come, 1), (go, -1)):
        if docs is not None:
            after = merge_counts(after, reference_counts(docs, text_col=text_col), sign)
    after = settle(after, "line-counts")
    was, now = (c.where(F.col("n") >= least).select("a", "b") for c in (counts, after))
    known = filters.select("shards").first()
    if known is None or now.count() > 2 * SHARD_KEYS * known[0]:
        return after, settle(build_filters(now), "line-filters")
    changed = settle(update_filters(filters, now.join(was, ["a", "b"], "left_anti"), was.join(now, ["a", "b"], "left_anti")), "line-filters")
    if changed.where("filter is null").isEmpty():
        return after, changed
    return after, settle(rebuild_filters(changed, now), "line-filters")


class CommonKeys:
    """Exact keys, and the filters that are asked first; made once a task. Keys are held as sorted arrays, 16 bytes each."""

    def __init__(self, a: np.ndarray, b: np.ndarray, filters: dict[int, bytes], shards: int) -> None:
        order = np.lexsort((b, a))
        self.a, self.b = a[order], b[order]
        self.filters = {k: CuckooFilter.of(v) for k, v in filters.items() if v is not None}
        self.shards = shards

    def maybe(self, a: np.ndarray) -> np.ndarray:
        """Whether a filter may hold each key; a shard without one may hold any."""
        where = np.mod(a, self.shards)
        hit = np.full(len(a), bool(len(self.a)))
        for k in np.unique(where):
            if k in self.filters:
                hit[where == k] = self.filters[k].contains(a[where == k])
        return hit

    def sure(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each key is held exactly."""
        at, end = np.searchsorted(self.a, a, "left"), np.searchsorted(self.a, a, "right")
        found = np.zeros(len(a), bool)
        while (open_ := ~found & (at < end)).any():  # as often as one a has different b: once, but for collisions
            found[open_] = self.b[at[open_]] == b[open_]
            at = at + 1
        return found

    def gone(self, keys: list[bytes]) -> np.ndarray:
        """Which lines go."""
        a = _hashes(keys, SEED)
        at = np.array([i for i in np.flatnonzero(self.maybe(a)) if keys[i]], np.int64)
        return at[self.sure(a[at], _hashes([keys[i] for i in at], LINE_SEED))]


def _without(text: str | None, gone: np.ndarray) -> str:
    if not len(gone):
        return text or ""
    dropped = set(gone.tolist())
    return "\n".join([line for i, line in enumerate((text or "").split("\n")) if i not in dropped])


def _rows(batch: pa.RecordBatch, keys: list[list[bytes]], gone: list[np.ndarray]) -> pa.RecordBatch:
    kept = [_without(t, g) for t, g in zip(batch.column("text").to_pylist(), gone, strict=True)]
    n, dropped = pa.array(map(len, keys), pa.int64()), pa.array(map(len, gone), pa.int64())
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), n, dropped, pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])


def _drop_by_broadcast(picked: DataFrame, common: DataFrame, filters: DataFrame, schema: str) -> DataFrame:
    """common: a, b, of a checked number. No shuffle: every text is split where it is read."""
    table, held = common.toArrow(), filters.collect()
    a, b = (table.column(c).to_numpy() for c in ("a", "b"))
    carried = picked.sparkSession.sparkContext.broadcast((a, b, {r["shard"]: r["filter"] for r in held}, held[0]["shards"] if held else 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = CommonKeys(*carried.value)
        for batch in parts(batches):
            keys = [_keys(t) for t in batch.column("text").to_pylist()]
            yield _rows(batch, keys, [known.gone(k) for k in keys])

    return picked.mapInArrow(run, schema)


def _drop_by_join(picked: DataFrame, common: DataFrame, filters: DataFrame, schema: str) -> DataFrame:
    """Keys that a filter may hold are joined to the exact table, and what is found back to the texts.

    Equal texts lose the same lines, so a text's hash stands for all its copies.
    """
    text = F.coalesce("text", F.lit(""))
    picked = picked.withColumn("row_a", F.xxhash64(text)).withColumn("row_b", F.xxhash64(F.lit("text"), text))
    size, shards = filters.agg(F.coalesce(F.sum(F.octet_length("filter")), F.lit(0)), F.coalesce(F.max("shards"), F.lit(1))).first()
    held = {r["shard"]: r["filter"] for r in filters.collect()} if size <= BROADCAST_BYTES else {}  # of a checked size
    carried = picked.sparkSession.sparkContext.broadcast(held)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        any_ = np.zeros(1, np.int64)
        known = CommonKeys(any_, any_, carried.value, shards)
        for batch in parts(batches):
            keys = [sorted({*_keys(t)} - {b""}) for t in batch.column("text").to_pylist()]
            flat = [k for own in keys for k in own]
            a = _hashes(flat, SEED)
            hit = np.flatnonzero(known.maybe(a))
            row = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys])[hit])
            b = _hashes([flat[i] for i in hit], LINE_SEED)
            yield pa.RecordBatch.from_arrays([batch.column("row_a").take(row), batch.column("row_b").take(row), pa.array(a[hit]), pa.array(b)], names=["row_a", "row_b", "a", "b"])

    maybe = picked.select("row_a", "row_b", "text").mapInArrow(keyed, "row_a long, row_b long, a long, b long")
    sure = salted_join(settle(maybe.distinct(), "line-keys"), common, ["a", "b"])
    gone = sure.groupBy("row_a", "row_b").agg(F.collect_list("a").alias("gone_a"), F.collect_list("b").alias("gone_b"))  # the lines of one text at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            keys = [_keys(t) for t in batch.column("text").to_pylist()]
            own = [CommonKeys(np.array(a or [], np.int64), np.array(b or [], np.int64), {}, 1) for a, b in zip(batch.column("gone_a").to_pylist(), batch.column("gone_b").to_pylist(), strict=True)]
            yield _rows(batch, keys, [c.gone(k) for c, k in zip(own, keys, strict=True)])

    return salted_join(picked, settle(gone, "line-finds"), ["row_a", "row_b"], "left").select("doc_id", "text", "gone_a", "gone_b").mapInArrow(run, schema)


def drop_common_lines(docs: DataFrame, counts: DataFrame, filters: DataFrame, *, least: int, id_col: str = "doc_id", text_col: str = "text", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """id_col, n_lines (before), n_dropped, kept (the text left) for every row; lines whose key stands in at least so many documents go."""
    common = counts.where(F.col("n") >= least).select("a", "b")
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    drop = _drop_by_broadcast if common.count() <= broadcast_keys else _drop_by_join
    return drop(picked, common, filters, f"doc_id {picked.dtypes[0][1]}, n_lines long, n_dropped long, kept string").withColumnRenamed("doc_id", id_col)


def dedup_lines(docs: DataFrame, *, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, filters and removal over one corpus."""
    counts = settle(reference_counts(docs, text_col=text_col), "line-counts")
    filters = settle(build_filters(counts.where(F.col("n") >= least).select("a", "b")), "line-filters")
    return drop_common_lines(docs, counts, filters, least=least, id_col=id_col, text_col=text_col)
