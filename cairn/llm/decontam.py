"""Benchmark decontamination with an FM-index per training shard.

A task gathers its documents into shards of bounded size. A shard's words become numbers (words that no benchmark
phrase holds share one number, and a run of them one symbol, for no phrase can lie across it), documents end in a
terminator, and the shard gets a suffix order, its Burrows-Wheeler transform, and a wavelet tree over that.
Benchmark windows are looked up by backward search, all windows a step at a time; their occurrences are located by
walking back to sampled suffix positions; and the spans found are merged per document.

Nothing is shuffled: the text goes through Python once. The benchmark is carried to the tasks only in slices of
``SLICE_BYTES``, whose size is checked; a larger benchmark takes one pass for each slice.

Defined results: null texts and items have no words; an item of fewer words than a window, but not none, is one
window; repeated documents get a row each; rows of the benchmark with the same item_id and text count once, and
what a null item_id's text hits is hit, but no item is named or counted for it; an empty benchmark hits nothing;
other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, settle

WINDOW = 13
#: Benchmark text that one pass carries to the tasks: some 300 MB a worker at most, for 2 million windows.
SLICE_BYTES = 8 << 20
#: Symbols of a shard: some 100 bytes each while it is built.
SHARD_SYMBOLS = 1_000_000
#: Documents of a shard, whose texts are held while it is built.
SHARD_ROWS = 20_000
#: A suffix position is kept for each so many symbols.
SAMPLE = 16

#: ASCII letters lower-cased, digits and all bytes of non-ASCII letters as they are, all else a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Positions of s in the order of their suffixes, by prefix doubling over those not yet told apart."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    put = s[order]
    first = np.maximum.accumulate(np.where(np.r_[True, put[1:] != put[:-1]], np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = first, -1
    open_ = _shared(first)
    step = 1
    while len(open_):
        own = order[open_]
        key = rank[own] * (n + 1) + rank[np.minimum(own + step, n)] + 1
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[open_] = own
        head = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(own)), 0))
        rank[own] = open_[head]
        open_ = open_[_shared(head)]
        step *= 2
    return order


def _shared(first: np.ndarray) -> np.ndarray:
    """Where a group of more than one member stands, of groups given by their first place."""
    alone = np.r_[True, first[1:] != first[:-1]] & np.r_[first[1:] != first[:-1], True]
    return np.flatnonzero(~alone)


class WaveletTree:
    """Ranks over a sequence of small numbers; one bit level after another, from the highest bit."""

    def __init__(self, s: np.ndarray, size: int) -> None:
        self.levels = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        s = s.astype(np.int32)
        for k in reversed(range(self.levels)):
            bit = (s >> k) & 1
            self.ones.append(np.r_[0, np.cumsum(bit, dtype=np.int32)].astype(np.int32))
            self.zeros.append(len(s) - int(self.ones[-1][-1]))
            high = bit.astype(bool)
            s = np.concatenate([s[~high], s[high]])

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often c stands before at, up to the offset that start() takes off."""
        for k, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros, strict=True):
            one = ones[at]
            at = np.where((c >> k) & 1, zeros + one, at - one)
        return at

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at these places, and their rank as above."""
        c = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            one = ones[at]
            bit = ones[at + 1] - one
            c = c * 2 + bit
            at = np.where(bit == 1, zeros + one, at - one)
        return c, at


class FMIndex:
    """Backward search and location over a shard; s must end in a symbol that stands nowhere else."""

    def __init__(self, s: np.ndarray, size: int) -> None:
        order = suffix_order(s)
        self.n = len(s)
        self.tree = WaveletTree(s[order - 1], size)
        self.before = np.r_[0, np.cumsum(np.bincount(s, minlength=size))]
        self.base = self.tree.rank(np.arange(size), np.zeros(size, np.int64))
        self.sampled = np.r_[0, np.cumsum(order % SAMPLE == 0)]
        self.places = order[order % SAMPLE == 0]

    def _step(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[c] + self.tree.rank(c, at) - self.base[c]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """phrases: a row each, padded in front. The range of suffixes that begin with each phrase."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1] if len(phrases) else 0
        for k in reversed(range(width)):
            live = np.flatnonzero((width - k <= lengths) & (low < high))
            if not len(live):
                break
            c = phrases[live, k]
            low[live], high[live] = self._step(c, low[live]), self._step(c, high[live])
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """The text positions of these places in the suffix order."""
        out, todo, steps = np.zeros(len(at), np.int64), np.arange(len(at)), 0
        at = at.copy()
        while len(todo):
            known = self.sampled[at + 1] > self.sampled[at]
            out[todo[known]] = self.places[self.sampled[at[known]]] + steps
            todo, at = todo[~known], at[~known]
            c, rank = self.tree.access(at)
            at = self.before[c] + rank - self.base[c]
            steps += 1
        return out


class Phrases:
    """A slice of the benchmark: numbered words, different windows, and the items that each belongs to.

    Windows are rows of an array, told apart by sorting; the items of window w are ``names[own[at[w]:at[w + 1]]]``.
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int) -> None:
        self.number: dict[bytes, int] = {}
        flat: list[int] = []
        cuts = [0]
        for _, text in items:
            flat += [self.number.setdefault(w, len(self.number) + 3) for w in words_of(text)]
            cuts.append(len(flat))
        ids, ends = np.array(flat, np.int32), np.array(cuts[1:], np.int64)
        del flat
        counts = np.diff(np.array(cuts, np.int64))
        self.window = window
        # A window for each place that has a whole one after it in its item, and one for a shorter item; padded in front.
        item = np.repeat(np.arange(len(items)), np.where(counts > 0, np.maximum(1, counts - window + 1), 0))
        first = np.r_[True, item[1:] != item[:-1]] if len(item) else np.zeros(0, bool)
        place = np.arange(len(item)) - np.maximum.accumulate(np.where(first, np.arange(len(item)), 0)) if len(item) else item
        stop = (ends - counts)[item] + place + np.minimum(counts, window)[item]
        back = np.arange(window) - window
        size = np.minimum(counts, window)[item]
        rows = np.zeros((len(item), window), np.int32)
        for k in back:
            own = -k <= size
            rows[own, k] = ids[stop[own] + k]
        keys = rows.view(np.dtype((np.void, rows.dtype.itemsize * window)))[:, 0] if len(rows) else np.zeros(0, "V4")
        order = np.argsort(keys, kind="stable")
        new = np.r_[True, keys[order][1:] != keys[order][:-1]] if len(order) else np.zeros(0, bool)
        which = np.cumsum(new) - 1
        self.rows, self.lengths = rows[order][new].astype(np.int64), size[order][new]
        pairs = np.unique(which.astype(np.int64) * len(items) + item[order]) if len(items) else np.zeros(0, np.int64)
        self.names = [name for name, _ in items]
        self.own = pairs % max(1, len(items))
        self.at = np.searchsorted(pairs // max(1, len(items)), np.arange(len(self.lengths) + 1))

    def items_of(self, window: int) -> list[str]:
        return [self.names[i] for i in self.own[self.at[window] : self.at[window + 1]] if self.names[i] is not None]


_held: dict[str, Phrases] = {}


def _phrases(mark: str, items: list[tuple[str | None, str]], window: int) -> Phrases:
    """Made once a worker, which keeps those of the latest slice only."""
    if mark not in _held:
        _held.clear()
        _held[mark] = Phrases(items, window)
    return _held[mark]


def _shard_hits(docs: list[list[bytes]], phrases: Phrases) -> list[tuple[list[tuple[int, int]], set[str]]]:
    """Of each document, the merged spans of words hit, and the items that occur. Symbols: 0 ends the shard, 1 a document, 2 is a run of other words."""
    number = phrases.number
    flat, lengths = [], []
    for words in docs:
        flat += [number.get(w, 2) for w in words]
        flat.append(1)
        lengths.append(len(words) + 1)
    flat.append(0)
    s = np.array(flat, np.int64)
    kept = np.flatnonzero(np.r_[True, (s[1:] != 2) | (s[:-1] != 2)])
    index = FMIndex(s[kept], len(number) + 3)
    low, high = index.search(phrases.rows, phrases.lengths)
    found = np.flatnonzero(high > low)
    count = (high - low)[found]
    which = np.repeat(found, count)
    places = np.repeat(low[found] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    starts = kept[index.locate(places)]
    ends = starts + phrases.lengths[which]
    begins = np.r_[0, np.cumsum(lengths)]
    own = np.searchsorted(begins, starts, "right") - 1
    out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in docs]
    for i in np.lexsort((starts, own)):
        spans, names = out[own[i]]
        a, b = int(starts[i] - begins[own[i]]), int(ends[i] - begins[own[i]])
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
        names.update(phrases.items_of(int(which[i])))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pass(docs: DataFrame, items: list[tuple[str | None, str]], window: int, schema: str) -> DataFrame:
    """docs: doc_id, text, kept, spans, items. Adds what a slice of the benchmark hits; schema names the columns to give back."""
    carried, mark = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    with_text = "text string" in schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _phrases(mark, carried.value, window)
        held: list[tuple[pa.RecordBatch, list[int]]] = []
        different: dict[str, int] = {}  # exact copies in a shard share their entry in the index
        words: list[list[bytes]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            hits = _shard_hits(words, phrases) if len(phrases.lengths) else [([], set())] * len(words)
            for batch, own in held:
                rows = []
                for k, spans, names in zip(own, batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
                    new, found = hits[k]
                    rows.append((_merged([(x["start"], x["stop"]) for x in spans] + new) if spans else new, sorted({*names, *found})))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        *([batch.column("text")] if with_text else []),
                        batch.column("kept"),
                        pa.array([len(words[k]) for k in own], pa.int64()),
                        pa.array([[{"start": a, "stop": b} for a, b in s] for s, _ in rows], span),
                        pa.array([n for _, n in rows], pa.list_(pa.string())),
                    ],
                    names=["doc_id", *(["text"] if with_text else []), "kept", "n_words", "spans", "items"],
                )

        size = 0
        for batch in parts(batches):
            own = []
            for text in batch.column("text").to_pylist():
                k = different.setdefault(text or "", len(words))
                if k == len(words):
                    words.append(words_of(text))
                    size += len(words[k]) + 1
                own.append(k)
            held.append((batch, own))
            if size >= SHARD_SYMBOLS or sum(len(b) for b, _ in held) >= SHARD_ROWS:
                yield from flush()
                held.clear(), different.clear(), words.clear()
                size = 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, schema)


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    keep: list[str] | None = None,
) -> DataFrame:
    """For every row: doc_id, n_words, spans (array of start, stop in words, merged) and items (names that occur, sorted).

    With keep, text and kept (a struct of these columns of docs) come along.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("name"), F.col(item_text).alias("text")).where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-size // SLICE_BYTES))
    out = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        (F.struct(*keep) if keep else F.lit(None).cast("boolean")).alias("kept"),
        F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    kinds = dict(out.dtypes)
    for k in range(slices):
        own = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(slices)) == k).orderBy("name", "text").collect()  # a slice of a checked size
        if k:
            out = settle(out.drop("n_words"), "decontaminated")
        text = "text string, " if keep or k < slices - 1 else ""
        out = _pass(out, [(r["name"], r["text"]) for r in own], window, f"doc_id {kinds['doc_id']}, {text}kept {kinds['kept']}, n_words long, spans {kinds['spans']}, items {kinds['items']}")
    return out if keep else out.drop("kept")


def judge(hits: DataFrame, *, least_share: float = 0.05) -> DataFrame:
    """n_hit, n_items, items_joined and contaminated, from spans and items; contaminated if at least one word in 1 / least_share is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    times = F.lit(round(1 / least_share)).cast("long")
    return (
        hits.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_joined", F.array_join("items", ","))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (times * F.col("n_hit") >= F.col("n_words")))
    )
