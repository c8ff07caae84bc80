"""Phrase collocations: bitmaps of positions per word, shifted, joined and counted in shards.

A shard (a part of a task's texts) numbers the places of its words, with a place left free between pieces, so that no
phrase runs over a piece's end. Each word of a language has a bitmap over places, kept as its blocks of eight that
aren't empty. A phrase's bitmap is its head's, shifted by one place, AND the next word's; its set bits are its
occurrences, counted by popcount and summed over shards. Phrases are extended depth first, a batch of first words at a
time, so no more than a batch's bitmaps are held.

Two passes over the texts keep rare phrases out of the shuffles:

1. shards send (hash, count) of their phrases of one and two words. Sums of equal hashes are upper bounds of what
   phrases occur, and hashes with ``least`` or more set bits in a table of ``TABLE_BITS`` bits at most, which is broadcast;
2. shards send phrases themselves whose words and neighbours are in that table, and counts are summed exactly.

The table never loses a phrase; where it is crowded, more rare phrases pass it and are dropped by their exact counts.

Defined results: a null text is an empty one; a null language is ``und``; ids play no part, so null and repeated ones
count as any row; phrases don't run over a document's end; an empty table has no phrases; texts may be of any length;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, settle
from .encoder import text_bytes

PART_ROWS = 20_000
PART_BYTES = 3 << 20
#: Of the table of hashes that may be frequent: 32 MB at most.
TABLE_BITS = 1 << 28
SLICE_BITS = 1 << 16
#: Blocks of bitmaps that are extended at once.
BATCH = 150_000
#: A language's phrases are ranked by so many tasks before its first ones meet.
SALTS = 64

INNER, BLANK, END = range(3)


def _classes() -> np.ndarray:
    own = np.full(256, INNER, np.uint8)
    own[[0x20, 0x09]] = BLANK
    own[list(b".,;:!?\n\x0b\x0c\r")] = END
    return own


CLASSES = _classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


class Shard:
    """Words of some texts and their bitmaps. Word codes tell languages apart."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        raw, at = text_bytes(texts)
        kind = CLASSES[raw]
        inner = kind == INNER
        first = np.zeros(len(raw) + 1, bool)
        first[at] = True
        begins = inner.copy()
        begins[1:] &= ~inner[:-1] | first[1:-1]
        starts = np.flatnonzero(begins)
        upto = (np.cumsum(inner, dtype=np.int32) - 1)[starts]
        letters = LOWER[raw[inner]]
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(upto, np.int32(len(letters)))), pa.py_buffer(letters)]).dictionary_encode()
        coded = langs.dictionary_encode()
        self.langs: list[str] = coded.dictionary.to_pylist()
        n = max(1, len(self.langs))
        text = np.searchsorted(at, starts, "right") - 1
        both = words.indices.to_numpy().astype(np.int64) * n + coded.indices.to_numpy()[text] if len(starts) else np.zeros(0, np.int64)
        seen = np.zeros(len(words.dictionary) * n, bool)
        seen[both] = True
        codes = np.flatnonzero(seen)
        self.word = (np.cumsum(seen) - 1)[both]
        self.lang_of = codes % n
        self.text_of = codes // n
        self.words: list[bytes] = words.dictionary.to_pylist()
        self.size = len(codes)
        self.totals = np.bincount(self.lang_of[self.word], minlength=n) if len(starts) else np.zeros(n, np.int64)
        cuts = np.cumsum((kind == END) | first[:-1], dtype=np.int32)[starts]
        place = np.arange(len(starts))
        place[1:] += np.cumsum(cuts[1:] != cuts[:-1])
        self._build(place)
        hashes = np.fromiter(map(_hash, self.words), np.uint64, len(self.words))
        self.hashes = hashes[self.text_of]
        self.lang_hash = np.fromiter((_hash(x.encode()) for x in self.langs), np.uint64, len(self.langs))[self.lang_of] if self.size else np.zeros(0, np.uint64)

    def _build(self, place: np.ndarray) -> None:
        """Bitmaps as blocks that aren't empty, by word and block, and the same by block and word."""
        order = np.argsort(self.word, kind="stable")
        word, block = self.word[order], (place >> 3)[order]
        bits = np.left_shift(1, (place & 7)[order]).astype(np.uint8)
        new = np.ones(len(order), bool)
        new[1:] = (word[1:] != word[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        self.of, self.block = word[at], block[at]
        self.bits = np.bitwise_or.reduceat(bits, at) if len(at) else bits
        self.counts = np.bincount(self.of, weights=np.bitwise_count(self.bits), minlength=self.size).astype(np.int64)
        self.n_blocks = int(place[-1] >> 3) + 2 if len(place) else 1
        by_block = np.argsort(self.block, kind="stable")
        self.there, self.there_bits = self.of[by_block], self.bits[by_block]
        self.there_at = np.searchsorted(self.block[by_block], np.arange(self.n_blocks + 1))

    def only(self, keep: np.ndarray) -> None:
        """Forget the bitmaps of other words."""
        own = keep[self.there]
        upto = np.concatenate([[0], np.cumsum(own)])
        self.there, self.there_bits, self.there_at = self.there[own], self.there_bits[own], upto[self.there_at]
        own = keep[self.of]
        self.of, self.block, self.bits = self.of[own], self.block[own], self.bits[own]

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Bitmaps of first words, a batch at a time: of, block, bits."""
        start = 0
        while start < len(self.of):
            stop = min(start + BATCH, len(self.of))
            if stop < len(self.of):
                whole = int(np.searchsorted(self.of, self.of[stop], "left"))
                stop = whole if whole > start else int(np.searchsorted(self.of, self.of[start], "right"))
            yield self.of[start:stop], self.block[start:stop], self.bits[start:stop]
            start = stop

    def extend(self, of: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bitmaps of heads with every next word: head, word, count of each phrase; and the phrases' bitmaps: of, block, bits."""
        moved = bits.astype(np.uint16) << 1
        over = moved > 255
        of, block, bits = np.concatenate([of, of[over]]), np.concatenate([block, block[over] + 1]), np.concatenate([moved & 255, moved[over] >> 8]).astype(np.uint8)
        some = bits > 0
        of, block, bits = of[some], block[some], bits[some]
        first = self.there_at[block]
        many = self.there_at[block + 1] - first
        which = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        both = np.repeat(bits, many) & self.there_bits[which]
        hit = np.flatnonzero(both)
        source = np.repeat(np.arange(len(of)), many)[hit]
        of, block, word, both = of[source], block[source], self.there[which[hit]], both[hit]
        order = np.argsort(of * self.size + word, kind="stable")
        of, word, block, both = of[order], word[order], block[order], both[order]
        new = np.ones(len(order), bool)
        new[1:] = (of[1:] != of[:-1]) | (word[1:] != word[:-1])
        at = np.flatnonzero(new)
        count = np.add.reduceat(np.bitwise_count(both), at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
        return of[at], word[at], count, np.cumsum(new) - 1, block, both

    def hash_of(self, *words: np.ndarray) -> np.ndarray:
        h = self.lang_hash[words[0]]
        for w in words:
            h = _mixed(h, self.hashes[w])
        return h


class Table:
    """Hashes that may be frequent."""

    def __init__(self, bits: int, slices: dict[int, bytes]) -> None:
        self.mask = np.uint64(bits - 1)
        self.bytes = np.zeros(bits // 8, np.uint8)
        for k, own in slices.items():
            self.bytes[k * SLICE_BITS // 8 : k * SLICE_BITS // 8 + len(own)] = np.frombuffer(own, np.uint8)

    def holds(self, h: np.ndarray) -> np.ndarray:
        slot = h & self.mask
        return (self.bytes[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in parts(batches, rows=PART_ROWS, size=PART_BYTES):
        yield Shard(batch.column("text"), batch.column("lang"))


def _send_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    for shard in _shards(batches):
        yield out(shard.hash_of(np.arange(shard.size)), shard.counts)
        for own in shard.batches():
            head, word, count, *_ = shard.extend(*own)
            yield out(shard.hash_of(head, word), count)


def frequent_table(hashes: DataFrame, least: int) -> Table:
    """hashes: h, n. The table of those that sum up to least; its slices are filled by tasks, and it has TABLE_BITS bits at most."""
    sums = settle(hashes.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h"), "hashes")
    bits = max(SLICE_BITS, min(TABLE_BITS, 1 << (16 * sums.count()).bit_length()))
    slot = F.col("h").bitwiseAND(bits - 1)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = np.sort(batch.column(0).to_numpy())
            for own in np.split(slots, np.flatnonzero(np.diff(slots >> 16)) + 1) if len(slots) else []:
                flags = held.setdefault(int(own[0]) >> 16, np.zeros(SLICE_BITS, bool))
                flags[own & (SLICE_BITS - 1)] = True
        for k, flags in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(flags, bitorder="little").tobytes()])], names=["slice", "bits"])

    dealt = sums.select(slot.alias("slot")).distinct().repartition(F.shiftright("slot", 16)).select("slot")
    return Table(bits, {r["slice"]: r["bits"] for r in dealt.mapInArrow(fill, "slice long, bits binary").toLocalIterator()})


def count_phrases(docs: DataFrame, *, most_words: int = 3, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """lang, phrase, words, n: phrases of up to most_words words that occur least times or more; and lang, n: all words."""
    spark = docs.sparkSession
    picked = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    table = spark.sparkContext.broadcast(frequent_table(picked.mapInArrow(_send_hashes, "h long, n long"), least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = table.value.holds

        for shard in _shards(batches):

            text = [w.decode() for w in shard.words]

            def out(words: list[np.ndarray], n: np.ndarray, shard: Shard = shard, text: list[str] = text) -> pa.RecordBatch:
                each = [[text[k] for k in shard.text_of[w].tolist()] for w in words]
                langs = pa.array(shard.langs).take(pa.array(shard.lang_of[words[0]]))
                return pa.RecordBatch.from_arrays([langs, pa.array(map(" ".join, zip(*each, strict=True)), pa.string()), pa.array(np.full(len(n), len(words), np.int32)), pa.array(n)], names=["lang", "phrase", "words", "n"])

            def deeper(heads: list[np.ndarray], of: np.ndarray, block: np.ndarray, bits: np.ndarray, shard: Shard = shard) -> Iterator[pa.RecordBatch]:
                head, word, count, at, block, bits = shard.extend(of, block, bits)
                words = [*(h[head] for h in heads), word]
                keep = may(shard.hash_of(*words[-2:]))
                found = [w[keep] for w in words]
                yield out(found, count[keep])
                if len(words) < most_words and keep.any():
                    own = keep[at]
                    yield from deeper(found, (np.cumsum(keep) - 1)[at[own]], block[own], bits[own])

            yield pa.RecordBatch.from_arrays([pa.array(shard.langs, pa.string()), pa.array([None] * len(shard.langs), pa.string()), pa.array(np.zeros(len(shard.langs), np.int32)), pa.array(shard.totals[: len(shard.langs)])], names=["lang", "phrase", "words", "n"])
            known = np.arange(shard.size)
            keep = may(shard.hash_of(known))
            yield out([known[keep]], shard.counts[keep])
            if most_words > 1:
                shard.only(keep)
                for own in shard.batches():
                    yield from deeper([known], *own)

    sums = picked.mapInArrow(run, "lang string, phrase string, words int, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    counted = settle(sums.where((F.col("n") >= least) | F.col("phrase").isNull()), "phrases")
    return counted.where("phrase is not null"), counted.where("phrase is null").select("lang", "n")


def collocations(docs: DataFrame, *, most_words: int = 3, least: int = 10, covered: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first top phrases of two words and more.

    Cut after its first k words, a phrase that occurs a times scores floor(1000000 a a / (l r)), l and r being counts of
    its parts; its lowest cut counts. Phrases within a longer one that occurs at least covered per cent as often are dropped.
    """
    counted, totals = count_phrases(docs, most_words=most_words, least=least, text_col=text_col, lang_col=lang_col)
    found = counted.where("words > 1").withColumnRenamed("n", "a")
    head = F.expr("substring_index(phrase, ' ', k)")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumn("head", head)
    cuts = cuts.withColumn("tail", F.expr("substring(phrase, length(head) + 2)"))
    part = lambda name, n: counted.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    # Counts below 10^15: products of three numbers are exact in 38 digits.
    score = F.expr("(cast(a AS decimal(15,0)) * cast(a AS decimal(15,0)) * cast(1000000 AS decimal(7,0))) div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))")
    lowest = F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest)
    within = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    longer = found.where("words > 2").select("lang", F.explode(within).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
