"""Filter interaction audit: what each filter removes in every order of a chain, from one scan of the texts.

Texts are scanned as Arrow buffers: byte classes by a table, prefix sums for counts of words, capitals, symbols and code
points, and words as 64-bit hashes, sorted within each document, for distinct ones. Equal hashes are verified byte by
byte, and a document where two words share a hash is counted anew by its words themselves. What is left of a document
is a bit mask of the filters that it fails; masks are counted by part and label, and every order is worked out from
these counts.

Defined results: a null text is an empty one; a null id has no labels and is no copy of, nor original for, any other
row; rows with equal id and text are no copies of each other; of several labels of an id, any that is 1 counts; a null
part is the empty string; an empty table has no parts; texts may be of any length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, settle
from .encoder import text_bytes

PART_ROWS = 20_000
SYMBOLS = b"#$%&*|"
#: Any odd number; bytes of a word are digits of its hash to this base.
BASE = 0x9E3779B97F4A7C15
#: Longer words are compared one pair at a time.
LANES = 8

WORD, CAPITAL, SYMBOL, POINT = 1, 2, 4, 8


def _classes() -> np.ndarray:
    own = np.full(256, WORD | POINT, np.uint8)
    own[0x41:0x5B] |= CAPITAL
    own[list(SYMBOLS)] |= SYMBOL
    own[0x80:0xC0] = WORD  # within a code point
    own[0x09:0x0E] = own[0x20] = POINT
    return own


CLASSES = _classes()


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set within each text."""
    upto = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=upto[1:])
    return upto[at[1:]] - upto[at[:-1]]


def _hashes(letters: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    powers = np.ones(int(lengths.max(initial=1)), np.uint64)
    powers[1:] = BASE
    powers = np.cumprod(powers, dtype=np.uint64)
    place = np.arange(len(letters), dtype=np.int64) - np.repeat(begins, lengths)
    sums = np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * powers[place], begins)
    sums ^= sums >> np.uint64(31)
    return sums * np.uint64(0xD6E8FEB86659FD93)


def _same(letters: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the words of these lengths that begin at a and at b are equal: eight bytes at a time."""
    padded = np.zeros(len(letters) + 8, np.uint8)
    padded[: len(letters)] = letters
    eight = np.ndarray((len(letters) + 1,), "<u8", padded, strides=(1,))
    equal = np.ones(len(a), bool)
    todo = np.arange(len(a))
    for k in range(LANES):
        rest = lengths[todo] - 8 * k
        mask = np.where(rest >= 8, np.uint64(2**64 - 1), (np.uint64(1) << (8 * rest.clip(0, 7)).astype(np.uint64)) - np.uint64(1))
        equal[todo] = ((eight[a[todo] + 8 * k] ^ eight[b[todo] + 8 * k]) & mask) == 0
        todo = todo[(rest > 8) & equal[todo]]
        if not len(todo):
            return equal
    for i in todo.tolist():
        x, y, n = int(a[i]), int(b[i]), int(lengths[i])
        equal[i] = np.array_equal(letters[x : x + n], letters[y : y + n])
    return equal


def count_distinct(letters: np.ndarray, begins: np.ndarray, lengths: np.ndarray, text: np.ndarray, n_texts: int, hashes: np.ndarray) -> np.ndarray:
    """Distinct words of each text. Words lie end to end in letters; text is each word's, in order."""
    words = np.bincount(text, minlength=n_texts)
    if not len(begins):
        return words
    bits = max(1, n_texts - 1).bit_length()
    keys = (text.astype(np.uint64) << np.uint64(64 - bits)) | (hashes >> np.uint64(bits))
    order = np.argsort(keys)
    again = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    a, b = order[again], order[again + 1]
    sound = lengths[a] == lengths[b]
    sound[sound] = _same(letters, begins[a[sound]], begins[b[sound]], lengths[a[sound]])
    distinct = words - np.bincount(text[a], minlength=n_texts)
    for t in np.unique(text[a[~sound]]).tolist():
        own = np.flatnonzero(text == t)
        distinct[t] = len({letters[s : s + n].tobytes() for s, n in zip(begins[own].tolist(), lengths[own].tolist(), strict=True)})
    return distinct


def scan(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text."""
    kind = CLASSES[raw]
    inside = (kind & WORD).astype(bool)
    begins = inside.copy()
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    begins[1:] &= ~inside[:-1] | first[1:-1]
    words = _per_text(begins, at)
    letters = raw[inside]
    starts = (np.cumsum(inside) - 1)[begins]
    lengths = np.diff(np.append(starts, len(letters)))
    hashes = _hashes(letters, starts, lengths) if len(starts) else np.zeros(0, np.uint64)
    return {
        "n_words": words,
        "n_distinct": count_distinct(letters, starts, lengths, np.repeat(np.arange(len(words)), words), len(words), hashes),
        "n_capitals": _per_text(kind & CAPITAL != 0, at),
        "n_symbols": _per_text(kind & SYMBOL != 0, at),
        "n_points": _per_text(kind & POINT != 0, at),
    }


COUNTS = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_points")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, rows=PART_ROWS):
        raw, at = text_bytes(batch.column("text"))
        found = scan(raw, at)
        view, bounds = memoryview(raw), at.tolist()
        digests = [hashlib.sha256(view[a:b]).digest()[:16] for a, b in zip(bounds, bounds[1:])]  # noqa: B905
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(digests, pa.binary()), *(pa.array(found[c]) for c in COUNTS)], names=["id", "part", "digest", *COUNTS])


def measure_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part, digest (half of the text's SHA-256) and the counts of every text."""
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    return picked.mapInArrow(_measured, f"id {kind}, part string, digest binary, " + ", ".join(f"{c} long" for c in COUNTS))


def failing_masks(measured: DataFrame, conditions: dict[str, str | None]) -> DataFrame:
    """id, part, mask: bit k is set where filter k fails. A condition is SQL over the counts; None: a copy of a smaller id's text."""
    bits = [F.lit(0) if says is None else F.when(F.expr(says), 1 << k).otherwise(0) for k, says in enumerate(conditions.values())]
    rows = measured.select("id", "part", "digest", sum(bits[1:], bits[0]).cast("int").alias("mask"))
    copies = [k for k, says in enumerate(conditions.values()) if says is None]
    if not copies:
        return rows.drop("digest")
    # Copies of a text come down to one row a task before the shuffle, and meet their original by text and id, so that no text is a hot key.
    firsts = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("original", F.lit(1 << copies[0]))
    mask = F.col("mask") + F.when(F.col("id").isNull() | F.col("original").isNotNull(), 0).otherwise(1 << copies[0])
    return rows.join(firsts, ["digest", "id"], "left").select("id", "part", mask.alias("mask"))


def interactions(cells: DataFrame, letters: str) -> DataFrame:
    """For every part, order of the filters and step: what is kept, removed and lost there.

    cells: part, mask, n, good, toxic (rows with this mask, and how many of them are labelled so).
    """
    n = len(letters)
    masks = np.arange(1 << n)
    orders = ["".join(p) for p in permutations(letters)]
    steps = [(o, k, letters.index(c), sum(1 << letters.index(x) for x in o[:k])) for o in orders for k, c in enumerate(o)]
    fails = np.array([masks >> b & 1 for _, _, b, _ in steps], bool)
    gone = np.array([masks & before for *_, before in steps]) > 0
    alone = np.array([masks == 1 << b for _, _, b, _ in steps])
    own = np.array([b for _, _, b, _ in steps])
    names = pd.DataFrame({"filter_order": [o for o, *_ in steps], "step": np.array([k + 1 for _, k, *_ in steps], np.int32)})

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, held in zip(frame["part"], frame["cells"], strict=True):
                count = np.zeros((3, 1 << n), np.int64)
                for c in held:
                    count[:, c["mask"]] += (c["n"], c["good"], c["toxic"])
                removed = (fails & ~gone).astype(np.int64) @ count.T
                by_filter = np.array([removed[own == b, 0].sum() for b in range(n)])
                yield names.assign(
                    part=part, kept=(~fails & ~gone).astype(np.int64) @ count[0], removed=removed[:, 0], redundant=(fails & gone).astype(np.int64) @ count[0],
                    unique_fails=alone.astype(np.int64) @ count[0], good_lost=removed[:, 1], toxic_lost=removed[:, 2], shapley=by_filter[own],
                )[FIELDS]

    # A part has a row for each mask at most.
    each = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return each.mapInPandas(reduce, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


FIELDS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_filters(docs: DataFrame, labels: DataFrame, conditions: dict[str, str | None], *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """interactions() of these filters (letter -> condition, see failing_masks) over docs; labels: id_col, quality, toxic."""
    measured = settle(measure_texts(docs, id_col=id_col, text_col=text_col, part_col=part_col), "measured")
    masks = failing_masks(measured, conditions)
    is_1 = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(is_1("quality"), is_1("toxic"))
    cells = masks.join(known, "id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    return interactions(cells, "".join(conditions))
