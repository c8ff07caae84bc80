"""Hierarchical packing of token ids into sequences of several lengths.

Every task packs its own documents, a window of ``WINDOW`` ids at a time, so texts are read once and never shuffled:

* route: a document's whole runs of the longest length are sequences of their own; what is left of it goes to the
  shortest tier (``TIERS``) that holds it;
* pack: from the longest tier down, the longest unit opens a sequence of its tier's length, and the gap takes the
  longest units that fit, which come from shorter tiers;
* where nothing fits, the gap takes the head of the longest unit of the shortest tier that has one, whose rest goes to
  its own tier. Sequences are so full to the last id; each cuts one document at its end at most;
* balance: sequences of a tier are dealt out over step groups of ``STEP`` ids, in turns back and forth by their
  attention costs (squared lengths of pieces).

A sequence that a window can't fill is taken on by the next one; the last one of a task, fewer ids than the longest
length, becomes sequences of powers of two (tiers below ``TIERS`` occur only there). So nothing is padded at all.

Ids are written as token files (see tokenfile); sequences lie in them one after another. File names are unique to the
attempt, and only those of the attempt that succeeded are in the table of pieces, so retried tasks do no harm.

Defined results: a null text is an empty one and has the end id alone; null and repeated ids are packed as any other,
each row by itself; a text longer than any sequence fills as many as it takes; an empty table has no pieces; other
columns are ignored. Which documents share a sequence depends on how the table is dealt out over tasks.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, scratch, settle
from .encoder import encoder_of, with_ends
from .tokenfile import PART_BYTES, PART_ROWS, Shard, ShardWriter, _open

#: Lengths of sequences; powers of two.
TIERS = (512, 1024, 2048, 4096)
#: Ids that are packed together: 2 bytes each, and about as much again for what is put together.
WINDOW = 4 << 20
#: Ids of a step group.
STEP = 1 << 16
#: A task's first sequence and step group have its number times this.
OF_TASK = 1 << 32

PIECE = [("row", np.int64), ("start", np.int64), ("length", np.int64), ("seq", np.int64), ("offset", np.int64)]


class Units:
    """What is left of documents, by length: (row, start, length), taken longest first."""

    def __init__(self, most: int) -> None:
        self.by_length: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]
        self.held = 0  # bit k: there is a unit of length k

    def put(self, row: int, start: int, length: int) -> None:
        self.by_length[length].append((row, start))
        self.held |= 1 << length

    def longest(self, most: int) -> int:
        """The greatest length up to most that a unit has, or 0."""
        return max(0, (self.held & ((2 << most) - 1)).bit_length() - 1)

    def take(self, length: int) -> tuple[int, int]:
        own = self.by_length[length]
        found = own.pop()
        if not own:
            self.held ^= 1 << length
        return found


def pack_units(lengths: np.ndarray, *, tiers: tuple[int, ...] = TIERS, last: bool = False) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Pieces (row, start, length, seq, offset) of documents of these lengths, each sequence's length, and what fills no sequence.

    The last of a task leaves nothing: what fills no sequence becomes shorter ones.
    """
    most = tiers[-1]
    pieces: list[tuple[int, int, int, int, int]] = []
    sizes: list[int] = []
    units = Units(most)
    for row, n in enumerate(lengths.tolist()):
        whole = n // most * most
        for start in range(0, whole, most):
            pieces.append((row, start, most, len(sizes), 0))
            sizes.append(most)
        if n > whole:
            units.put(row, whole, n - whole)
    left: list[tuple[int, int, int]] = []
    while units.held:
        first = units.longest(most)
        size = next(t for t in tiers if t >= first)
        own, full = [(*units.take(first), first)], first
        while full < size:
            gap = size - full
            n = units.longest(gap)
            if n:
                own.append((*units.take(n), n))
            else:
                n = next((m for m in map(units.longest, tiers) if m > gap), 0)
                if not n:
                    break
                row, start = units.take(n)
                own.append((row, start, gap))
                units.put(row, start + gap, n - gap)
                n = gap
            full += n
        if full < size:
            left = own
            break
        offset = 0
        for row, start, n in own:
            pieces.append((row, start, n, len(sizes), offset))
            offset += n
        sizes.append(size)
    if last:
        rest = sum(n for _, _, n in left)
        bounds = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
        todo = left[::-1]
        for size in bounds:
            offset = 0
            while offset < size:
                row, start, n = todo.pop()
                if offset + n > size:
                    todo.append((row, start + size - offset, n - size + offset))
                    n = size - offset
                pieces.append((row, start, n, len(sizes), offset))
                offset += n
            sizes.append(size)
        left = []
    return np.array(pieces, PIECE), np.array(sizes, np.int64), left


def step_groups(pieces: np.ndarray, sizes: np.ndarray, *, step: int = STEP) -> tuple[np.ndarray, int]:
    """The step group of each sequence, and how many there are. Groups of a length differ by one sequence at most, and hardly in cost."""
    cost = np.bincount(pieces["seq"], weights=pieces["length"].astype(float) ** 2, minlength=len(sizes))
    group, n = np.zeros(len(sizes), np.int64), 0
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        own = own[np.argsort(-cost[own], kind="stable")]
        groups = -(-len(own) * int(size) // step)
        turn, place = np.divmod(np.arange(len(own)), groups)
        group[own] = n + np.where(turn % 2, groups - 1 - place, place)
        n += groups
    return group, n


class Window:
    """Documents that are packed together: their ids, end to end, and what they are."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.names: list[pa.Array] = []
        #: Of each document: ids that lie in it before its part here, length of that part, length of the document.
        self.before: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.whole: list[np.ndarray] = []
        self.held = 0

    def add(self, names: pa.Array, ids: np.ndarray, before: np.ndarray, lengths: np.ndarray, whole: np.ndarray) -> None:
        for to, x in ((self.names, names), (self.ids, ids), (self.before, before), (self.lengths, lengths), (self.whole, whole)):
            to.append(x)
        self.held += len(ids)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write packed sequences; their pieces: id_col, start, length, doc_tokens, sequence_id, offset, tier, step_id, ids_file, at.

    start: the document's ids before the piece. tier: the sequence's length. at: where the piece lies in ids_file.
    """
    folder = scratch(docs.sparkSession, "packed")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encoder = encoder_of(tokenizer_path)
        writer, name = None, f"{folder}/{task:08d}-{uuid.uuid4().hex}-ids.arrow"
        window, n_seq, n_step = Window(), task * OF_TASK, task * OF_TASK

        def packed(*, last: bool) -> pa.RecordBatch:
            nonlocal window, n_seq, n_step
            names, ids = pa.concat_arrays(window.names), np.concatenate(window.ids)
            before, lengths, whole = (np.concatenate(x) for x in (window.before, window.lengths, window.whole))
            begins = np.cumsum(lengths) - lengths
            pieces, sizes, left = pack_units(lengths, last=last)
            group, groups = step_groups(pieces, sizes)
            of = pieces["row"]
            at = writer.total + (np.cumsum(sizes) - sizes)[pieces["seq"]] + pieces["offset"]
            for a, n in zip((begins[of] + pieces["start"]).tolist(), pieces["length"].tolist(), strict=True):
                writer.add(ids[a : a + n])
            out = pa.RecordBatch.from_arrays(
                [names.take(pa.array(of)), *map(pa.array, (before[of] + pieces["start"], pieces["length"], whole[of], n_seq + pieces["seq"], pieces["offset"], sizes[pieces["seq"]], n_step + group[pieces["seq"]])), pa.array([name] * len(of), pa.string()), pa.array(at)],
                names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step_id", "ids_file", "at"],
            )
            n_seq, n_step, window = n_seq + len(sizes), n_step + groups, Window()
            for row, start, n in left:
                a = begins[row] + start
                window.add(names.slice(row, 1), ids[a : a + n].copy(), before[row : row + 1] + start, np.array([n]), whole[row : row + 1])
            return out

        for batch in parts(batches, rows=PART_ROWS, size=PART_BYTES):
            if writer is None:
                system, path = _open(name)
                system.create_dir(os.path.dirname(path), recursive=True)
                writer = ShardWriter(name, encoder.dtype)
            ids, at = with_ends(*encoder.encode(batch.column(1)), end_id)
            lengths = np.diff(at)
            window.add(batch.column(0), ids, np.zeros(len(lengths), np.int64), lengths, lengths)
            if window.held >= WINDOW:
                yield packed(last=False)
        if writer is not None:
            if window.held:
                yield packed(last=True)
            writer.close()

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = picked.mapInArrow(run, f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, tier long, step_id long, ids_file string, at long")
    return settle(found, "pieces").withColumnRenamed("id", id_col)


def with_sums(pieces: DataFrame) -> DataFrame:
    """pieces with ids_crc32, of their ids as read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, name = None, None
        for batch in batches:
            sums = []
            for file, a, n in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("ids_file", "at", "length")), strict=True):
                if file != name:
                    shard, name = Shard(file), file
                crc = 0
                for part in shard.slices(a, a + n):
                    crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                sums.append(crc)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], names=[*batch.schema.names, "ids_crc32"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return pieces.mapInArrow(run, f"{fields}, ids_crc32 long")
