"""Token ids of whole Arrow columns of texts, cut into pieces by byte classes and encoded once a distinct piece.

The vocabulary file in use drops white space, cuts the rest into pieces, and ends each piece with a token that ends in
``</w>``, so a text's ids are those of its pieces, one after another. Where a file says that it cuts text so (``CUTS``),
pieces are found with NumPy over the column's bytes and only pieces that the worker hasn't met go through the library;
with any other file every text goes through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

import numpy as np
import pyarrow as pa

#: Pieces of a generation, of which a worker remembers two: some 150 bytes each.
CACHE = 300_000
#: Pieces that are encoded by one call.
BLOCK = 2000

#: The parts of a tokenizer's file that say how it cuts text.
CUTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "type": "BPE",
    "dropout": None,
    "continuing_subword_prefix": None,
    "end_of_word_suffix": "</w>",
}

BLANK, LETTER, SIGN, DIGIT, ODD = range(5)
#: The first byte of U+00C0 to U+00FF, whose lower case is 32 further on.
LATIN = 0xC3


def _classes() -> np.ndarray:
    """Of each byte. Words that hold an odd one are left to the library: what it normalises, contractions, special tokens."""
    own = np.full(256, ODD, np.uint8)
    own[0x21:0x7F] = SIGN
    own[[ord("'"), ord("<")]] = ODD
    own[0x30:0x3A] = DIGIT
    own[0x41:0x5B] = own[0x61:0x7B] = LETTER
    own[0x80:0xC0] = own[LATIN] = LETTER
    own[0x09:0x0E] = own[0x20] = BLANK
    return own


CLASSES = _classes()
ODD_BYTES = re.compile(b"[" + b"".join(b"\\x%02x" % i for i in np.flatnonzero(CLASSES == ODD)) + b"]|\xc3[\x97\xb7]")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each text begins, with the end of the last; nulls are empty."""
    width = np.dtype(np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return raw, at - at[0]


def cut_pieces(raw: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts in order, lower-cased unless odd, and how many begin before each text's start."""
    kind = CLASSES[raw]
    before = np.zeros(len(raw), np.uint8)
    before[1:] = raw[:-1]
    latin = before == LATIN
    kind[latin & ((raw == 0x97) | (raw == 0xB7))] = ODD  # signs among the letters
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    first = first[:-1]
    full = kind != BLANK
    odd = kind == ODD
    if odd.any():
        begins = full.copy()
        begins[1:] &= ~full[:-1] | first[1:]
        word = np.cumsum(begins, dtype=np.int32)
        strange = np.zeros(int(word[-1]) + 1, bool)
        strange[word[odd]] = True
        kind[strange[word] & full] = ODD
    low = LOWER[raw]
    low[latin & (raw >= 0x80) & (raw <= 0x9E)] += 32
    low = np.where(kind == ODD, raw, low)
    begins = full & (kind == DIGIT)
    begins |= first & full
    begins[1:] |= full[1:] & (kind[1:] != kind[:-1])
    if len(full):
        begins[0] = full[0]
    held = np.cumsum(full, dtype=np.int32)  # bytes up to and with each
    starts = np.flatnonzero(begins)
    ends = np.append(held[starts] - 1, held[-1] if len(held) else 0).astype(np.int32, copy=False)
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(low[full]))])
    return pieces, np.searchsorted(starts, at)


class WordEncoder:
    """Encodes columns of texts, remembering pieces where the vocabulary file allows it."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        held = json.loads(Path(path).read_text(encoding="utf-8"))
        by_piece = {k: held.get(k) for k in ("normalizer", "pre_tokenizer", "post_processor")} | {k: held["model"].get(k) for k in ("type", "dropout", "continuing_subword_prefix", "end_of_word_suffix")}
        # Signs may be encoded apart only where no special token is among them.
        self.by_piece = by_piece == CUTS and all(t["content"].startswith("<|") and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in held["added_tokens"])
        self.dtype = np.dtype("<u2") if max(vocabulary.values()) < 1 << 16 else np.dtype("<u4")
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for s, i in vocabulary.items() if s.endswith("</w>")]] = True
        self.own: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        #: Takes pieces that are cut and lower-cased already, with blanks between.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        odd = [p for p in new if ODD_BYTES.search(p)]
        plain = list(set(new).difference(odd)) if odd else new
        for i in range(0, len(plain), BLOCK):
            block = plain[i : i + BLOCK]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(block).decode()], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(self.last[ids]) + 1
            if len(cuts) == len(block):
                raw, ends = ids.tobytes(), (cuts * self.dtype.itemsize).tolist()
                self.own.update((p, raw[a:b]) for p, a, b in zip(block, [0, *ends], ends))  # noqa: B905
            else:
                self.own.update(zip(block, self._alone([p.decode() for p in block]), strict=True))
        if odd:
            self.own.update(zip(odd, self._alone([p.decode() for p in odd]), strict=True))

    def _known(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces."""
        found = list(map(self.own.get, pieces))
        if None not in found:
            return found
        new = [p for p, ids in zip(pieces, found, strict=True) if ids is None]
        if len(self.own) + len(new) > CACHE:
            self.older, self.own, new = self.own, {}, pieces
        if self.older:
            self.own.update((p, self.older[p]) for p in new if p in self.older)
            new = [p for p in new if p not in self.own]
        self._learn(new)
        return list(map(self.own.__getitem__, pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column, one text after another, and where each text's begin, with the end of the last."""
        size = self.dtype.itemsize
        if not self.by_piece:
            each = self._alone([t or "" for t in texts.to_pylist()])
            return np.frombuffer(b"".join(each), self.dtype), np.cumsum([0, *(len(e) // size for e in each)])
        pieces, upto = cut_pieces(*text_bytes(texts))
        coded = pieces.dictionary_encode()
        _, bounds, data = coded.dictionary.buffers()
        bounds, data = np.frombuffer(bounds, np.int32)[: len(coded.dictionary) + 1].tolist(), data.to_pybytes() if data else b""
        each = self._known([data[a:b] for a, b in zip(bounds, bounds[1:])])  # noqa: B905
        ends = np.zeros(len(each) + 1, np.int32)
        np.cumsum(np.fromiter(map(len, each), np.int32, len(each)) // size, out=ends[1:])
        lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.frombuffer(b"".join(each), self.dtype))).take(coded.indices)
        return lists.values.to_numpy(), lists.offsets.to_numpy()[upto]


def with_ends(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    n = len(at) - 1
    closed = at + np.arange(n + 1)
    whole = np.full(len(ids) + n, end_id, ids.dtype)
    own = np.ones(len(whole), bool)
    own[closed[1:] - 1] = False
    whole[own] = ids
    return whole, closed


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """A worker's own encoder, which remembers pieces from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
