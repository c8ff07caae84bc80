"""Secret scan: pattern candidates, and encodings that are confirmed by decoding them.

Base kinds are found by pattern alone. The added kinds are reported only if their structure holds:

* ``jwt``: a dotted signed token whose first part decodes to a JSON object that names ``alg`` and whose second
  part decodes to a JSON object;
* ``key``: base64 (plain or URL-safe) or hex (either case, with colons or without), wrapped and indented or not, that
  decodes to a DER sequence whose nested lengths fill it exactly and which holds an integer first (private and public key
  encodings), or to the OpenSSH key format, whose fields say where it ends. A key may begin anywhere; its own header says
  how long it is, so what stands before or follows, words or more base64, is no part of it;
* ``pem``: an armoured private key whose body decodes to such a structure.

Spans are code points, end exclusive. A null text is an empty one; whole texts are scanned, however long;
repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts

KINDS = ("assign", "access", "hex", "jwt", "key", "pem")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
JWT = re.compile(r"(?<![A-Za-z0-9])(e[wy][A-Za-z0-9_-]+)\.(e[wy3][A-Za-z0-9_-]*)\.[A-Za-z0-9_-]+")
PEM = re.compile(r"-----BEGIN ((?:[A-Z]+ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
#: Where a DER sequence may begin: its tag, a length that fits, and more of the alphabet than words have. They may overlap.
B64_HEAD = re.compile(r"(?=M[B-I][A-Za-z0-9+/_-]{20})")
HEX_HEAD = re.compile(r"(?=30:?(?:1[6-9A-Fa-f]|[2-7][0-9A-Fa-f]|8[1-4])(?::?[0-9A-Fa-f]{2}){10})")
#: The first bytes of the OpenSSH format, ``openssh-key-v1``, in base64.
SSH_HEAD = re.compile(r"b3BlbnNzaC1rZXktdjE[A-D]")
SSH_MAGIC = b"openssh-key-v1\0"
B64_RUN, B64_BREAK = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[ \t]*\r?\n[ \t]*")
HEX_RUN, HEX_BREAK = re.compile(r"[0-9A-Fa-f]+"), re.compile(r":(?:[ \t]*\r?\n[ \t]*)?|[ \t]*\r?\n[ \t]*")
URL_SAFE = str.maketrans("-_", "+/")
WORDS = ("password", "passwd", "secret", "token", "api")


def _length(data: bytes, at: int, end: int) -> tuple[int, int] | None:
    """Of a DER element whose length field is at ``at``: where its content begins and ends."""
    if at >= end:
        return None
    n = data[at]
    at += 1
    if n & 0x80:
        count = n & 0x7F
        if not 1 <= count <= 4 or at + count > end:
            return None
        n = int.from_bytes(data[at : at + count], "big")
        at += count
    return (at, at + n) if at + n <= end else None


def _fills(data: bytes, at: int, end: int) -> bool:
    """Whether elements with sound lengths fill data[at:end] exactly, nested ones too."""
    todo = [(at, end)]
    while todo:
        at, end = todo.pop()
        while at < end:
            tag = data[at]
            span = _length(data, at + 1, end)
            if span is None:
                return False
            if tag & 0x20:
                todo.append(span)
            at = span[1]
    return True


def _begins(data: bytes, size: int) -> bool:
    """Whether the elements of a sequence of this size have sound lengths as far as its first bytes show them."""
    todo = [(2 + (data[1] & 0x7F if data[1] & 0x80 else 0), size)]
    while todo:
        at, end = todo.pop()
        while at < end and at + 6 <= len(data):
            span = _length(data, at + 1, end)
            if span is None:
                return False
            if data[at] & 0x20:
                todo.append(span)
            at = span[1]
    return True


def is_key(data: bytes) -> bool:
    """DER sequence that is filled by its elements and starts as keys do, or the OpenSSH format."""
    if data.startswith(SSH_MAGIC):
        return _ssh_length(data) == len(data)
    if len(data) < 24 or data[0] != 0x30:
        return False
    span = _length(data, 1, len(data))
    if span is None or span[1] != len(data) or span[0] >= len(data):
        return False
    return data[span[0]] in (0x02, 0x30) and _fills(data, *span)


def _der_length(head: bytes) -> int:
    """How many bytes a DER sequence of these first ones has, if it starts as keys do; else 0."""
    if len(head) < 8 or head[0] != 0x30:
        return 0
    at, n = 2, head[1]
    if n & 0x80:
        at += n & 0x7F
        if not 3 <= at <= 6:
            return 0
        n = int.from_bytes(head[2:at], "big")
    return at + n if head[at] in (0x02, 0x30) and at + n >= 24 else 0


def _ssh_length(data: bytes) -> int:
    """Where the OpenSSH format that data begins with ends: three fields, a count, as many public keys, one private part; 0 if it doesn't."""
    at, fields = len(SSH_MAGIC), 3

    def skip() -> None:
        nonlocal at
        at += 4 + int.from_bytes(data[at : at + 4], "big") if at + 4 <= len(data) else len(data) + 1

    for _ in range(fields):
        skip()
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if at > len(data) or not 1 <= count <= 64:
        return 0
    for _ in range(count + 1):
        skip()
    return at if at <= len(data) else 0


def _gathered(text: str, at: int, most: int, run: re.Pattern, gap: re.Pattern) -> tuple[str, int]:
    """Up to most characters of an encoding from there on, over breaks, and where they end."""
    got, n = [], 0
    while m := run.match(text, at, at + most - n):
        got.append(m[0])
        n, at = n + len(m[0]), m.end()
        if n == most or not (b := gap.match(text, at)):
            break
        at = b.end()
    return "".join(got), at


#: Characters of an encoding that are looked at before the rest of it.
PEEK = 1024


def _stated(text: str, at: int, size: int, chars: int, run: re.Pattern, gap: re.Pattern, decode: Callable[[str], bytes]) -> int:
    """Where the key of this size in an encoding of so many characters ends, or 0 if it is none."""
    if chars > PEEK and not ((head := decode(_gathered(text, at, PEEK, run, gap)[0])) and _begins(head, size)):
        return 0
    own, end = _gathered(text, at, chars, run, gap)
    return end if len(own) == chars and is_key(decode(own)) else 0


def _padded(text: str, end: int, chars: int) -> int:
    """Past the padding that an encoding of so many characters may have."""
    rest = text[end : end + -chars % 4]
    return end + len(rest) - len(rest.lstrip("="))


def _keys(text: str) -> list[tuple[int, int, int]]:
    """Spans of keys, each cut to the length that its header states."""
    found = []
    upto = 0
    for m in B64_HEAD.finditer(text) if "M" in text else ():
        a = m.start()
        size = a >= upto and _der_length(_b64(text[a : a + 20]))
        if size and size <= len(text) - a:
            chars = -(-size * 8 // 6)
            if end := _stated(text, a, size, chars, B64_RUN, B64_BREAK, _b64):
                upto = _padded(text, end, chars)
                found.append((a, 4, upto))
    upto = 0
    for m in HEX_HEAD.finditer(text) if "30" in text else ():
        a = m.start()
        size = a >= upto and _der_length(bytes.fromhex(text[a : a + 24].replace(":", "")[:16]))
        if size and size <= len(text) - a and (end := _stated(text, a, size, 2 * size, HEX_RUN, HEX_BREAK, _unhex)):
            upto = end
            found.append((a, 4, end))
    for m in SSH_HEAD.finditer(text) if "b3Blbn" in text else ():
        own, _ = _gathered(text, m.start(), len(text), B64_RUN, B64_BREAK)
        size = _ssh_length(_b64(own[: len(own) - (len(own) % 4 == 1)]))
        if size:
            chars = -(-size * 8 // 6)
            _, b = _gathered(text, m.start(), chars, B64_RUN, B64_BREAK)
            found.append((m.start(), 4, _padded(text, b, chars)))
    return found


def _b64(text: str) -> bytes:
    """Of either alphabet, padded or not; nothing if it can't be decoded."""
    own = text.rstrip("=").translate(URL_SAFE)
    try:
        return base64.b64decode(own + "=" * (-len(own) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _unhex(text: str) -> bytes:
    return bytes.fromhex(text[: len(text) // 2 * 2])


def _object(part: str) -> dict:
    try:
        found = json.loads(_b64(part))
    except (ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) else {}


def _is_object(part: str) -> bool:
    return bool(_object(part)) or _b64(part).strip() == b"{}"


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    runs = [m.span() for m in HEX.finditer(text)]
    found += [(a, 2, b) for a, b in runs]
    if "." in text and ("ey" in text or "ew" in text):
        found += [(m.start(), 3, m.end()) for m in JWT.finditer(text) if "alg" in _object(m[1]) and _is_object(m[2])]
    if "-----BEGIN " in text:
        found += [(m.start(), 5, m.end()) for m in PEM.finditer(text) if is_key(_b64("".join(m[2].split())))]
    found += _keys(text)
    return sorted(set(found))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        rows = [find_spans(t or "") for t in batch.column(1).to_pylist()]
        kinds = [[x[1] for x in r] for r in rows]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *(pa.array([k.count(n) for k in kinds], pa.int64()) for n in range(len(KINDS))),
                pa.array([_joined([x for x in r if x[1] < len(BASE)]) for r in rows], pa.string()),
                pa.array([_joined(r) for r in rows], pa.string()),
            ],
            names=["id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"],
        )


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_<kind> for each kind, base_spans and spans (``kind:start:end`` by start and kind, comma-joined)."""
    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return picked.mapInArrow(_scan, f"id {kind}, {counts}, base_spans string, spans string").withColumnRenamed("id", id_col)
