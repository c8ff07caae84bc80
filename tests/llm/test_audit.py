"""The audit of filters against plain code for every document and order."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import audit, encoder, queries

DOCS = "doc_id long, text string, lang string, id int, part string, digest int, n_words int, mask int, original int, quality int, n int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 1, 1, 1, 1, 1, 1) for r in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = ["Ab", "b", "cé", "d#", "EFG", "h" * 20, "h" * 21, "中文", "$x", "z\xa0y"]
    own = [" ".join(rng.choice(words) + (str(rng.randint(0, 30)) if rng.random() < k / 40 else "") for _ in range(rng.choice([3, 99, 100, 140]))) for k in range(40)]
    odd = [None, "", "\x0b \n", "A", "x" * 3000, " ".join(f"u{k}" for k in range(20_000)), "\x1c\x85 |"]
    texts = own + odd + own[:6] + [None, ""]
    langs = ["en", "de", None, "", "fr"]
    return [(k if k != 11 else None, t, langs[k % 5]) for k, t in enumerate(texts)] + [(3, own[3], "en"), (3, own[4], "en"), (None, own[0], None), (1000, own[0], "en"), (-1, own[5], "de")]


def plain(rows, labels):
    """(part, order, step) -> the contract's numbers, one document at a time."""
    text = [t or "" for _, t, _ in rows]
    first = {}
    for (i, _, _), t in zip(rows, text, strict=True):
        if i is not None:
            first[t] = min(i, first.get(t, i))
    fails = []
    for (i, _, _), t in zip(rows, text, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails.append({"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i})
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    found = {}
    for part in {lang or "" for *_, lang in rows}:
        own = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        shapley = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            alive = set(own)
            for step, c in enumerate(order, 1):
                gone = {k for k in alive if fails[k][c]}
                shapley[c] += len(gone)
                found[part, order, step] = [
                    len(alive - gone), len(gone), sum(fails[k][c] for k in own if k not in alive), sum(fails[k][c] and sum(fails[k].values()) == 1 for k in own),
                    sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone),
                ]
                alive -= gone
        for (p, order, step), v in found.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in found.items()}


def test_audit_is_every_document_in_every_order(spark, rows):
    rng = random.Random(2)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i, *_ in rows] + [(None, 1, 1), (5, 1, 0), (5, 0, 1), (777_777, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit_filters(docs_of(spark, rows).repartition(3), known, queries.FILTERS)
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got.collect()} == plain(rows, labels)


def test_empty_tables_and_missing_labels(spark, rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_filters(docs_of(spark, []), none, queries.FILTERS).count() == 0
    got = audit.audit_filters(docs_of(spark, rows), none, queries.FILTERS).collect()
    assert len(got) == 600 * 4 and not any(r["good_lost"] or r["toxic_lost"] for r in got)


def test_other_filters_and_letters(spark):
    rows = [(1, "a b c", "en"), (2, "a a", "en"), (3, "", "en")]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = audit.audit_filters(docs_of(spark, rows), none, {"x": "n_words < 1", "y": "n_distinct < 2"}).collect()
    assert {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in got} == {
        ("xy", 1): (2, 1, 0, 0, 1), ("xy", 2): (1, 1, 1, 1, 3), ("yx", 1): (1, 2, 0, 1, 3), ("yx", 2): (1, 0, 1, 0, 1),
    }


@pytest.mark.parametrize("spoil", [lambda h: h, lambda h: h * np.uint64(0), lambda h: h & np.uint64(3 << 62)])
def test_distinct_words_are_verified(rows, spoil):
    """Where hashes collide, words decide."""
    texts = [t for _, t, _ in rows]
    raw, at = encoder.text_bytes(pa.array(["before", *texts, "after"]).slice(1, len(texts)))
    words = [[w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    flat = [w for ws in words for w in ws]
    letters = np.frombuffer(b"".join(flat), np.uint8)
    lengths = np.array([len(w) for w in flat])
    starts = np.cumsum(lengths) - lengths
    hashes = spoil(audit._hashes(letters, starts, lengths))
    got = audit.count_distinct(letters, starts, lengths, np.repeat(np.arange(len(words)), list(map(len, words))), len(words), hashes)
    assert got.tolist() == [len(set(w)) for w in words]
    assert audit.scan(raw, at)["n_distinct"].tolist() == got.tolist()


def test_long_words_that_differ_at_their_end():
    words = [b"a" * 200 + b"1", b"a" * 200 + b"2", b"a" * 200 + b"1", b"b" * 16, b"b" * 16, b"b" * 15 + b"c"]
    letters = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.array(list(map(len, words)))
    starts = np.cumsum(lengths) - lengths
    for hashes in (np.zeros(6, np.uint64), audit._hashes(letters, starts, lengths)):
        assert audit.count_distinct(letters, starts, lengths, np.zeros(6, np.int64), 1, hashes).tolist() == [4]
