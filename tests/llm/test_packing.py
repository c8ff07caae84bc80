"""Packing against the plain encoding of every document, and its rules."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from cairn.llm import packing, queries

DOCS = "doc_id long, text string, id string, start int, ids_file string, at int, tier int, row int"


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1, "x", 1, 1, 1) for i, t in rows], DOCS).repartition(parts)


def held_to_the_rules(rows, texts):
    """rows: pieces with ids_crc32; texts: (doc_id, text), all different ids."""
    plain = Tokenizer.from_file(queries.vocabulary_path())
    ids = {i: [*e.ids, 2] for (i, _), e in zip(texts, plain.encode_batch([t or "" for _, t in texts], add_special_tokens=False), strict=True)}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert by_doc.keys() == ids.keys()
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[i])
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[i][r["start"] : at], "<u4").tobytes())
        assert at == len(ids[i])
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert {r["tier"] for r in own} == {at} and at <= 4096 and at & (at - 1) == 0
        assert len({r["step_id"] for r in own}) == 1
    return by_doc, by_seq


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    own = [" ".join(rng.choice(words) for _ in range(int(rng.lognormvariate(5, 1.2)) + 1)) for _ in range(150)]
    return list(enumerate([*own, None, "", "  \n", "same", "same", " ".join(rng.choice(words) for _ in range(30_000))]))


@pytest.mark.parametrize("window", [packing.WINDOW, 3000])
def test_every_id_lies_in_one_full_sequence(spark, texts, monkeypatch, window):
    monkeypatch.setattr(packing, "WINDOW", window)
    monkeypatch.setattr(packing, "PART_ROWS", 7)
    rows = packing.with_sums(packing.pack_documents(docs_of(spark, texts), queries.vocabulary_path(), end_id=2)).collect()
    _, by_seq = held_to_the_rules(rows, texts)
    # Shorter sequences than the least tier: those of one incomplete sequence a task.
    assert sum(r["length"] for r in rows if r["tier"] < 512) < 3 * 512
    assert len(by_seq) < len(rows)


def test_query_is_the_plain_encoding(spark, small):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    held_to_the_rules(queries.op11_pack(spark, small).collect(), texts)


def test_null_and_repeated_ids_and_empty_tables(spark):
    rows = [(None, "a b c"), (None, None), (4, "a b"), (4, "a b"), (4, "")]
    got = packing.with_sums(packing.pack_documents(docs_of(spark, rows, 1), queries.vocabulary_path(), end_id=2)).collect()
    lengths = {(i, t): len((t or "").split()) + 1 for i, t in rows}
    assert sum(r["length"] for r in got) == sum(lengths[r] for r in rows)
    assert {r["tier"] for r in got} <= {1, 2, 4, 8, 16}
    assert packing.pack_documents(docs_of(spark, []), queries.vocabulary_path(), end_id=2).count() == 0


def test_routing_filling_and_cutting():
    # 3000 takes what fits its gap of 1096, longest first; 1500 opens a sequence of 2048, which cuts the last unit.
    pieces, sizes, left = packing.pack_units(np.array([3000, 700, 396, 1500, 600, 8192 + 5]))
    own = [[(int(p["row"]), int(p["length"])) for p in pieces if p["seq"] == k] for k in range(len(sizes))]
    assert sizes.tolist() == [4096, 4096, 4096, 2048]
    assert own == [[(5, 4096)], [(5, 4096)], [(0, 3000), (1, 700), (2, 396)], [(3, 1500), (5, 5), (4, 543)]]
    assert left == [(4, 543, 57)]
    # Units that fill a sequence exactly are not cut.
    pieces, sizes, left = packing.pack_units(np.array([256, 256, 1024, 2000, 48]))
    assert len(pieces) == 5 and sorted(sizes.tolist()) == [512, 1024, 2048] and not left
    # What is left of a task becomes powers of two, in order.
    pieces, sizes, left = packing.pack_units(np.array([100, 19]), last=True)
    assert sizes.tolist() == [64, 32, 16, 4, 2, 1] and not left


def test_packing_keeps_whole_what_it_can():
    rng = np.random.default_rng(2)
    lengths = (rng.lognormal(6.3, 1.1, 20_000).astype(int) + 1).clip(1, 4000)
    pieces, sizes, _ = packing.pack_units(lengths)
    cut = len(pieces) - len(np.unique(pieces["row"]))
    assert cut < len(sizes)  # one cut a sequence at most
    whole = np.bincount(pieces["row"], minlength=len(lengths)) == 1
    assert whole.mean() > 0.75


def test_step_groups_are_of_even_size_and_cost():
    rng = np.random.default_rng(3)
    pieces, sizes, _ = packing.pack_units((rng.lognormal(6.3, 1.1, 30_000).astype(int) + 1))
    group, n = packing.step_groups(pieces, sizes)
    assert sorted(np.unique(group).tolist()) == list(range(n))
    cost = np.bincount(pieces["seq"], weights=pieces["length"].astype(float) ** 2)
    for size in np.unique(sizes):
        own = sizes == size
        count = np.bincount(group[own])
        count = count[count > 0]
        assert count.max() - count.min() <= 1 and count.max() * size <= packing.STEP
        total = np.bincount(group[own], weights=cost[own])
        total = total[np.unique(group[own])]
        assert total.max() < 1.25 * total.mean()
