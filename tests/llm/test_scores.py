"""Scores of the two classifiers' queries, worked out from their models one document at a time, in plain code."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import common, quality, queries, toxicity


def out(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest


def documents(spark, small):
    return {r["doc_id"]: r["text"] for r in queries.table(spark, small, "documents").select("doc_id", "text").collect()}


def plain_toxicity(machine, text):
    """All pairs of a document's terms, one by one."""
    there = {w for w in bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").encode()).split()}
    named = {zlib.crc32(w) % toxicity.BUCKETS for w in there} | {zlib.crc32(w[:n], n) % toxicity.BUCKETS for w in there for n in toxicity.PREFIXES if len(w) >= n}
    named.add(toxicity.BUCKETS + min(toxicity.SIZES - 1, int(2 * math.log2(1 + len(there)))))
    own = sorted(machine.terms[b] for b in named if b in machine.terms)
    total = machine.bias + sum(machine.linear[i] for i in own)
    total += sum(float(np.dot(machine.factors[i], machine.factors[j])) for k, i in enumerate(own) for j in own[k + 1 :])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def test_toxicity_scores_are_sums_over_explicit_pairs(spark, small):
    machine = toxicity.train(queries.table(spark, small, "documents"), queries.table(spark, small, "labels"), learn_from=~common.held_out(F.col("doc_id"), 3, 1))
    texts = documents(spark, small)
    rows = queries.op9_toxicity(spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and len(machine.terms) > 5
    for r in rows:
        want = plain_toxicity(machine, texts[r["doc_id"]])
        assert math.isclose(r["score"], want, rel_tol=1e-6, abs_tol=1e-9)
        assert r["held_out"] == out(r["doc_id"], 3, 1) and r["predicted"] == int(r["score"] >= 0.7)


def plain_quality(field, text):
    """Forward and backward over one document's lines, in logarithms; the mean marginal, weighted by lengths."""
    x, size, counts = quality.line_features([text or ""])
    z = [float(np.dot(np.clip((row - field.mean) / field.scale, -6, 6), field.weights[:-1]) + field.weights[-1]) for row in x]
    n = len(z)
    assert counts.tolist() == [n] and n == (text or "").count("\n") + 1
    unary, go = [(0.0, v) for v in z], field.go.tolist()
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    ahead = [list(unary[0])]
    for t in range(1, n):
        ahead.append([unary[t][k] + add(*(ahead[-1][j] + go[j][k] for j in (0, 1))) for k in (0, 1)])
    behind = [[0.0, 0.0]]
    for t in range(n - 1, 0, -1):
        behind.append([add(*(go[j][k] + unary[t][k] + behind[-1][k] for k in (0, 1))) for j in (0, 1)])
    behind.reverse()
    both = [[a[k] + b[k] for k in (0, 1)] for a, b in zip(ahead, behind, strict=True)]
    p = [1 / (1 + math.exp(max(-700.0, min(700.0, c[0] - c[1])))) for c in both]
    lengths = [max(1, len(line.encode())) for line in (text or "").split("\n")]
    assert size.tolist() == lengths
    return sum(a * b for a, b in zip(p, lengths, strict=True)) / sum(lengths)


@pytest.fixture(scope="module")
def field(spark, small):
    return quality.train(queries.table(spark, small, "documents"), queries.table(spark, small, "labels"), learn_from=~common.held_out(F.col("doc_id"), 5, 0))


def test_quality_scores_are_length_weighted_marginals(spark, small, field):
    texts = documents(spark, small)
    rows = queries.op10_quality(spark, small).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert math.isclose(r["score"], plain_quality(field, texts[r["doc_id"]]), rel_tol=1e-6, abs_tol=1e-9)
        assert r["held_out"] == out(r["doc_id"], 5, 0) and r["predicted"] == int(r["score"] >= 0.3)


def test_the_pipelines_first_stage_keeps_all_good_documents_and_no_other(spark, small, field):
    import corpus_pipeline

    docs = queries.table(spark, small, "documents")
    kept = [tuple(r) for r in corpus_pipeline.STAGES[0][1](spark, docs, small).collect()]
    want = [tuple(r) for r in docs.collect() if plain_quality(field, r["text"]) >= 0.3]
    assert sorted(kept, key=repr) == sorted(want, key=repr) and 0 < len(want) < docs.count()
