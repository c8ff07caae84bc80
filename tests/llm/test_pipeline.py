"""The corpus pipeline: each stage against plain code over what its predecessor kept."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_operators import plain_fingerprint

import corpus_pipeline as pipeline
from cairn.llm import mixing
from cairn.llm.queries import op10_quality, table, vocabulary_path

NAMES = [name for name, _ in pipeline.STAGES]


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """The rows that go into each stage and those that the last one gives back; every stage is written and reread."""
    docs, kept = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, f in pipeline.STAGES:
        kept.append(docs.collect())
        path = str(tmp_path_factory.mktemp("stage") / "out")
        f(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != NAMES[-1]:
            assert docs.columns == spark.read.parquet(f"{small}/documents.parquet").columns
    return [*kept, docs.collect()]


def test_only_rejected_documents_go(spark, small, stages):
    """test_scores.py works the scores out in plain code."""
    good = {r["doc_id"] for r in op10_quality(spark, small).where("predicted = 1").collect()}
    assert sorted(map(repr, stages[1])) == sorted(repr(r) for r in stages[0] if r["doc_id"] in good)
    assert 0 < len(stages[1]) < len(stages[0])


def test_one_document_of_each_group_stays(stages):
    """All pairs of fingerprints; of each component the document with the smallest id."""
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in stages[1]}
    left, firsts = sorted(prints), []
    while left:
        group = [left.pop(0)]
        firsts.append(group[0])
        for i in group:
            near = [j for j in left if (prints[i] ^ prints[j]).bit_count() <= 4]
            group += near
            left = [j for j in left if j not in set(near)]
    assert sorted(r["doc_id"] for r in stages[2]) == firsts and len(firsts) < len(prints)
    texts = {r["doc_id"]: r["text"] for r in stages[1]}
    assert all(r["text"] == texts[r["doc_id"]] for r in stages[2])


def test_contaminated_documents_go(spark, small, stages):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows: dict = {}
    for r in table(spark, small, "benchmark").collect():
        ws = cut(r["text"])
        for k in range(max(1, len(ws) - 12) if ws else 0):
            windows.setdefault(len(ws[k : k + 13]), set()).add(tuple(ws[k : k + 13]))
    kept = []
    for r in stages[2]:
        ws = cut(r["text"])
        hit = {p for n, held in windows.items() for i in range(len(ws) - n + 1) if tuple(ws[i : i + n]) in held for p in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(ws)):
            kept.append(r)
    assert sorted(map(repr, stages[3])) == sorted(map(repr, kept)) and len(kept) < len(stages[2])


def test_the_mix_takes_its_copies(spark, stages):
    before, after = stages[3], stages[4]
    # Ids are distinct here, so that copies can be told by them; order within a size may differ, totals may not.
    got = Counter(r["doc_id"] for r in after)
    assert set(got) <= {r["doc_id"] for r in before} and max(got.values()) <= 3
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in before}
    source = {r["doc_id"]: r["source"] for r in before}
    taken, want = Counter(), Counter()
    for i, n in got.items():
        taken[source[i]] += n * size[i]
    for r in mixing.mix_sources(spark.createDataFrame(before)).collect():
        want[source[r["doc_id"]]] += r["taken"]
    # Which documents of a size get the copies hangs on the key, how many words a source gives doesn't.
    assert +taken == +want


def test_token_files_hold_the_mix(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    start, want = 0, []
    for r in sorted(stages[4], key=lambda r: r["doc_id"]):
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, pipeline.END_ID]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in stages[5]) == want


def test_run_is_its_stages(spark, small, stages):
    got = sorted(tuple(r) for r in pipeline.run(spark, small).collect())
    assert got == sorted(tuple(r) for r in stages[5])


def test_nulls_repeats_and_empty_tables(spark, small, tmp_path):
    folder = str(tmp_path)
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    kind = spark.read.parquet(f"{small}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "good words here.\nand more of them.", "en", "a", 5), (1, "good words here.\nand more of them.", "en", "a", 5), (2, "", None, None, None), (None, "another text with words", "en", "b", 1)]
    spark.createDataFrame(rows, kind).write.parquet(f"{folder}/documents.parquet")
    assert pipeline.run(spark, folder).count() >= 0
    spark.createDataFrame([], kind).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert pipeline.run(spark, folder).count() == 0
