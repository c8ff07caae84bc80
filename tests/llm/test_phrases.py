"""Collocations against counts of plain code."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import phrases

DOCS = "doc_id long, text string, lang string, phrase string, h int, n int, words int, k int, score int, salt int"


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(k, t, lang, "x", 1, 1, 1, 1, 1, 1) for k, (t, lang) in enumerate(rows)], DOCS).repartition(parts)


def pieces_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def plain(rows, most_words, least, covered, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces_of(text):
            n[lang] += len(w)
            for m in range(1, most_words + 1):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i : i + m])] += 1
    found = []
    for lang, own in f.items():
        held = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows_of = []
        for p, a in held.items():
            score, _, l, r = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            inside = (q for q in held if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not any(100 * held[q] >= covered * a for q in inside):
                rows_of.append((-score, -a, " ".join(p).encode(), l, r))
        found += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(rows_of)[:top], 1)]
    return sorted(found)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["a", "b", "É", "c", "Ab", "été", "中", "\x1c", "z\xa0", "#"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "!"]
    own = [("".join(rng.choice(words[: rng.randint(2, 10)]) + rng.choice(ends) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None])) for _ in range(120)]
    return [*own, (None, "en"), ("", None), ("  ", "fr"), ("a a a a a a a a a a a a", "fr"), ("same words here " * 3000, "en"), *[("x y z", "es")] * 12, *[("y z", "es")] * 13, ("a" * 5000, "en")]


@pytest.mark.parametrize(("most_words", "least", "covered", "top"), [(3, 10, 50, 2000), (2, 3, 50, 4), (4, 5, 80, 2000)])
def test_collocations_are_the_counted_ones(spark, rows, most_words, least, covered, top):
    got = phrases.collocations(docs_of(spark, rows), most_words=most_words, least=least, covered=covered, top=top)
    assert sorted(map(tuple, got.collect())) == plain(rows, most_words, least, covered, top)


def test_a_crowded_table_loses_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "TABLE_BITS", 1)
    monkeypatch.setattr(phrases, "PART_ROWS", 5)
    assert sorted(map(tuple, phrases.collocations(docs_of(spark, rows)).collect())) == plain(rows, 3, 10, 50, 2000)


def test_empty_table(spark):
    assert phrases.collocations(docs_of(spark, [], 1)).count() == 0


def test_products_beyond_64_bits(spark, monkeypatch):
    big = 3_000_000_000
    counted = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 1)], "lang string, phrase string, words int, n long")
    totals = spark.createDataFrame([("en", 2 * big)], "lang string, n long")
    monkeypatch.setattr(phrases, "count_phrases", lambda *_, **__: (counted, totals))
    row = phrases.collocations(docs_of(spark, [], 1)).first()
    assert row["score"] == 10**6 * (big - 1) ** 2 // big**2 == 999_999


@pytest.mark.parametrize("batch", [phrases.BATCH, 1, 40])
def test_bitmaps_of_a_shard(rows, monkeypatch, batch):
    """Popcounts of words and of their pairs, and the bitmaps behind them."""
    monkeypatch.setattr(phrases, "BATCH", batch)
    shard = phrases.Shard(pa.array([t for t, _ in rows]), pa.array([lang or "und" for _, lang in rows]))
    name = [(shard.langs[shard.lang_of[k]], shard.words[shard.text_of[k]].decode()) for k in range(shard.size)]
    one, two, three = Counter(), Counter(), Counter()
    for text, lang in rows:
        for w in pieces_of(text):
            w = [(lang or "und", x) for x in w]
            one.update(w), two.update(zip(w, w[1:])), three.update(zip(w, w[1:], w[2:]))  # noqa: B905
    assert dict(zip(name, shard.counts.tolist(), strict=True)) == one
    got, deep = {}, Counter()
    for own in shard.batches():
        head, word, count, at, block, bits = shard.extend(*own)
        got |= {(name[a], name[b]): n for a, b, n in zip(head.tolist(), word.tolist(), count.tolist(), strict=True)}
        assert np.bincount(at, weights=np.bitwise_count(bits), minlength=len(count)).tolist() == count.tolist()
        first, last, n, *_ = shard.extend(at, block, bits)
        for k, c, m in zip(first.tolist(), last.tolist(), n.tolist(), strict=True):
            deep[name[head[k]], name[word[k]], name[c]] += m
    assert got == two and deep == three
