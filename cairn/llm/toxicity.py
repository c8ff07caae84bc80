"""Toxicity: a factorization machine over hashed terms.

Terms are words and the beginnings of words, hashed into buckets, and one for how many different words a document has;
a document has the set of its buckets. Buckets that tell the classes apart in the training sample are kept: those with
a log-likelihood ratio of ``LEAST_G`` or more, the ``MAX_TERMS`` highest at most. The machine adds a weight for each bucket and, through factor vectors, one for each pair of buckets, so that
terms which are harmless apart, or in a long document, can count together. Terms are left out at random while fitting
(``KEEP`` stay each step), so that one of several will do. It is fitted on a bounded sample of labelled documents (``max_rows`` of either class), as one
small task; every document is then scored, whole, on the executors.

Defined results: null and empty texts get the score of a document without terms; a null id is not held out;
repeated rows are scored each; without labels of both classes every score is the share of toxic labels (0 if there
are none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, parts

BUCKETS = 1 << 18
PREFIXES = (4, 5)
FACTORS = 8
#: Documents of either class that the machine is fitted on, at most (about; chosen by hash).
MAX_ROWS = 3000
MAX_TERMS = 1024
LEAST_G = 13.0
KEEP = 0.8
STEPS = 200
#: Buckets for the number of different words, two a doubling.
SIZES = 64
CACHE = 300_000

WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split())


def buckets(word: bytes) -> list[int]:
    """Of the word, and of its beginnings."""
    return [zlib.crc32(word) % BUCKETS, *(zlib.crc32(word[:n], n) % BUCKETS for n in PREFIXES if len(word) >= n)]


def size_bucket(words_: int) -> int:
    return BUCKETS + min(SIZES - 1, int(2 * np.log2(1 + words_)))


def document_buckets(text: str | None) -> list[int]:
    own = words(text)
    return sorted({b for w in own for b in buckets(w)} | {size_bucket(len(own))})


@dataclass
class Machine:
    terms: dict[int, int]
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.factors
        return self.bias + x @ self.linear + 0.5 * (s * s - (x * x) @ (self.factors * self.factors)).sum(axis=1)

    def logit(self, own: list[int]) -> float:
        """Of a document that has these terms."""
        f = self.factors[own]
        return float(self.bias + self.linear[own].sum() + 0.5 * ((f.sum(axis=0) ** 2).sum() - (f * f).sum()))


def _g(a: np.ndarray, b: np.ndarray, na: float, nb: float) -> np.ndarray:
    """Log-likelihood ratio of document frequencies a of na and b of nb."""
    total = na + nb
    out = np.zeros(len(a))
    for seen, n in ((a, na), (b, nb), (na - a, na), (nb - b, nb)):
        share = (a + b) if seen is a or seen is b else total - a - b
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(seen > 0, seen * np.log(seen * total / (share * n)), 0.0)
    return 2 * out


def fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 7) -> Machine:
    """rows: the different buckets of each document."""
    share = float(np.average(y, weights=weight)) if len(y) else 0.0
    empty = Machine({}, float(np.log((share + 1e-6) / (1 - share + 1e-6))), np.zeros(0), np.zeros((0, FACTORS)))
    if not 0 < y.sum() < len(y):
        return empty
    seen = [np.bincount(np.concatenate([r for r, v in zip(rows, y, strict=True) if v == k] or [np.zeros(0, int)]), minlength=BUCKETS + SIZES).astype(float) for k in (0, 1)]
    g = _g(seen[1], seen[0], float(y.sum()), float(len(y) - y.sum()))
    g[seen[0] + seen[1] < 3] = 0
    g[BUCKETS:] = np.where(seen[0][BUCKETS:] + seen[1][BUCKETS:] > 0, np.inf, 0)
    chosen = np.argsort(-g, kind="stable")[:MAX_TERMS]
    chosen = chosen[g[chosen] >= LEAST_G]
    if (chosen >= BUCKETS).all():
        return empty
    terms = {int(b): i for i, b in enumerate(chosen)}
    x = np.zeros((len(rows), len(terms)), np.float32)
    for i, r in enumerate(rows):
        x[i, [terms[b] for b in r.tolist() if b in terms]] = 1
    rng = np.random.default_rng(seed)
    m = Machine(terms, empty.bias, np.zeros(len(terms), np.float32), rng.normal(0, 0.01, (len(terms), FACTORS)).astype(np.float32))
    w = (weight / weight.sum()).astype(np.float32)
    # Either class counts half while fitting, so that the rarer one is learned as well.
    pull = np.where(y == 1, 0.5 / w[y == 1].sum(), 0.5 / w[y == 0].sum()).astype(np.float32) * w
    y = y.astype(np.float32)
    params = [np.zeros(1, np.float32), m.linear, m.factors]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    full = x
    for step in range(1, STEPS + 1):
        m.bias = float(params[0][0])
        x = full * (rng.random(full.shape, dtype=np.float32) < KEEP)
        s = x @ m.factors
        logit = m.bias + x @ m.linear + 0.5 * (s * s - x @ (m.factors * m.factors)).sum(axis=1)
        err = (pull * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)).astype(np.float32)
        grads = [np.array([err.sum()]), x.T @ err + 1e-5 * m.linear, x.T @ (err[:, None] * s) - (x.T @ err)[:, None] * m.factors + 1e-4 * m.factors]
        for p, d, (a, b) in zip(params, grads, state, strict=True):
            a += 0.1 * (d - a)
            b += 0.001 * (d * d - b)
            p -= 0.05 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    m.bias = float(params[0][0])
    m.linear, m.factors = m.linear.astype(float), m.factors.astype(float)
    return m


def train(docs: DataFrame, labels: DataFrame, *, learn_from: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Machine:
    """Fit on a bounded sample; features are made where the texts are, and one task fits."""
    sample = labelled_sample(docs, labels, label=label, id_col=id_col, text_col=text_col, learn_from=learn_from, most=max_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            own = [document_buckets(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.list_(pa.int32())), batch.column(2), batch.column(3)], names=["doc_id", "buckets", "y", "weight"])

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")
        m = fit([np.asarray(b, np.int64) for b in rows["buckets"]], rows["y"].to_numpy(np.int64), rows["weight"].to_numpy(float))
        return pd.DataFrame({"model": [pickle.dumps(m)]})

    made = sample.select("text", "doc_id", "y", "weight").mapInArrow(features, f"doc_id {dict(docs.dtypes)[id_col]}, buckets array<int>, y int, weight double")
    got = made.groupBy().applyInPandas(fitted, "model binary").collect()  # one row, of bounded size
    return pickle.loads(got[0]["model"]) if got else fit([], np.zeros(0), np.zeros(0))  # noqa: S301  made above


def score(docs: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score for every row."""
    spark = docs.sparkSession
    carried = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = carried.value
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in parts(batches):
            logits = []
            for text in batch.column(1).to_pylist():
                there = words(text)
                own = {m.terms[b] for b in (size_bucket(len(there)),) if b in m.terms}
                for w in there:
                    found = known.get(w)
                    if found is None:
                        found = known[w] = tuple(m.terms[b] for b in buckets(w) if b in m.terms)
                    if found:
                        own.update(found)
                logits.append(m.logit(sorted(own)))
            if len(known) > CACHE:
                known.clear()
            p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double").withColumnRenamed("doc_id", id_col)
