"""Document quality: a linear-chain conditional random field labels every line good or bad.

A line has features of its own (lengths, shares of character classes, doubled symbols, repeated words) and those of
the lines before and after it; the chain adds weights for going from one label to the next. Forward-backward gives
each line's marginal, and the marginals, weighted by line length, make the document's score. Only documents are
labelled, so their lines are taught the document's label. The field is fitted on a bounded sample (``max_rows``
documents of either class, of at most ``MAX_LINES`` lines), as one small task; every document is scored whole.

Defined results: a null text is an empty one, and an empty text is one empty line, whose marginal is the score; a
null id is not held out; repeated rows are scored each; without labels of both classes every score is the share of
good labels (1 if there are none); an empty table gives an empty result; other columns are ignored unless kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, parts

#: Documents of either class that the field is fitted on, at most (about; chosen by hash), and their lines.
MAX_ROWS = 1500
MAX_LINES = 200
STEPS = 200

LOWER, CAPITAL, DIGIT, SPACE, SYMBOL, BEYOND = range(6)
CLASS = np.array([LOWER if 97 <= c <= 122 else CAPITAL if 65 <= c <= 90 else DIGIT if 48 <= c <= 57 else SPACE if c == 32 or 9 <= c <= 13 else BEYOND if c >= 128 else SYMBOL for c in range(256)], np.uint8)
STOPS = np.isin(np.arange(256), list(b".,;:!?"))
OWN = 14


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their weights (length, at least 1), and how many lines each text has."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.r_[0, ends[:-1] + 1]
    counts = np.array([r.count(b"\n") + 1 for r in raw], np.int64)
    kind = CLASS[data]

    def total(mask: np.ndarray) -> np.ndarray:
        run = np.r_[0, np.cumsum(mask, dtype=np.int64)]
        return (run[ends] - run[starts]).astype(float)

    size = (ends - starts).astype(float)
    before = np.r_[np.uint8(10), data[:-1]]
    blank = kind == SPACE
    opens = ~blank & np.r_[True, blank[:-1]]
    word_n = total(opens)
    symbol = kind == SYMBOL
    per = np.maximum(size, 1)
    each = np.maximum(word_n, 1)
    lower, capital, beyond = total(kind == LOWER), total(kind == CAPITAL), total(kind == BEYOND)
    distinct = np.array([len(set(line.split())) for r in raw for line in r.split(b"\n")], float)
    f = np.stack(
        [
            np.log1p(size),
            (lower + beyond) / per,
            capital / np.maximum(lower + capital + beyond, 1),
            total(kind == DIGIT) / per,
            total(symbol) / per,
            total(symbol & ~STOPS[data]) / per,
            total(symbol & (data == before)) / each,
            total(opens & symbol) / each,
            total(STOPS[data]) / each,
            (size - total(blank)) / each / 10,
            np.log1p(word_n),
            distinct / each,
            beyond / per,
            (size == 0).astype(float),
        ],
        axis=1,
    )
    place = np.arange(len(size)) - np.repeat(np.cumsum(counts) - counts, counts)
    first, last = place == 0, place == np.repeat(counts, counts) - 1
    up, down = np.roll(f, 1, axis=0), np.roll(f, -1, axis=0)
    up[first], down[last] = f[first], f[last]
    same = (np.abs(up - f).max(axis=1) < 1e-12) & ~first
    x = np.concatenate([f, up - f, down - f, np.stack([first, last, same], axis=1)], axis=1)
    return x, np.maximum(size, 1), counts


def marginals(unary: np.ndarray, counts: np.ndarray, go: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """unary: a score for each line and label; go: one for each step from label to label.

    The marginals of label 1, the expected steps, and the sum of log partition functions. All chains move together.
    """
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    lengths = counts[order]
    alpha, beta = np.zeros_like(unary), np.ones_like(unary)
    local = np.exp(unary - unary.max(axis=1, keepdims=True))
    step = np.exp(go)
    norm = np.zeros(len(unary))
    live = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
    for t, n in enumerate(live):
        at = starts[:n] + t
        a = local[at] * (alpha[at - 1] @ step if t else 1)
        s = a.sum(axis=1, keepdims=True)
        alpha[at] = a / s
        norm[at] = np.log(s[:, 0])
    for t in range(len(live) - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        b = (local[at + 1] * beta[at + 1]) @ step.T
        beta[at] = b / b.sum(axis=1, keepdims=True)
    both = alpha * beta
    p = both[:, 1] / both.sum(axis=1)
    inner = np.ones(len(unary), bool)
    inner[np.cumsum(counts) - counts] = False
    at = np.flatnonzero(inner)
    pair = alpha[at - 1][:, :, None] * step * (local[at] * beta[at])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return p, pair, float(norm.sum() + unary.max(axis=1).sum())


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    go: np.ndarray
    share: float | None = None

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.share is not None or not texts:
            return np.full(len(texts), self.share or 0.0)
        x, size, counts = line_features(texts)
        z = np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights[:-1] + self.weights[-1]
        p, _, _ = marginals(np.stack([np.zeros(len(z)), z], axis=1), counts, self.go)
        at = np.cumsum(counts) - counts
        return np.add.reduceat(p * size, at) / np.add.reduceat(size, at)


def fit(texts: list[str], y: np.ndarray, weight: np.ndarray) -> Field:
    width = 3 * OWN + 3
    if not 0 < y.sum() < len(y):
        return Field(np.zeros(width), np.ones(width), np.zeros(width + 1), np.zeros((2, 2)), float(np.average(y, weights=weight)) if len(y) else 1.0)
    x, _, counts = line_features(texts)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.c_[np.clip((x - mean) / scale, -6, 6), np.ones(len(x))]
    line_y = np.repeat(y, counts)
    # A document counts once, however many lines it has.
    per = np.repeat(weight / counts, counts)
    per /= per.sum()
    w, go = np.zeros(width + 1), np.zeros((2, 2))
    inner = np.ones(len(x), bool)
    inner[np.cumsum(counts) - counts] = False
    told = line_y[inner]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, go)]
    for i in range(1, STEPS + 1):
        z = x @ w
        p, pair, _ = marginals(np.stack([np.zeros(len(z)), z], axis=1), counts, go)
        steps = (pair * per[inner][:, None, None]).sum(axis=0)
        for k in (0, 1):
            steps[k, k] -= per[inner][told == k].sum()
        grads = [x.T @ (per * (p - line_y)) + 1e-3 * np.r_[w[:-1], 0], steps + 1e-3 * go]
        for v, d, (a, b) in zip((w, go), grads, state, strict=True):
            a += 0.1 * (d - a)
            b += 0.001 * (d * d - b)
            v -= 0.05 * (a / (1 - 0.9**i)) / (np.sqrt(b / (1 - 0.999**i)) + 1e-8)
    return Field(mean, scale, w, go)


def train(docs: DataFrame, labels: DataFrame, *, learn_from: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Field:
    """Fit on a bounded sample, in one task."""
    sample = labelled_sample(docs, labels, label=label, id_col=id_col, text_col=text_col, learn_from=learn_from, most=max_rows)
    short = sample.where(F.regexp_count("text", F.lit("\n")) < MAX_LINES)

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")
        m = fit(rows["text"].tolist(), rows["y"].to_numpy(np.int64), rows["weight"].to_numpy(float))
        return pd.DataFrame({"model": [pickle.dumps(m)]})

    got = short.groupBy().applyInPandas(fitted, "model binary").collect()  # one row, of bounded size
    return pickle.loads(got[0]["model"]) if got else fit([], np.zeros(0), np.zeros(0))  # noqa: S301  made above


def score(docs: DataFrame, field: Field, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, score for every row. With keep, text and kept (a struct of these columns) come along."""
    spark = docs.sparkSession
    carried = spark.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            p = carried.value.scores([t or "" for t in batch.column("text").to_pylist()])
            more = [batch.column("text"), batch.column("kept")] if keep else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *more, pa.array(p, pa.float64())], names=["doc_id", *(["text", "kept"] if keep else []), "score"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.struct(*keep).alias("kept")] if keep else []))
    kinds = dict(picked.dtypes)
    more = f"text string, kept {kinds['kept']}, " if keep else ""
    return picked.mapInArrow(run, f"doc_id {kinds['doc_id']}, {more}score double")
