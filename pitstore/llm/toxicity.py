"""Toxicity by a classifier chain (operator 5)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

WORDS = re.compile(r"\w+")
#: Labelled rows that a model is fitted on at most, taken in the order of a hash of the id.
FIT_ROWS = 10_000


def features(text: str | None) -> set[str]:
    """The words of the lower-cased text and, marked, their first four and five letters."""
    words = set(WORDS.findall(text.lower())) if text else set()
    return words | {w[:4] + "-" for w in words if len(w) > 4} | {w[:5] + "-" for w in words if len(w) > 5}


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Rows:
    """Documents as numbers of features; the documents behind each other, `n` features each."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, names: list[str]):
        self.flat, self.sizes, self.names = flat, sizes, names
        self.doc = np.repeat(np.arange(len(sizes)), sizes)

    def __len__(self):
        return len(self.sizes)

    def take(self, at: np.ndarray) -> Rows:
        mask = np.zeros(len(self), bool)
        mask[at] = True
        return Rows(self.flat[mask[self.doc]], self.sizes[mask], self.names)


class Linear:
    """Logistic regression on the presence of features and on the logits of the categories before it.

    Features in at least `seen` documents that pass a chi-square test stay. Columns are scaled to length one;
    accelerated gradient descent with a ridge finds the weights. One class only, or no rows: a constant.
    """

    def __init__(self, rows: Rows, before: np.ndarray, y: np.ndarray, seen: int = 4, chi: float = 20.0, ridge: float = 0.5, steps: int = 200):
        self.weights: dict[str, float] = {}
        self.before = np.zeros(before.shape[1])
        self.bias = float(np.log((y.sum() + 0.01) / (len(y) - y.sum() + 1.0))) if len(y) else -30.0
        if not len(y) or y.min() == y.max():
            return
        v, n, p = len(rows.names), len(y), y.sum()
        df, hit = np.bincount(rows.flat, minlength=v), np.bincount(rows.flat, weights=y[rows.doc], minlength=v)
        gap = hit * n - df * p
        chi2 = gap**2 / np.maximum(df * (n - df) * p * (n - p) / n, 1e-9)
        keep = np.flatnonzero((df >= seen) & (chi2 >= chi))
        new = np.full(v, -1)
        new[keep] = np.arange(len(keep))
        on = new[rows.flat] >= 0
        at, doc, k, c = new[rows.flat[on]], rows.doc[on], len(keep), before.shape[1]
        size = np.concatenate([np.sqrt(df[keep]), np.sqrt((before**2).sum(0)) + 1e-9, [np.sqrt(n)]])
        value, dense = 1 / size[at], np.column_stack([before, np.ones(n)]) / size[k:]

        def times(w):
            return np.bincount(doc, weights=w[at] * value, minlength=n) + dense @ w[k:]

        def back(e):
            return np.concatenate([np.bincount(at, weights=e[doc] * value, minlength=k)[:k], dense.T @ e])

        u = np.ones(k + c + 1)
        for _ in range(20):
            u = back(times(u / np.linalg.norm(u)))
        pull = np.concatenate([ridge / df[keep], np.full(c, 1e-3), [0.0]])
        step = 1 / (0.3 * np.linalg.norm(u) + ridge)
        w = z = np.zeros(k + c + 1)
        for t in range(steps):
            g = back(_sigmoid(times(z)) - y) + pull * z
            last, w = w, z - step * g
            z = w + t / (t + 3) * (w - last)
        w = w / size
        self.bias, self.before = float(w[-1]), w[k:-1]
        self.weights = {rows.names[i]: float(x) for i, x in zip(keep, w)}

    def logits_of(self, rows: Rows, before: np.ndarray) -> np.ndarray:
        w = np.array([self.weights.get(x, 0.0) for x in rows.names])
        return np.bincount(rows.doc, weights=w[rows.flat], minlength=len(rows)) + before @ self.before + self.bias

    def logits(self, docs: list[set[str]], before: np.ndarray) -> np.ndarray:
        known, keys = self.weights, self.weights.keys()
        return np.array([sum(known[w] for w in sorted(keys & d)) for d in docs], float).reshape(-1) + before @ self.before + self.bias


class Chain:
    """One linear model for each category in order; later ones see the logits of the earlier ones.

    A later model is fitted on out-of-fold logits, so that it trusts earlier predictions as much as they
    deserve on unseen documents.
    """

    def __init__(self, rows: Rows, labels: np.ndarray, folds: int = 4):
        self.models: list[Linear] = []
        fold = np.arange(len(rows)) % folds
        before = np.zeros((len(rows), 0))
        for c in range(labels.shape[1]):
            known = np.flatnonzero(~np.isnan(labels[:, c]))
            self.models.append(Linear(rows.take(known), before[known], labels[known, c]))
            if c + 1 < labels.shape[1]:
                out = np.zeros(len(rows))
                for f in range(folds):
                    part, rest = known[fold[known] != f], np.flatnonzero(fold == f)
                    out[rest] = Linear(rows.take(part), before[part], labels[part, c]).logits_of(rows.take(rest), before[rest])
                before = np.column_stack([before, out])

    def probabilities(self, rows: list[set[str]]) -> np.ndarray:
        before = np.zeros((len(rows), 0))
        for m in self.models:
            before = np.column_stack([before, m.logits(rows, before)])
        return _sigmoid(before)


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Chain:
    """Fits the chain on at most `fit_rows` labelled documents, chosen by a hash of their ids.

    A document's repeated labels count as the largest, of repeated rows the least text does; null labels are left out for their category; labels
    without a document and documents without a text take no part.
    """
    bounded_batches(docs.sparkSession)
    named = [F.max(labels[c].cast("double")).alias(f"y{k}") for k, c in enumerate(categories)]
    some = labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].alias("k")).agg(*named).orderBy(F.xxhash64("k"), "k").limit(fit_rows)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).where(F.col("text").isNotNull())
    labelled = rows.join(F.broadcast(some), F.col("id") == F.col("k"))
    joined = labelled.groupBy("id").agg(F.min("text").alias("text"), *[F.max(f"y{k}").alias(f"y{k}") for k in range(len(categories))])

    def shrink(batches):
        for b in batches:
            words = [" ".join(sorted(features(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.string()), *b.columns[2:]], names=b.schema.names)

    number: dict[str, int] = {}
    seen: dict = {}
    for r in joined.mapInArrow(shrink, joined.schema).toLocalIterator():
        at = np.fromiter((number.setdefault(w, len(number)) for w in r["text"].split(" ") if w), np.int32)
        seen[r["id"]] = (at, [np.nan if v is None else v for v in r[2:]])
    order = sorted(seen)
    y = np.array([seen[i][1] for i in order], float).reshape(len(order), len(categories))
    flat = np.concatenate([seen[i][0] for i in order]) if order else np.zeros(0, np.int32)
    return Chain(Rows(flat, np.array([len(seen[i][0]) for i in order], int), list(number)), y)


def score(docs: DataFrame, chain: Chain, categories: list[str], id_col: str = "doc_id", text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """id and a probability for each category, of every document's whole text.

    Null and empty texts get what the model says of no words; null ids and repeated rows stay; an empty table
    gives no rows; other columns are not read. No shuffle; the model's size is bounded by the rows it was
    fitted on.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        for b in batches:
            p = model.value.probabilities([features(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, c]) for c in range(p.shape[1])]], names=["id", *[f"p{c}" for c in range(p.shape[1])]])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, ", ".join([f"id {kind}", *[f"p{c} double" for c in range(len(categories))]]))
    return out.select(F.col("id").alias(id_col), *[F.col(f"p{k}").alias(prefix + c) for k, c in enumerate(categories)])


def drop_toxic(docs: DataFrame, chain: Chain, category: int, threshold: float = 0.4, text_col: str = "text") -> DataFrame:
    """The documents whose probability of the category is under the threshold, with all their columns.

    Null and empty texts are judged as texts without words; null ids and repeated rows are judged row by row;
    an empty table gives no rows; only the text is read.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(chain)
    place = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            p = model.value.probabilities([features(t) for t in b.column(place).to_pylist()])
            yield b.filter(pa.array(p[:, category] < threshold))

    return docs.mapInArrow(run, docs.schema)
