"""Toxicity by a classifier chain.

Categories are predicted in order by linear models over hashed features of a text, the presence of words and of words'
beginnings (stems of inflected words). Each model after the first also reads the probabilities of the categories before
it. In training these come from models that haven't seen the row (out of fold), as they do in use.

Models are fitted by numpy on the driver, on the `max_rows` labelled documents with the least hashes of their
identifiers: a bounded sample, of which the driver gets bins of features, no texts. Prediction covers every document, in
Arrow batches, with weights of a fixed size.

A document is put into a category from a probability on that is chosen on the out-of-fold probabilities. It has to hold
for the final model as well: where it does not, a half is tried, and where the labels show no signal at all (the
out-of-fold order of the classes is no better than chance could give, or no feature tells them apart) nothing is put into
the category.

Of the table `labels` the chain takes what is there: low quality first, then toxic.

Defined results: a null or empty text has no features and is judged by the models' offsets; a category with one class
only among the sample is given to no document; documents without labels are only predicted; a label that is null or whose
document is missing is left out; several labels of one document count as the greatest; of several texts under one
identifier the smallest is learned from; repeated rows are judged alike; further columns, whatever their names, are
carried by `without` and ignored elsewhere; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import inner, small_batches, text_or_empty
from sparkloom.llm.wordhash import Words, mix, pieces

BINS = 1 << 20
BEGINNINGS = (4, 5, 6)
FEATURES = 2048
FOLDS = 4
#: Texts of the sample that must have a feature.
LEAST = 3


def features(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bin) in order; only bins that are wanted, if given."""
    ws = Words(texts, lower=True, starts=BEGINNINGS)
    doc = np.repeat(np.arange(len(texts)), np.diff(ws.first))
    docs, bins = [doc], [ws.hashes[0]]
    for size in BEGINNINGS:
        word, h = ws.beginnings(size)
        docs.append(doc[word])
        bins.append(mix(h + np.uint64(size)))
    at, bin_ = np.concatenate(docs), (np.concatenate(bins) >> np.uint64(44)).astype(np.int64)
    if wanted is not None:
        keep = wanted[bin_]
        at, bin_ = at[keep], bin_[keep]
    both = np.unique(at * BINS + bin_)
    return both // BINS, both % BINS


@dataclass
class Linear:
    """bins with weights, weights of earlier probabilities, an offset."""

    bins: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    offset: float

    def logits(self, doc: np.ndarray, bin_: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        dense = np.zeros(BINS, np.float32)
        dense[self.bins] = self.weights
        return np.bincount(doc, dense[bin_], minlength=len(earlier)) + earlier @ self.earlier + self.offset


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(doc: np.ndarray, bin_: np.ndarray, y: np.ndarray, earlier: np.ndarray, rounds: int = 250, ridge: float = 1e-4) -> Linear:
    """Logistic regression over the FEATURES bins whose presence differs most, in standard errors, between classes."""
    n, pos = len(y), int(y.sum())
    if pos in (0, n):
        rate = (pos + 0.5) / (n + 2)
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(earlier.shape[1]), float(np.log(rate / (1 - rate))))
    all_ = np.bincount(bin_, minlength=BINS)
    ones = np.bincount(bin_[y[doc] > 0], minlength=BINS)
    p = all_ / n
    z = np.abs(ones / pos - (all_ - ones) / (n - pos)) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / pos + 1 / (n - pos)))
    z[all_ < LEAST] = 0
    bins = np.flatnonzero(z >= 4.0)
    bins = bins[np.argsort(-z[bins], kind="stable")][:FEATURES]
    index = np.full(BINS, -1, np.int64)
    index[bins] = np.arange(len(bins))
    keep = index[bin_] >= 0
    d, f = doc[keep], index[bin_[keep]]
    w, m, v = (np.zeros(len(bins) + earlier.shape[1] + 1) for _ in range(3))
    w[-1] = np.log(pos / (n - pos))
    weight = np.where(y > 0, n / (2 * pos), n / (2 * (n - pos)))
    k = len(bins)
    for t in range(1, rounds + 1):
        g = (sigmoid(np.bincount(d, w[f], minlength=n) + earlier @ w[k:-1] + w[-1]) - y) * weight / n
        grad = np.concatenate([np.bincount(f, g[d], minlength=k), earlier.T @ g, [g.sum()]]) + ridge * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Linear(bins, w[:k], w[k:-1], float(w[-1]))


@dataclass
class Chain:
    names: list[str]
    models: list[Linear]
    limits: list[float]
    out_of_fold: np.ndarray

    def predict(self, texts: pa.Array) -> np.ndarray:
        wanted = np.zeros(BINS, bool)
        for m in self.models:
            wanted[m.bins] = True
        doc, bin_ = features(texts, wanted)
        out = np.zeros((len(texts), 0))
        for m in self.models:
            out = np.column_stack([out, sigmoid(m.logits(doc, bin_, out))])
        return out


#: Standard errors by which the out-of-fold order of the classes must beat chance.
SIGNAL = 3.0
#: The limit of a category that no document is put into.
NEVER = 2.0


def has_signal(p: np.ndarray, y: np.ndarray) -> bool:
    """Whether rows of class 1 stand above the others by the rank-sum test."""
    n, pos = len(y), int(y.sum())
    if pos in (0, n):
        return False
    _, place, count = np.unique(p, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]  # ties share their middle rank
    above = (rank[y > 0].sum() - pos * (pos + 1) / 2) / (pos * (n - pos)) - 0.5
    return above >= SIGNAL * np.sqrt((n + 1) / (12 * pos * (n - pos)))


def f1(flag: np.ndarray, y: np.ndarray) -> float:
    return 2 * float((flag & (y > 0)).sum()) / max(1, int(flag.sum()) + int(y.sum()))


def best_limit(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap between log-odds among those where F1 is within 0.002 of the best."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    scores = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    scores[:-1][p[order][1:] == p[order][:-1]] = -1
    best = np.flatnonzero(scores >= scores.max() - 0.002)
    odds = np.clip(np.append(p[order], 0.0), 1e-6, 1 - 1e-6)
    odds = np.log(odds / (1 - odds))
    above, below = odds[best], odds[best + 1]
    at = int(np.argmax(above - below))
    return float(sigmoid((above[at] + below[at]) / 2))


def limit_for(held: np.ndarray, final: np.ndarray, y: np.ndarray) -> float:
    """The limit by the out-of-fold probabilities, if it is as good for the final model's on the same rows, else a half; NEVER
    without signal, or if flagging everything would be as good."""
    if not has_signal(held, y) or final.min() == final.max():
        return NEVER
    everything = f1(np.ones(len(y), bool), y)
    limit = best_limit(held, y)
    least = f1(held >= limit, y)
    if least <= everything:
        return NEVER
    if f1(final >= limit, y) >= least:
        return limit
    return 0.5 if f1(final >= 0.5, y) > everything else NEVER


def train(doc: np.ndarray, bin_: np.ndarray, labels: np.ndarray, names: Sequence[str]) -> Chain:
    """doc, bin_: distinct (row of labels, bin); labels: a column of 0 and 1 for each name."""
    n = len(labels)
    fold = mix(np.arange(n, dtype=np.uint64)) % np.uint64(FOLDS)
    models, limits, earlier = [], [], np.zeros((n, 0))
    for c in range(len(names)):
        y = labels[:, c].astype(np.float64)
        held = np.zeros(n)
        for k in range(FOLDS):
            out, rest = fold == k, fold != k
            place = (np.cumsum(rest) - 1).astype(np.int32)
            inside = rest[doc]
            m = fit(place[doc[inside]], bin_[inside], y[rest], earlier[rest])
            held[out] = sigmoid(m.logits(doc, bin_, earlier))[out]
        models.append(fit(doc, bin_, y, earlier))
        limits.append(limit_for(held, sigmoid(models[-1].logits(doc, bin_, earlier)), y) if n else NEVER)
        earlier = np.column_stack([earlier, held])
    return Chain(list(names), models, limits, earlier)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns behind the text, and the text's bins as four bytes each."""
    for batch in batches:
        for part, texts in pieces(batch, 0):
            doc, bin_ = features(texts)
            cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
            bins = [bin_[a:b].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(bins, pa.binary())], names=[*part.schema.names[1:], "bins"])


def learn(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", *, max_rows: int = 6_000) -> Chain:
    """A chain over categories, each a Column over labels that is 0, 1 or null."""
    small_batches(docs.sparkSession)
    flag = [f"y{k}" for k in range(len(categories))]
    flags = labels.select(F.col(id_col).alias("id"), *[c.cast("int").alias(k) for k, c in zip(flag, categories.values(), strict=True)]).dropna()
    sample = flags.groupBy("id").agg(*[F.max(k).alias(k) for k in flag]).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    known = docs.select(F.col(id_col).alias("doc"), text_or_empty(text_col).alias("text")).join(F.broadcast(sample), F.col("doc") == F.col("id"))  # max_rows rows at most
    rows = known.groupBy("id").agg(F.min("text").alias("text"), *[F.max(k).alias(k) for k in flag]).select("text", "id", *flag)
    kind = dict(rows.dtypes)["id"]
    found = rows.mapInArrow(_packed, f"id {kind}, {', '.join(f'{k} int' for k in flag)}, bins binary").orderBy("id").collect()
    own = [np.frombuffer(r["bins"], "<i4") for r in found]
    doc, bin_ = np.repeat(np.arange(len(own), dtype=np.int32), list(map(len, own))), np.concatenate([np.zeros(0, "<i4"), *own])
    keep = (np.bincount(bin_, minlength=BINS) >= LEAST)[bin_]  # others are never chosen, and are most of them
    return train(doc[keep], bin_[keep], np.array([[r[k] for k in flag] for r in found], np.int64).reshape(len(found), len(flag)), list(categories))


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: id_col, p_<category> for each, is_<category> for each."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((chain.names, chain.models, chain.limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, models, limits = held.value
        own = Chain(names, models, limits, np.zeros((0, 0)))
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                p = own.predict(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(p[:, i]) for i in range(len(names))], *[pa.array(p[:, i] >= limits[i]) for i in range(len(names))]], names=["id", *[f"p_{k}" for k in names], *[f"is_{k}" for k in names]])

    kind = dict(docs.dtypes)[id_col]
    fields = ", ".join([f"id {kind}", *[f"p_{k} double" for k in chain.names], *[f"is_{k} boolean" for k in chain.names]])
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, fields).withColumnRenamed("id", id_col)


def without(docs: DataFrame, chain: Chain, category: str, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text the chain doesn't put into a category."""
    small_batches(docs.sparkSession)
    held, which = docs.sparkSession.sparkContext.broadcast((chain.names, chain.models, chain.limits)), chain.names.index(category)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, models, limits = held.value
        own = Chain(names, models, limits, np.zeros((0, 0)))
        for batch in batches:
            for part, texts in pieces(batch, batch.num_columns - 1):
                yield part.filter(pa.array(own.predict(texts)[:, which] < limits[which])).select(range(part.num_columns - 1))

    judged = inner(docs.columns, "judged")[0]
    return docs.withColumn(judged, text_or_empty(text_col)).mapInArrow(run, docs.schema)


#: The categories of the table `labels`, in the chain's order.
CATEGORIES: dict[str, Callable[[], Column]] = {
    "low_quality": lambda: (F.col("quality") == 0),
    "toxic": lambda: (F.col("toxic") == 1),
}


def learn_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_rows: int = 6_000) -> Chain:
    return learn(docs, labels, {k: c() for k, c in CATEGORIES.items()}, id_col, text_col, max_rows=max_rows)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_rows: int = 6_000) -> DataFrame:
    """A row a document: id_col, p_low_quality, p_toxic, toxic, kept."""
    chain = learn_labels(docs, labels, id_col, text_col, max_rows=max_rows)
    scored = score(docs, chain, id_col, text_col)
    return scored.select(id_col, "p_low_quality", "p_toxic", F.col("is_toxic").alias("toxic"), (~F.col("is_toxic")).alias("kept"))
