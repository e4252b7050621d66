"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each model sees a text's words and
the probabilities of the categories before it. In training those come from
out-of-fold predictions, so that a later model meets them as it will in use.

The label tells toxic texts only, so the earlier categories are learned: toxic
training texts are clustered by the words that speak for toxicity, in whatever
language, and each cluster is a category. The last category is the label itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import NON_ALNUM, U64, Words, column_bytes, mix64, pieces, range_hashes
from .rows import with_text
from .scratch import Scratch
from .sums import added

BITS = 20
#: At most so many labelled rows train the chain: those with the least hash of their id.
MAX_TRAINING_ROWS = 20_000
FOLDS = 4
KEPT_FEATURES = 1000
#: Learned categories before the last.
GROUPS = 3
#: Words also stand for their beginnings of so many bytes, as compounds share a stem.
PREFIXES = (5, 6, 7, 8)


def word_buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of each word and of each proper prefix."""
    docs, hashes, long = [words.docs], [words.hashes], words.ends - words.starts
    for n in PREFIXES:
        on = long > n
        docs.append(words.docs[on])
        hashes.append(mix64(range_hashes(words.data, words.starts[on], words.starts[on] + n) + U64(n)))
    return np.concatenate(docs), (np.concatenate(hashes) >> U64(64 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class Linear:
    """Weights of hashed words (sparse), of earlier categories, and a bias."""

    buckets: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


@dataclass(frozen=True)
class Chain:
    names: tuple[str, ...]
    models: tuple[Linear, ...]
    thresholds: tuple[float, ...]


def telling(pos: np.ndarray, every: np.ndarray, n_pos: float, n: float) -> np.ndarray:
    """The features whose presence speaks most for a category, by the z-score of their log odds: rows that hold each, of the category and in all."""
    neg, n_neg = every - pos, n - n_pos
    odds = np.log((pos + 0.5) / (n_pos - pos + 0.5)) - np.log((neg + 0.5) / (n_neg - neg + 0.5))
    z = odds / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    z[every < 3] = 0
    best = np.argsort(-z, kind="stable")[:KEPT_FEATURES]
    return np.sort(best[z[best] > 2])


def _fit(flat: np.ndarray, row: np.ndarray, before: np.ndarray, y: np.ndarray, size: int, steps: int = 200) -> Linear:
    """Logistic regression with a ridge penalty on the telling words, of ``size``, and on earlier probabilities."""
    m, n = before.shape[1], len(y)
    if not n or not 0 < y.sum() < n:
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(m), 20.0 * (2 * float(y.mean() if n else 0) - 1))
    buckets = telling(np.bincount(flat, weights=y[row], minlength=size), np.bincount(flat, minlength=size).astype(float), y.sum(), n)
    k = len(buckets)
    place = np.full(size, -1)
    place[buckets] = np.arange(k)
    known = place[flat] >= 0
    at, on = place[flat[known]], row[known]
    w = np.zeros(k + m + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = np.bincount(on, weights=w[at], minlength=n) + before @ w[k : k + m] + w[-1]
        e = (1 / (1 + np.exp(-np.clip(g, -50, 50))) - y) / n
        grad = np.concatenate([np.bincount(at, weights=e[on], minlength=k), before.T @ e, [e.sum()]])
        grad[:-1] += 1e-5 * w[:-1]
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        w -= 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return Linear(buckets, w[:k], w[k : k + m], float(w[-1]))


def _predict(model: Linear, flat: np.ndarray, row: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Probabilities; (row, bucket) pairs must be distinct."""
    g = np.full(len(before), model.bias) + before @ model.earlier
    if len(model.buckets) and len(flat):
        at = np.minimum(np.searchsorted(model.buckets, flat), len(model.buckets) - 1)
        known = model.buckets[at] == flat
        g += np.bincount(row[known], weights=model.weights[at[known]], minlength=len(before))
    return 1 / (1 + np.exp(-np.clip(g, -50, 50)))


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1 on out-of-fold predictions; midway between neighbouring predictions."""
    if not len(p) or not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1  # a threshold can't part equal predictions
    i = int(np.argmax(f1))
    return float((p[order][i] + (p[order][i + 1] if i + 1 < len(p) else 0)) / 2)


def groups_of(bags: list[np.ndarray], size: int, groups: int, rounds: int = 12) -> np.ndarray:
    """A group for each row with a feature, -1 for the others: clusters by the cosine of their features.

    The first centre is the mean of all; then always the row that is least like
    any centre so far. Deterministic; ties go to the earlier row or group.
    """
    x = np.zeros((len(bags), size), np.float32)
    for i, b in enumerate(bags):
        x[i, b] = 1
    norm = np.linalg.norm(x, axis=1)
    some = np.flatnonzero(norm)
    out = np.full(len(bags), -1)
    if len(some) < groups or not groups:
        return out
    x = x[some] / norm[some, None]
    centre = [x.mean(0)]
    for _ in range(groups):
        near = np.max([x @ c / max(np.linalg.norm(c), 1e-9) for c in centre], axis=0)
        centre.append(x[int(np.argmin(near))])
    centres = np.array(centre[1:])
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        centres = np.array([x[own == g].sum(0) if (own == g).any() else centres[g] for g in range(groups)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    out[some] = np.argmax(x @ centres.T, axis=1)
    return out


def fit_chain(bags: list[np.ndarray], labels: dict[str, np.ndarray], size: int, fold: np.ndarray | None = None) -> Chain:
    """A chain in the order of ``labels``, from each row's distinct features below ``size``."""
    n = len(bags)
    flat = np.concatenate(bags).astype(np.int64) if n else np.zeros(0, np.int64)
    row = np.repeat(np.arange(n), [len(b) for b in bags])
    fold = np.arange(n) % FOLDS if fold is None else fold
    before, models, cuts = np.zeros((n, 0)), [], []
    for y in labels.values():
        y = y.astype(float)
        out = np.zeros(n)
        for f in range(FOLDS if n else 0):
            rows_in, rows_out = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            place = np.empty(n, np.int64)
            place[rows_in], place[rows_out] = np.arange(len(rows_in)), np.arange(len(rows_out))
            inside = fold[row] != f
            part = _fit(flat[inside], place[row[inside]], before[rows_in], y[rows_in], size)
            out[rows_out] = _predict(part, flat[~inside], place[row[~inside]], before[rows_out])
        models.append(_fit(flat, row, before, y, size))
        cuts.append(_best_threshold(out, y))
        before = np.column_stack([before, out])
    return Chain(tuple(labels), tuple(models), tuple(cuts))


def _bags(column: pa.Array) -> list[pa.Array]:
    """Each text's distinct buckets, as 32-bit numbers in one value."""
    data, offsets = column_bytes(column)
    out = []
    for _, _, part, offs in pieces(data, offsets):
        words = Words(part, offs, NON_ALNUM, lower=True)
        d, b = word_buckets(words)
        pairs = np.unique(d << BITS | b)
        ends = np.searchsorted(pairs, np.arange(len(offs)) << BITS)
        low = (pairs & ((1 << BITS) - 1)).astype(np.int32)
        out += [low[ends[i] : ends[i + 1]].tobytes() for i in range(len(offs) - 1)]
    return [pa.array(out, pa.binary())]


def _count_words(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    """By fold and kind (2 * fold for toxic rows, one more for all): rows that hold each bucket, and at the end the number of rows."""
    out: dict[int, np.ndarray] = {}
    for batch in batches:
        fold, toxic = batch.column("fold").to_numpy(zero_copy_only=False), batch.column("toxic").to_numpy(zero_copy_only=False) > 0
        own = [np.frombuffer(b, np.int32) for b in batch.column("bag").to_pylist()]
        for k in range(2 * FOLDS):
            rows = [own[i] for i in np.flatnonzero((fold == k // 2) & (toxic | bool(k % 2)))]
            if rows:
                sums = out.setdefault(k, np.zeros((1 << BITS) + 1, np.float32))
                sums[:-1] += np.bincount(np.concatenate(rows), minlength=1 << BITS)
                sums[-1] += len(rows)
    return out


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS, groups: int = GROUPS) -> Chain:
    """A chain from at most ``most`` labelled documents.

    A doc_id with several labels is toxic if any is 1; of several texts with one
    doc_id one counts. The executors count the words of all these rows, by fold,
    and what is telling without some fold, or in all, makes the features; only
    these reach the driver, a few numbers a row.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    told = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    told = scratch.save(told.orderBy(F.xxhash64("id"), "id").limit(most))
    picked = docs.select("doc_id", "text").join(F.broadcast(told), F.col("doc_id") == F.col("id")).select("id", "toxic", "text")  # ``most`` ids
    rows = with_text(picked, _bags, "bag: binary", keep=["id", "toxic"]).groupBy(F.col("row.id").alias("id"), F.col("row.toxic").alias("toxic")).agg(F.min("got.bag").alias("bag"))
    rows = scratch.save(rows.withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int")))
    counts, none = added(rows.select("toxic", "fold", "bag"), 2 * FOLDS, _count_words), np.zeros((1 << BITS) + 1)
    total = [sum((counts.get(2 * f + kind, none) for f in range(FOLDS)), none) for kind in (0, 1)]
    found = []
    for f in range(-1, FOLDS):
        pos, every = (t - (counts.get(2 * f + kind, none) if f >= 0 else none) for kind, t in enumerate(total))
        found.append(telling(pos[:-1], every[:-1], pos[-1], every[-1]))
    known = np.unique(np.concatenate(found))  # (FOLDS + 1) * KEPT_FEATURES at most

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.flatnonzero(np.isin(known, np.frombuffer(b, np.int32))).astype(np.int32).tobytes() for b in batch.column("bag").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), batch.column("fold"), pa.array(own, pa.binary())], ["id", "toxic", "fold", "own"])

    kind = rows.schema["id"].dataType.simpleString()
    got = sorted(rows.mapInArrow(compact, f"id {kind}, toxic {rows.schema['toxic'].dataType.simpleString()}, fold int, own binary").collect(), key=lambda r: r["id"])  # ``most`` rows
    bags = [np.frombuffer(r["own"], np.int32) for r in got]
    toxic = np.array([r["toxic"] > 0 for r in got], bool)
    group = np.full(len(got), -1)
    group[toxic] = groups_of([b for b, t in zip(bags, toxic, strict=True) if t], len(known), groups)
    chain = fit_chain(bags, {f"group_{g + 1}": group == g for g in range(groups)} | {"toxic": toxic}, len(known), np.array([r["fold"] for r in got], int))
    models = tuple(Linear(known[m.buckets], m.weights, m.earlier, m.bias) for m in chain.models)
    return Chain(chain.names, models, chain.thresholds)


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, most: int = MAX_TRAINING_ROWS, groups: int = GROUPS) -> DataFrame:
    """(row, got): the kept columns; a probability p_<category> for each category, and whether the text is toxic.

    Null and empty texts have no words and get the chain's bias. Words count
    once a text, wherever in it they stand, in texts of any length. Without
    labels nothing is toxic. Repeated rows have equal scores; an empty table gives
    an empty one. Other columns of any name pass through.
    """
    trained = train(docs, labels, most, groups)
    chain, names = docs.sparkSession.sparkContext.broadcast(trained), trained.names

    def run(column: pa.Array) -> list[pa.Array]:
        c = chain.value
        used = np.zeros(1 << BITS, bool)
        for m in c.models:
            used[m.buckets] = True
        data, offsets = column_bytes(column)
        probabilities = np.zeros((len(offsets) - 1, len(c.models)))
        for lo, hi, part, offs in pieces(data, offsets):
            words = Words(part, offs, NON_ALNUM, lower=True)
            d, b = word_buckets(words)
            on = used[b]
            pairs = np.unique(d[on] << BITS | b[on])
            flat, row = pairs & ((1 << BITS) - 1), pairs >> BITS
            before = np.zeros((hi - lo, 0))
            for m in c.models:
                before = np.column_stack([before, _predict(m, flat, row, before)])
            probabilities[lo:hi] = before
        return [*(pa.array(probabilities[:, i]) for i in range(len(names))), pa.array(probabilities[:, -1] >= c.thresholds[-1])]

    fields = ", ".join(f"p_{n}: double" for n in names) + ", toxic: boolean"
    return with_text(docs, run, fields, keep=keep)
