"""Quality classifier from positive and unlabelled texts.

Trusted positives and unlabelled web text train a linear scorer by minimising
the non-negative unbiased risk

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)),

where the class prior is estimated from how much rarer unlabelled texts are than
positives in the region that looks most positive. No negative label is used.

The scorer sees binned counts of a text and the evidence of its words: the mean
log odds of its hashed words among positives against all texts, taken for each
training row from the other folds only. All training rows count: words, bins,
risks, gradients and curvatures are sums that the executors make, and what
reaches the driver has a size fixed by the numbers of buckets and bins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import NON_ALNUM, U64, Words, column_bytes, pieces
from .quality_rules import COUNTS, FIELDS, text_counts
from .rows import with_text
from .scratch import Scratch
from .sums import added

BINS, FOLDS = 12, 4
#: Words are hashed to so many buckets.
WORD_BITS = 16
N_FEATURES = 13
#: Weights: one for each bin of each feature, and a bias.
SIZE = N_FEATURES * BINS + 1
RIDGE, MAX_STEPS = 1e-3, 12
#: Ids of positives are broadcast up to so many, after a count; beyond it the same join shuffles.
BROADCAST_IDS = 1_000_000
#: Scores of the held-back half are counted in so many bins.
SCORE_BINS = 1000


def features(c: dict[str, np.ndarray], evidence: np.ndarray) -> np.ndarray:
    """Ratios of the counts, and the evidence of the words; one row a text."""
    words, lines, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1), np.maximum(c["word_chars"], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]),
            c["word_chars"] / words,
            c["n_symbols"] / words,
            c["n_bangs"] / words,
            c["n_repeat_words"] / words,
            c["n_dup_lines"] / lines,
            c["n_ended"] / lines,
            c["n_upper"] / np.maximum(c["n_letters"], 1),
            c["n_letters"] / chars,
            c["n_digits"] / chars,
            c["n_short_words"] / words,
            np.log1p(c["n_words"] / lines),
            evidence,
        ],
        1,
    )


def bags(column: pa.Array) -> pa.Array:
    """Each text's distinct word buckets, as 16-bit numbers in one value."""
    data, offsets = column_bytes(column)
    out = []
    for _, _, part, offs in pieces(data, offsets):
        words = Words(part, offs, NON_ALNUM, lower=True)
        pairs = np.unique(words.docs << WORD_BITS | (words.hashes >> U64(64 - WORD_BITS)).astype(np.int64))
        ends = np.searchsorted(pairs, np.arange(len(offs)) << WORD_BITS)
        low = (pairs & ((1 << WORD_BITS) - 1)).astype(np.uint16)
        out += [low[ends[i] : ends[i + 1]].tobytes() for i in range(len(offs) - 1)]
    return pa.array(out, pa.binary())


def word_odds(counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log odds of each word among positives against all rows, [fold left out (the last: none), bucket].

    ``counts[fold, positive or all, bucket]`` are numbers of rows that hold a
    word, ``rows[fold, positive or all]`` those of rows.
    """
    out = np.zeros((FOLDS + 1, counts.shape[2]))
    for f in range(FOLDS + 1):
        c, n = counts.sum(0) - (counts[f] if f < FOLDS else 0), rows.sum(0) - (rows[f] if f < FOLDS else 0)
        out[f] = np.log((c[0] + 0.5) / (n[0] + 1)) - np.log((c[1] + 0.5) / (n[1] + 1))
    return np.clip(out, -3, 3)


def binned(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Index of the weight of each feature's bin: one of BINS for each feature."""
    return np.stack([np.searchsorted(cuts[j], x[:, j], "right") + j * BINS for j in range(x.shape[1])], 1)


def scores(bins: np.ndarray, w: np.ndarray) -> np.ndarray:
    return w[bins].sum(1) + w[-1]


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -50, 50)))


def sums(bins: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What a set of rows adds to risk, gradient and curvature: one flat array, additive over rows."""
    n = len(bins)
    x = np.zeros((n, SIZE))
    x[np.arange(n)[:, None], bins] = 1
    x[:, -1] = 1
    g = scores(bins, w)
    s = _sigmoid(g)
    return np.concatenate([[n, np.logaddexp(0, g).sum(), np.logaddexp(0, -g).sum()], x.sum(0), s @ x, ((x.T * (s * (1 - s))) @ x).ravel()])


@dataclass(frozen=True)
class _Means:
    """``sums`` by the number of rows."""

    plus: float  # loss of score g as a negative
    minus: float  # and as a positive
    x: np.ndarray
    sx: np.ndarray
    sxx: np.ndarray

    @classmethod
    def of(cls, total: np.ndarray) -> _Means:
        m = total / max(total[0], 1)
        return cls(m[1], m[2], m[3 : 3 + SIZE], m[3 + SIZE : 3 + 2 * SIZE], m[3 + 2 * SIZE :].reshape(SIZE, SIZE))


def pu_risk(p: _Means, u: _Means, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk, its gradient and its curvature."""
    rest = u.plus - prior * p.plus
    if rest >= 0:
        return prior * p.minus + rest, u.sx - prior * p.x, u.sxx
    return prior * p.minus, prior * (p.sx - p.x), prior * p.sxx


def apart_risk(p: _Means, u: _Means, _: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Telling positives from unlabelled rows, for the estimate of the prior."""
    return p.minus + u.plus, p.sx - p.x + u.sx, p.sxx + u.sxx


def minimise(totals: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], risk, prior: float, w: np.ndarray) -> np.ndarray:
    """Newton steps, halved where they don't lower the risk; ``totals(w)`` are the sums over positives and over unlabelled rows."""
    held = np.where(np.arange(SIZE) < SIZE - 1, RIDGE, 1e-9)
    best, at, step = np.inf, w, np.zeros(SIZE)
    for _ in range(MAX_STEPS):
        value, gradient, curvature = risk(*map(_Means.of, totals(w)), prior)
        value += float(held @ (w * w)) / 2
        if value < best:
            gain, best, at = best - value, value, w
            step = np.linalg.solve(curvature + np.diag(held), gradient + held * w)
            if gain < 1e-4 * abs(best):
                break
        else:
            step = step / 2
            if np.abs(step).max() < 1e-3:
                break
        w = at - step
    return at


def _least_ratio(p: np.ndarray, u: np.ndarray) -> float:
    return float(np.clip(min(u / np.maximum(p, 1e-9)), 0.05, 0.99))


def estimate_prior(p_scores: np.ndarray, u_scores: np.ndarray, least: float = 0.2) -> float:
    """The smallest ratio of unlabelled to positive mass above a threshold that still has ``least`` of the positives."""
    cuts = np.quantile(p_scores, np.linspace(0, 1 - least, 33))
    return _least_ratio(*(np.array([(s >= c).mean() for c in cuts]) for s in (p_scores, u_scores)))


def estimate_prior_of(p_counts: np.ndarray, u_counts: np.ndarray, least: float = 0.2) -> float:
    """The same from counts of scores in bins."""
    p, u = (c[::-1].cumsum()[::-1] / max(c.sum(), 1) for c in (p_counts, u_counts))
    return _least_ratio(p[p >= least], u[p >= least]) if p_counts.sum() and u_counts.sum() else 0.5


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never learned: crc32 of the id as text leaves 2 modulo 4. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint16) for b in batch.column(name).to_pylist()]


def _flags(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(bool)


def _count_words(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    """By fold and kind (2 * fold for positives, one more for all): rows that hold each bucket, and at the end the number of rows."""
    out = {k: np.zeros((1 << WORD_BITS) + 1) for k in range(2 * FOLDS)}
    for batch in batches:
        fold, positive, own = batch.column("fold").to_numpy(zero_copy_only=False), _flags(batch, "positive"), _lists(batch, "bag")
        for k in out:
            rows = [own[i] for i in np.flatnonzero((fold == k // 2) & (positive | bool(k % 2)))]
            if rows:
                out[k][:-1] += np.bincount(np.concatenate(rows), minlength=1 << WORD_BITS)
                out[k][-1] += len(rows)
    return out


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, N_FEATURES)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each document.

    Positives: documents with label 1 and no label 0, outside the held-out fold.
    Unlabelled: all documents outside it; each of either kind counts. Documents
    without an id are scored and train nothing. Null and empty texts are scored
    from counts of 0 and no words. Without positives every score is 0.5. Repeated
    rows have equal scores and count as often as they come; an empty table gives
    an empty one. Other columns, of any name, are not looked at.
    """
    scratch, spark = Scratch(docs.sparkSession, "pu"), docs.sparkSession
    both = lambda column: [*text_counts(column), bags(column)]
    counted = with_text(docs, both, FIELDS + ", bag: binary", keep=["doc_id"])
    doc_id = F.col("row.doc_id")
    good = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(F.min("quality").alias("q")).where("q = 1")
    train = ~held_out(doc_id) & doc_id.isNotNull()
    fold, half = F.when(train, F.pmod(F.xxhash64(doc_id), F.lit(FOLDS))).otherwise(FOLDS).cast("int"), F.pmod(F.xxhash64(doc_id, F.lit("half")), F.lit(2)).cast("int")
    good = scratch.save(good)
    good = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    flagged = counted.join(good, doc_id == F.col("labelled"), "left").select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), fold.alias("fold"), half.alias("half"), (train & F.col("q").isNotNull()).alias("positive"), "got.*")
    flagged = scratch.save(flagged)
    n = flagged.count()
    scratch.free()

    # Evidence of words, and features.
    by_kind = added(flagged.where(F.col("fold") < FOLDS).select("fold", "positive", "bag"), 2 * FOLDS, _count_words)
    words = np.stack([by_kind.get(k, np.zeros((1 << WORD_BITS) + 1)) for k in range(2 * FOLDS)]).reshape(FOLDS, 2, -1)
    odds = spark.sparkContext.broadcast(word_odds(words[:, :, :-1], words[:, :, -1]).astype(np.float32))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = zip(_lists(batch, "bag"), batch.column("fold").to_pylist(), strict=True)
            evidence = np.array([float(odds.value[f][b].mean()) if len(b) else 0.0 for b, f in own])
            x = features({c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in COUNTS}, evidence)
            kept = ["doc_id", "held_out", "fold", "half", "positive"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(list(x), pa.list_(pa.float64()))], [*kept, "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = scratch.save(flagged.mapInArrow(featured, f"doc_id {kind}, held_out boolean, fold int, half int, positive boolean, x array<double>"), n)
    scratch.drop(flagged)
    training = rows.where(F.col("fold") < FOLDS)

    # Bins by quantiles of all training rows.
    at = [i / BINS for i in range(1, BINS)]
    quantiles = training.agg(*(F.percentile_approx(F.col("x")[j], at, 10_000).alias(str(j)) for j in range(N_FEATURES))).first()
    cuts = np.array([q if q is not None else [0.0] * (BINS - 1) for q in quantiles])

    def totals(part: DataFrame) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        part, zero = part.select("positive", "x"), np.zeros(3 + 2 * SIZE + SIZE * SIZE)

        def at_weights(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            def make(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
                out = {}
                for batch in batches:
                    bins, positive = binned(_matrix(batch), cuts), _flags(batch, "positive")
                    for k, b in ((0, bins[positive]), (1, bins)):
                        if len(b):
                            out[k] = out.get(k, 0) + sums(b, w)
                return out

            got = added(part, 4, make)
            return got.get(0, zero), got.get(1, zero)

        return at_weights

    w = np.zeros(SIZE)
    if n and words[:, 0, -1].sum():
        first = minimise(totals(training.where("half = 0")), apart_risk, 0.0, w)

        def histogram(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
            out = {}
            for batch in batches:
                s, positive = _sigmoid(scores(binned(_matrix(batch), cuts), first)), _flags(batch, "positive")
                for k, b in ((0, s[positive]), (1, s)):
                    out[k] = out.get(k, 0) + np.histogram(b, SCORE_BINS, (0, 1))[0]
            return out

        seen = added(training.where("half = 1").select("positive", "x"), 4, histogram)
        prior = estimate_prior_of(*(seen.get(k, np.zeros(SCORE_BINS)) for k in (0, 1)))
        w = minimise(totals(training), pu_risk, prior, first)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _sigmoid(scores(binned(_matrix(batch), cuts), w))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "held_out", "x").mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
