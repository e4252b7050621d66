"""Risk, gradient, curvature and sums of the PU classifier against plain versions; edge cases."""

import numpy as np
import pytest

from spanveil.llm import quality_classifier as pu


def _rows(n, seed):
    rng = np.random.default_rng(seed)
    return rng.integers(0, pu.BINS, (n, pu.N_FEATURES)) + np.arange(pu.N_FEATURES) * pu.BINS


def _risk(p, u, prior, w):
    """Row by row."""
    loss = lambda rows, sign: sum(np.log1p(np.exp(-sign * (sum(w[i] for i in r) + w[-1]))) for r in rows) / len(rows)
    return prior * loss(p, 1) + max(0.0, loss(u, -1) - prior * loss(p, -1))


@pytest.mark.parametrize("prior, shift", [(0.3, 0.0), (0.9, 4.0)])
def test_risk_and_gradient(prior, shift):
    p, u = _rows(30, 1), _rows(80, 2)
    w = np.random.default_rng(3).normal(0, 0.3, pu.SIZE)
    w[p[:, 0]] += shift  # in the second case positives look so sure that the rest falls below 0
    means = lambda w: [pu._Means.of(pu.sums(b, w)) for b in (p, u)]
    value, gradient, curvature = pu.pu_risk(*means(w), prior)
    assert value == pytest.approx(_risk(p, u, prior, w))
    for i in (int(p[0, 0]), int(u[0, 5]), pu.SIZE - 1):
        e = np.zeros(pu.SIZE)
        e[i] = 1e-5
        assert (_risk(p, u, prior, w + e) - _risk(p, u, prior, w - e)) / 2e-5 == pytest.approx(gradient[i], abs=1e-6)
        there, here = (pu.pu_risk(*means(w + s * e), prior)[1] for s in (1, -1))
        assert (there - here) / 2e-5 == pytest.approx(curvature[i], abs=1e-5)


def test_sums_add_up():
    rows, w = _rows(50, 4), np.linspace(-1, 1, pu.SIZE)
    assert pu.sums(rows, w) == pytest.approx(pu.sums(rows[:20], w) + pu.sums(rows[20:], w))


def test_the_rest_of_the_risk_is_never_below_0():
    p, u = _rows(30, 1), np.concatenate([_rows(30, 1), _rows(50, 5)])
    seen = []

    def totals(w):
        out = pu.sums(p, w), pu.sums(u, w)
        seen.append(pu.pu_risk(*map(pu._Means.of, out), 0.4)[0])
        return out

    w = pu.minimise(totals, pu.pu_risk, 0.4, np.zeros(pu.SIZE))
    assert min(seen) >= 0 and _risk(p, u, 0.4, w) < _risk(p, u, 0.4, np.zeros(pu.SIZE))


def test_prior_of_counts():
    rng = np.random.default_rng(6)
    p, u = rng.beta(5, 2, 20_000), np.concatenate([rng.beta(5, 2, 12_000), rng.beta(1, 9, 8_000)])
    counts = [np.histogram(x, pu.SCORE_BINS, (0, 1))[0] for x in (p, u)]
    assert pu.estimate_prior_of(*counts) == pytest.approx(0.6, abs=0.05) == pytest.approx(pu.estimate_prior(p, u), abs=0.05)
    assert pu.estimate_prior_of(np.zeros(pu.SCORE_BINS), np.ones(pu.SCORE_BINS)) == 0.5


def test_word_odds_leave_a_fold_out():
    counts = np.zeros((pu.FOLDS, 2, 3))
    counts[0, 0, 0] = counts[0, 1, 0] = counts[1, 1, 0] = 5  # in fold 0 all that hold the word are positive, in fold 1 none
    odds = pu.word_odds(counts, np.full((pu.FOLDS, 2), 10.0))
    assert odds[0, 0] < odds[4, 0] < odds[1, 0] == pytest.approx(0) and odds[:, 1] == pytest.approx(0)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "good words here", "p"), (1, "good words here", "p"), (2, None, "p"), (None, "x", "p"), (3, "w " * 100_000, "p")], "doc_id int, text string, positive string")
    labels = spark.createDataFrame([(1, 1, "x"), (1, 1, "x"), (7, 1, "x")], "doc_id int, quality int, text string")
    got = pu.score_quality(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert {r.score for r in pu.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert pu.score_quality(docs.limit(0), labels).count() == 0
