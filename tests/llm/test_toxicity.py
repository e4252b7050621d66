"""The chain on planted categories, learned groups against a plain clustering rule, and edge cases."""

import numpy as np
import pytest

from spanveil.llm import toxicity


def _planted(n=1200, seed=1):
    """Rows of features below 60: 0-4 speak for one kind of toxicity, 5-9 for another."""
    rng = np.random.default_rng(seed)
    kind = np.where(rng.random(n) < 0.25, rng.integers(0, 2, n), -1)
    bags = []
    for k in kind:
        own = rng.choice(np.arange(10, 60), 12, replace=False)
        bags.append(np.unique(np.concatenate([own, rng.choice(np.arange(5 * k, 5 * k + 5), 3)]) if k >= 0 else own))
    return bags, kind


def test_groups_are_the_planted_kinds():
    bags, kind = _planted()
    toxic = kind >= 0
    telling = toxicity.telling(*(np.bincount(np.concatenate(b), minlength=60).astype(float) for b in ([x for x, t in zip(bags, toxic, strict=True) if t], bags)), toxic.sum(), len(bags))
    assert set(range(10)) <= set(telling)
    own = [b[np.isin(b, telling)] for b, t in zip(bags, toxic, strict=True) if t]
    got = toxicity.groups_of(own, 60, 2)
    same = (got == kind[toxic]).mean()
    assert max(same, 1 - same) > 0.95
    assert (toxicity.groups_of([np.zeros(0, int)], 5, 2) == -1).all() and len(toxicity.groups_of([], 5, 2)) == 0


def test_chain_uses_out_of_fold_predictions():
    bags, kind = _planted()
    chain = toxicity.fit_chain(bags, {"a": kind == 0, "b": kind == 1, "toxic": kind >= 0}, 60)
    assert [len(m.earlier) for m in chain.models] == [0, 1, 2] and chain.models[2].earlier.min() > 0
    fresh, want = _planted(seed=2)
    flat, row = np.concatenate(fresh), np.repeat(np.arange(len(fresh)), [len(b) for b in fresh])
    before = np.zeros((len(fresh), 0))
    for m in chain.models:
        before = np.column_stack([before, toxicity._predict(m, flat, row, before)])
    assert ((before[:, 2] >= chain.thresholds[2]) == (want >= 0)).mean() > 0.97


def test_logistic_fit_is_at_its_minimum():
    bags, kind = _planted()
    y, flat, row = (kind >= 0).astype(float), np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    y[:40] = 1 - y[:40]  # so that the minimum is finite
    m = toxicity._fit(flat, row, np.zeros((len(y), 0)), y, 60, steps=3000)
    error = toxicity._predict(m, flat, row, np.zeros((len(y), 0))) - y
    gradient = [error[row[flat == b]].sum() / len(y) + 1e-5 * w for b, w in zip(m.buckets, m.weights, strict=True)]
    assert np.abs([*gradient, error.mean()]).max() < 2e-3


def test_edges(spark):
    words = "vile grim foul nasty"
    docs = [(i, f"plain text number {i} " + (words if i % 3 == 0 else ""), "r", "t") for i in range(60)]
    docs += [(3, "another text for an id that repeats", "r", "t"), (3, f"plain text number 3 {words}", "r", "t"), (None, words, "r", "t"), (90, None, "r", "t"), (91, "", "r", "t"), (92, "w " * 100_000, "r", "t")]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, row string, toxic string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "x") for i in range(60)] + [(3, 0, "x"), (None, 1, "x"), (5, None, "x")], "doc_id bigint, toxic int, text string")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == 66
    assert all(r.got.toxic == (words in (r.row.text or "")) for r in got)
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert not any(r.got.toxic for r in toxicity.score_toxicity(docs, labels.where("toxic = 0")).collect())
