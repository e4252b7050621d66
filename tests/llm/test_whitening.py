"""Whitening against numpy on the whole matrix."""

import math

import numpy as np
import pytest

from spanveil.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<double>, row string, x string, component int"


def _frame(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, "r", "x", None) for i, v in enumerate(vectors)], SCHEMA).repartition(parts)


def _rows(spark, vectors, **kw):
    got = whitening.whiten(_frame(spark, vectors), **kw).collect()
    return {(r.row.vec_id, r.component): r for r in got}, len(got)


def _plain(vectors, k=8):
    x = np.floor(1024 * np.array(vectors)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    centred = x - s / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:k]
    return ((n * x - s) ** 2).sum(1), centred @ u[:, order] / np.sqrt(e[order]), e[order] / np.trace(v)


@pytest.mark.parametrize(("d", "tile", "block"), [(5, 2, 7), (8, 32, 4096), (11, 4, 3), (3, 1, 1)])
def test_whitening_equals_the_whole_matrix(spark, d, tile, block):
    rng = np.random.default_rng(d)
    vectors = (rng.normal(size=(60, d)) @ rng.normal(size=(d, d)) + 3).tolist()
    got, n = _rows(spark, vectors, tile=tile, block=block)
    deviation, w, explained = _plain(vectors)
    k = min(8, d)
    assert n == 60 * k
    signs = [math.copysign(1, got[0, c + 1].whitened * w[0, c]) for c in range(k)]
    for (i, c), r in got.items():
        assert r.n == 60 and r.deviation == deviation[i]
        assert abs(r.whitened - signs[c - 1] * w[i, c - 1]) < 1e-8 and abs(r.explained - explained[c - 1]) < 1e-10 and r.identity_error < 1e-10


def test_unusable_vectors_are_left_out(spark):
    good = np.random.default_rng(1).normal(size=(20, 4)).tolist()
    bad = [None, [], [1.0, None, 2.0, 3.0], [math.nan] * 4, [math.inf, 1.0, 1.0, 1.0], [1e300] * 4, [1.0, 2.0], [1.0] * 5]
    got, _ = _rows(spark, bad + good + good[:1])
    assert {i for i, _ in got} == set(range(len(bad), len(bad) + 21))
    assert {r.n for r in got.values()} == {21}
    assert [got[8, c].whitened for c in range(1, 5)] == [got[28, c].whitened for c in range(1, 5)]


def test_components_without_spread(spark):
    got, n = _rows(spark, [[0.5, 0.25, -1.0]] * 7)
    assert n == 21 and {(r.whitened, r.explained, r.deviation, r.identity_error) for r in got.values()} == {(None, 0.0, 0, 0.0)}
    got, n = _rows(spark, [[float(i), float(2 * i), 0.0] for i in range(40)])
    assert n == 120 and all((got[i, 1].whitened is not None, got[i, 2].whitened, got[i, 3].whitened) == (True, None, None) for i in range(40))
    assert abs(got[0, 1].explained - 1) < 1e-12 and got[0, 1].identity_error < 1e-12
    assert _rows(spark, [[1.0, 2.0]])[1] == 2


def test_deviations_beyond_fast_numbers(spark):
    big = [[2.0**40, 0.0], [-(2.0**40), 1.0], [3.0, 0.5]]
    got, _ = _rows(spark, big)
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in big]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((3 * a - t) ** 2 for a, t in zip(v, s, strict=True)) for v in x]
    assert [got[i, 1].deviation for i in range(3)] == [t if t < 2**63 else None for t in want]
    assert None in [got[i, 1].deviation for i in range(3)]


def test_no_vectors(spark):
    out = whitening.whiten(_frame(spark, [None]).where("false"))
    assert out.count() == 0 and out.columns[1:] == ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(_frame(spark, [None, []])).count() == 0


def test_query_over_the_table(spark, small):
    got = queries.op11_embedding_whitening(spark, small).toPandas().sort_values(["vec_id", "component"])
    table = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    deviation, w, explained = _plain([r.embedding for r in table])
    assert got.component.tolist() == list(range(1, 9)) * len(table) and (got.deviation.to_numpy().reshape(-1, 8) == deviation[:, None]).all()
    mine = got.whitened.to_numpy().reshape(-1, 8)
    assert np.abs(mine - w * np.sign((mine * w).sum(0))).max() < 1e-8 and np.abs(got.explained.to_numpy()[:8] - explained).max() < 1e-12
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10
