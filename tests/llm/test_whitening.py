"""Whitening against numpy on the whole list of vectors, on odd rows too."""

from __future__ import annotations

import math

import numpy as np
import pytest

from trackspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n int, key int"


def brute(vectors, k):
    """n, deviations, covariance's eigenvalues and vectors, and the centred matrix of a list of equally long vectors."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(0)
    deviations = [int(((n * row - s) ** 2).sum()) for row in x]
    centred = np.array([[float((n * a - b)) / n for a, b in zip(row, s)] for row in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return n, deviations, e[::-1][:k], v[:, ::-1][:, :k], centred, e.sum()


def good(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    made = (rng.normal(size=(300, 6)) * [3, 2, 1.5, 1, 0.7, 0.3]).tolist()
    made += [made[0]] * 150 + [made[1]] * 3
    out = [(k, v, "x", 1, 2) for k, v in enumerate(made)]
    return [*out, (5, made[7], "x", 1, 2), (None, made[8], "x", 1, 2), (900, None, "", 1, 2), (901, [1.0, None], "", 1, 2), (902, [float("nan")] * 6, "", 1, 2), (903, [float("inf")] * 6, "", 1, 2)]


@pytest.mark.parametrize("weights", ["count", "one"])
def test_whitening(spark, rows, weights):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = whitening.whiten(df, 4, weights).collect()
    kept = [r for r in rows if good(r[1])]
    assert sorted(str(r.vec_id) for r in got) == sorted(str(r[0]) for r in kept)
    fit = [r[1] for r in kept] if weights == "count" else [list(v) for v in dict.fromkeys(tuple(r[1]) for r in kept)]
    n, deviations, e, vectors, centred, trace = brute(fit, 4)
    place = {tuple(np.float32(v)): k for k, v in enumerate(fit)}
    by_id = {i: v for i, v, *_ in kept}
    signs = None
    for r in got:
        k = place[tuple(np.float32(by_id[r.vec_id]))] if r.vec_id != 5 else None
        assert r.n == n and r.identity_error <= 1e-9 and [c.component for c in r.components] == [1, 2, 3, 4]
        assert np.allclose([c.explained for c in r.components], e / trace, rtol=1e-9)
        if k is None:
            continue
        assert r.deviation == deviations[k]
        want = centred[k] @ vectors / np.sqrt(e)
        have = np.array([c.whitened for c in r.components])
        signs = np.sign(have * want) if signs is None else signs
        assert np.allclose(have, want * signs, atol=1e-8)


def test_vectors_of_other_lengths_and_without_variance(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.5, 3.0]), (3, [0.5, 0.5]), (4, [0.5, 0.5]), (5, []), (6, [2.0**39, -(2.0**39)]), (7, [2.0**60, 0.0])]
    got = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert [c.whitened is None for c in got[1].components] == [False, True, True] and math.isclose(got[1].components[0].explained, 1)
    assert math.isclose(abs(got[1].components[0].whitened), 1) and got[1].components[0].whitened == -got[2].components[0].whitened
    assert got[3].n == 3 and got[6].deviation is None and got[5].components == []
    n, deviations, *_ = brute([r[1] for r in rows[2:4]] + [rows[5][1]], 2)
    assert got[3].deviation == (deviations[0] if deviations[0] < 1 << 63 else None)
    alone = whitening.whiten(spark.createDataFrame([(1, [4.0, 4.0])] * 3, "vec_id long, embedding array<double>")).collect()
    assert [(r.n, r.deviation, r.identity_error, [c.whitened for c in r.components]) for r in alone] == [(3, 0, None, [None, None])] * 3


def test_empty_table(spark):
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_whole_table(spark):
    out = whitening.query(spark, "/root/testdata/sf0.01").collect()
    n = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").count()
    assert len(out) == 32 * n and max(r.identity_error for r in out) <= 1e-4
    top = np.array([r.whitened for r in out if r.component == 1])
    assert abs(top.mean()) < 1e-9 and math.isclose((top**2).mean(), 1, rel_tol=1e-9)
