"""Embedding whitening against plain numpy, and its eigen solver on hard matrices."""

import math

import numpy as np
import pytest
from __spark_entry__ import queries
from lakeops.llm import whitening


def brute(rows):
    """The query's lines for (id, vector) pairs, by numpy's own eigen solver."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) and all(e is not None and math.isfinite(e) for e in v)]
    x = [(i, tuple(math.floor(64 * float(e)) + 1_000_000 for e in v)) for i, v in kept]
    fit = sorted({v for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array(sums) / n
    centred = np.array(fit) - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, v in x:
        deviation = sum((n * e - s) ** 2 for e, s in zip(v, sums))
        w = (np.array(v) - mean) @ vectors / np.sqrt(values)
        for k in range(min(16, len(values))):
            out[i, k + 1] = (n, deviation, w[k], values[k] / values.sum())
    return out


SF = "/root/testdata/sf0.001"


def test_query_equals_brute_force(spark, sf_dir=SF):
    found = queries()["op11_embedding_whitening"](spark, sf_dir).toPandas()
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    expected = brute([(r.vec_id, r.embedding) for r in rows])
    assert len(found) == len(expected) and found.identity_error.nunique() == 1 and found.identity_error[0] < 1e-9
    signs = {}
    for r in found.itertuples():
        n, deviation, w, share = expected[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.explained == pytest.approx(share, rel=1e-9)
        if abs(w) > 1e-3:
            assert signs.setdefault(r.component, np.sign(w * r.whitened)) == np.sign(w * r.whitened)
        assert abs(r.whitened) == pytest.approx(abs(w), abs=1e-7)


def test_defined_results_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.1, 0.5, 0.2]), (2, [0.1, 0.5, 0.2]), (2, [0.3, -0.5, 0.9]), (3, [0.7, 0.1, 0.0]), (4, [1.0, 0.4, -0.7]),
        (None, [0.2, 0.2, 0.3]), (5, None), (6, [None, 0.1, 0.2]), (7, [nan, 0.1, 0.2]), (8, [0.1, inf, 0.2]), (9, []),
        (10, [0.5]), (11, [1e300, 0.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit_whitening(df)
    assert (model.dim, model.n, len(model.values)) == (3, 5, 3) and model.identity_error < 1e-12
    found = df.select("vec_id", model.whitened_column(df.embedding).alias("w")).collect()
    kept = [r.vec_id for r in found if r.w is not None]
    assert sorted(kept, key=str) == sorted([1, 2, 2, 3, 4, None], key=str)
    first, second = [r.w for r in found if r.w is not None][:2]
    assert first == second
    expected = brute([(i, v) for i, (_, v) in enumerate(rows) if v is not None and len(v) == 3 and v[0] != 1e300])
    assert [r.w.deviation for r in found if r.w] == [expected[i, 1][1] for i in range(6)]


def test_without_variance_and_without_rows(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int"
    for name, rows in (("none", []), ("same", [(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 1)]), ("null", [(1, None, 1)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert queries()["op11_embedding_whitening"](spark, f"{tmp_path}/{name}").collect() == []


def test_fewer_components_than_entries(spark):
    """Vectors on a line have one component."""
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<double>")
    model = whitening.fit_whitening(df)
    assert len(model.values) == 1 and model.explained == [pytest.approx(1.0)]


def test_deviations_beyond_a_long_are_null(spark):
    df = spark.createDataFrame([(1, [2.0**50, 0.0]), (2, [-(2.0**50), 1.0])], "vec_id long, embedding array<double>")
    model = whitening.fit_whitening(df)
    found = df.select(model.whitened_column(df.embedding).alias("w")).collect()
    assert [r.w.deviation for r in found] == [None, None] and all(len(r.w.whitened) >= 1 for r in found)


@pytest.mark.parametrize("size", [1, 2, 7, 40])
def test_eigenvectors(size):
    rng = np.random.default_rng(size)
    q = np.linalg.qr(rng.standard_normal((size, size)))[0]
    spectra = [
        rng.standard_normal(size), np.ones(size), np.repeat([3.0, 1.0], [size // 2, size - size // 2]),
        10.0 ** -np.linspace(0, 14, size), np.maximum(rng.standard_normal(size), 0),
    ]
    for spectrum in spectra:
        v = q @ np.diag(spectrum) @ q.T
        values, vectors = whitening.eigen_by_division(v)
        norm = max(np.linalg.norm(v), 1e-300)
        assert np.abs(values - np.sort(spectrum)[::-1]).max() < 1e-14 * norm + 1e-300
        assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-14
        assert np.linalg.norm(v @ vectors - vectors * values) < 1e-13 * norm + 1e-300


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((12, 12)))[0]
    signs = np.where(np.arange(12) % 3 == 0, 1.0, -1.0)
    a = q @ np.diag(signs * 10.0 ** -np.arange(12)) @ q.T
    assert np.abs(whitening.polar_factor(a) - q @ np.diag(signs) @ q.T).max() < 1e-2
    b = q @ np.diag(signs * np.linspace(1, 3, 12)) @ q.T
    assert np.abs(whitening.polar_factor(b) - q @ np.diag(signs) @ q.T).max() < 1e-14
