import math

import numpy as np
import pytest

from transloom.llm.whitening import above, feast, intervals, largest, positive, whiten

SCHEMA = "vec_id long, embedding array<float>"


def spectrum(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    v = (q * np.array(values, float)) @ q.T
    return (v + v.T) / 2


SPECTRA = {
    "close": [5.0, 4.999999, 4.99, 3, 2.9, 2.8, 2.7, 2.6, 2.5, 2.4, 1, 0.5],
    "equal": [7.0, 7.0, 7.0, 7.0, 7.0, 7.0, 3.0, 3.0, 3.0, 1.0],
    "wide": [1e8, 1e5, 1e3, 10, 1, 0.1, 1e-3, 1e-4, 1e-5, 0],
    "one": [4.0],
    "cluster": list(np.linspace(1, 1.2, 64)),
    "spike": [100.0, *np.linspace(1, 2, 63)],
    "rank": [3.0, 2.0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
}


@pytest.mark.parametrize("name", SPECTRA)
def test_largest_eigenpairs(name):
    v = spectrum(SPECTRA[name])
    values, axes = largest(v, 8)
    wanted = np.sort(np.linalg.eigvalsh(v))[::-1][:8]
    scale = np.abs(v).max()
    assert np.allclose(values, wanted, rtol=0, atol=1e-12 * scale)
    assert np.abs(axes @ axes.T - np.eye(len(axes))).max() < 1e-12
    assert np.abs(axes @ v - values[:, None] * axes).max() < 1e-12 * scale


def test_inertia_counts():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 20):
        a = rng.standard_normal((n, n))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        assert positive(a) == (values > 0).sum()
        for at in (-1.0, 0.3, 2.0):
            assert above(a, at) == (values > at).sum()
    assert positive(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1
    assert positive(np.zeros((3, 3))) == 0


def test_intervals_hold_all():
    v = spectrum(SPECTRA["cluster"])
    values = np.linalg.eigvalsh(v)
    cuts = intervals(v, 8)
    assert sum(n for *_, n in cuts) >= 8
    for low, high, n in cuts:
        assert ((values > low) & (values <= high)).sum() == n
        found, _ = feast(v, low, high, n)
        assert np.allclose(np.sort(found), np.sort(values[(values > low) & (values <= high)]), atol=1e-12)


def brute(rows):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in rows])
    n = len(x)
    sums = [int(s) for s in x.sum(axis=0)]
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    d = x - np.array(sums) / n
    cov = d.T @ d / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:8], q[:, ::-1][:, :8]
    return n, deviation, d @ q / np.sqrt(e), e / np.trace(cov)


def test_against_plain_numpy(spark):
    rng = np.random.default_rng(2)
    rows = (rng.standard_normal((400, 12)) * np.linspace(0.2, 2, 12) + 0.3).astype(np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(rows)]
    # left out: null, null entry, not finite, empty, another length
    odd = [(-1, None), (-2, [None] * 12), (-3, [float("nan")] * 12), (-4, [float("inf"), *[0.0] * 11]), (-5, []), (-6, [1.0, 2.0])]
    df = spark.createDataFrame(data + odd, SCHEMA).repartition(5)
    found = whiten(df).collect()
    n, deviation, white, explained = brute(rows)
    assert len(found) == 400 * 8
    got = np.zeros((400, 8))
    for r in found:
        assert r["n"] == n and int(r["deviation"]) == deviation[r["vec_id"]]
        assert abs(r["explained"] - explained[r["component"] - 1]) < 1e-12
        assert r["identity_error"] < 1e-9
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got * sign - white).max() < 1e-8
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]}


def test_odd_tables(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)).collect() == []  # one vector has no spread
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, SCHEMA)).collect() == []
    # two vectors spread along one line; repeated and null ids are rows; clashing columns
    rows = [(1, [0.0, 0.0], 1.0, 5), (1, [1.0, 1.0], 2.0, 6), (None, [0.0, 0.0], 1.0, 5), (4, [1.0, 1.0], 2.0, 6)]
    found = whiten(spark.createDataFrame(rows, SCHEMA + ", whitened double, n int")).collect()
    assert len(found) == 4 and {r["component"] for r in found} == {1}
    assert sorted(round(abs(r["whitened"]), 9) for r in found) == [1.0] * 4
    assert sum(r["vec_id"] is None for r in found) == 1
    # lengths that are equally frequent: the larger one
    assert {r["vec_id"] for r in whiten(spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [1.0, 2.0]), (4, [2.0, 5.0])], SCHEMA)).collect()} == {3, 4}
    # a hot vector: a third of all rows
    hot = [(i, [0.5, -0.25, 1.0]) for i in range(100)] + [(i, [i % 7 / 7, i % 11 / 11, i % 13 / 13]) for i in range(100, 300)]
    assert max(r["identity_error"] for r in whiten(spark.createDataFrame(hot, SCHEMA)).collect()) < 1e-9
