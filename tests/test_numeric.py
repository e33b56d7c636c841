"""Families, special functions, GLM-PCA, clusters, signal."""

import math

import numpy as np
import pytest

from cellweave.functions.families import FAMILIES
from cellweave.functions.special import digamma, lgamma, trigamma
from cellweave.operators import graph, reduction, signal


def test_special():
    x = np.array([0.1, 1.0, 2.5, 30.0])
    assert lgamma(x) == pytest.approx([math.lgamma(v) for v in x])
    assert digamma(np.array([1.0])) == pytest.approx(-0.5772156649)
    eps = 1e-5
    assert trigamma(x) == pytest.approx((digamma(x + eps) - digamma(x - eps)) / (2 * eps), rel=1e-5)
    assert digamma(x) == pytest.approx([(math.lgamma(v + eps) - math.lgamma(v - eps)) / (2 * eps) for v in x], abs=1e-5)


def test_densities():
    x = np.linspace(-5, 5, 50)
    assert FAMILIES["gaussian"]().density(x, 1.5) == pytest.approx(np.exp(-((x - 1.5) ** 2) / 2) / math.sqrt(2 * math.pi))
    t = np.linspace(-30, 30, 100)
    assert FAMILIES["bernoulli"]().density(np.ones(100), t) == pytest.approx(1 / (1 + np.exp(-t)), abs=1e-6)
    k = np.arange(0, 50.0)
    assert FAMILIES["poisson"]().log_density(k, math.log(3)) == pytest.approx([n * math.log(3) - 3 - math.lgamma(n + 1) for n in k])
    y = np.linspace(0.01, 0.99, 20)
    a, b = 0.3 * 4, 0.7 * 4
    want = (a - 1) * np.log(y) + (b - 1) * np.log(1 - y) + math.lgamma(4) - math.lgamma(a) - math.lgamma(b)
    assert FAMILIES["beta"](nu=4.0).log_density(y, 0.3) == pytest.approx(want)
    assert FAMILIES["sigmoid_beta"](nu=4.0).log_density(y, math.log(0.3 / 0.7)) == pytest.approx(want)
    g = np.logspace(-2, 2, 20)
    assert FAMILIES["gamma"](nu=2.0).log_density(g, 1.5) == pytest.approx(2.5 * math.log(2) + 1.5 * np.log(g) - 2 * g - math.lgamma(2.5))
    assert FAMILIES["log_normal"](nu=0.5).log_density(g, 0.2) == pytest.approx(-np.log(g * 0.5 * math.sqrt(2 * math.pi)) - (np.log(g) - 0.2) ** 2 / 0.5)


def test_inverse_links():
    assert FAMILIES["poisson"]().inverse_link(np.array([0.0, 1.0, math.e])) == pytest.approx([1e-20, 1e-20, 1])
    assert FAMILIES["bernoulli"]().inverse_link(np.array([0.0, 1.0, 0.5])) == pytest.approx([-30, 30, 0])
    rng = np.random.default_rng(0)
    x = rng.beta(2, 5, size=(4000, 1))
    f = FAMILIES["beta"]().fit(x)
    assert f.params["nu"][0] == pytest.approx(7, rel=0.15)
    t = f.inverse_link(x[:5])
    for row, v in zip(t, x[:5], strict=True):
        around = f.log_density(v, np.array([row[0] - 1e-3, row[0], row[0] + 1e-3]))
        assert around[1] >= max(around[0], around[2])


@pytest.mark.parametrize("name", sorted(FAMILIES))
def test_gradients_are_derivatives_of_the_loss(name):
    f = FAMILIES[name](**({"nu": 2.5} if name not in ("gaussian", "bernoulli", "poisson") else {}))
    x = np.array([0.2, 0.5, 0.9])
    theta, eps = np.array([0.3, 0.6, 0.4]), 1e-6
    want = [(f.loss(x[k : k + 1], theta[k : k + 1] + eps) - f.loss(x[k : k + 1], theta[k : k + 1] - eps)) / (2 * eps) for k in range(3)]
    assert f.gradient(x, theta) == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_fits_reach_the_greatest_likelihood():
    rng = np.random.default_rng(3)
    x = np.column_stack((rng.beta(2, 5, 5000), rng.beta(0.5, 0.7, 5000)))
    nu = FAMILIES["beta"]().fit(x).params["nu"]
    assert nu == pytest.approx([7, 1.2], rel=0.08)
    m = x.clip(1e-4, 1 - 1e-4)

    def beta(a, b, k):
        return ((a - 1) * np.log(m[:, k]) + (b - 1) * np.log(1 - m[:, k]) - lgamma(a) - lgamma(b) + lgamma(a + b)).sum()

    for k in range(2):
        # No pair (a, b) around does better than the best one of the fitted a + b.
        best = max(beta(t * nu[k], (1 - t) * nu[k], k) for t in np.linspace(0.05, 0.95, 181))
        assert best >= max(beta(t * nu[k] * f, (1 - t) * nu[k] * f, k) for f in (0.97, 1.03) for t in np.linspace(0.05, 0.95, 181)) - 1e-6
    g = rng.gamma(3, 1 / 2, size=(5000, 1))
    rate = FAMILIES["gamma"]().fit(g).params["nu"][0]
    assert rate == pytest.approx(2, rel=0.08) and FAMILIES["gamma"]().fit(g, "moments").params["nu"][0] == pytest.approx(2, rel=0.15)
    shape = lambda r: r * g.mean()
    like = lambda k, r: (k * np.log(r) + (k - 1) * np.log(g) - r * g - lgamma(k)).sum()
    assert all(like(shape(rate), rate) >= like(shape(rate * f), rate * f) for f in (0.97, 1.03))
    assert FAMILIES["log_normal"]().fit(np.exp(rng.normal(1, 0.5, (5000, 1)))).params["nu"][0] == pytest.approx(0.5, rel=0.05)


def low_rank(spark, kind="poisson"):
    rng = np.random.default_rng(1)
    side = rng.integers(0, 2, 60)
    means = np.where(side[:, None] == np.arange(12) % 2, 6.0, 0.5)
    x = rng.poisson(means)
    rows = [(f"c{i:02d}", f"f{j:02d}", float(x[i, j])) for i in range(60) for j in range(12) if x[i, j]]
    return spark.createDataFrame(rows, "cell_id string, feature_id string, count double"), side


def separated(df, side):
    v = {r["cell_id"]: r["vector"] for r in df.collect()}
    first = np.array([v[f"c{i:02d}"][0] for i in range(60)])
    return max(np.mean((first > np.median(first)) == side), np.mean((first <= np.median(first)) == side))


def test_glmpca_descends_and_separates(spark):
    x, side = low_rank(spark)
    m = reduction.GLMPCA(1, "poisson", max_iter=12).fit(x)
    assert all(b <= a for a, b in zip(m.losses, m.losses[1:], strict=False)) and m.losses[-1] < m.losses[0]
    assert m.loadings.T @ m.loadings == pytest.approx(np.eye(1))
    assert separated(m.transform(), side) > 0.9


@pytest.mark.parametrize("name", sorted(set(FAMILIES) - {"lognormal", "poisson"}))
def test_glmpca_runs_with_every_family(spark, name):
    rng = np.random.default_rng(2)
    high = rng.integers(0, 2, 40)[:, None] == np.arange(6) % 2
    x = {"bernoulli": (rng.random((40, 6)) < np.where(high, 0.95, 0.05)).astype(float), "gaussian": rng.normal(np.where(high, 3, -3), 1)}.get(name)
    if x is None:
        x = rng.beta(np.where(high, 8, 2), 4) if "beta" in name else rng.gamma(np.where(high, 8, 2), 0.5)
    rows = [(f"c{i:02d}", f"f{j}", float(x[i, j])) for i in range(40) for j in range(6) if x[i, j]]
    df = spark.createDataFrame(rows, "cell_id string, feature_id string, count double")
    m = reduction.GLMPCA(1, name, max_iter=4).fit(df)
    assert np.isfinite(m.losses).all() and m.losses[-1] <= m.losses[0]
    v = np.array([r["vector"][0] for r in m.transform().orderBy("cell_id").collect()])
    side = high[:, 0]
    assert max(np.mean((v > np.median(v)) == side), np.mean((v <= np.median(v)) == side)) > 0.75


def test_nearest_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_ROWS", 70)
    monkeypatch.setattr(graph, "ROW_BLOCK", 110)
    monkeypatch.setattr(graph, "LIST_ROWS", 20)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 6)) + 4 * rng.integers(0, 3, size=(600, 1))
    x[50] = x[51]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vector array<double>")
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = {i: np.lexsort((np.arange(600), d[i]))[:5].tolist() for i in range(600)}
    for found, least in ((graph.nearest(df, 5), 1.0), (graph.nearest_by_lists(df, 5), 0.9)):
        got: dict = {}
        for r in found.orderBy("src", "rank").collect():
            got.setdefault(r["src"], []).append(r["dst"])
            assert r["distance"] == pytest.approx(d[r["src"], r["dst"]])
        assert len(got) == 600 and all(len(v) == 5 for v in got.values())
        assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in range(600)]) >= least
    few = graph.nearest(df, 5, df.filter("cell_id % 50 = 0"))
    assert few.count() == 60 and graph.nearest_by_lists(df.filter("1 = 0"), 5).count() == 0


def test_pca_and_lsa(spark):
    x, side = low_rank(spark)
    assert separated(reduction.pca(reduction.log1p(reduction.normalized(x)), 2), side) > 0.9
    got = reduction.lsa(x, 3, "count", drop_first=False)
    dense = np.zeros((60, 12))
    for r in x.collect():
        dense[int(r[0][1:]), int(r[1][1:])] = r[2]
    s = np.linalg.svd(dense, compute_uv=False)[:3]
    v = np.array([r["vector"] for r in got.collect()])
    assert np.sqrt((v**2).sum(axis=0)) == pytest.approx(s, rel=1e-6)


def test_clusters_find_blocks(spark):
    edges = [(i, j, 1.0) for b in range(3) for i in range(b * 6, b * 6 + 6) for j in range(b * 6, b * 6 + 6) if i != j] + [(0, 6, 0.1), (6, 0, 0.1)]
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    labels = graph.clusters(e)
    by = {r["node"]: r["label"] for r in labels.collect()}
    assert all(len({by[i] for i in range(b * 6, b * 6 + 6)}) == 1 for b in range(3)) and len(set(by.values())) == 3
    assert graph.modularity(e, labels) > 0.6


def test_spectrum_of_a_period(spark):
    h = [("a", k, int(200 * (1 + math.sin(2 * math.pi * k / 18)))) for k in range(100)]
    s = signal.spectrum(spark.createDataFrame(h, "bc string, bin int, n long"))
    assert signal.band_power(s).first()["period"] == pytest.approx(180, abs=25)
