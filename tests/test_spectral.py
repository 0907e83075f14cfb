"""Eigenvalues, components, clusters and nested portfolios against numpy and plain loops."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import spectral as sp

SCHEMA = "year int, ticker string, date date, ret double"


def universe(n=30, days=120, seed=1, groups=3, gaps=False):
    """Returns with planted groups: assets of a group share a factor."""
    rng = np.random.default_rng(seed)
    factors = rng.normal(0, 0.01, (days, groups))
    table = pd.DataFrame({f"t{k:02d}": factors[:, k % groups] * (1 + 0.1 * k / n) + rng.normal(0, 0.004, days) for k in range(n)})
    if gaps:
        table = table.mask(rng.random(table.shape) < 0.1)
    return table


def rows_of(table, year=2020):
    return [(year, k, dt.date(year, 1, 1) + dt.timedelta(days=i), None if np.isnan(x) else float(x)) for k in table for i, x in enumerate(table[k])]


@pytest.fixture(scope="module")
def known(spark):
    a, b = universe(), universe(9, 60, seed=4, groups=2, gaps=True)
    still = [(2021, "still", dt.date(2021, 1, 1) + dt.timedelta(days=i), 0.0) for i in range(60)] + [(2022, "alone", dt.date(2022, 1, 1), 0.1)]
    df = spark.createDataFrame(rows_of(a) + rows_of(b, 2021) + still, SCHEMA)
    return df, sp.moments(df, "year", size=7).cache(), {2020: a, 2021: b}


def test_eigenvalues_equal_numpy(known):
    _, pairs, tables = known
    found = sp.eigen(pairs, "year").toPandas()
    for year, table in tables.items():
        corr = table.corr().to_numpy()
        values, vectors = np.linalg.eigh(corr)
        mine = found[found["year"] == year].sort_values("k")
        assert np.allclose(mine["value"], values[::-1])
        assert np.allclose(mine["cumulative"], np.cumsum(values[::-1]) / values.sum())
        for k, loading in enumerate(mine["loadings"]):
            assert abs(abs(np.dot(loading, vectors[:, -1 - k])) - 1) < 1e-8 and max(loading, key=abs) > 0
        assert list(mine["keys"].iloc[0]) == list(table.columns)
    assert len(found[found["year"] == 2022]) == 0


def test_projections_equal_numpy(known):
    df, pairs, tables = known
    found = sp.eigen(pairs, "year").cache()
    got = sp.projections(df, found, "year", 2).toPandas()
    table = tables[2020]
    z = ((table - table.mean()) / table.std()).to_numpy()
    for k in (1, 2):
        loading = np.array(found.where(f"year = 2020 AND k = {k}").first().loadings)
        mine = got[(got["year"] == 2020) & (got["k"] == k)].sort_values("date")["score"]
        assert np.allclose(mine, z @ loading)


def test_orthogonal_features(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)) @ np.array([[1, 0.9, 0.1], [0, 0.3, 0.2], [0, 0, 1.0]])
    table = pd.DataFrame(x, columns=["a", "b", "c"])
    table["flat"], table["gap"], table["d"] = 1.0, np.where(np.arange(300) == 5, np.nan, 1.0 * np.arange(300)), table["a"] * 2 + 1
    df = spark.createDataFrame(table.assign(gap=table["gap"].astype(object).where(table["gap"].notna(), None)), "a double, b double, c double, flat double, gap double, d double")
    made, loadings = sp.orthogonal(df, ["a", "b", "c", "flat", "gap", "d"], 0.95)
    assert list(loadings["feature"]) == ["a", "b", "c", "d"]
    used = table[["a", "b", "c", "d"]]
    z = ((used - used.mean()) / used.std()).to_numpy()
    values, vectors = np.linalg.eigh(z.T @ z)
    n = int(np.searchsorted(np.cumsum(values[::-1]) / values.sum(), 0.95)) + 1
    names = [c for c in made.columns if c.startswith("pc_")]
    assert len(names) == n and np.allclose(loadings.attrs["values"], values[::-1][:n])
    got = made.toPandas().sort_values("a")[names].to_numpy()
    want = (z @ vectors[:, ::-1][:, :n])[np.argsort(table["a"].to_numpy())]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)
    assert np.allclose(np.corrcoef(got.T) - np.eye(n), 0, atol=1e-6)
    plain, nothing = sp.orthogonal(df, ["flat"])
    assert plain.columns == df.columns and not len(nothing)


def pairwise_tau(x, y):
    """The definition, pair by pair."""

    def one(rank):
        up = a = b = 0.0
        for i, j in itertools.combinations(range(len(x)), 2):
            w = 1 / (1 + rank[i]) + 1 / (1 + rank[j])
            sx, sy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            up, a, b = up + w * sx * sy, a + w * sx * sx, b + w * sy * sy
        return up / np.sqrt(a * b)

    by = lambda f, s: {k: r for r, k in enumerate(sorted(range(len(x)), key=lambda k: (f[k], s[k], k), reverse=True))}
    return (one(by(x, y)) + one(by(y, x))) / 2


def test_weighted_tau_equals_the_pairwise_definition():
    rng = np.random.default_rng(5)
    for _ in range(20):
        x, y = rng.integers(0, 6, 12).astype(float), rng.integers(0, 6, 12).astype(float)
        assert sp.weighted_tau(x, y) == pytest.approx(pairwise_tau(x, y))
    # Published example of the additive hyperbolic form.
    assert sp.weighted_tau([12, 2, 1, 12, 2], [1, 4, 7, 1, 0]) == pytest.approx(-0.56694968153682723)


def test_rank_agreement_on_planted_loadings():
    table = pd.DataFrame({"feature": ["a", "b", "c"], "pc_1": [0.9, 0.4, 0.1], "pc_2": [0.1, -0.2, 0.9]})
    table.attrs["values"] = np.array([10.0, 1.0])
    got = sp.rank_tau({"a": 3.0, "b": 2.0, "c": 1.0}, table)
    assert got["weighted"] == pytest.approx(1.0) and abs(got["kendall"]) < 1 and got["pearson"] > 0


def test_planted_groups_are_found(known):
    _, pairs, tables = known
    got = sp.clusters(pairs, "year", most=6).toPandas()
    mine = got[got["year"] == 2020]
    groups = mine.groupby("cluster")["key"].apply(lambda s: frozenset(int(x[1:]) % 3 for x in s))
    assert len(groups) == 3 and all(len(g) == 1 for g in groups)
    assert (mine["silhouette"] > 0.5).all() and len(mine) == 30 and mine["cluster"].iloc[mine["key"].argmin()] == 0
    # Quality is the mean over the deviation of plainly computed silhouettes.
    corr = tables[2020].corr().to_numpy()
    rows = np.sqrt(np.clip(1 - corr, 0, None) / 2)
    labels = mine.sort_values("key")["cluster"].to_numpy()
    s = []
    for i in range(30):
        d = np.sqrt(((rows - rows[i]) ** 2).sum(axis=1))
        a = d[(labels == labels[i]) & (np.arange(30) != i)].mean()
        b = min(d[labels == other].mean() for other in set(labels) - {labels[i]})
        s.append((b - a) / max(a, b))
    assert np.allclose(mine.sort_values("key")["silhouette"], s, atol=1e-6) and mine["quality"].iloc[0] == pytest.approx(np.mean(s) / np.std(s))
    assert set(got["year"]) == {2020, 2021}


def test_nested_and_closed_form_weights_equal_a_plain_loop(known):
    _, pairs, tables = known
    grouped = sp.clusters(pairs, "year", most=6).cache()
    got = sp.nested_weights(pairs, grouped, "year").toPandas()
    plain = sp.closed_form(pairs, "year").toPandas()
    for year, table in tables.items():
        mine = got[got["year"] == year].sort_values("key")
        cov, labels = table.cov().to_numpy(), mine["cluster"].to_numpy()
        inner = np.zeros((len(cov), labels.max() + 1))
        for c in range(labels.max() + 1):
            at = np.flatnonzero(labels == c)
            inv = np.linalg.inv(cov[np.ix_(at, at)])
            inner[at, c] = inv.sum(axis=1) / inv.sum()
        inv = np.linalg.inv(inner.T @ cov @ inner)
        assert np.allclose(mine["weight"], inner @ (inv.sum(axis=1) / inv.sum())) and mine["weight"].sum() == pytest.approx(1)
        inv = np.linalg.inv(cov)
        assert np.allclose(plain[plain["year"] == year].sort_values("key")["weight"], inv.sum(axis=1) / inv.sum())


def test_denoising_shrinking_and_detoning(known):
    _, pairs, tables = known
    corr = tables[2020].corr().to_numpy()
    values, vectors = np.linalg.eigh(corr)
    values, vectors = values[::-1], vectors[:, ::-1]
    flat = np.r_[values[:3], np.full(27, values[3:].mean())]
    constant = vectors @ np.diag(flat) @ vectors.T
    constant /= np.sqrt(np.outer(np.diag(constant), np.diag(constant)))
    right = vectors[:, 3:] @ np.diag(values[3:]) @ vectors[:, 3:].T
    shrunk = corr - right + 0.3 * right + 0.7 * np.diag(np.diag(right))
    v2, e2 = np.linalg.eigh(constant)
    toned = constant - v2[-1] * np.outer(e2[:, -1], e2[:, -1])
    toned /= np.sqrt(np.outer(np.diag(toned), np.diag(toned)))
    i = np.triu_indices(30, 1)
    for want, options in ((constant, {}), (shrunk, {"how": "shrink", "alpha": 0.3}), (toned, {"market": 1})):
        got = sp.denoised(pairs, "year", **options).where("year = 2020").orderBy("a", "b").toPandas()
        assert np.allclose(got["corr"], want[i]), options


def loop_hrp(cov, corr):
    dist = np.sqrt(np.clip(1 - corr, 0, None) / 2)
    far = np.sqrt(((dist[:, None, :] - dist[None, :, :]) ** 2).sum(-1))
    clusters = [[i] for i in range(len(far))]
    while len(clusters) > 1:
        pairs = [(min(far[i, j] for i in a for j in b), k, m) for (k, a), (m, b) in itertools.combinations(enumerate(clusters), 2)]
        _, k, m = min(pairs)
        clusters = [c for i, c in enumerate(clusters) if i not in (k, m)] + [clusters[k] + clusters[m]]
    weights = np.ones(len(far))

    def risk(items):
        v = cov[np.ix_(items, items)]
        w = 1 / np.diag(v) / (1 / np.diag(v)).sum()
        return w @ v @ w

    def split(items):
        if len(items) > 1:
            a, b = items[: len(items) // 2], items[len(items) // 2 :]
            share = 1 - risk(a) / (risk(a) + risk(b))
            weights[a] *= share
            weights[b] *= 1 - share
            split(a)
            split(b)

    split(clusters[0])
    return weights


def test_hierarchical_risk_parity_equals_a_plain_loop(known):
    _, pairs, tables = known
    got = sp.hrp(pairs, "year").toPandas()
    for year, table in tables.items():
        mine = got[got["year"] == year].sort_values("key")["weight"].to_numpy()
        assert np.allclose(mine, loop_hrp(table.cov().to_numpy(), table.corr().to_numpy())) and mine.sum() == pytest.approx(1)


def test_nothing_gives_nothing(known):
    df, _, _ = known
    none = sp.moments(df.limit(0), "year")
    for made in (sp.eigen(none, "year"), sp.clusters(none, "year"), sp.closed_form(none, "year"), sp.denoised(none, "year"), sp.hrp(none, "year")):
        assert made.count() == 0
