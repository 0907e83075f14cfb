"""Estimators held against plain loops."""

import datetime as dt
import math

import numpy as np
import pytest

from tickloom.operators import breaks, statistics

RNG = np.random.default_rng(21)
DAYS = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(400)]


def series(spark, values, name="close", key="a"):
    return spark.createDataFrame([(key, DAYS[i], float(v)) for i, v in enumerate(values)], f"ticker string, date date, {name} double")


@pytest.mark.parametrize("model,lags,constant", [("linear", 2, True), ("linear", 1, False), ("quadratic", 1, True), ("sm_poly_1", 1, True), ("sm_poly_2", 1, True), ("sm_exp", 1, True), ("sm_power", 1, True)])
def test_sadf_models(spark, model, lags, constant):
    price = np.exp(np.cumsum(RNG.normal(0.01, 0.05, 60)) + 1)
    log = np.log(price)
    d = np.diff(log)
    rows = range(lags, len(d))
    level = price if model == "sm_poly_1" else log
    x, y = [], []
    for k, i in enumerate(rows):
        trends = {"linear": [k], "quadratic": [k**2], "sm_poly_1": [k**2, k], "sm_poly_2": [k**2, k], "sm_exp": [k], "sm_power": [math.log(k) if k else math.nan]}[model]
        if model.startswith("sm_"):
            x.append([trends[0], 1.0, *trends[1:]])
            y.append(level[i + 1])
        else:
            x.append([log[i], *(d[i - j] for j in range(1, lags + 1)), *trends, *([1.0] if constant else [])])
            y.append(d[i])
    x, y, want = np.array(x, float), np.array(y), {}
    for end in range(30, len(y)):
        best = []
        for start in range(end + 1 - 30 + 1):
            a, b = x[start : end + 1], y[start : end + 1]
            if np.isfinite(a).all():
                q, r = np.linalg.qr(a)
                beta = np.linalg.solve(r, q.T @ b)
                inverse = np.linalg.inv(r)
                best.append(beta[0] / math.sqrt(((b - a @ beta) ** 2).sum() / (len(b) - a.shape[1]) * (inverse[0] @ inverse[0])))
        want[DAYS[end + lags + 1]] = max(best)
    got = {r.date: r.sadf for r in breaks.sadf(series(spark, price), model, lags, constant, least=30, block=9).collect()}
    assert got == pytest.approx(want, rel=1e-4)


def test_bde_cusum(spark):
    x = RNG.normal(0.1, 1, 80)
    delta = np.median(x)
    sums, rises = [0.0] * 3, [0.0] * 3
    got = breaks.bde_cusum(series(spark, x, "ret")).orderBy("date").collect()
    for k, row in enumerate(got):
        mean, var = (x[: k + 1].mean(), x[: k + 1].var()) if k else (0.0, 1.0)
        steps = [delta / var * (x[k] - mean - delta / 2), abs(delta) / var * (x[k] - mean - abs(delta) / 2), -abs(delta) / var * (x[k] - mean + abs(delta) / 2)]
        sums, rises = [s + v for s, v in zip(sums, steps)], [max(r + v, 0) for r, v in zip(rises, steps)]
        assert (row.s, row.g, row.up, row.down) == pytest.approx((sums[0], *rises), abs=1e-9)


def test_johansen(spark):
    """Two series that share a trend have rank 1, two walks of their own rank 0."""
    rows = []
    for b in (0, 1):
        walk = np.cumsum(RNG.normal(0, 0.02, 400))
        own = RNG.normal(0, 0.005, 400) if b else np.cumsum(RNG.normal(0, 0.02, 400)) - walk
        rows += [(b, 2 * b, DAYS[i], float(np.exp(3 + walk[i]))) for i in range(400)] + [(b, 2 * b + 1, DAYS[i], float(np.exp(3 + walk[i] + own[i]))) for i in range(400)]
    got = breaks.johansen(spark.createDataFrame(rows, "sector int, ticker int, date date, close double"), "sector").collect()
    assert len(got) == 4 and {r.trace_rank for r in got if r.basket} <= {1, 2} and {r.trace_rank for r in got if not r.basket} == {0}
    assert all(r.trace == pytest.approx(sum(s.eigen for s in got if s.basket == r.basket and s.r >= r.r)) for r in got)


def test_ffd_search(spark):
    price = np.exp(np.cumsum(RNG.normal(0, 0.02, 400)) + 3)
    got = sorted(breaks.ffd_search(series(spark, price), 4).collect(), key=lambda r: r.d)
    assert [r.d for r in got] == [0, 0.25, 0.5, 0.75, 1] and got[0].corr == pytest.approx(1) and got[-1].adf < got[-1].critical < -2.8
    best = [r.d for r in got if r.adf < r.critical][0]
    assert [r.d for r in got if r.optimal] == [best]
    d = np.diff(np.log(price))
    a, b = np.column_stack([d[1:-1], np.diff(d)[:-1], np.ones(len(d) - 2)]), np.diff(d)[1:]
    beta, rest, _, _ = np.linalg.lstsq(a, b, rcond=None)
    assert got[-1].adf == pytest.approx(beta[0] / math.sqrt(rest[0] / (len(b) - 3) * np.linalg.inv(a.T @ a)[0, 0]))


def test_hurst_estimators(spark):
    x = RNG.normal(size=130)

    def dfa(v):
        y, sizes, f = np.cumsum(v - v.mean()), [], []
        for s in sorted({int(k) for k in np.logspace(1, np.log10(len(v) // 4), 30)}):
            off = [y[i * s : i * s + s] - np.polyval(np.polyfit(range(s), y[i * s : i * s + s], 1), range(s)) for i in range(len(v) // s)]
            sizes.append(s)
            f.append(math.sqrt(np.mean(np.square(off))))
        return np.polyfit(np.log(sizes), np.log(f), 1, w=np.sqrt(sizes))[0]

    def aggvar(v):
        return (np.polyfit(np.log(range(1, 21)), [math.log(np.var([np.mean(v[i * k : i * k + k]) for i in range(len(v) // k)])) for k in range(1, 21)], 1)[0] + 2) / 2

    def higuchi(v):
        lengths = []
        for k in range(1, 21):
            total = 0.0
            for m in range(k):
                sub = v[m::k]
                total += sum(abs(b - a) for a, b in zip(sub[:-1], sub[1:])) * (len(v) - 1) / (k * len(sub) * k)
            lengths.append(total / k)
        return np.polyfit(np.log(range(1, 21)), np.log(lengths), 1)[0]

    for name, one in (("dfa", dfa), ("aggvar", aggvar), ("higuchi", higuchi)):
        got = [r.hurst for r in statistics.rolling_hurst(series(spark, x, "ret"), 120, 5, name).orderBy("date").collect()]
        assert got == pytest.approx([one(x[i : i + 120]) for i in (0, 5, 10)]), name
    assert statistics.rolling_hurst(series(spark, [1.0] * 130, "ret"), 120, 5, "dfa").where("hurst IS NOT NULL").count() == 0


def test_konto():
    def slow(s, window):
        n, total = len(s), 0.0
        if window:
            window = min(window, n // 2)
        points = list(range(window, n - window + 1) if window else range(1, n // 2 + 1))
        for i in points:
            back, best = window or i, 0
            for length in range(1, back + 1):
                word = s[i : i + length]
                if len(word) == length and any(s[j : j + length] == word for j in range(i - back, i)):
                    best = length
            total += math.log2(back + 1) / (best + 1)
        return total / len(points)

    for word in ("abababababab", "aabbabab", "".join(RNG.choice(list("ab"), 60))):
        for window in (0, 4):
            assert statistics.konto(word, window) == pytest.approx(slow(word, window)), (word, window)
    assert statistics.konto("", 0) == 0


def test_continuous_entropy_and_js(spark):
    x = RNG.normal(size=90)
    got = [r.entropy for r in statistics.continuous_entropy(series(spark, x, "ret"), 30).orderBy("date").collect()]
    z = (8 + 324 * 90 + 12 * math.sqrt(36 * 90 + 729 * 90**2)) ** (1 / 3)
    bins, want = round(z / 6 + 2 / (3 * z) + 1 / 3), []
    for i in range(30, 90):
        p = np.histogram(x[i - 30 : i], bins)[0] / 30
        want.append(-sum(v * math.log(v) for v in p if v))
    assert got == pytest.approx(want)
    y = RNG.normal(1, 2, 90)
    both = series(spark, x, "ret").unionByName(series(spark, y, "ret", "b"))
    grid = np.linspace(min(x.min(), y.min()), max(x.max(), y.max()), 90)
    p, q = (np.array([np.mean([math.exp(-(((g - v) / (s.std(ddof=1) * 90**-0.2)) ** 2) / 2) for v in s]) / (s.std(ddof=1) * 90**-0.2 * math.sqrt(2 * math.pi)) for g in grid]) for s in (x, y))
    m = (p + q) / 2
    (row,) = statistics.js_divergence(both, size=1).collect()
    assert (row.a, row.b) == ("a", "b") and row.js == pytest.approx(0.5 * sum(p * np.log(p / m)) + 0.5 * sum(q * np.log(q / m)))
