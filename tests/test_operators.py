"""Recurrences, readers and writers held against brute force, and skewed ticks."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars, breaks, fundamentals, joins, labels, panel, portfolio, statistics
from tickloom.sources import io


def series(spark, values, name="close"):
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"ticker string, date date, {name} double")


def column(df, name):
    return [getattr(r, name) for r in df.orderBy("date").collect()]


PRICES = np.exp(np.cumsum(np.random.default_rng(5).normal(0, 0.03, 90)) + 3)


@pytest.mark.parametrize("two_sided", [False, True])
def test_csw(spark, two_sided):
    y = np.log(PRICES)
    want = {}
    for t in range(2, len(y)):
        var = (np.diff(y[: t + 1]) ** 2).sum() / (t - 1)
        options = [((abs(y[t] - y[k]) if two_sided else y[t] - y[k]) / (var * math.sqrt(t - k)), math.sqrt(4.6 + math.log(t - k))) for k in range(t)]
        want[t] = max(options, key=lambda o: o[0])
    got = breaks.csw_cusum(series(spark, PRICES), two_sided=two_sided).orderBy("date").collect()
    assert {t: (got[t].stat, got[t].critical) for t in want} == {t: pytest.approx(w) for t, w in want.items()}


def test_kalman(spark):
    """Against the same filter and smoother solved as one least-squares problem."""
    z, q, r = PRICES[:25], 1e-3, 1.0
    n = len(z)
    f, noise = np.array([[1.0, 1.0], [0.0, 1.0]]), q * np.array([[0.25, 0.5], [0.5, 1.0]])
    # States 0..n (0 is the start); the noise has rank one: x[k+1] = F x[k] + g w.
    g = np.array([0.5, 1.0])
    assert np.allclose(np.outer(g, g) * q, noise)
    steps = [np.linalg.matrix_power(f, k) for k in range(n + 1)]

    def level(upto, at):
        """Mean of the level at a step, given the first observations."""
        a = np.zeros((upto, 2 + n))
        for k in range(1, upto + 1):
            a[k - 1, :2] = steps[k][0]
            for j in range(k):
                a[k - 1, 2 + j] = (steps[k - 1 - j] @ g)[0]
        mean, cov = np.r_[0.0, 1.0, np.zeros(n)], np.diag(np.r_[10.0, 10.0, np.full(n, q)])
        gain = cov @ a.T @ np.linalg.inv(a @ cov @ a.T + r * np.eye(upto))
        x = mean + gain @ (z[:upto] - a @ mean)
        row = np.r_[steps[at][0], [(steps[at - 1 - j] @ g)[0] if j < at else 0.0 for j in range(n)]]
        return row @ x

    got = breaks.kalman(series(spark, z)).orderBy("date").collect()
    assert [x.level for x in got] == pytest.approx([level(k, k) for k in range(1, n + 1)])
    assert [x.smooth for x in got] == pytest.approx([level(n, k) for k in range(1, n + 1)])


def test_dynamic_zscore(spark):
    y = PRICES.copy()
    y[50] *= 3
    lag, filtered, signals = 30, list(y), [0] * len(y)
    mean, dev = np.mean(y[:lag]), np.std(y[:lag])
    for i in range(lag + 1, len(y)):
        if abs(y[i] - mean) > 3 * dev:
            signals[i] = 1 if y[i] > mean else -1
            filtered[i] = 0.5 * y[i] + 0.5 * filtered[i - 1]
        mean, dev = np.mean(filtered[i - lag : i]), np.std(filtered[i - lag : i])
    assert column(breaks.dynamic_zscore(series(spark, y)), "signal") == signals and signals[50] == 1


def test_fractional_differences(spark):
    y, d = np.log(PRICES), 0.4
    w = [1.0]
    for k in range(1, len(y)):
        w.append(-w[-1] * (d - k + 1) / k)
    width = next(k for k, x in enumerate(w) if abs(x) < 1e-2)
    fixed = [None if t + 1 < width else sum(w[k] * y[t - k] for k in range(width)) for t in range(len(y))]
    got = column(breaks.fracdiff(series(spark, PRICES), d, 1e-2), "fracdiff")
    assert [g is None or g != g for g in got] == [x is None for x in fixed]
    assert [g for g, x in zip(got, fixed, strict=True) if x is not None] == pytest.approx([x for x in fixed if x is not None])
    got = column(breaks.fracdiff_expanding(series(spark, PRICES), d, 0.5), "fracdiff")
    known = [t for t, g in enumerate(got) if g is not None and g == g]
    assert 0 < len(known) < len(y) and [got[t] for t in known] == pytest.approx([sum(w[k] * y[t - k] for k in range(t + 1)) for t in known])


def test_daily_volatility(spark):
    rows = [("a", dt.datetime(2020, 1, 1) + dt.timedelta(hours=9 * i), float(p)) for i, p in enumerate(PRICES)]
    got = {r.ts: r.trgt for r in labels.daily_volatility(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double"), 10).collect()}
    times, closes = [r[1] for r in rows], PRICES
    held = []
    for t, c in zip(times, closes, strict=True):
        before = [k for k, u in enumerate(times) if u < t - dt.timedelta(days=1)]
        if before:
            held.append((t, c / closes[before[-1]] - 1))
    a = 2 / 11
    for k, (t, _) in enumerate(held):
        w = np.array([(1 - a) ** (k - j) for j in range(k + 1)])
        r = np.array([x for _, x in held[: k + 1]])
        m = (w * r).sum() / w.sum()
        bias = 1 - (w**2).sum() / w.sum() ** 2
        if k:
            assert got[t] == pytest.approx(math.sqrt((w * (r - m) ** 2).sum() / w.sum() / bias))
    assert len(got) == len(held)


def test_holding_period(spark):
    df = series(spark, [0, 1, 1, 0, -1, 1, 1, 0], "position")
    # Held two days, then one, then two.
    assert portfolio.holding_period(df).first().days == pytest.approx(5 / 3)


def test_imbalance_and_run_bars():
    signed = np.array([1.0, 1, 1, -1, 1, 1, 1, 1, 1, 1])

    def mean_of(v):
        w = 0.5 ** np.arange(len(v) - 1, -1, -1)
        return (v * w).sum() / w.sum()

    # After three ticks the expected imbalance is known; a bar closes when the sum exceeds three times it.
    ids, theta, expected, start, k = [-1] * 10, 0.0, None, 0, 0
    for i in range(10):
        theta += signed[i]
        if expected is None and i + 1 >= 3:
            expected = mean_of(signed[max(0, i - 2) : i + 1])
        if expected is not None and abs(theta) > 3 * abs(expected):
            ids[start : i + 1] = [k] * (i + 1 - start)
            expected = mean_of(signed[max(0, i - 2) : i + 1])
            theta, start, k = 0.0, i + 1, k + 1
    got, closes = bars.ImbalanceBars(3, 3, 3, 1, 100, False).feed(signed)
    assert [b if b < closes.sum() else -1 for b in got.tolist()] == ids
    runs, _ = bars.RunBars(2, 4, 3, 1, 100, False).feed(np.array([1.0, -1] * 3 + [1] * 8))
    assert runs.max() >= 1 and (np.diff(runs) >= 0).all()


@pytest.mark.parametrize("make", [lambda: bars.ThresholdBars(7.0), lambda: bars.ImbalanceBars(5, 20, 3, 2, 50, True), lambda: bars.RunBars(5, 20, 3, 2, 50, True)])
def test_bars_do_not_depend_on_batches(make):
    values = np.random.default_rng(3).integers(-3, 4, 500).astype(float)
    values = np.abs(values) if isinstance(make(), bars.ThresholdBars) else values
    ids, closes = make().feed(values)
    state, parts = make(), []
    for part in np.split(values, [1, 2, 40, 40, 333]):
        parts.append(state.feed(part))
    assert closes.sum() >= 3
    assert np.concatenate([p[0] for p in parts]).tolist() == ids.tolist() and np.concatenate([p[1] for p in parts]).tolist() == closes.tolist()


@pytest.mark.parametrize("reset", ["", "day"])
def test_bars_of_a_hot_symbol(spark, reset):
    """One symbol holds most ticks; batches are short, so that bars cross them."""
    rng = np.random.default_rng(4)
    rows = [("hot" if rng.random() < 0.8 else f"s{rng.integers(3)}", dt.datetime(2020, 1, 1) + dt.timedelta(minutes=i), i, 1.0 + i % 7, float(rng.integers(1, 9))) for i in range(4000)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq long, price double, volume double")
    want, total = {}, {}
    for symbol, ts, _, _, volume in rows:
        key = (symbol, ts.date()) if reset else symbol
        total[key] = total.get(key, 0.0) + volume
        if total[key] >= 50:
            want[symbol] = [*want.get(symbol, []), total.pop(key)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = bars.recurrent_bars(ticks, "threshold", "volume", 50, reset=reset).orderBy("date_time").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {s: [r.volume for r in got if r.symbol == s] for s in want} == want and len(got) == sum(map(len, want.values()))


def test_drop_zero_constant_and_short(spark):
    df = series(spark, [1, 1, 1, 1]).unionByName(series(spark, [1, 2]).withColumn("ticker", F.lit("b")))
    assert {r.ticker for r in panel.enough_rows(df).collect()} == {"a"} and {r.ticker for r in panel.drop_constant(df, "close").collect()} == {"b"}


def test_purge_first_and_upsert(spark):
    spans = spark.createDataFrame([(1, 3), (4, 6), (9, 9)], "t0 int, t1 int")
    test = spark.createDataFrame([(3, 4), (8, 8)], "t0 int, t1 int")
    assert [r.t0 for r in joins.purge(spans, test).collect()] == [9]
    stored, new = spark.createDataFrame([(1, "old")], "k int, v string"), spark.createDataFrame([(1, "new"), (2, "new")], "k int, v string")
    assert {(r.k, r.v) for r in joins.upsert(stored, new, ["k"]).collect()} == {(1, "old"), (2, "new")}
    parts = [spark.createDataFrame([("a", "2020/Q1", 2, 5.0), ("a", "2020/Q1", 1, 7.0)], "ticker string, report_name string, report_date int, x double"), spark.createDataFrame([("a", "2020/Q2", 1, 9.0)], "ticker string, report_name string, report_date int, y double")]
    assert {(r.report_name, r.x, r.y) for r in fundamentals.join_statements(parts).collect()} == {("2020/Q1", 7.0, None), ("2020/Q2", None, 9.0)}


def test_readers_and_writers(spark, tmp_path):
    day = tmp_path / "AAA" / "x"
    day.mkdir(parents=True)
    (day / "daily.csv").write_text("date,open,high,low,close,volume,amount,market_capital,pe,ps,pcf\n2020-01-02,1,2,0.5,1.5,10,15,,1,1,1\n2020-01-03,1,2,0.5,2.5,10,15,7,1,1,1\n")
    read = io.prices(spark, str(tmp_path / "*" / "x" / "daily.csv"), zero=True).orderBy("date").collect()
    assert [(r.ticker, r.close, r.market_capital) for r in read] == [("AAA", 1.5, 0.0), ("AAA", 2.5, 7.0)]
    prices = io.prices(spark, str(tmp_path / "*" / "x" / "daily.csv"))
    assert io.calendar(prices, "AAA", "2020-01-03", "2020-02-01").count() == 1
    io.write_by_ticker(prices.select("ticker", "date", "close"), str(tmp_path / "out"))
    assert io.factor_range(spark, str(tmp_path / "out"), "2020-01-01", "2020-01-02", ["close"]).count() == 1
    io.write_report(prices.select("ticker", "close"), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 2
    (tmp_path / "t.csv").write_text("date_time,price,volume\n2020-01-02 00:00:01,1.5,3\n")
    assert io.ticks(spark, str(tmp_path / "t.csv"), "s").first().price == 1.5
    cells = spark.createDataFrame([("[1.5, 0.2]",), ("--",), ("2",), (None,), ("x",)], "a string")
    assert [r.a for r in io.statement_items(cells, ["a"]).collect()] == [1.5, 0.0, 2.0, 0.0, 0.0]
    names = spark.createDataFrame([("2023FY",), ("2023Q6",), ("2023Q1",)], "n string")
    assert [r.q for r in names.select(io.report_name(F.col("n")).alias("q")).collect()] == ["2023/Q4", "2023/Q2", "2023/Q1"]
    assert [(r.report_name, str(r.report_date)) for r in portfolio.quarters_between(spark, "2020-02-01", "2020-08-01").collect()] == [("2020/Q1", "2020-03-31"), ("2020/Q2", "2020-06-30"), ("2020/Q3", "2020-09-30")]


def test_pairs_do_not_depend_on_blocks(spark):
    """Against pandas and per-pair regressions, with gaps, in blocks of a few keys."""
    rng = np.random.default_rng(9)
    market = np.cumsum(rng.normal(0, 0.02, 60))
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=t), float(np.exp(3 + market[t] + rng.normal(0, 0.01 * (k + 1)))) if rng.random() > 0.1 else None) for k in range(9) for t in range(60)]
    df = spark.createDataFrame(rows, "ticker int, date date, close double")
    wide = pd.DataFrame(rows, columns=["k", "t", "x"]).pivot(index="t", columns="k", values="x").astype(float)
    cov, corr = wide.cov(), wide.corr()
    for size in (2, 100):
        got = {(r.a, r.b): r for r in panel.pair_statistics(df, "close", size=size).collect()}
        assert set(got) == {(a, b) for a in range(9) for b in range(a + 1, 9)}
        for (a, b), r in got.items():
            both = wide[[a, b]].dropna()
            slope, intercept = np.polyfit(both[a], both[b], 1)
            assert r.n == len(both) and (r.cov, r.corr, r.slope, r.intercept) == pytest.approx((cov.loc[a, b], corr.loc[a, b], slope, intercept))
        pairs = {(r.a, r.b): r for r in statistics.coint_statistics(df, size=size).collect()}
        assert set(pairs) == set(got)
        for (a, b), r in pairs.items():
            both = np.log(wide[[a, b]].dropna())
            beta, alpha = np.polyfit(both[a], both[b], 1)
            e = (both[b] - alpha - beta * both[a]).to_numpy()
            lag, d = e[:-1], np.diff(e)
            g = lag @ d / (lag @ lag)
            se = math.sqrt(((d - g * lag) ** 2).sum() / (len(d) - 1) / (lag @ lag))
            assert (r.n, r.beta, r.t) == (len(d), pytest.approx(beta), pytest.approx(g / se))
