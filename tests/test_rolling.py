"""Rolling primitives, factors and joins against pandas and hand-made values."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.rolling import Frame, where
from tickloom.operators import bars, breaks, fundamentals, joins, labels, statistics


def series(spark, values, ticker="a"):
    rows = [(ticker, dt.date(2020, 1, 1) + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ticker string, date date, x double")


def run(df, make):
    f = Frame(["x"])
    out = make(f, f["x"])
    return [r.y for r in f.apply(df, {"y": out}, digits=6).orderBy("date").collect()]


def test_windows_are_null_until_full_and_where_a_value_is_missing(spark):
    df = series(spark, [3, 1, 3, 2, 3, None, 2])
    assert run(df, lambda f, x: f.sum(x, 3)) == [None, None, 7, 6, 8, None, None]
    assert run(df, lambda f, x: f.ts_rank(x, 3)) == [None, None, 2.5, 2, 2.5, None, None]
    assert run(df, lambda f, x: f.argmax(x, 3)) == [None, None, 1, 2, 1, None, None]
    assert run(df, lambda f, x: f.argmin(x, 3)) == [None, None, 2, 1, 2, None, None]


def test_rank_over_history_averages_ties(spark):
    values = [3, 1, 3, 2, None]
    want = pd.Series(values, dtype=float).rank(pct=True).round(6).where(lambda s: s.notna(), None).tolist()
    got = run(series(spark, values), lambda f, x: f.rank(x))
    assert [None if w is None or w != w else w for w in want] == got


def test_constant_series_raises_nothing(spark):
    df = series(spark, [5] * 10)
    assert set(run(df, lambda f, x: f.corr(x, x, 4))) == {None}
    assert set(run(df, lambda f, x: (x - f.mean(x, 4)) / f.std(x, 4))) == {None}


def test_decay_keeps_the_first_rows(spark):
    assert run(series(spark, [1, 2, 3, 4]), lambda f, x: f.decay(x, 3)) == [1, 2, pytest.approx(14 / 6, abs=1e-6), pytest.approx(20 / 6, abs=1e-6)]


def test_against_pandas(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=60).round(3)
    s, t = pd.Series(values), pd.Series(np.arange(1.0, 61))
    df = series(spark, values)
    for make, want in (
        (lambda f, x: f.std(x, 5), s.rolling(5).std()),
        (lambda f, x: f.corr(x, f.row_number(), 7), s.rolling(7).corr(t)),
        (lambda f, x: f.ewm(x, 0.5), s.ewm(alpha=0.5, adjust=False).mean()),
        (lambda f, x: f.beta_sequence(x, 6), s.rolling(6).apply(lambda w: (w * np.arange(1, 7)).sum() / 91)),
        (lambda f, x: f.ewm(x, 0.5, 4), s.ewm(alpha=0.5, adjust=False, min_periods=4).mean()),
        (lambda f, x: f.slope(x, 6), s.rolling(6).apply(lambda w: np.polyfit(np.arange(6), w, 1)[0])),
        (lambda f, x: f.ts_rank(x, 9), s.rolling(9).apply(lambda w: pd.Series(w).rank().iloc[-1])),
        (lambda f, x: f.scale(x), s / s.abs().sum()),
    ):
        got = pd.Series(run(df, make), dtype=float)
        assert np.allclose(got, want, atol=2e-6, equal_nan=True)


def test_where_and_division(spark):
    assert run(series(spark, [0, 2]), lambda f, x: 1.0 / x) == [None, 0.5]
    assert run(series(spark, [-1, 2]), lambda f, x: where(x > 0.0, x, 0.0 * x)) == [0, 2]


def test_asof(spark):
    day = lambda n: dt.date(2020, 1, n)
    left = spark.createDataFrame([("a", day(1)), ("a", day(5)), ("a", day(9)), ("b", day(3))], "ticker string, date date")
    right = spark.createDataFrame([("a", day(2), 1.0), ("a", day(8), 2.0)], "ticker string, at date, v double")
    for direction, want in (("backward", [None, 1.0, 2.0, None]), ("forward", [1.0, 2.0, None, None]), ("nearest", [1.0, 1.0, 2.0, None])):
        got = joins.asof(left, right, "ticker", "date", "at", direction).orderBy("ticker", "date").collect()
        assert [r.v for r in got] == want, direction


def test_threshold_bars_start_from_zero():
    ids, closes = bars.ThresholdBars(10).feed(np.array([4.0] * 6))
    assert ids.tolist() == [0, 0, 0, 1, 1, 1] and np.flatnonzero(closes).tolist() == [2, 5]
    assert np.flatnonzero(bars.ThresholdBars(10).feed(np.array([4.0] * 5))[1]).tolist() == [2]


def test_tick_rule(spark):
    rows = [("s", dt.datetime(2020, 1, 1, 0, 0, i), i, p, 1.0) for i, p in enumerate([10.0, 10.0, 11.0, 11.0, 10.0])]
    got = bars.tick_rule(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq long, price double, volume double")).orderBy("seq").collect()
    assert [r.side for r in got] == [0, 0, 1, 1, -1]


def test_cusum():
    assert list(labels.cusum_steps([1, 1, 1, -4], 2)) == [False, False, True, True]


def at(n):
    return dt.datetime(2020, 1, n)


def test_concurrency_and_uniqueness(spark):
    price = spark.createDataFrame([("s", at(i), float(i)) for i in range(1, 7)], "symbol string, ts timestamp_ntz, close double")
    events = spark.createDataFrame([("s", at(1), at(3)), ("s", at(2), at(5)), ("s", at(6), at(6))], "symbol string, t0 timestamp_ntz, t1 timestamp_ntz")
    assert [r.c for r in labels.concurrency(price, events).orderBy("ts").collect()] == [1, 2, 2, 1, 1, 1]
    got = [r.uniqueness for r in labels.average_uniqueness(price, events).orderBy("t0").collect()]
    assert got == pytest.approx([2 / 3, 3 / 4, 1])
    folds = labels.purged_folds(events, 3).collect()
    test = {r.fold: r for r in folds if r.role == "test"}
    assert all(not (r.t0 <= test[r.fold].t1 and test[r.fold].t0 <= r.t1) for r in folds if r.role == "train")


def test_triple_barrier(spark):
    price = spark.createDataFrame([("s", at(i + 1), p, 0.1) for i, p in enumerate([100.0, 105.0, 125.0, 80.0])], "symbol string, ts timestamp_ntz, close double, trgt double")
    got = {r.t0: (r.t1, r.bin) for r in labels.triple_barrier(price, 3, 2.0, 1.0).collect()}
    assert got[at(1)] == (at(3), 1) and got[at(3)] == (at(4), -1)


def test_quarterise(spark):
    df = spark.createDataFrame([("a", f"2020/Q{q}", v) for q, v in enumerate([10.0, 25.0, 45.0, 70.0], 1)], "ticker string, report_name string, x double")
    assert [r.x for r in fundamentals.quarterise(df, ["x"]).orderBy("report_name").collect()] == [10, 15, 20, 25]


def test_normal_distribution(spark):
    got = spark.range(1, 100).select((F.col("id") / 100).alias("p")).select("p", statistics.norm_cdf(statistics.norm_ppf(F.col("p"))).alias("q")).collect()
    assert all(abs(r.p - r.q) < 1e-5 for r in got)


def test_sadf_has_every_end_point(spark):
    rng = np.random.default_rng(2)
    y = np.cumsum(rng.normal(size=75)) / 50 + 3
    got = {r.date: r.sadf for r in breaks.sadf(series(spark, np.exp(y)).withColumnRenamed("x", "close"), block=7).collect()}
    want = {}
    for end in range(41, 75):
        best = -np.inf
        for start in range(end - 40 + 1):
            lag, d = y[start:end], np.diff(y[start : end + 1])
            x = np.stack([lag, np.ones_like(lag)], 1)
            inv = np.linalg.inv(x.T @ x)
            b = inv @ x.T @ d
            best = max(best, b[0] / np.sqrt(((d - x @ b) ** 2).sum() / (len(d) - 2) * inv[0, 0]))
        want[dt.date(2020, 1, 1) + dt.timedelta(days=end)] = best
    assert got == pytest.approx(want, rel=1e-5)


def test_hurst_of_every_window_over_all_lags(spark):
    x = np.random.default_rng(3).normal(size=135)
    got = [r.hurst for r in statistics.rolling_hurst(series(spark, [None, *x]).withColumnRenamed("x", "ret")).orderBy("date").collect()]

    def one(v):
        rs = []
        for n in range(2, 20):
            c = v[: len(v) // n * n].reshape(-1, n)
            d = np.cumsum(c - c.mean(1)[:, None], 1)
            rs.append((np.ptp(d, axis=1) / c.std(1)).mean())
        return np.polyfit(np.log(range(2, 20)), np.log(rs), 1)[0]

    assert got == pytest.approx([one(x[i : i + 128]) for i in range(8)])


def test_bootstrap_draws_as_many_as_there_are_labels(spark):
    spans = spark.createDataFrame([(s, i, i + 3) for s, n in (("a", 70), ("b", 9)) for i in range(n)], "symbol string, i0 int, i1 int")
    got = breaks.sequential_bootstrap(spans).groupBy("symbol").count().collect()
    assert {r.symbol: r["count"] for r in got} == {"a": 70, "b": 9}


def test_every_registered_query_has_a_callable():
    from tickloom.plans import catalog

    assert "factor_panel" in catalog.QUERIES and all(map(callable, catalog.QUERIES.values())) and set(catalog.SQL) <= set(catalog.QUERIES)
