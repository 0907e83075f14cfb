"""Position machines, fingerprints, the sweep purge and small scores against plain loops."""

import datetime as dt
import itertools
import random
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from tickloom.operators import bars, fingerprint as fp, joins, panel, portfolio, reversion as rv, statistics as st, validation as v

DAY = dt.date(2020, 1, 1)


def walk(n=260, seed=1, size=0.02):
    rng = np.random.default_rng(seed)
    return 100 * np.exp(np.cumsum(rng.normal(0, size, n)))


@pytest.fixture(scope="module")
def prices(spark):
    table = {f"t{k}": walk(seed=k) for k in range(3)}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "41")  # keys over several batches
    yield spark.createDataFrame([(k, DAY + dt.timedelta(days=i), float(p)) for k, ps in table.items() for i, p in enumerate(ps)], "ticker string, date date, close double").cache(), table
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def placed(df):
    out = {}
    for r in df.orderBy("ticker", "date").collect():
        out.setdefault(r.ticker, []).append(r.position)
    return out


def loop(signals, leave, hold):
    position, entry, held, out = 0.0, 0.0, 0, [0.0]
    for i in range(1, len(signals)):
        if position:
            held += 1
            if held >= hold:
                position, held = 0.0, 0
            else:
                position = leave(i, position, entry)
                held = held if position else 0
        if not position and signals[i]:
            position, entry, held = float(signals[i]), i, 0
        out.append(position)
    return out


@pytest.mark.parametrize(("partial", "stop"), [(False, 3.0), (True, 0.5)])
def test_band_positions(prices, partial, stop):
    df, table = prices
    got = placed(rv.band_positions(df, 20, 1.2, 6, partial, stop))
    for k, p in table.items():
        s = pd.Series(p)
        mean, dev = s.rolling(20).mean(), s.rolling(20).std()
        signals = np.where(s < mean - 1.2 * dev, 1, np.where(s > mean + 1.2 * dev, -1, 0))

        def leave(i, position, entry, s=s, mean=mean, dev=dev):
            if partial and ((position > 0 and s[i] >= mean[i]) or (position < 0 and s[i] <= mean[i])):
                return position / 2
            if (position > 0 and s[i] < s[entry] - stop * dev[i]) or (position < 0 and s[i] > s[entry] + stop * dev[i]):
                return 0.0
            return position

        assert got[k] == loop(signals, leave, 6)
        assert {1.0, -1.0} <= set(got[k]) and (0.5 in map(abs, got[k])) == partial


def test_rsi_positions(prices):
    df, table = prices
    got = placed(rv.rsi_positions(df, 14, 60, 40, 7, 0.03))
    for k, p in table.items():
        s = pd.Series(p)
        d = s.diff()
        up, down = d.clip(lower=0).rolling(14).mean(), (-d).clip(lower=0).rolling(14).mean()
        rsi = 100 - 100 / (1 + up / down)
        signals = np.where(rsi < 40, 1, np.where(rsi > 60, -1, 0))

        def leave(i, position, entry, s=s, rsi=rsi):
            if position > 0:
                return 0.0 if s[i] < s[entry] * 0.97 or rsi[i] > 50 else position
            return 0.0 if s[i] > s[entry] * 1.03 or rsi[i] < 50 else position

        assert got[k] == loop(signals, leave, 7) and {1.0, -1.0} <= set(got[k])


def test_hurst_positions(spark, prices):
    df, table = prices
    rng = random.Random(4)
    h = {k: [rng.random() if i > 30 else None for i in range(len(p))] for k, p in table.items()}
    hurst = spark.createDataFrame([(k, DAY + dt.timedelta(days=i), x) for k, hs in h.items() for i, x in enumerate(hs)], "ticker string, date date, hurst double")
    got = placed(rv.hurst_positions(df, hurst.where("hurst IS NOT NULL"), 0.5, 20, 1.0, 4))
    for k, p in table.items():
        s = pd.Series(p)
        mean, dev = s.rolling(20).mean(), s.rolling(20).std()
        low = np.array([x is not None and x < 0.5 for x in h[k]])
        signals = np.where(low & (s < mean - dev), 1, np.where(low & (s > mean + dev), -1, 0))
        assert got[k] == loop(signals, lambda i, position, entry: position, 4) and {1.0, -1.0} <= set(got[k])


def test_term_structure(spark):
    front, back = walk(300, 7), walk(300, 8)
    make = lambda p: spark.createDataFrame([("c", DAY + dt.timedelta(days=i), float(x)) for i, x in enumerate(p)], "ticker string, date date, close double")
    got = rv.term_structure(make(front), make(back), 30, 1.2, 9, 0.8).orderBy("date").collect()
    ratio = pd.Series(back / front)
    z = (ratio - ratio.rolling(30).mean()) / ratio.rolling(30).std()
    want, position, entry, held = [], 0, 0.0, 0
    for i in range(300):
        if i >= 30 and position:
            held += 1
            if (position == 1 and z[i] < entry - 0.8) or (position == -1 and z[i] > entry + 0.8) or held >= 9:
                position = 0
        elif i >= 30 and abs(z[i]) > 1.2:
            position, entry, held = int(np.sign(z[i])), z[i], 0
        want.append(float(position))
    assert [r.position for r in got] == want and set(want) == {-1.0, 0.0, 1.0}
    change = pd.Series(front).pct_change() - pd.Series(back).pct_change()
    held = pd.Series(want).shift(1) * change
    assert [r.strategy_return for r in got][1:] == pytest.approx(list(held[1:]))


def known_function(spark, n=400):
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, (n, 4))
    y = 2 * x[:, 0] + 3 * np.abs(x[:, 1]) + 4 * (x[:, 2] > 0) * (x[:, 0] > 0)
    return spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, idle double, label double")


def test_fingerprint_recovers_a_known_function(spark):
    df = known_function(spark)
    names = ["a", "b", "c", "idle"]
    tree = DecisionTreeRegressor(maxDepth=8, labelCol="label", featuresCol="features").fit(v.assembled(df, names))
    got = {(r.effect, r.feature): r for r in fp.fingerprint(df, tree, names, [("a", "c"), ("b", "idle")], 15, "prediction").collect()}
    linear, bent = ({f: got[e, f].raw for f in names} for e in ("linear", "non-linear"))
    assert linear["a"] > 3 * linear["b"] and linear["a"] > 10 * linear["idle"]
    assert bent["b"] > bent["a"] / 2 and bent["b"] > 10 * bent["idle"]
    assert got["pair", "a, c"].share > 0.8
    for effect in ("linear", "non-linear", "pair"):
        assert sum(r.share for k, r in got.items() if k[0] == effect) == pytest.approx(1)


def test_fingerprint_equals_a_loop(spark):
    df = known_function(spark, 60)
    names = ["a", "b"]
    line = LinearRegression(labelCol="label", featuresCol="features").fit(v.assembled(df, names))
    got = {(r.effect, r.feature): r.raw for r in fp.fingerprint(df, line, names, [("a", "b")], 7, "prediction").collect()}
    values = fp.quantiles(df, names, 7)
    rows = df.toPandas()
    for f in names:
        exact = np.quantile(rows[f], np.linspace(0, 1, 7))
        assert np.allclose(values[f], exact, atol=0.1)
        x = np.array(values[f])
        w = line.coefficients[names.index(f)]
        assert got["linear", f] == pytest.approx(np.abs(w * (x - x.mean())).mean()) and got["non-linear", f] == pytest.approx(0, abs=1e-9)
    assert got["pair", "a, b"] == pytest.approx(0, abs=1e-9)
    chance = LogisticRegression(labelCol="label", featuresCol="features").fit(v.assembled(df.withColumn("label", (F.col("label") > 2).cast("double")), names))
    curve = fp.dependence(df, chance, names, values)
    x = rows[names].to_numpy()
    for f, i in itertools.product(names, range(7)):
        moved = x.copy()
        moved[:, names.index(f)] = values[f][i]
        p = 1 / (1 + np.exp(-(moved @ np.array(chance.coefficients) + chance.intercept)))
        assert curve[(curve["a"] == f) & (curve["i"] == i)]["mean"].iloc[0] == pytest.approx(p.mean())


def test_purge_by_symbol_equals_all_pairs(spark):
    rng = random.Random(3)
    spans = lambda n: [(rng.choice("ab"), a, a + rng.randint(0, 6)) for a in (rng.randint(0, 80) for _ in range(n))]
    train, test = [*spans(120), ("a", None, 3), ("a", 5, 5), ("a", 5, 5)], spans(9)
    kind = "symbol string, t0 int, t1 int"
    got = sorted(map(repr, map(tuple, joins.purge(spark.createDataFrame(train, kind), spark.createDataFrame(test, kind)).collect())))
    free = lambda r, same: r[1] is None or not any((not same or t[0] == r[0]) and t[1] <= r[2] and r[1] <= t[2] for t in test)
    assert got == sorted(repr(r) for r in train if free(r, True)) and len(got) < len(train)
    whole = joins.purge(spark.createDataFrame(train, kind), spark.createDataFrame(test, kind), by=None)
    assert sorted(map(repr, map(tuple, whole.collect()))) == sorted(repr(r) for r in train if free(r, False))
    none = spark.createDataFrame([], kind)
    assert joins.purge(spark.createDataFrame(train, kind), none).count() == len(train) and joins.purge(none, none).count() == 0


def test_best_asset_of_named_tickers(spark):
    rows = [(k, DAY + dt.timedelta(days=i), float(p)) for k, ps in {"MSFT": [1, 2, 2], "AAPL": [2, 4, 1], "X": [5, 5, 50]}.items() for i, p in enumerate(ps)]
    got = [(r.ticker, r.momentum) for r in portfolio.best_asset(spark.createDataFrame(rows, "ticker string, date date, close double"), 1).orderBy("date").collect()]
    assert got == [("AAPL", 1.0), ("X", 9.0)]


def test_zero_columns_and_small_scores(spark):
    df = spark.createDataFrame([(1, 0.0, True, False, None, -1.0), (2, 0.0, False, False, None, 0.0)], "k int, nought double, some boolean, never boolean, empty double, neg double")
    made = panel.drop_zero_columns(df, ["nought", "some", "never", "empty", "neg"])
    assert made.columns == ["k", "some", "neg"] and [r.some for r in made.orderBy("k").collect()] == [1, 0]
    assert panel.drop_zero_columns(df.limit(0), ["nought"]).columns == ["k", "some", "never", "empty", "neg"]
    rows = [("g", 1, 0.9), ("g", 0, 0.8), ("g", 1, 0.8), ("g", 0, 0.1), ("one", 1, 0.5)]
    got = {r.k: r for r in st.classification_scores(spark.createDataFrame(rows, "k string, label int, p double"), ["k"]).collect()}
    assert got["g"].auc == pytest.approx((2 + 1.5) / 4) and got["g"].profit == 200 and got["g"].weighted_accuracy == pytest.approx((0.4 + 0.3 + 0.4) / 1.4)
    assert got["one"].auc is None and got["one"].weighted_accuracy == 0 and got["one"].profit == -100
    sizes = spark.createDataFrame([(float(x),) for x in (-0.4, -0.1, 0.0, 0.2, 1.0)], "c double").select("c", st.bet_mixture(F.col("c"), (0.1, -0.2), (0.3, 0.5), 0.6).alias("m")).collect()
    law = lambda x: 0.6 * NormalDist(0.1, 0.3).cdf(x) + 0.4 * NormalDist(-0.2, 0.5).cdf(x)
    for r in sizes:
        assert r.m == pytest.approx((law(r.c) - law(0)) / ((1 - law(0)) if r.c >= 0 else law(0)), abs=1e-6)
    months = spark.createDataFrame([("a", DAY + dt.timedelta(days=31 * (i % 3))) for i in range(9)] + [("b", DAY)], "symbol string, t0 date")
    assert {r.symbol: (r.months, r.concentration) for r in st.month_concentration(months).collect()} == {"a": (3, pytest.approx(0)), "b": (1, None)}


def test_depth_by_interval(spark):
    start = dt.datetime(2024, 1, 1)
    ticks = spark.createDataFrame([("s", start + dt.timedelta(seconds=i), i, p, 1.0 + i) for i, p in enumerate([5.0, 6.0, 6.0, 5.0, 4.0, 4.0])], "symbol string, ts timestamp_ntz, seq long, price double, volume double")
    got = [(r.bid, r.ask) for r in bars.depth_by_interval(ticks, 3).orderBy("start").collect()]
    assert got == [(0.0, 5.0), (15.0, 0.0)]
