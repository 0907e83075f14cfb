"""Operators without SQL held against loops written from their definitions."""

import datetime as dt
import math
import random
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.factors import market
from tickloom.functions.rolling import Frame
from tickloom.operators import labels, statistics as st
from tickloom.sources.views import PANEL

DAY = dt.datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def ohlc(spark):
    rng = np.random.default_rng(12)
    n = 120
    close = 80 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    open_ = close * np.exp(rng.normal(0, 0.01, n))
    table = pd.DataFrame({
        "ticker": 1, "date": [DAY.date() + dt.timedelta(days=i) for i in range(n)], "open": open_, "close": close,
        "high": np.maximum(open_, close) * 1.004, "low": np.minimum(open_, close) * 0.996, "volume": rng.integers(100, 999, n).astype(float),
    })
    table["amount"] = table["volume"] * table["close"]
    for c in PANEL:
        if c not in table:
            table[c] = table["close"]
    return table


def ewm(values, alpha):
    """y = alpha x + (1 - alpha) y from the first known value on."""
    out, y = [], math.nan
    for x in values:
        if not math.isnan(x):
            y = x if math.isnan(y) else alpha * x + (1 - alpha) * y
        out.append(y)
    return np.array(out)


def test_recursive_trend_columns(spark, ohlc):
    f = Frame(PANEL)
    made = market.trend_recursive(f)
    got = f.apply(spark.createDataFrame(ohlc), made).toPandas().sort_values("date").reset_index(drop=True)
    c, h, l, p = ohlc["close"], ohlc["high"], ohlc["low"], np.log(ohlc["close"])
    d = c.diff()
    up, down = ewm(d.clip(lower=0).where(d.notna()), 1 / 14), ewm((-d).clip(lower=0).where(d.notna()), 1 / 14)
    tr = pd.concat([h - l, (h - c.shift()).abs(), (l - c.shift()).abs()], axis=1).max(axis=1).where(c.shift().notna())
    rise, fall = h.diff(), -l.diff()
    plus = ewm(pd.Series(np.where((rise > fall) & (rise > 0), rise, 0.0)).where(rise.notna()), 1 / 14)
    minus = ewm(pd.Series(np.where((fall > rise) & (fall > 0), fall, 0.0)).where(rise.notna()), 1 / 14)
    want = {
        "rsi": 100 - 100 / (1 + up / down), "atr": ewm(tr, 1 / 14), "trend_ewma": ewm(p.diff() / p.diff().rolling(20).std(), 2 / 21),
        "trend_adx": ewm(pd.Series(100 * np.abs(plus - minus) / (plus + minus)), 1 / 14),
    }
    want |= {f"ewma_diff_{s}_{n}": ewm(p, 2 / (s + 1)) - ewm(p, 2 / (n + 1)) for s, n in ((2, 6), (4, 12), (8, 24))}
    assert set(want) == set(made)
    for name, values in want.items():
        a, b = got[name].to_numpy(float)[25:], np.asarray(values, float)[25:]
        assert np.isfinite(b).all() and np.allclose(a, b, rtol=1e-7), name


def walk(seed, n=60, step=1):
    rng = random.Random(seed)
    price, out = 100.0, []
    for i in range(n):
        price *= 1 + rng.gauss(0, 0.02)
        out.append((DAY + dt.timedelta(days=step * i + rng.choice([0, 0, 1]) * (step > 1)), price))
    return out


BARS = "symbol string, ts timestamp_ntz, close double"


def test_trend_labels(spark):
    table = {s: walk(k) for k, s in enumerate("ab")}
    df = spark.createDataFrame([(s, t, p) for s, rows in table.items() for t, p in rows], BARS)
    got = {(r.symbol, r.ts): r for r in labels.trend_labels(df, (4, 7, 12)).collect()}
    assert len(got) == 2 * 49
    for s, rows in table.items():
        for i in range(49):
            best = (0.0, 0)
            for n in (4, 7, 12):
                y, k = np.array([p for _, p in rows[i : i + n]]), np.arange(n)
                beta, a = np.polyfit(k, y, 1)
                t = beta / math.sqrt(((y - a - beta * k) ** 2).sum() / (n - 2) / ((k - k.mean()) ** 2).sum())
                if abs(t) > abs(best[0]):
                    best = (t, n)
            r = got[s, rows[i][0]]
            assert (r.horizon, r.label, r.t1) == (best[1], int(np.sign(best[0])), rows[i + best[1] - 1][0]) and r.t_value == pytest.approx(best[0], rel=1e-6)


@pytest.mark.parametrize(("pt", "sl"), [(2.0, 1.0), (0.0, 1.0), (1.5, 0.0)])
def test_calendar_barriers(spark, pt, sl):
    rows = walk(5, 50, step=2)
    target = [0.01 + 0.02 * (i % 3) for i in range(50)]
    df = spark.createDataFrame([("a", t, p, g) for (t, p), g in zip(rows, target, strict=True)], BARS + ", trgt double")
    got = {r.t0: (r.t1, r.trgt) for r in labels.triple_barrier_days(df, 7, pt, sl, least=0.015, skip=2).collect()}
    want = {}
    for i in range(2, 50):
        t0, p0 = rows[i]
        if target[i] <= 0.015:
            continue
        end = next((t for t, _ in rows if t >= t0 + dt.timedelta(days=7)), None)
        touch = next((t for t, p in rows[i:] if (end is None or t <= end) and ((pt and p / p0 - 1 > pt * target[i]) or (sl and p / p0 - 1 < -sl * target[i]))), None)
        t1 = touch or end
        if t1:
            want[t0] = (t1, target[i])
    assert got == want and len({t1 - t0 for t0, (t1, _) in got.items()}) > 2


def test_vertical_barrier(spark):
    rows = walk(6, 30, step=2)
    df = spark.createDataFrame([("a", t, p) for t, p in rows], BARS)
    got = {r.t0: r.t1 for r in labels.vertical_barrier(df.select("symbol", F.col("ts").alias("t0")), df, 5 * 86_400).collect()}
    assert got == {t0: t1 for t0, _ in rows if (t1 := next((t for t, _ in rows if t >= t0 + dt.timedelta(days=5)), None))}


@pytest.mark.parametrize("embargo", [0.0, 0.1])
def test_purged_folds_of_each_symbol(spark, embargo):
    rng = random.Random(2)
    spans = sorted({("ab"[i % 2], i, i + rng.randint(0, 4)) for i in range(60)})
    df = spark.createDataFrame(spans, "symbol string, t0 int, t1 int")
    got = {(r.symbol, r.t0, r.fold): r.role for r in labels.purged_folds(df, 4, embargo).collect()}
    want = {}
    for s in "ab":
        mine = [x for x in spans if x[0] == s]
        parts = np.array_split(np.arange(len(mine)), 4)
        for fold, part in enumerate(parts, 1):
            a, b = mine[part[0]][1], max(mine[i][2] for i in part)
            for i, (_, t0, t1) in enumerate(mine):
                if i in part:
                    want[s, t0, fold] = "test"
                elif not (t0 <= b and a <= t1) and not part[-1] < i <= part[-1] + int(len(mine) * embargo):
                    want[s, t0, fold] = "train"
    assert got == want


def test_message_entropies(spark):
    messages = ["abababab", "aaaa", "abcabcaabb", "ab"]
    got = {r.m: r for r in st.message_entropies(spark.createDataFrame([(m,) for m in messages], "m string"), "m", 2).withColumn("lz", st.lempel_ziv("m")).collect()}

    def entropy(words):
        share = [words.count(w) / len(words) for w in set(words)]
        return -sum(x * math.log2(x) for x in share)

    for m in messages:
        # The words of a message are those before its last one.
        words = [m[i : i + 2] for i in range(len(m) - 2)]
        assert got[m].shannon == pytest.approx(entropy(list(m)), abs=1e-9)
        assert got[m].plug_in == pytest.approx(entropy(words) / 2 if words else 0.0, abs=1e-9) or not words
        library, i = {m[0]}, 1
        while i < len(m):
            for j in range(i, len(m)):
                if m[i : j + 1] not in library:
                    library.add(m[i : j + 1])
                    break
            i = j + 1
        assert got[m].lz == pytest.approx(len(library) / len(m))


def test_bet_sizes(spark):
    p = [0.01, 0.3, 0.5, 0.77, 0.999]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    got = df.select("p", st.bet_gaussian(F.col("p")).alias("two"), st.bet_gaussian(F.col("p"), 3, F.lit(-1)).alias("three"), st.norm_ppf(F.col("p")).alias("z")).collect()
    for r in got:
        law = NormalDist()
        z = lambda k: (r.p - 1 / k) / math.sqrt(r.p * (1 - r.p))  # noqa: E731, B023
        assert r.two == pytest.approx(2 * law.cdf(z(2)) - 1, abs=1e-6) and r.three == pytest.approx(-(2 * law.cdf(z(3)) - 1), abs=1e-6)
        assert r.z == pytest.approx(law.inv_cdf(r.p), abs=5e-5)
    rows = [(0.0, 100.0, 115.0), (2.0, 100.0, 90.0), (7.0, 100.0, 100.0), (-3.0, 100.0, 140.0)]
    w, most = 50.0, 10
    sized = st.bet_dynamic(spark.createDataFrame(rows, "pos double, price double, forecast double"), w, most).collect()
    for r in sized:
        d = r.forecast - r.price
        target = int(most * d / math.sqrt(w + d * d))
        assert r.target == target
        if target == r.pos:
            assert r.limit is None
            continue
        sign = 1 if target >= r.pos else -1
        total = sum(r.forecast - j / most * math.sqrt(w / (1 - (j / most) ** 2)) for j in range(int(abs(r.pos + sign)), abs(target) + 1))
        if abs(r.pos + sign) <= abs(target):
            assert r.limit == pytest.approx(total / abs(target - r.pos))
    forms = spark.createDataFrame([(x,) for x in (-2.0, -0.25, 0.0, 0.35, 3.0)], "d double").select("d", st.bet_power(F.col("d"), F.lit(2.0)).alias("power"), labels.discrete(F.col("d"), 0.5).alias("steps")).collect()
    assert [r.power for r in forms] == [-4.0, -0.0625, 0.0, pytest.approx(0.1225), 9.0]
    assert [r.steps for r in forms] == [-1.0, 0.0, 0.0, 0.5, 1.0]
