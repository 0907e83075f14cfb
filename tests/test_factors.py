"""Factors held against pandas and numpy, written from the definitions and not through the frame that Spark runs."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from tickloom.functions.factors import alpha101, alpha191, market
from tickloom.functions.rolling import Frame
from tickloom.sources.views import PANEL

N = 330


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(11)
    frames = []
    for k in range(2):
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, N))) + k
        open_ = close * np.exp(rng.normal(0, 0.01, N))
        high, low = np.maximum(open_, close) * (1 + rng.random(N) * 0.01 + 0.001), np.minimum(open_, close) * (1 - rng.random(N) * 0.01 - 0.001)
        volume = rng.integers(100, 1000, N).astype(float)
        dates = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(N)]
        frames.append(pd.DataFrame({"ticker": k, "date": dates, "open": open_, "high": high, "low": low, "close": close, "volume": volume}))
    df = pd.concat(frames, ignore_index=True)
    df["amount"] = df["volume"] * (df["open"] + df["close"]) / 2
    df["vwap"] = df["amount"] / df["volume"]
    df["cap"], df["ind"] = df["amount"] / df["close"], df["vwap"] * 1.5
    df["bm_open"], df["bm_close"] = df.groupby("date")["open"].transform("mean"), df.groupby("date")["close"].transform("mean")
    return df


def spark_values(spark, table, make, names):
    f = Frame(PANEL)
    made = make(f)
    found = f.apply(spark.createDataFrame(table), {n: made[n] for n in names}).toPandas().sort_values(["ticker", "date"])
    return found[found["ticker"] == 1].reset_index(drop=True)


def one(table):
    return table[table["ticker"] == 1].reset_index(drop=True)


def check(got, want):
    for name, series in want.items():
        a, b = got[name].to_numpy(float), np.asarray(series, float)
        b = np.where(np.isinf(b), np.nan, b)
        assert np.isfinite(b).sum() > 20, name
        assert np.allclose(a, b, rtol=1e-6, atol=1e-8, equal_nan=True), (name, np.flatnonzero(~np.isclose(a, b, rtol=1e-6, atol=1e-8, equal_nan=True))[:5])


def place(x, n):
    return x.rolling(n).apply(lambda w: w.rank().iloc[-1])


def linear(x, n):
    w = np.arange(1, n + 1) / (n * (n + 1) / 2)
    return x.rolling(n).apply(lambda v: v @ w, raw=True)


def pct_rank(x):
    return x.rank(pct=True)


def test_volatility(spark, table):
    d, n = one(table), 20
    o, h, l, c, v = (d[k] for k in ("open", "high", "low", "close", "volume"))
    log = np.log
    rs = log(h / c) * log(h / o) + log(l / c) * log(l / o)
    night, day = log(o / c.shift()), log(c / o)
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    mean = lambda x: x.rolling(n).mean()
    s = v / v.sum()
    entropy = -mean(night * s * log(v.shift() / v.sum())) - k * mean(day * s * log(s)) - (1 - k) * mean((log(o / h) * log(h / c) + log(l / o) * log(l / c)) * s * log(s))
    want = {
        "parkinson": np.sqrt(mean(log(h / l) ** 2) / (4 * log(2))), "garman_klass": np.sqrt(mean(log(h / l) ** 2) / 2 - (2 * log(2) - 1) * mean(day**2)), "rogers_satchell": np.sqrt(mean(rs)),
        "yang_zhang": np.sqrt(mean((night - mean(night)) ** 2) + k * mean((day - mean(day)) ** 2) + (1 - k) * mean(rs)), "intrinsic_entropy": entropy.abs(),
    }
    check(spark_values(spark, table, market.volatility, list(want)), want)


def test_microstructure(spark, table):
    d, n = one(table), 20
    h, l, c, v, a = (d[k] for k in ("high", "low", "close", "volume", "amount"))
    step, move = c.diff(), np.log(c / c.shift())
    side = np.sign(step).replace(0, np.nan).ffill()
    z = step / step.rolling(n).std()
    buy = v * z.map(lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2))) if x == x else np.nan)
    gain, loss = step.clip(lower=0).rolling(14).mean(), (-step.clip(upper=0)).rolling(14).mean()
    want = {
        "roll_measure": 2 * np.sqrt(step.rolling(n).cov(step.shift()).abs()), "market_depth": v / (h - l), "bar_kyle": (step / (side * v)).rolling(n).mean(), "bar_amihud": (move.abs() / a).rolling(n).mean(),
        "bar_hasbrouck": (move / (side * np.sqrt(a))).rolling(n).mean(), "vpin": (2 * buy - v).abs().rolling(n).mean() / v, "rsi_sma": 100 - 100 / (1 + gain / loss),
    }
    check(spark_values(spark, table, market.microstructure, list(want)), want)
    got = spark_values(spark, table, market.microstructure, ["bvc_buy_volume"])["bvc_buy_volume"]
    assert np.allclose(got, buy, rtol=1e-5, atol=1e-3, equal_nan=True)


def test_primitives(spark, table):
    d = one(table)
    c, v, o = d["close"], d["volume"], d["open"]
    k = np.arange(1, 7)
    want = {
        "ts_sum": c.rolling(5).sum(), "ts_std": c.rolling(5).std(), "ts_corr": c.rolling(10).corr(v), "ts_cov": c.rolling(10).cov(v), "ts_rank": place(c, 9), "ts_product": (c / c.shift()).rolling(5).apply(np.prod, raw=True),
        "ts_argmax": c.rolling(5).apply(np.argmax, raw=True) + 1, "ts_argmin": c.rolling(5).apply(np.argmin, raw=True) + 1, "delta": c.diff(3), "delay": c.shift(3), "pct_change": c.pct_change(3), "wma": linear(c, 6),
        "rank_pct": pct_rank(c), "scale": c / c.abs().sum(), "reg_beta_seq": c.rolling(6).apply(lambda w: (w @ k) / (k @ k), raw=True), "count_if": (c > o).astype(float).rolling(12).sum(),
        "sum_if": v.where(c > c.shift(), 0.0).rolling(12).sum(), "zscore": (c - c.rolling(20).mean()) / c.rolling(20).std(),
    }
    check(spark_values(spark, table, market.primitives, list(want)), want)


def test_returns_trend_and_strategies(spark, table):
    c = one(table)["close"]
    p, d = np.log(c), np.log(c).diff()
    check(spark_values(spark, table, market.returns, ["ret_backward_5", "ret_forward_10", "ret_log"]), {"ret_backward_5": c.pct_change(5), "ret_forward_10": c.shift(-10) / c - 1, "ret_log": d})
    want = {
        "breakout_20": 2 * (p - p.rolling(20).min()) / (p.rolling(20).max() - p.rolling(20).min()) - 1, "price_mom_10": p.diff(10) / d.rolling(10).std(), "divergence_10": np.sign(d).rolling(10).mean(),
        "time_trend_10": p.rolling(10).apply(lambda w: np.polyfit(np.arange(10), w, 1)[0], raw=True), "snr_20": p.diff(20) / d.abs().rolling(20).sum(), "mw_diff_5_20": (p.rolling(5).mean() - p.rolling(20).mean()) / p.rolling(20).std(),
    }
    check(spark_values(spark, table, market.trend, list(want)), want)
    r = c.pct_change()
    mom = (1 + r).rolling(252).apply(np.prod, raw=True) - 1
    check(spark_values(spark, table, market.strategies, ["ts_momentum"]), {"ts_momentum": np.sign(mom).shift() * r})
    gone = (1 + r.fillna(0)).cumprod()
    check(spark_values(spark, table, market.performance, ["cum_return", "drawdown", "rolling_sharpe"]), {"cum_return": gone - 1, "drawdown": gone / gone.cummax() - 1, "rolling_sharpe": r.rolling(63).mean() / r.rolling(63).std() * 252**0.5})


def test_alphas_of_the_191_family(spark, table):
    d = one(table)
    o, h, l, c, v, a, w, bo, bc = (d[k] for k in ("open", "high", "low", "close", "volume", "amount", "vwap", "bm_open", "bm_close"))
    ret, prev, step = c.pct_change(), c.shift(), c.diff()
    tr = np.maximum(np.maximum(h - l, (prev - h).abs()), (prev - l).abs())
    floor, roof = np.minimum(l, prev), np.maximum(h, prev)
    low = o * 0.15 + l * 0.85
    away, growth = np.log(bc) - np.log(bc).rolling(20).mean(), np.log(c).pct_change()
    share = lambda x, n: place(x, n) / n
    k6, k12, k20 = (lambda x, n=n: x.rolling(n).apply(lambda u: (u @ np.arange(1, n + 1)) / (np.arange(1, n + 1) ** 2).sum(), raw=True) for n in (6, 12, 20))
    sums = (c - c.rolling(24).mean()).rolling(24).sum()
    lower = (bc < bo).astype(float).rolling(50).sum()
    want = {
        1: -pct_rank(np.log(v).diff()).rolling(6).corr(pct_rank(c / o)), 14: c.diff(5), 15: o / prev - 1, 21: k6(c.rolling(6).mean()), 75: ((c > o) & (bc < bo)).astype(float).rolling(50).sum() / lower, 116: k20(c),
        140: np.minimum(pct_rank(linear(pct_rank(o) + pct_rank(l) - pct_rank(h) - pct_rank(c), 8).round(8)), share(linear(share(v.rolling(60).mean(), 20).rolling(8).corr(share(c, 8)), 7), 3)),
        141: -pct_rank(pct_rank(v.rolling(15).mean()).rolling(9).corr(pct_rank(h))), 143: c.where(~(c > prev), (1 + ret) * c), 145: (v.rolling(9).mean() - v.rolling(26).mean()) / v.rolling(12).mean() * 100, 147: k12(c.rolling(12).mean()),
        149: (ret * bc.pct_change()).where(bc.diff() < 0, 0.0).rolling(252).sum() / (bc.pct_change() ** 2).where(bc.diff() < 0, 0.0).rolling(252).sum(), 153: sum(c.rolling(n).mean() for n in (3, 6, 12, 24)) / 4,
        154: v.rolling(180).mean().rolling(18).corr(w) - (w - w.rolling(16).min()), 156: -np.maximum(linear(w.diff(5), 3), linear(-low.diff(2) / low, 3)),
        159: sum((c - floor.rolling(n).sum()) / (roof - floor).rolling(n).sum() * k for n, k in ((6, 288), (12, 144), (24, 72))) * 100 / 504, 161: tr.rolling(12).mean(), 163: -(ret * v.rolling(20).mean() * w * (h - c)),
        166: (ret - ret.rolling(20).mean()).rolling(20).sum() * (-20 * 19**1.5) / (((c / prev) ** 2).rolling(20).sum() ** 1.5 * 19 * 18), 168: -v / v.rolling(20).mean(), 171: -((l - c) * o**5) / ((c - h) * c**5),
        177: (h.rolling(20).apply(np.argmax, raw=True) + 1) * 5, 180: (-v).where(~(v.rolling(20).mean() < v), -(share(c.diff(7).abs(), 60) * np.sign(c.diff(7)))), 183: sums.rolling(24).max() - sums.rolling(24).min() / c.rolling(24).std(),
        181: (growth - growth.rolling(20).mean() - away**2).rolling(20).sum() / (away**3).rolling(20).sum(), 185: -((1 - o / c) ** 2), 189: (c - c.rolling(6).mean()).abs().rolling(6).mean(), 191: v.rolling(20).mean().rolling(5).corr(l) + h * 0.5 + l * 0.5 - c,
    }
    want[149][:252] = np.nan
    want = {f"alpha191_{n:03d}": s for n, s in want.items()}
    got = spark_values(spark, table, alpha191.factors, list(want))
    check(got, want)


def test_recursive_alphas(spark, table):
    d = one(table)
    c, h, l = d["close"], d["high"], d["low"]
    e = lambda x, alpha, least=0: x.ewm(alpha=alpha, adjust=False, min_periods=least).mean()
    k = (c - l.rolling(9).min()) / (h.rolling(9).max() - l.rolling(9).min()) * 100
    ret = c.pct_change()
    drift = e(ret, 2 / 61)
    want = {57: e(k, 1 / 3, 3), 24: e(c.diff(5), 1 / 5), 151: e(c.diff(20), 1 / 20), 146: (ret - drift).rolling(20).mean() * (ret - drift) / e(drift**2, 1 / 60), 188: ((h - l) / e(h - l, 2 / 11) - 1) * 100}
    want = {f"alpha191_{n:03d}": s for n, s in want.items()}
    check(spark_values(spark, table, alpha191.recursive, list(want)), want)


def test_alphas_of_the_101_family(spark, table):
    d = one(table)
    o, h, l, c, v = (d[k] for k in ("open", "high", "low", "close", "volume"))
    want = {"alpha006": -o.rolling(10).corr(v), "alpha012": np.sign(v.diff()) * -c.diff(), "alpha041": np.sqrt(h * l) - d["vwap"], "alpha101": (c - o) / (h - l + 0.001)}
    check(spark_values(spark, table, alpha101.factors, list(want)), want)


def test_more_alphas_of_the_101_family(spark, table):
    """Written from the published formulas; rank is the percent rank over the history; unknown correlations count as 0, and a decay's gaps are filled, where the usual implementations do so."""
    d = one(table)
    o, h, l, c, v, w = (d[k] for k in ("open", "high", "low", "close", "volume", "vwap"))
    ret, step, rank = c.pct_change(), c.diff(), pct_rank
    corr = lambda x, y, n: x.rolling(n).corr(y)
    filled = lambda x: x.replace([np.inf, -np.inf], 0).fillna(0)
    adv = {n: v.rolling(n).mean() for n in (10, 20, 30, 40, 50, 60, 120, 180)}
    scale = lambda x: x / x.abs().sum()
    cov = lambda x, y, n: x.rolling(n).cov(y)
    pair = o.rolling(5).sum() * ret.rolling(5).sum()
    curve = (c.shift(20) - c.shift(10)) / 10 - (c.shift(10) - c) / 10
    most = lambda x, n: x.rolling(n).apply(np.argmax, raw=True) + 1
    calm = lambda n: (step.rolling(n).min() > 0) | (step.rolling(n).max() < 0)
    hl2 = (h + l) / 2
    want = {
        2: -corr(rank(np.log(v).diff(2)), rank((c - o) / o), 6), 3: -corr(rank(o), rank(v), 10), 4: -place(rank(l), 9), 5: rank(o - w.rolling(10).mean()) * -rank(c - w).abs(),
        8: -rank(pair - pair.shift(10)), 9: step.where(calm(5), -step), 10: rank(step.where(calm(4), -step)),
        11: (rank((w - c).rolling(3).max()) + rank((w - c).rolling(3).min())) * rank(v.diff(3)), 13: -rank(cov(rank(c), rank(v), 5)), 14: filled(corr(o, v, 10)) * -rank(ret.diff(3)),
        16: -rank(cov(rank(h), rank(v), 5)), 17: -(rank(place(c, 10)) * rank(step.diff()) * rank(place(v / adv[20], 5))), 18: -rank((c - o).abs().rolling(5).std() + (c - o) + filled(corr(c, o, 10))),
        19: -np.sign(c - c.shift(7) + c.diff(7)) * (1 + rank(1 + ret.rolling(250).sum())), 20: -(rank(o - h.shift()) * rank(o - c.shift()) * rank(o - l.shift())),
        22: -filled(corr(h, v, 5)).diff(5) * rank(c.rolling(20).std()), 25: rank(-ret * adv[20] * w * (h - c)), 26: -filled(corr(place(v, 5), place(h, 5), 5)).rolling(3).max(),
        28: scale(filled(corr(adv[20], l, 5)) + hl2 - c), 33: rank(-1 + o / c), 37: rank(corr((o - c).shift(), c, 200)) + rank(o - c), 40: -rank(h.rolling(10).std()) * corr(h, v, 10),
        42: rank(w - c) / rank(w + c), 43: place(v / adv[20], 20) * place(-c.diff(7), 8), 44: -corr(h, rank(v), 5), 49: pd.Series(1.0, c.index).where(curve < -0.1, -step), 51: pd.Series(1.0, c.index).where(curve < -0.05, -step),
        50: -rank(corr(rank(v), rank(w), 5)).rolling(5).max(), 52: -l.rolling(5).min().diff(5) * rank((ret.rolling(240).sum() - ret.rolling(20).sum()) / 220) * place(v, 5),
        53: -(((c - l) - (h - c)) / (c - l).replace(0, 0.0001)).diff(9), 54: -(l - c) * o**5 / ((l - h).replace(0, -0.0001) * c**5),
        55: -corr(rank((c - l.rolling(12).min()) / (h.rolling(12).max() - l.rolling(12).min()).replace(0, 0.0001)), rank(v), 6), 57: -((c - w) / linear(rank(most(c, 30)).ffill().bfill(), 2)),
        60: -(2 * scale(rank(((c - l) - (h - c)) * v / (h - l).replace(0, 0.0001))) - scale(rank(most(c, 10)))), 101: (c - o) / (h - l + 0.001),
    }
    want = {f"alpha{n:03d}": s for n, s in want.items()}
    names, got, bad = list(want), {}, {}
    for k in range(0, len(names), 8):  # few columns a plan, as in the registered queries
        part = spark_values(spark, table, alpha101.factors, names[k : k + 8])
        got |= {n: part[n] for n in names[k : k + 8]}
    for name, series in want.items():
        a, b = got[name].to_numpy(float), np.asarray(series, float)
        b = np.where(np.isinf(b), np.nan, b)
        # Covariances of ranks tie but for their last digits, which shifts a rank by a place.
        near = np.isclose(a, b, rtol=1e-6, atol=1.5 / N if name == "alpha016" else 1e-8, equal_nan=True)
        if np.isfinite(b).sum() < 60 or not near.all():
            bad[name] = np.flatnonzero(~near)[:5].tolist()
    assert not bad
