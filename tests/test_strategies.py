"""Strategies held against plain loops over rows."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import strategies

DAYS = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(140)]
RNG = np.random.default_rng(11)


def frame(spark, wide, names, schema):
    return spark.createDataFrame([(k, d, *(float(wide[n][k][i]) for n in names)) for k in range(len(wide[names[0]])) for i, d in enumerate(DAYS)], schema)


@pytest.mark.parametrize("butterfly", [False, True])
def test_curve(spark, butterfly):
    legs = {n: np.exp(np.cumsum(RNG.normal(0, 0.1, (2, 140)), 1)) for n in ("short", "mid", "long")}
    got = strategies.curve_trade(frame(spark, legs, ["short", "mid", "long"], "curve int, date date, short double, mid double, long double"), butterfly, 20, 1.0, 5, 1.5, 0.5).orderBy("curve", "date").collect()
    seen = set()
    for k in range(2):
        s, m, g = (pd.Series(legs[n][k]) for n in ("short", "mid", "long"))
        spread = 2 * m - s - g if butterfly else g - s
        z = (spread - spread.rolling(20).mean()) / spread.rolling(20).std()
        ds, dm, dg = (-v.pct_change() for v in (s, m, g))
        move = 2 * dm - ds - dg if butterfly else dg - ds
        at, entry, days, before = 0, 0.0, 0, 0
        for i in range(140):
            out = 0
            if i >= 20:
                if at:
                    days += 1
                    up = z[i] - entry
                    lost = (at == 1 and up < -1.5) or (at == -1 and up > 1.5)
                    won = (at == 1 and up > 0.5) or (at == -1 and up < -0.5)
                    if lost or won or days >= 5:
                        seen.add("lost" if lost else "won" if won else "old")
                        at = 0
                    out = at
                elif abs(z[i]) > 1:
                    at, entry, days = (1 if z[i] < 0 else -1), z[i], 0
                    out = at
            row = got[k * 140 + i]
            assert row.position == out
            if i:
                assert row.ret == pytest.approx(before * move[i])
            before = out
    assert "won" in seen


def test_pairs(spark):
    walk = np.cumsum(RNG.normal(0, 0.02, 140))
    p = {"close": np.exp(np.array([3 + walk, 3.2 + walk + RNG.normal(0, 0.01, 140), 3 + np.cumsum(RNG.normal(0, 0.02, 140))]))}
    got = strategies.pairs_zscore(frame(spark, p, ["close"], "ticker int, date date, close double"), 20, 1.5, 6).orderBy("date").collect()
    a, b = pd.Series(p["close"][0]), pd.Series(p["close"][1])
    hedge = (a * b).sum() / (b * b).sum()
    spread = a - hedge * b
    z = (spread - spread.rolling(20).mean()) / spread.rolling(20).std()
    move = a.pct_change() - hedge * b.pct_change()
    at = days = 0
    before = 0
    for i, row in enumerate(got):
        if i >= 20:
            if at:
                days += 1
                if days >= 6 or (at > 0 and z[i] > 0) or (at < 0 and z[i] < 0):
                    at = 0
            if not at and abs(z[i]) > 1.5:
                at, days = (-1 if z[i] > 0 else 1), 0
        assert (row.a, row.b, row.position) == (0, 1, at) and row.hedge == pytest.approx(hedge)
        if i:
            assert row.ret == pytest.approx(before * move[i])
        before = at


def currencies():
    return {"close": np.exp(np.cumsum(RNG.normal(0, 0.01, (6, 140)), 1)), "rate": 0.03 + np.cumsum(RNG.normal(0, 0.001, (6, 140)), 1)}


def test_carry(spark):
    c = currencies()
    got = strategies.carry_trade(frame(spark, c, ["close", "rate"], "ticker int, date date, close double, rate double"), 2, 10, 15).orderBy("date").collect()
    close, rate = (pd.DataFrame(c[n].T) for n in ("close", "rate"))
    ret, diff = close.pct_change().iloc[1:].reset_index(drop=True), rate.sub(rate.mean(axis=1), axis=0).iloc[1:].reset_index(drop=True)
    w, d = ret * 0.0, ret * 0.0
    for i in range(0, len(ret), 10):
        if i + 15 >= len(ret):
            break
        best = diff.loc[i].sort_values(ascending=False).index
        w.loc[i:, best[:2]], w.loc[i:, best[-2:]] = 0.5, -0.5
        d.loc[i:] = diff.loc[i].to_numpy()
    raw = (w.shift(1) * ret).sum(axis=1)
    scale = (0.1 / (raw.rolling(15).std() * np.sqrt(252))).clip(upper=3.0).fillna(1.0)
    w = w.mul(scale, axis=0)
    fx, carry = (w.shift(1) * ret).sum(axis=1), (w * d / 252).sum(axis=1)
    assert [r.fx for r in got] == pytest.approx(fx.tolist()) and [r.carry for r in got] == pytest.approx(carry.tolist())
    assert got[-1].wealth == pytest.approx((1 + fx + carry).prod())


def test_rate_differential(spark):
    c = currencies()
    got = strategies.rate_differential(frame(spark, c, ["close", "rate"], "ticker int, date date, close double, rate double"), 2, 15, 0.5, 6).orderBy("date").collect()
    close, rate = (pd.DataFrame(c[n].T) for n in ("close", "rate"))
    diff = rate.sub(rate.mean(axis=1), axis=0)
    z = ((diff - diff.rolling(15).mean()) / diff.rolling(15).std()).iloc[1:].reset_index(drop=True)
    ret, diff = close.pct_change().iloc[1:].reset_index(drop=True), diff.iloc[1:].reset_index(drop=True)
    pos = ret * 0.0
    for i in range(15, len(ret)):
        order = z.loc[i].sort_values(ascending=False).index
        for k in order[:2]:
            if z.loc[i, k] > 0.5:
                pos.loc[i, k] = -0.5
        for k in order[-2:]:
            if z.loc[i, k] < -0.5:
                pos.loc[i, k] = 0.5
    for k in pos.columns:
        starts = [i for i in range(1, len(pos)) if pos.loc[i, k] != 0 and pos.loc[i - 1, k] == 0]
        for i in starts:
            pos.loc[i : min(i + 6, len(pos) - 1) - 1, k] = pos.loc[i, k]
    fx = (pos.shift(1) * ret).sum(axis=1)
    assert (pos != 0).any().all() and [r.fx for r in got] == pytest.approx(fx.tolist())
    assert [r.carry for r in got] == pytest.approx((pos * diff / 252).sum(axis=1).tolist())


def test_risk_parity(spark):
    x = RNG.normal(0, 0.01, (4, 140)) * np.array([[1], [2], [3], [0]])
    got = strategies.risk_parity(frame(spark, {"ret": x}, ["ret"], "ticker int, date date, ret double"), 20, 60, 1e9, 0.1).collect()
    assert {r.rebalance for r in got} == {DAYS[i] for i in (60, 80, 100, 120)} and {r.ticker for r in got} == {0, 1, 2}
    for i in (60, 120):
        w = np.array([r.weight for r in sorted(got, key=lambda r: r.ticker) if r.rebalance == DAYS[i]])
        cov = np.cov(x[:3, i - 60 : i])
        share = w * (cov @ w) / (w @ cov @ w)
        assert share == pytest.approx([1 / 3] * 3, abs=1e-6) and np.sqrt(w @ cov @ w * 252) == pytest.approx(0.1)


def test_basket(spark):
    n = 30
    close = np.exp(np.cumsum(RNG.normal(0, 0.02, (3, n)), 1)) * 10
    open_ = close * np.exp(RNG.normal(0, 0.005, (3, n)))
    weight = np.repeat(RNG.normal(0, 1, (3, 6)), 5, 1)
    rate, cost = np.ones((3, n)), RNG.normal(0, 0.001, (3, n))
    rows = [("b", k, DAYS[i], *(float(v[k, i]) for v in (open_, close, weight, rate, cost))) for k in range(3) for i in range(n)]
    got = [r.value for r in strategies.basket_value(spark.createDataFrame(rows, "basket string, ticker int, date date, open double, close double, weight double, rate double, cost double")).orderBy("date").collect()]
    want, k, held, last, reset = [], 1.0, None, np.zeros(3), False
    for i in range(1, n):
        ahead = open_[:, i + 1] if i + 1 < n else np.full(3, np.nan)
        h = weight[:, i] / np.abs(weight[:, i]).sum() / (ahead * rate[:, i])
        if held is None:
            held = h * k
            want.append(k)
            continue
        move = close[:, i] - open_[:, i] if reset else close[:, i] - close[:, i - 1]
        if reset:
            held = h * k
        k += np.nansum(held * rate[:, i] * (move + cost[:, i]))
        want.append(k)
        reset, last = not (last == weight[:, i]).all(), weight[:, i]
    assert got == pytest.approx(want)
