"""The Hurst strategy against a plain loop over three symbols."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import hurst_trades as ht

DAY = dt.date(2018, 1, 1)
N = 420


def tables():
    out = {}
    for k in range(3):
        rng = np.random.default_rng(20 + k)
        drift = np.repeat(rng.choice([-0.01, 0.0, 0.012], N // 30), 30)
        close = 100 * np.exp(np.cumsum(drift + rng.normal(0, [0.004, 0.02, 0.035][k], N)))
        level = np.repeat(rng.choice([0.2, 0.5, 0.9], N // 20), 20)
        hurst = np.clip(level + rng.normal(0, 0.03, N), 0.05, 0.99)
        hurst[:70] = np.nan
        out[f"t{k}"] = pd.DataFrame({"close": close, "high": close * (1 + rng.random(N) * 0.01), "low": close * (1 - rng.random(N) * 0.01), "hurst": hurst})
    return out


def loop(t, rules):
    c, h = t["close"], t["hurst"]
    r = c.pct_change()
    d = c.diff()
    up, down = d.clip(lower=0).where(d.notna()).rolling(14).mean(), (-d).clip(lower=0).where(d.notna()).rolling(14).mean()
    rsi = 100 - 100 / (1 + up / down)
    tr = pd.concat([t["high"] - t["low"], (t["high"] - c.shift()).abs(), (t["low"] - c.shift()).abs()], axis=1).max(axis=1)
    atr, short, long = tr.rolling(rules.atr).mean(), c.rolling(rules.short).mean(), c.rolling(rules.long).mean()
    position, entry, kind, held = 0, 0.0, 0, 0
    out = []
    for i in range(N):
        if i < max(rules.window, rules.long) or np.isnan(h[i]):
            out.append(0)
            continue
        mr, tr_ = rules.low, rules.high
        recent = h[:i].dropna().tail(100)
        if i >= 100 and len(recent) >= 10:
            mr, tr_ = max(0.25, min(0.35, recent.quantile(0.1))), max(0.65, min(0.85, recent.quantile(0.9)))
            gap = 0.25 * min(2.0, max(1.0, 1 + 3 * recent.std()))
            if tr_ - mr < gap:
                mr = max(0.2, (mr + tr_ - gap) / 2)
                tr_ = min(0.9, mr + gap)
        if i >= 60 + rules.window:
            p = c[i - 60 : i].reset_index(drop=True)
            q = p.pct_change().dropna()
            if q.std() * 252**0.5 > 0.4:
                mr, tr_ = max(0.25, mr - 0.05), min(0.65, tr_ + 0.05)
            elif np.corrcoef(np.arange(60), p)[0, 1] ** 2 > 0.6:
                tr_ = max(0.51, tr_ - 0.03)
            elif q.autocorr(1) < -0.2:
                mr = min(0.42, mr + 0.03)
        if position:
            held += 1
            gain = position * (c[i] - entry) / entry
            gone = False
            if rules.by_type:
                most = 8 if kind == 1 else 15
                gone = (kind == 2 and h[i] < rules.high - 0.15) or (kind == 1 and h[i] > rules.low + 0.15) or (held > most and gain < 0.01) or held > 1.5 * most
            k = 1.8 if rules.by_type and kind == 1 else rules.profit
            if position > 0:
                stop = max(entry, c[i] - 0.4 * rules.stop * atr[i]) if gain > 0.03 else max(entry * 0.998, c[i] - 0.6 * rules.stop * atr[i]) if gain > 0.015 else entry - rules.stop * atr[i]
                gone |= c[i] <= stop or c[i] >= entry + k * atr[i]
            else:
                stop = min(entry, c[i] + 0.4 * rules.stop * atr[i]) if gain > 0.03 else min(entry * 1.002, c[i] + 0.6 * rules.stop * atr[i]) if gain > 0.015 else entry + rules.stop * atr[i]
                gone |= c[i] >= stop or c[i] <= entry - k * atr[i]
            position = 0 if gone else position
        else:
            seven = [x for x in h[max(0, i - 7) : i] if not np.isnan(x)]
            m10 = (c[i] / c[i - 10] - 1) * 100
            m50 = (c[i] / c[i - 50] - 1) * 100
            signal = 0
            if h[i] < mr and (len(seven) < 4 or all(x < mr + 0.03 for x in seven)):
                signal = -1 if c[i] > short[i] * 1.015 and rsi[i] > 75 else 1 if c[i] < short[i] * 0.985 and rsi[i] < 25 else 0
            elif h[i] > tr_ and h[i] >= mr and (len(seven) < 4 or all(x > tr_ - 0.03 for x in seven)):
                if short[i] > long[i] * 1.01 and m10 > 1.5 and (m50 >= -5 or m10 > 3):
                    signal = 1
                elif short[i] < long[i] * 0.99 and m10 < -1.5 and (m50 <= 5 or m10 < -3):
                    signal = -1
            if signal:
                position, entry, kind, held = signal, c[i], 1 if h[i] < mr else 2, 0
        out.append(position)
    return out


@pytest.mark.parametrize("by_type", [False, True])
def test_positions_equal_a_loop(spark, by_type):
    made = tables()
    rules = ht.HurstRules(by_type=by_type, window=60)
    rows = [(k, DAY + dt.timedelta(days=i), *map(float, t.loc[i, ["high", "low", "close"]])) for k, t in made.items() for i in range(N)]
    known = [(k, DAY + dt.timedelta(days=i), float(t["hurst"][i])) for k, t in made.items() for i in range(N) if not np.isnan(t["hurst"][i])]
    prices = spark.createDataFrame(rows, "ticker string, date date, high double, low double, close double")
    hurst = spark.createDataFrame(known, "ticker string, date date, hurst double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "53")
    try:
        found = ht.hurst_strategy(prices, hurst, rules).cache()
        got = {}
        for r in found.orderBy("ticker", "date").collect():
            got.setdefault(r.ticker, []).append(r)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    held = set()
    for k, t in made.items():
        want = loop(t, rules)
        assert [r.position for r in got[k]] == want, k
        held |= set(want)
        r = (pd.Series(want).shift(1) * t["close"].pct_change()).fillna(0.0)
        assert [x.strategy_return for x in got[k]] == pytest.approx(list(r))
    assert held == {-1, 0, 1}
    shown = {(r.ticker, r.side): r for r in ht.evaluate(found).collect()}
    assert sum(r.days for r in shown.values()) == 3 * N and any(r.side == "long" and r.volatility > 0 for r in shown.values())
    assert ht.hurst_strategy(prices.limit(0), hurst, rules).count() == 0
