"""Returns, volatility, microstructure, trend and strategy columns of one instrument."""

from __future__ import annotations

import math

from ..rolling import Frame, X, greatest, where

HORIZONS = (1, 5, 10, 15, 20)


def returns(f: Frame) -> dict[str, X]:
    """Backward and forward returns over n rows, and the log return."""
    c = f["close"]
    out = {f"ret_backward_{n}": f.pct(c, n) for n in HORIZONS}
    out |= {f"ret_forward_{n}": f.lead(c, n) / c - 1.0 for n in HORIZONS}
    out["ret_current"] = f.pct(c, 1)
    out["ret_log"] = c.log() - f.lag(c, 1).log()
    return out


def primitives(f: Frame) -> dict[str, X]:
    """One column for every rolling primitive."""
    c, v, o = f["close"], f["volume"], f["open"]
    return {
        "ts_sum": f.sum(c, 5), "ts_mean": f.mean(c, 5), "ts_min": f.min(c, 5), "ts_max": f.max(c, 5), "ts_std": f.std(c, 5),
        "ts_corr": f.corr(c, v, 10), "ts_cov": f.cov(c, v, 10), "ts_rank": f.ts_rank(c, 9), "ts_rank_pct": f.ts_rank(c, 9) / 9.0,
        "ts_product": f.product(c / f.lag(c), 5), "ts_argmax": f.argmax(c, 5), "ts_argmin": f.argmin(c, 5),
        "highday": (20.0 - f.argmax(c, 20)) * 5.0, "lowday": (20.0 - f.argmin(c, 20)) * 5.0,
        "delta": f.delta(c, 3), "delay": f.lag(c, 3), "pct_change": f.pct(c, 3), "decay_linear": f.decay(c, 6), "wma": f.wma(c, 6),
        "rank_pct": f.rank(c), "scale": f.scale(c), "reg_beta_seq": f.beta_sequence(c, 6), "count_if": f.sum((c > o).flag(), 12),
        "sum_if": f.sum(where(c > f.lag(c), v, 0.0 * v), 12), "zscore": (c - f.mean(c, 20)) / f.std(c, 20),
        "neutralized": f.neutralize(c, f["ind"]),
    }


def volatility(f: Frame, n: int = 20) -> dict[str, X]:
    """Range-based rolling volatilities and the intrinsic entropy, weighted by shares of the ticker's whole volume."""
    o, h, l, c, v = (f[k] for k in ("open", "high", "low", "close", "volume"))
    hl, co = (h / l).log(), (c / o).log()
    rs = (h / c).log() * (h / o).log() + (l / c).log() * (l / o).log()
    prev = f.lag(c, 1)
    night, day = (o / prev).log(), (c / o).log()
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    sq = lambda x: x * x
    share = v / f.total(v)
    told = share * share.log()

    def own(x: X) -> X:
        """Mean square of departures, each from its own row's rolling mean."""
        gap = x - f.mean(x, n)
        return f.mean(f.let(sq(gap).sql, gap.stage), n)

    # Weighted by the share of all volume: overnight, within the day, and of the range.
    over_night = -f.mean(night * share * (f.lag(v, 1) / f.total(v)).log(), n)
    in_day = -f.mean(day * told, n)
    in_range = -f.mean(((o / h).log() * (h / c).log() + (l / o).log() * (l / c).log()) * told, n)
    return {
        "parkinson": f.mean(sq(hl) / (4 * math.log(2)), n).sqrt(),
        "garman_klass": f.mean(0.5 * sq(hl) - (2 * math.log(2) - 1) * sq(co), n).sqrt(),
        "rogers_satchell": f.mean(rs, n).sqrt(),
        "yang_zhang": (own(night) + k * own(day) + (1 - k) * f.mean(rs, n)).sqrt(),
        "intrinsic_entropy": (over_night + k * in_day + (1 - k) * in_range).abs(),
    }


def norm_cdf(x: X) -> X:
    """Abramowitz and Stegun 26.2.17; absolute error below 7.5e-8."""
    t = 1.0 / (1.0 + 0.2316419 * x.abs())
    # Fixed values of the approximation.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = (-0.5 * x * x).exp() / math.sqrt(2 * math.pi) * poly
    return where(x >= 0.0, 1.0 - tail, tail)


def bulk_buys(f: Frame, c: X, v: X, n: int) -> X:
    """Bulk classification: the share of a bar's volume that bought, from its price change in rolling deviations."""
    d = f.delta(c, 1)
    z = f.let((d / f.std(d, n)).sql, f.std(d, n).stage)
    return v * norm_cdf(z)


def microstructure(f: Frame, n: int = 20) -> dict[str, X]:
    """Daily liquidity and cost measures."""
    o, h, l, c, v, a = (f[k] for k in ("open", "high", "low", "close", "volume", "amount"))
    d = f.delta(c, 1)
    roll = 2.0 * f.cov(d, f.lag(d, 1), n).abs().sqrt()
    hl2 = (h / l).log() * (h / l).log()
    beta = f.mean(f.sum(hl2, 2), n)
    wide = (f.max(h, 2) / f.min(l, 2)).log()
    gamma = wide * wide
    den = 3 - 2 * 2**0.5
    alpha = (2**0.5 - 1) * beta.sqrt() / den - (gamma / den).sqrt()
    alpha = where(alpha > 0.0, alpha, 0.0 * alpha)
    k2 = (8 / math.pi) ** 0.5
    sigma = (2**-0.5 - 1) * beta.sqrt() / (k2 * den) + (gamma / (k2 * k2 * den)).sqrt()
    side = f.ffill(where(d.sign().eq(0.0), X(f, "CAST(NULL AS DOUBLE)"), d.sign()))
    buy = bulk_buys(f, c, v, n)
    move = (c / f.lag(c)).log()
    return {
        "roll_measure": roll, "roll_impact": roll / a, "market_depth": v / (h - l),
        "corwin_schultz": 2.0 * (alpha.exp() - 1.0) / (1.0 + alpha.exp()), "becker_parkinson": where(sigma > 0.0, sigma, 0.0 * sigma),
        "bar_kyle": f.mean(d / (side * v), n), "bar_amihud": f.mean(move.abs() / a, n), "bar_hasbrouck": f.mean(move / (a.sqrt() * side), n), "bvc_buy_volume": buy,
        "vpin": f.mean((2.0 * buy - v).abs(), n) / v, "rsi_sma": 100.0 - 100.0 / (1.0 + f.mean(where(d > 0.0, d, 0.0 * d), 14) / f.mean(where(d < 0.0, -d, 0.0 * d), 14)),
        "true_range": greatest(greatest(h - l, (h - f.lag(c)).abs()), (l - f.lag(c)).abs()), "turnover_log": (o * v + 1.0).log(),
    }


def trend(f: Frame) -> dict[str, X]:
    """Trend columns on the log price, windows 5 to 30 (our definitions where none is published)."""
    p = f.let(f["close"].log().sql, 0)
    o, h, l, c = (f[k] for k in ("open", "high", "low", "close"))
    d = f.delta(p, 1)
    tr = greatest(greatest(h - l, (h - f.lag(c)).abs()), (l - f.lag(c)).abs())
    out: dict[str, X] = {}
    for n in (5, 10, 20, 30):
        lo, hi = f.min(p, n), f.max(p, n)
        out |= {
            f"breakout_{n}": 2.0 * (p - lo) / (hi - lo) - 1.0, f"price_mom_{n}": f.delta(p, n) / f.std(d, n), f"divergence_{n}": f.mean(d.sign(), n),
            f"time_trend_{n}": f.slope(p, n), f"stochastic_{n}": (c - f.min(l, n)) / (f.max(h, n) - f.min(l, n)), f"intensity_{n}": f.mean((c - o) / tr, n),
            f"energy_{n}": f.sum(d * d, n) * f.delta(p, n).sign(), f"snr_{n}": f.delta(p, n) / f.sum(d.abs(), n),
        }
    for s, n in ((5, 20), (10, 30)):
        out[f"mw_diff_{s}_{n}"] = (f.mean(p, s) - f.mean(p, n)) / f.std(p, n)
    return out


def trend_recursive(f: Frame) -> dict[str, X]:
    """The trend, momentum and range columns that need recursive means."""
    p, c, h, l = f["close"].log(), f["close"], f["high"], f["low"]
    d, dc = f.delta(p, 1), f.delta(c, 1)
    tr = greatest(greatest(h - l, (h - f.lag(c)).abs()), (l - f.lag(c)).abs())
    up, down = f.ewm(where(dc > 0.0, dc, 0.0 * dc), 1 / 14), f.ewm(where(dc < 0.0, -dc, 0.0 * dc), 1 / 14)
    rise, fall = f.delta(h, 1), -f.delta(l, 1)
    plus = f.ewm(where((rise > fall) & (rise > 0.0), rise, 0.0 * rise), 1 / 14)
    minus = f.ewm(where((fall > rise) & (fall > 0.0), fall, 0.0 * fall), 1 / 14)
    out = {
        "rsi": where(down > 0.0, 100.0 - 100.0 / (1.0 + up / down), 100.0 + 0.0 * up), "atr": f.ewm(tr, 1 / 14),
        "trend_ewma": f.ewm(d / f.std(d, 20), 2 / 21), "trend_adx": f.ewm(100.0 * (plus - minus).abs() / (plus + minus), 1 / 14),
    }
    out |= {f"ewma_diff_{s}_{n}": f.ewm(p, 2 / (s + 1)) - f.ewm(p, 2 / (n + 1)) for s, n in ((2, 6), (4, 12), (8, 24))}
    return out


def strategies(f: Frame) -> dict[str, X]:
    """Signals lagged by a row times the return, for the strategies without path-dependent positions."""
    c = f["close"]
    ret = f.let(f.pct(c, 1).sql, f.pct(c, 1).stage)
    vol = f.std(ret, 63) * 252**0.5
    mom = f.product(1.0 + ret, 252) - 1.0
    size = 0.1 / vol
    scalar = where(size > 2.0, 2.0 + 0.0 * size, size)
    follow = ((c - f.mean(c, 20)).sign() + (c - f.mean(c, 60)).sign() + (c - f.mean(c, 120)).sign()) / 3.0
    cap = where(size > 3.0, 3.0 + 0.0 * size, size)
    z = (c - f.mean(c, 20)) / f.std(c, 20)
    parts = [(0.4, 21), (0.2, 63), (0.2, 126), (0.2, 252)]
    factor = sum((w * (f.product(1.0 + ret, n) - 1.0) for w, n in parts[1:]), parts[0][0] * (f.product(1.0 + ret, 21) - 1.0))
    return {
        "ts_momentum": f.lag(mom.sign(), 1) * ret, "momentum_vol_control": f.lag(mom.sign() * scalar, 1) * ret, "momentum_factor": factor,
        "trend_following": f.lag(follow * cap, 1) * ret, "bollinger_entry": where(z < -2.0, 1.0 + 0.0 * z, where(z > 2.0, -1.0 + 0.0 * z, 0.0 * z)),
    }


def performance(f: Frame) -> dict[str, X]:
    """Wealth, running maximum, drawdown and rolling metrics of daily returns."""
    c = f["close"]
    ret = f.pct(c, 1)
    wealth = f.let(f"exp(sum(ln(1 + coalesce({ret.sql}, 0))) OVER ({f.over()} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))", ret.stage)
    peak = f.let(f"max({wealth.sql}) OVER ({f.over()} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", wealth.stage)
    return {
        "cum_return": wealth - 1.0, "running_max": peak, "drawdown": wealth / peak - 1.0, "rolling_return": f.mean(ret, 63) * 252.0,
        "rolling_vol": f.std(ret, 63) * 252**0.5, "rolling_sharpe": f.mean(ret, 63) / f.std(ret, 63) * 252**0.5,
    }


def fractional_weights(d: float, least: float) -> list[float]:
    """Weights of a fixed-width fractional difference, newest first, until they fall below ``least``."""
    w = [1.0]
    while abs(nxt := -w[-1] * (d - len(w) + 1) / len(w)) >= least:
        w.append(nxt)
    return w


def regime(f: Frame, n: int = 60) -> dict[str, X]:
    """Lag-1 autocorrelation, trend fit and volatility, the regime they make, and the variance ratio."""
    c = f["close"]
    p = c.log()
    ret = f.delta(p, 1)
    t = f.row_number()
    r = f.corr(p, t, n)
    auto = f.corr(ret, f.lag(ret, 1), n)
    vol = f.std(ret, n) * 252**0.5
    code = where(vol > 0.4, 3.0 + 0.0 * vol, where(r * r > 0.6, 1.0 + 0.0 * vol, where(auto < -0.2, 2.0 + 0.0 * vol, 0.0 * vol)))
    five = f.delta(p, 5)
    return {"autocorr": auto, "trend_r2": r * r, "annual_vol": vol, "regime": code, "variance_ratio": f.std(five, n) * f.std(five, n) / (5.0 * f.std(ret, n) * f.std(ret, n))}
