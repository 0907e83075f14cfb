"""The published 191 short-horizon alphas.

Not here: 30 (needs a cross-section of book values).  bm_open and bm_close are
those of the benchmark index.  ``recursive`` holds those built on recursive
means; they have no SQL.
"""

from __future__ import annotations

from ..rolling import Frame, X, greatest, least, where


def factors(f: Frame) -> dict[str, X]:
    o, h, l, c, v, a = (f[k] for k in ("open", "high", "low", "close", "volume", "amount"))
    w = f["vwap"]
    rank, corr, cov, std, mean, total = f.rank, f.corr, f.cov, f.std, f.mean, f.sum
    lag, delta, lo, hi, wma, pct = f.lag, f.delta, f.min, f.max, f.wma, f.pct
    ret = f.let(pct(c).sql, pct(c).stage)
    prev = lag(c)

    def share(x: X, n: int) -> X:
        return f.ts_rank(x, n) / float(n)

    def positive(x: X) -> X:
        return where(x > 0.0, x, 0.0 * x)

    def at_least(cond: X, x: X) -> X:
        """x where the condition holds, 0 elsewhere; NULL where x is."""
        return where(cond, x, 0.0 * x)

    hl2 = h * 0.5 + l * 0.5
    typical = (h + l + c) / 3.0
    d1 = delta(c)
    body = (2.0 * c - l - h) / (h - l)
    moved = greatest(delta(h).abs(), delta(l).abs())
    rise = h + l > lag(h + l)
    fall = h + l < lag(h + l)
    out: dict[str, X] = {}

    def add(n: int, x: X) -> None:
        out[f"alpha191_{n:03d}"] = x

    add(1, -corr(rank(delta(v.log())), rank(c / o), 6))
    add(2, -delta(body))
    gap3 = where(d1 > 0.0, c - least(prev, l), where(d1 < 0.0, c - greatest(prev, h), 0.0 * d1))
    add(3, total(gap3, 6))
    add(4, where((mean(c, 2) < mean(c, 8) - std(c, 8)) | (v / mean(v, 20) >= 1.0), 1.0 + 0.0 * c, -1.0 + 0.0 * c))
    add(5, -hi(corr(share(v, 5), share(h, 5), 5), 3))
    d6 = delta(o * 0.85 + h * 0.15, 4)
    add(6, -share(where(d6 > 1.0, 1.0 + 0.0 * d6, where(d6 < 1.0, -1.0 + 0.0 * d6, 0.0 * d6)), 4))
    add(7, (rank(hi(w - c, 3)) + rank(lo(w - c, 3))) * rank(delta(v, 3)))
    add(8, rank(-delta(h * 0.1 + l * 0.1 + w * 0.8, 4)))
    add(10, rank(hi(where(ret >= 0.0, c, std(ret, 20)).power(2.0), 5)))
    add(11, total(body * v, 6))
    add(12, -(rank(o - mean(w, 10)) * rank((c - w).abs())))
    add(13, (h * l).sqrt() - w)
    add(14, delta(c, 5))
    add(15, o / prev - 1.0)
    add(16, -hi(share(corr(rank(v), rank(w), 5), 5), 5))
    add(17, rank(w - hi(w, 15)).power(delta(c, 5)))
    add(18, c / lag(c, 5))
    add(19, where(c <= lag(c, 5), pct(c, 5), -pct(c, 5)))
    add(20, pct(c, 6) * 100.0)
    add(21, f.beta_sequence(mean(c, 6), 6))
    add(25, -rank(delta(c, 7) * (1.0 - rank(wma(v / mean(v, 20), 9)))) * (1.0 + rank(total(ret, 250))))
    add(26, mean(c, 7) - c + corr(w, lag(c, 5), 230))
    add(27, wma((pct(c, 3) + pct(c, 6)) * 100.0, 12))
    add(29, pct(c, 6) * v)
    add(31, (c / mean(c, 12) - 1.0) * 100.0)
    add(32, -total(rank(corr(rank(h), rank(v), 3)), 3))
    add(33, -delta(lo(l, 5), 5) * rank((total(ret, 240) - total(ret, 20)) / 220.0) * share(v, 5))
    add(34, mean(c, 12) / c)
    add(35, -least(rank(wma(delta(o), 15)), rank(wma(corr(o * 0.65 + c * 0.35, v, 17), 7))))
    add(36, rank(total(corr(rank(v), rank(w), 6), 2)))
    p37 = total(o, 5) * total(ret, 5)
    add(37, -rank(p37 - lag(p37, 10)))
    add(38, at_least(mean(h, 20) < h, -delta(h, 2)))
    add(39, rank(wma(corr(w * 0.3 + o * 0.7, total(mean(v, 180), 37), 14), 12)) - rank(wma(delta(c, 2), 8)))
    add(40, total(at_least(c > prev, v), 26) / total(at_least(c <= prev, v), 26) * 100.0)
    add(41, -rank(hi(delta(w, 3), 5)))
    add(42, -rank(std(h, 10)) * corr(h, v, 10))
    add(43, total(d1.sign() * v, 6))
    add(44, share(wma(corr(l, mean(v, 10), 7), 6), 4) + share(wma(delta(w, 3), 10), 5))
    add(45, rank(delta(c * 0.6 + o * 0.4)) * rank(corr(w, mean(v, 150), 15)))
    add(46, (mean(c, 3) + mean(c, 6) + mean(c, 12) + mean(c, 24)) / (4.0 * c))
    add(48, -rank(d1.sign() + lag(d1.sign(), 1) + lag(d1.sign(), 2)) * total(v, 5) / total(v, 20))
    up, down = total(at_least(rise, moved), 12), total(at_least(fall, moved), 12)
    add(49, down / (down + up))
    add(50, up / (up + down) - down / (up + down))
    add(51, up / (up + down))
    add(52, total(positive(h - lag(typical)), 26) / total(positive(lag(typical) - l), 26) * 100.0)
    add(53, total((d1 > 0.0).flag(), 12) / 12.0 * 100.0)
    add(54, -rank(std((c - o).abs(), 10) + (c - o) + corr(c, o, 10)))
    hc, lc, hpl, co = (h - prev).abs(), (l - prev).abs(), (h - lag(l)).abs(), (prev - lag(o)).abs()
    size55 = where((hc > lc) & (hc > hpl), hc + lc / 2.0 + co / 4.0, where((lc > hpl) & (lc > hc), lc + hc / 2.0 + co / 4.0, hpl + co / 4.0))
    add(55, total(16.0 * (c * 1.5 - o * 0.5 - lag(o)) / size55 * greatest(hc, lc), 20))
    add(56, (rank(o - lo(o, 12)) < rank(rank(corr(total(hl2, 19), total(mean(v, 40), 19), 13)).power(5.0))).flag())
    add(58, total((d1 > 0.0).flag(), 20) / 20.0 * 100.0)
    add(59, total(gap3, 20))
    add(60, total(body * v, 20))
    add(61, -greatest(rank(wma(delta(w), 12)), rank(wma(rank(corr(l, mean(v, 80), 8)), 17))))
    add(62, -corr(h, rank(v), 5))
    add(64, -greatest(rank(wma(corr(rank(w), rank(v), 4), 4)), rank(wma(hi(corr(rank(c), rank(mean(v, 60)), 4), 13), 14))))
    add(65, mean(c, 6) / c)
    add(66, (c / mean(c, 6) - 1.0) * 100.0)
    do = delta(o)
    dtm = total(at_least(do > 0.0, greatest(h - o, do)), 20)
    dbm = total(at_least(do < 0.0, greatest(o - l, do)), 20)
    add(69, where(dtm > dbm, (dtm - dbm) / dtm, where(dtm < dbm, (dtm - dbm) / dbm, 0.0 * dtm)))
    add(70, std(a, 6))
    add(71, (c / mean(c, 24) - 1.0) * 100.0)
    add(73, -(share(wma(wma(corr(c, v, 10), 16), 4), 5) - rank(wma(corr(w, mean(v, 30), 4), 3))))
    add(74, rank(corr(total(l * 0.35 + w * 0.65, 20), total(mean(v, 40), 20), 7)) + rank(corr(rank(w), rank(v), 6)))
    add(76, std(ret.abs() / v, 20) / mean(ret.abs() / v, 20))
    add(77, least(rank(wma(hl2 - w, 20)), rank(wma(corr(hl2, mean(v, 40), 3), 6))))
    add(78, (typical - mean(typical, 12)) / (0.015 * mean((c - mean(typical, 12)).abs(), 12)))
    add(80, pct(v, 5) * 100.0)
    add(83, -rank(cov(rank(h), rank(v), 5)))
    add(84, total(d1.sign() * v, 20))
    add(85, share(v / mean(v, 20), 20) * share(-delta(c, 7), 8))
    bend = lag(c, 20) * 0.1 + c * 0.1 - lag(c, 10) * 0.2
    add(86, where(bend > 0.25, -1.0 + 0.0 * c, where(bend < 0.0, 1.0 + 0.0 * c, -d1)))
    add(87, -(rank(wma(delta(w, 4), 7)) + share(wma((l - w) / (o - hl2), 11), 7)))
    add(88, pct(c, 20) * 100.0)
    add(90, -rank(corr(rank(w), rank(v), 5)))
    add(91, -(rank(c - hi(c, 5)) * rank(corr(mean(v, 40), l, 5))))
    add(92, -greatest(rank(wma(delta(c * 0.35 + w * 0.65, 2), 3)), share(wma(corr(mean(v, 180), c, 13).abs(), 5), 15)))
    add(93, total(at_least(do < 0.0, greatest(o - l, do)), 20))
    add(94, total(d1.sign() * v, 30))
    add(95, std(a, 20))
    add(97, std(v, 10))
    add(98, where(delta(mean(c, 100), 100) / lag(c, 100) <= 0.05, -(c - lo(c, 100)), -delta(c, 3)))
    add(99, -rank(cov(rank(c), rank(v), 5)))
    add(100, std(v, 20))
    add(101, -(rank(corr(c, total(mean(v, 30), 37), 15)) < rank(corr(rank(h * 0.1 + w * 0.9), rank(v), 11))).flag())
    add(103, f.argmin(l, 20) / 20.0 * 100.0)
    add(104, -(delta(corr(h, v, 5), 5) * rank(std(c, 20))))
    add(105, -corr(rank(o), rank(v), 10))
    add(106, delta(c, 20))
    add(107, -rank(o - lag(h)) * rank(o - prev) * rank(o - lag(l)))
    add(108, -(rank(h - lo(h, 2)).power(rank(corr(w, mean(v, 120), 6)))))
    add(110, total(positive(h - prev), 20) / total(positive(prev - l), 20) * 100.0)
    g, s = total(positive(d1), 12), total(positive(-d1), 12)
    add(112, (g - s) / (g + s) * 100.0)
    add(113, -(rank(mean(lag(c, 5), 20)) * corr(c, v, 2) * rank(corr(total(c, 5), total(c, 20), 2))))
    spread = (h - l) / mean(c, 5)
    add(114, rank(lag(spread, 2)) * rank(rank(v)) / (spread / (w - c)))
    add(115, rank(corr(h * 0.9 + c * 0.1, mean(v, 30), 10)).power(rank(corr(share(hl2, 4), share(v, 10), 7))))
    add(116, f.beta_sequence(c, 20))
    add(117, share(v, 32) * (1.0 - share(c + h - l, 16)) * (1.0 - share(ret, 32)))
    add(118, total(h - o, 20) / total(o - l, 20) * 100.0)
    add(119, rank(wma(corr(w, total(mean(v, 5), 26), 5), 7)) - rank(wma(share(lo(corr(rank(o), rank(mean(v, 15)), 21), 9), 7), 8)))
    add(120, rank(w - c) / rank(w + c))
    add(121, -(rank(w - lo(w, 12)).power(share(corr(share(w, 20), share(mean(v, 60), 2), 18), 3))))
    add(123, -(rank(corr(total(hl2, 20), total(mean(v, 60), 20), 9)) < rank(corr(l, v, 6))).flag())
    add(124, (c - w) / wma(rank(hi(c, 30)), 2))
    add(125, rank(wma(corr(w, mean(v, 80), 17), 20)) / rank(wma(delta(c * 0.5 + w * 0.5, 3), 16)))
    add(126, typical)
    far = (c / hi(c, 12) - 1.0) * 100.0
    add(127, mean(far * far, 12).sqrt())
    gain, loss = total(at_least(delta(typical) > 0.0, typical * v), 14), total(at_least(delta(typical) < 0.0, typical * v), 14)
    add(128, 100.0 - 100.0 / (1.0 + gain / loss))
    add(129, total(positive(-d1), 12))
    add(130, rank(wma(corr(hl2, mean(v, 40), 9), 10)) / rank(wma(corr(rank(w), rank(v), 7), 3)))
    add(131, rank(delta(w)).power(share(corr(c, mean(v, 50), 18), 18)))
    add(132, mean(a, 20))
    add(133, f.argmax(h, 20) * 5.0 - f.argmin(l, 20) * 5.0)
    add(134, pct(c, 12) * v)
    add(136, -rank(delta(ret, 3)) * corr(o, v, 10))
    add(137, 16.0 * (c * 1.5 - o * 0.5 - lag(o)) / size55 * greatest(hc, lc))
    add(138, -(rank(wma(delta(l * 0.7 + w * 0.3, 3), 20)) - share(wma(share(corr(share(l, 8), share(mean(v, 60), 17), 5), 19), 16), 7)))
    add(139, -corr(o, v, 10))
    _later(f, add)
    return out


def _later(f: Frame, add) -> None:
    """75, and 140 on."""
    o, h, l, c, v, a, w, bo, bc = (f[k] for k in ("open", "high", "low", "close", "volume", "amount", "vwap", "bm_open", "bm_close"))
    rank, corr, std, mean, total = f.rank, f.corr, f.std, f.mean, f.sum
    lag, delta, lo, hi, wma = f.lag, f.delta, f.min, f.max, f.wma
    ret = f.let(f.pct(c, 1).sql, f.pct(c, 1).stage)
    prev, d1 = lag(c), delta(c)

    def share(x: X, n: int) -> X:
        return f.ts_rank(x, n) / float(n)

    def only(cond: X, x: X) -> X:
        return where(cond, x, 0.0 * x)

    true_range = greatest(greatest(h - l, (prev - h).abs()), (prev - l).abs())
    lower = (bc < bo).flag()
    days = total(lower, 50)
    add(75, where(days.eq(0.0), days, total(((c > o) & (bc < bo)).flag(), 50) / days))
    heads = wma(rank(o) + rank(l) - rank(h) - rank(c), 8)
    add(140, least(rank(heads), share(wma(corr(share(c, 8), share(mean(v, 60), 20), 8), 7), 3)))
    add(141, -rank(corr(rank(mean(v, 15)), rank(h), 9)))
    add(142, -(rank(share(c, 10)) * rank(delta(d1)) * rank(share(v / mean(v, 20), 5))))
    add(143, where(d1 > 0.0, (1.0 + ret) * c, c))
    add(144, total(only(d1 < 0.0, ret.abs() / a), 20) / total((d1 < 0.0).flag(), 20))
    add(145, (mean(v, 9) - mean(v, 26)) / mean(v, 12) * 100.0)
    add(147, f.beta_sequence(mean(c, 12), 12))
    add(148, rank(corr(total(mean(v, 60), 9), o, 6)) - rank(o - lo(o, 14)))
    bm = f.let(f.pct(bc, 1).sql, f.pct(bc, 1).stage)
    add(149, total(only(bm < 0.0, ret * bm), 252) / total(only(bm < 0.0, bm * bm), 252))
    add(150, (c + h + l) / 3.0 * v)
    add(153, (mean(c, 3) + mean(c, 6) + mean(c, 12) + mean(c, 24)) / 4.0)
    add(154, corr(mean(v, 180), w, 18) - (w - lo(w, 16)))
    low_part = o * 0.15 + l * 0.85
    add(156, -greatest(wma(delta(w, 5), 3), wma(-(delta(low_part, 2) / low_part), 3)))
    add(157, lo(rank(lo(rank(-rank(delta(c - 1.0, 5))), 2).log()), 5) + share(lag(-ret, 6), 5))
    add(158, (h - l) / c)
    floor_, roof = least(l, prev), greatest(h, prev)
    parts = [(c - total(floor_, n)) / total(roof - floor_, n) * float(k) for n, k in ((6, 12 * 24), (12, 6 * 24), (24, 6 * 12))]
    add(159, (parts[0] + parts[1] + parts[2]) * 100.0 / float(12 * 6 + 6 * 24 + 12 * 24))
    add(161, mean(true_range, 12))
    add(163, -(ret * mean(v, 20) * w * (h - c)))
    for number, n in ((165, 48), (183, 24)):
        sums = total(c - mean(c, n), n)
        add(number, hi(sums, n) - lo(sums, n) / std(c, n))
    add(166, total(ret - mean(ret, 20), 20) * (-20 * 19**1.5) / (total((c / prev) * (c / prev), 20).power(1.5) * float(19 * 18)))
    add(167, total(only(d1 > 0.0, d1), 12))
    add(168, -(v / mean(v, 20)))
    add(170, rank(1.0 / c) * v / mean(v, 20) * (rank(h - c) * h / (total(h, 5) / 5.0)) - rank(delta(w, 5)))
    add(171, -((l - c) * o.power(5.0)) / ((c - h) * c.power(5.0)))
    rise, fall = delta(h), -delta(l)
    down, up = (total(only((x > 0.0) & (x > y), x), 14) * 100.0 / total(true_range, 14) for x, y in ((fall, rise), (rise, fall)))
    add(172, mean(((down - up) / (down + up)).abs(), 6) * 100.0)
    add(175, mean(true_range, 6))
    add(176, corr(rank((c - lo(l, 12)) / (hi(h, 12) - lo(l, 12))), rank(v), 6))
    add(177, f.argmax(h, 20) * 5.0)
    add(178, ret * v)
    add(179, rank(corr(a / v, v, 4)) * rank(corr(rank(mean(v, 50)), rank(l), 12)))
    d7 = delta(c, 7)
    add(180, where(mean(v, 20) < v, -(share(d7.abs(), 60) * d7.sign()), -v))
    log_bm, log_c = bc.log(), c.log()
    away = log_bm - mean(log_bm, 20)
    growth = log_c / lag(log_c) - 1.0
    add(181, total(growth - mean(growth, 20) - away * away, 20) / total(away * away * away, 20))
    add(182, mean((((c > o) & (bc > bo)) | ((c < o) & (bc < bo))).flag(), 20))
    add(184, rank(corr(lag(o - c), c, 200)) + rank(o - c))
    add(185, -((1.0 - o / c) * (1.0 - o / c)))
    plus, minus = d1.fill(0.0), delta(l).fill(0.0)
    plus, minus = where((plus < minus) | (plus < 0.0), 0.0 * plus, plus), where((minus < plus) | (minus < 0.0), 0.0 * minus, minus)
    reach = where(prev.sign().abs() > 0.0, greatest(greatest(h - l, h - prev), l - prev), h - l)
    plus, minus = (total(x, 14) * 100.0 / total(reach, 14) for x in (plus, minus))
    adx = mean((plus - minus).abs() / (plus + minus) * 100.0, 6)
    add(186, (adx + lag(adx)) / 2.0)
    add(187, total(only(delta(o) > 0.0, greatest(h - o, delta(o))), 20))
    add(189, mean((c - mean(c, 6)).abs(), 6))
    pace = (c / lag(c, 19)).power(0.05) - 1.0
    over, under = only(ret > pace, ret - pace), only(ret < pace, ret - pace)
    n_over, n_under = total((ret > pace).flag(), 20), total((ret < pace).flag(), 20)
    add(190, ((n_over - 1.0) * total(under * under, 20) / n_under / total(over * over, 20)).log())
    add(191, corr(mean(v, 20), l, 5) + h * 0.5 + l * 0.5 - c)


def recursive(f: Frame) -> dict[str, X]:
    """Those with recursive means of weight m / n."""
    h, l, c, v = (f[k] for k in ("high", "low", "close", "volume"))
    e, lag, delta, hi, lo = f.ewm, f.lag, f.delta, f.max, f.min
    d1, hl = delta(c), (h + l) * 0.5

    def positive(x: X) -> X:
        return where(x > 0.0, x, 0.0 * x)

    def place(n: int) -> X:
        return (c - lo(l, n)) / (hi(h, n) - lo(l, n)) * 100.0

    def room(n: int) -> X:
        return (hi(h, n) - c) / (hi(h, n) - lo(l, n)) * 100.0

    def strength(x: X, n: int) -> X:
        return e(positive(delta(x)), 1 / n) / e(delta(x).abs(), 1 / n) * 100.0

    k, slow = e(place(9), 1 / 3), e(place(9), 1 / 3, 3)
    sd = f.std(c, 20)
    up, down = where(d1 > 0.0, sd, 0.0 * sd), where(d1 <= 0.0, sd, 0.0 * sd)
    macd = e(c, 2 / 13) - e(c, 2 / 27)
    log3 = e(e(e(c.log(), 2 / 13), 2 / 13), 2 / 13)
    flow = v * (c * 2.0 - l - h) / (h - l)
    ret = f.pct(c, 1)
    drift = e(ret, 2 / 61)
    excess = ret - drift
    step = e(lag(c / lag(c, 9)), 1 / 9)
    half = e(v, 2 / 13) - e(v, 2 / 27)
    force = strength(c, 12)
    inverse = where(d1 > 0.0, 1.0 / d1, 1.0 + 0.0 * d1)
    smooth = e(c, 2 / 13)

    def gap(x: X, n: int) -> X:
        return e(f.mean(lag(x), 12) - f.mean(lag(x), 26), 1 / n)

    named = {
        146: f.mean(excess, 20) * excess / e(drift * drift, 1 / 60), 151: e(delta(c, 20), 1 / 20), 152: gap(step, 9), 155: half - e(half, 2 / 10), 160: e(down, 1 / 20),
        162: (force - lo(force, 12)) / (hi(force, 12) - lo(force, 12)), 164: e((inverse - lo(inverse, 12)) / (h - l) * 100.0, 2 / 13), 169: gap(e(d1, 1 / 9), 10),
        188: ((h - l) / e(h - l, 2 / 11) - 1.0) * 100.0, 173: 3.0 * smooth - 2.0 * e(smooth, 2 / 13) + log3, 174: e(up, 1 / 20),
        9: e((hl - lag(hl)) * (h - l) / v, 2 / 7), 22: e(delta(c / f.mean(c, 6) - 1.0, 3), 1 / 12), 23: e(up, 1 / 20) / (e(up, 1 / 20) + e(down, 1 / 20)) * 100.0, 24: e(delta(c, 5), 1 / 5),
        28: 3.0 * slow - 2.0 * e(slow, 1 / 3), 47: e(room(6), 1 / 9), 57: slow, 63: strength(c, 6), 67: strength(c, 24), 68: e((delta(h) * 0.5 + delta(l) * 0.5) * (h - l) / v, 2 / 15),
        72: e(room(6), 1 / 15), 79: strength(c, 12), 81: e(v, 2 / 21), 82: e(room(6), 1 / 20), 89: 2.0 * (macd - e(macd, 2 / 10)), 96: e(slow, 1 / 3, 3), 102: strength(v, 6),
        109: e(h - l, 2 / 10) / e(e(h - l, 2 / 10), 2 / 10), 111: e(flow, 2 / 11) - e(flow, 2 / 4), 122: log3 / lag(log3) - 1.0, 135: e(lag(c / lag(c, 20)), 1 / 20),
    }
    return {f"alpha191_{n:03d}": x for n, x in named.items()}
