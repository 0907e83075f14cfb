"""The published 101 formulaic alphas, over one instrument's history.

rank is the percent rank within the instrument's whole history (set ``by`` of
the frame's key to a date column for the cross-sectional form); comparisons
give -1 or 0 (alphas that end in ``flag``) as in the usual implementations.
"""

from __future__ import annotations

from ..rolling import Frame, X, where


def factors(f: Frame) -> dict[str, X]:
    o, h, l, c, v = f["open"], f["high"], f["low"], f["close"], f["volume"]
    vwap, cap, ind = f["vwap"], f["cap"], f["ind"]
    ret = f.let(f.pct(c).sql, f.pct(c).stage)
    rank, scale, corr, cov, std, mean, total = f.rank, f.scale, f.corr, f.cov, f.std, f.mean, f.sum
    lag, delta, lo, hi, tsr, dec = f.lag, f.delta, f.min, f.max, f.ts_rank, f.decay
    zero = lambda x: x.fill(0.0)
    flag = lambda cond: -cond.flag()

    def adv(n: int) -> X:
        return mean(v, n)

    def mix(a: X, b: X, w: float) -> X:
        return a * w + b * (1 - w)

    def curve() -> X:
        return (lag(c, 20) - lag(c, 10)) / 10.0 - (lag(c, 10) - c) / 10.0

    def larger(a: X, b: X) -> X:
        return where(a < b, b, a)

    def smaller(a: X, b: X) -> X:
        return where(a > b, b, a)

    hl2 = (h + l) / 2.0
    d1 = delta(c, 1)
    out: dict[str, X] = {}
    add = out.__setitem__
    add("alpha001", rank(f.argmax(where(ret < 0.0, std(ret, 20), c).power(2.0), 5)) - 0.5)
    add("alpha002", -corr(rank(delta(v.log(), 2)), rank((c - o) / o), 6))
    add("alpha003", -corr(rank(o), rank(v), 10))
    add("alpha004", -tsr(rank(l), 9))
    add("alpha005", rank(o - mean(vwap, 10)) * -(rank(c - vwap).abs()))
    add("alpha006", -corr(o, v, 10))
    add("alpha007", where(adv(20) >= v, -1.0 + 0.0 * v, -tsr(delta(c, 7).abs(), 60) * delta(c, 7).sign()))
    pair = total(o, 5) * total(ret, 5)
    add("alpha008", -rank(pair - lag(pair, 10)))
    add("alpha009", where((lo(d1, 5) > 0.0) | (hi(d1, 5) < 0.0), d1, -d1))
    add("alpha010", rank(where((lo(d1, 4) > 0.0) | (hi(d1, 4) < 0.0), d1, -d1)))
    add("alpha011", (rank(hi(vwap - c, 3)) + rank(lo(vwap - c, 3))) * rank(delta(v, 3)))
    add("alpha012", delta(v, 1).sign() * -d1)
    add("alpha013", -rank(cov(rank(c), rank(v), 5)))
    add("alpha014", zero(corr(o, v, 10)) * -rank(delta(ret, 3)))
    add("alpha015", -total(rank(zero(corr(rank(h), rank(v), 3))), 3))
    add("alpha016", -rank(cov(rank(h), rank(v), 5)))
    add("alpha017", -(rank(tsr(c, 10)) * rank(delta(d1, 1)) * rank(tsr(v / adv(20), 5))))
    add("alpha018", -rank(std((c - o).abs(), 5) + (c - o) + zero(corr(c, o, 10))))
    add("alpha019", -((c - lag(c, 7) + delta(c, 7)).sign()) * (1.0 + rank(1.0 + total(ret, 250))))
    add("alpha020", -(rank(o - lag(h)) * rank(o - lag(c)) * rank(o - lag(l))))
    add("alpha021", where((mean(c, 8) + std(c, 8) < mean(c, 2)) | (adv(20) / v < 1.0), -1.0 + 0.0 * c, 1.0 + 0.0 * c))
    add("alpha022", -delta(zero(corr(h, v, 5)), 5) * rank(std(c, 20)))
    add("alpha023", where(mean(h, 20) < h, -zero(delta(h, 2)), 0.0 * c))
    add("alpha024", where(delta(mean(c, 100), 100) / lag(c, 100) <= 0.05, -(c - lo(c, 100)), -delta(c, 3)))
    add("alpha025", rank(-ret * adv(20) * vwap * (h - c)))
    add("alpha026", -hi(zero(corr(tsr(v, 5), tsr(h, 5), 5)), 3))
    r27 = rank(mean(corr(rank(v), rank(vwap), 6), 2) / 2.0)
    add("alpha027", where(r27 > 0.5, -1.0 + 0.0 * r27, where(r27 <= 0.5, 1.0 + 0.0 * r27, r27)))
    add("alpha028", scale(zero(corr(adv(20), l, 5)) + hl2 - c))
    add("alpha029", lo(rank(rank(scale(total(rank(rank(-rank(delta(c - 1.0, 5)))), 2).log()))), 5) + tsr(lag(-ret, 6), 5))
    add("alpha030", (1.0 - rank(d1.sign() + lag(d1, 1).sign() + lag(d1, 2).sign())) * total(v, 5) / total(v, 20))
    add("alpha031", rank(rank(rank(dec(-rank(rank(delta(c, 10))), 10)))) + rank(-delta(c, 3)) + scale(zero(corr(adv(20), l, 12))).sign())
    add("alpha032", scale(mean(c, 7) - c) + 20.0 * scale(zero(corr(vwap, lag(c, 5), 230))))
    add("alpha033", rank(-1.0 + o / c))
    add("alpha034", rank(2.0 - rank(zero(std(ret, 2) / std(ret, 5))) - rank(d1)))
    add("alpha035", zero(tsr(v, 32) * (1.0 - tsr(c + h - l, 16)) * (1.0 - tsr(ret, 32))))
    add("alpha036", 2.21 * rank(corr(c - o, lag(v), 15)) + 0.7 * rank(o - c) + 0.73 * rank(tsr(lag(-ret, 6), 5)) + rank(corr(vwap, adv(20), 6).abs()) + 0.6 * rank((mean(c, 200) - o) * (c - o)))
    add("alpha037", rank(corr(lag(o - c), c, 200)) + rank(o - c))
    add("alpha038", -rank(tsr(o, 10)) * rank(zero(c / o)))
    add("alpha039", -rank(delta(c, 7)) * (1.0 - rank(dec(v / adv(20), 9))) * (1.0 + rank(total(ret, 250))))
    add("alpha040", -rank(std(h, 10)) * corr(h, v, 10))
    add("alpha041", (h * l).sqrt() - vwap)
    add("alpha042", rank(vwap - c) / rank(vwap + c))
    add("alpha043", tsr(v / adv(20), 20) * tsr(-delta(c, 7), 8))
    add("alpha044", -corr(h, rank(v), 5))
    add("alpha045", -(rank(mean(lag(c, 5), 20)) * zero(corr(c, v, 2)) * rank(corr(total(c, 5), total(c, 20), 2))))
    add("alpha046", where(curve() > 0.25, -1.0 + 0.0 * c, where(curve() < 0.0, 1.0 + 0.0 * c, -d1)))
    add("alpha047", rank(1.0 / c) * v / adv(20) * (h * rank(h - c) / mean(h, 5)) - rank(vwap - lag(vwap, 5)))
    add("alpha048", corr(d1, delta(lag(c), 1), 250) * d1 / c / total((d1 / lag(c)).power(2.0), 250))
    add("alpha049", where(curve() < -0.1, 1.0 + 0.0 * c, -d1))
    add("alpha050", -hi(rank(corr(rank(v), rank(vwap), 5)), 5))
    add("alpha051", where(curve() < -0.05, 1.0 + 0.0 * c, -d1))
    add("alpha052", -delta(lo(l, 5), 5) * rank((total(ret, 240) - total(ret, 20)) / 220.0) * tsr(v, 5))
    add("alpha053", -delta(((c - l) - (h - c)) / (c - l).zero_as(0.0001), 9))
    add("alpha054", -(l - c) * o.power(5.0) / ((l - h).zero_as(-0.0001) * c.power(5.0)))
    add("alpha055", -corr(rank((c - lo(l, 12)) / (hi(h, 12) - lo(l, 12)).zero_as(0.0001)), rank(v), 6))
    add("alpha056", -(rank(mean(ret, 10) / mean(mean(ret, 2), 3)) * rank(ret * cap)))
    add("alpha057", -((c - vwap) / dec(rank(f.argmax(c, 30)), 2)))
    add("alpha060", -(2.0 * scale(rank(((c - l) - (h - c)) * v / (h - l).zero_as(0.0001))) - scale(rank(f.argmax(c, 10)))))
    add("alpha061", (rank(vwap - lo(vwap, 16)) < rank(corr(vwap, adv(180), 18))).flag())
    add("alpha062", flag(rank(corr(vwap, total(adv(20), 22), 10)) < rank((rank(o) + rank(o) < rank(hl2) + rank(h)).flag())))
    add("alpha064", flag(rank(corr(total(mix(o, l, 0.178404), 13), total(adv(120), 13), 17)) < rank(delta(mix(hl2, vwap, 0.178404), 3))))
    add("alpha065", flag(rank(corr(mix(o, vwap, 0.00817205), total(adv(60), 9), 6)) < rank(o - lo(o, 14))))
    add("alpha066", -(rank(dec(delta(vwap, 4), 7)) + tsr(dec((mix(l, l, 0.96633) - vwap) / (o - hl2), 11), 7)))
    add("alpha068", flag(tsr(corr(rank(h), rank(adv(15)), 9), 14) < rank(delta(mix(c, l, 0.518371), 1))))
    add("alpha071", larger(tsr(dec(corr(tsr(c, 3), tsr(adv(180), 12), 18), 4), 16), tsr(dec(rank((l + o) - (vwap + vwap)).power(2.0), 16), 4)))
    add("alpha072", rank(dec(corr(hl2, adv(40), 9), 10)) / rank(dec(corr(tsr(vwap, 4), tsr(v, 19), 7), 3)).zero_as(0.0001))
    m73 = mix(o, l, 0.147155)
    add("alpha073", -larger(rank(dec(delta(vwap, 5), 3)), tsr(dec(-(delta(m73, 2) / m73), 3), 17)))
    add("alpha074", flag(rank(corr(c, total(adv(30), 37), 15)) < rank(corr(rank(mix(h, vwap, 0.0261661)), rank(v), 11))))
    add("alpha075", (rank(corr(vwap, v, 4)) < rank(corr(rank(l), rank(adv(50)), 12))).flag())
    add("alpha077", smaller(rank(dec(hl2 + h - (vwap + h), 20)), rank(dec(corr(hl2, adv(40), 3), 6))))
    add("alpha078", rank(corr(total(mix(l, vwap, 0.352233), 20), total(adv(40), 20), 7)).power(rank(corr(rank(vwap), rank(v), 6))))
    add("alpha081", flag(rank(f.product(rank(rank(corr(vwap, total(adv(10), 50), 8)).power(4.0)), 15).log()) < rank(corr(rank(vwap), rank(v), 5))))
    spread = (h - l) / mean(c, 5)
    add("alpha083", rank(lag(spread, 2)) * rank(rank(v)) / (spread / (vwap - c)))
    add("alpha084", tsr(vwap - hi(vwap, 15), 21).power(delta(c, 5)))
    add("alpha085", rank(corr(mix(h, c, 0.876703), adv(30), 10)).power(rank(corr(tsr(hl2, 4), tsr(v, 10), 7))))
    add("alpha086", flag(tsr(corr(c, mean(adv(20), 15), 6), 20) < rank((o + c) - (vwap + o))))
    add("alpha088", smaller(rank(dec((rank(o) + rank(l)) - (rank(h) + rank(c)), 8)), tsr(dec(corr(tsr(c, 8), tsr(adv(60), 21), 8), 7), 3)))
    add("alpha092", smaller(tsr(dec((hl2 + c < l + o).flag(), 15), 19), tsr(dec(corr(rank(l), rank(adv(30)), 8), 7), 7)))
    add("alpha094", -(rank(vwap - lo(vwap, 12)).power(tsr(corr(tsr(vwap, 20), tsr(adv(60), 4), 18), 3))))
    add("alpha095", (rank(o - lo(o, 12)) < tsr(rank(corr(mean(hl2, 19), mean(adv(40), 19), 13)).power(5.0), 12)).flag())
    add("alpha096", larger(tsr(dec(corr(rank(vwap), rank(v), 4), 4), 8), tsr(dec(f.argmax(corr(tsr(c, 7), tsr(adv(60), 4), 4), 13), 14), 13)))
    add("alpha098", rank(dec(corr(vwap, mean(adv(5), 26), 5), 7)) - rank(dec(tsr(f.argmin(corr(rank(o), rank(adv(15)), 21), 9), 7), 8)))
    add("alpha099", flag(rank(corr(total(hl2, 20), total(adv(60), 20), 9)) < rank(corr(l, v, 6))))
    add("alpha101", (c - o) / (h - l + 0.001))

    # With inputs neutralised on the sector's price.
    free = lambda x: f.neutralize(x, ind)
    fc, fv = free(c), free(vwap)
    add("alpha058", -tsr(dec(corr(fv, v, 4), 8), 6))
    add("alpha059", -tsr(dec(corr(fv, v, 4), 16), 8))
    add("alpha063", -(rank(dec(delta(fc, 2), 8)) - rank(dec(corr(mix(vwap, o, 0.318108), total(zero(adv(180)), 37), 14), 12))))
    add("alpha067", -(rank(h - lo(h, 2)).power(rank(corr(fv, free(adv(20)), 6)))))
    add("alpha069", -(rank(hi(delta(fv, 3), 5)).power(tsr(corr(mix(c, vwap, 0.490655), adv(20), 5), 9))))
    add("alpha070", -(rank(delta(vwap, 1)).power(tsr(corr(fc, zero(adv(50)), 18), 18))))
    add("alpha076", larger(rank(dec(delta(vwap, 1), 12)), tsr(dec(tsr(corr(free(l), zero(adv(81)), 8), 20), 17), 19)))
    add("alpha079", flag(rank(delta(free(mix(c, o, 0.60733)), 1)) < rank(corr(tsr(vwap, 4), tsr(zero(adv(150)), 9), 15))))
    add("alpha080", -(rank(delta(free(mix(o, h, 0.868128)), 4).sign()).power(tsr(corr(h, adv(10), 5), 6))))
    add("alpha082", -smaller(rank(dec(delta(o, 1), 15)), tsr(dec(corr(free(v), o, 17), 7), 13)))
    add("alpha087", -larger(rank(dec(delta(mix(c, vwap, 0.369701), 2), 3)), tsr(dec(corr(free(adv(81)), c, 13).abs(), 5), 14)))
    add("alpha089", tsr(dec(corr(l, adv(10), 7), 6), 4) - tsr(dec(delta(fv, 3), 10), 15))
    add("alpha090", -(rank(c - hi(c, 5)).power(tsr(corr(free(adv(40)), l, 5), 3))))
    add("alpha091", -(tsr(dec(dec(corr(fc, v, 10), 16), 4), 5) - rank(dec(corr(vwap, adv(30), 4), 3))))
    add("alpha093", tsr(dec(corr(fv, zero(adv(81)), 17), 20), 8) / rank(dec(delta(mix(c, vwap, 0.524434), 3), 16)))
    add("alpha097", -(rank(dec(delta(free(mix(l, vwap, 0.721001)), 3), 20)) - tsr(dec(tsr(corr(tsr(l, 8), tsr(zero(adv(60)), 17), 5), 19), 16), 7)))
    r100 = free(rank(((c - l) - (h - c)) / (h - l) * v))
    add("alpha100", -(1.5 * scale(free(r100)) - scale(free(corr(c, rank(adv(20)), 5) - rank(f.argmin(c, 30))))) * (v / adv(20)))
    return dict(sorted(out.items()))
