"""Trades by the Hurst exponent: mean reversion where it is low, trend following where it is high.

Thresholds adapt to the quantiles of the last 100 exponents, the regime of the
60 prices before shifts them, the last seven exponents must agree, and moving
averages, the RSI and the momentum confirm. All of that is window expressions
in one exchange by key; only the position passes as a machine, in sorted
batches, with its entry and the range of prices it is stopped at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carried import carried
from .reversion import simple_rsi

# Fixed values of the published strategy.
LOOKBACK, LEAST_VALUES, CONSISTENT, NEED = 100, 10, 7, 4
LOW, HIGH = (0.25, 0.35), (0.65, 0.85)


@dataclass(frozen=True)
class HurstRules:
    """Windows, thresholds before there are enough exponents, and stops in multiples of the ATR.

    ``by_type``: positions also leave when the exponent turns against the kind
    of their entry and when they are stale, and reversions take profit sooner."""

    window: int = 90
    low: float = 0.32
    high: float = 0.62
    short: int = 8
    long: int = 34
    atr: int = 14
    stop: float = 2.5
    profit: float = 5.0
    by_type: bool = False


def _quantile(values: Column, q: float) -> Column:
    """Of a sorted array, by linear interpolation."""
    at = (F.size(values) - 1) * q
    low = F.floor(at).cast("int")
    a, b = F.get(values, low), F.get(values, F.least(low + 1, F.size(values) - 1))
    return a + (b - a) * (at - low)


def thresholds(known: DataFrame, rules: HurstRules, key: str, order: str) -> DataFrame:
    """Adds mr and tr, the exponents below and above which reversion and trend are looked for, and regime."""
    along = Window.partitionBy(key).orderBy(order)
    last = along.rowsBetween(-LOOKBACK, -1)
    known = known.withColumn("__h", F.sort_array(F.collect_list("hurst").over(last))).withColumn("__s", F.stddev_samp("hurst").over(last))
    adapted = (F.col("__i") >= LOOKBACK) & (F.size("__h") >= LEAST_VALUES)
    low = F.greatest(F.lit(LOW[0]), F.least(F.lit(LOW[1]), _quantile(F.col("__h"), 0.1)))
    high = F.greatest(F.lit(HIGH[0]), F.least(F.lit(HIGH[1]), _quantile(F.col("__h"), 0.9)))
    gap = 0.25 * F.least(F.lit(2.0), F.greatest(F.lit(1.0), 1 + 3 * F.col("__s")))
    known = known.withColumns({"__l": low, "__u": high, "__g": gap})
    near = F.col("__u") - F.col("__l") < F.col("__g")
    known = known.withColumn("mr", F.when(near, F.greatest(F.lit(0.2), (F.col("__l") + F.col("__u") - F.col("__g")) / 2)).otherwise(F.col("__l")))
    known = known.withColumn("tr", F.when(near, F.least(F.lit(0.9), F.col("mr") + F.col("__g"))).otherwise(F.col("__u")))
    known = known.withColumn("mr", F.when(adapted, F.col("mr")).otherwise(rules.low)).withColumn("tr", F.when(adapted, F.col("tr")).otherwise(rules.high))
    # Of the 60 prices before a row: 59 returns, 58 pairs of them.
    prices, moves, pairs = (along.rowsBetween(-n, -1) for n in (60, 59, 58))
    r2, slope = F.regr_r2("close", "__t").over(prices), F.regr_slope("close", "__t").over(prices)
    known = known.withColumn("__before", F.lag("__r").over(along)).withColumns({"__vol": F.stddev_samp("__r").over(moves) * 252**0.5, "__r2": r2, "__slope": slope, "__auto": F.corr("__r", "__before").over(pairs)})
    regime = F.when(F.col("__vol") > 0.4, "volatile").when(F.col("__r2") > 0.6, "trending").when(F.col("__auto") < -0.2, "mean_reverting").otherwise("neutral")
    known = known.withColumn("regime", F.when(F.col("__i") >= 60 + rules.window, regime).otherwise("unknown"))
    low = F.when(F.col("regime") == "mean_reverting", F.least(F.lit(0.42), F.col("mr") + 0.03)).when(F.col("regime") == "volatile", F.greatest(F.lit(0.25), F.col("mr") - 0.05)).otherwise(F.col("mr"))
    high = F.when(F.col("regime") == "trending", F.greatest(F.lit(0.51), F.col("tr") - 0.03)).when(F.col("regime") == "volatile", F.least(F.lit(0.65), F.col("tr") + 0.05)).otherwise(F.col("tr"))
    return known.withColumns({"mr": low, "tr": high})


def entries(prices: DataFrame, hurst: DataFrame, rules: HurstRules = HurstRules(), key: str = "ticker", order: str = "date") -> DataFrame:  # noqa: B008
    """key, order, close, hurst, atr, mr, tr, regime, and signal: 1 or -1 where a position may begin; kind: 1 reversion, 2 trend."""
    along = Window.partitionBy(key).orderBy(order)

    def mean(x: str, n: int) -> Column:
        w = along.rowsBetween(-(n - 1), 0)
        return F.when(F.count(x).over(w) == n, F.avg(x).over(w))

    before = F.lag("close").over(along)
    span = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    joined = simple_rsi(prices, 14, key=key, order=order).drop("signal").join(hurst.select(key, order, "hurst"), [key, order], "left")
    known = joined.withColumns({"__i": F.row_number().over(along) - 1, "__r": F.try_divide("close", before) - 1, "__tr": span})
    known = known.withColumns({"__t": F.col("__i").cast("double"), "atr": mean("__tr", rules.atr), "__short": mean("close", rules.short), "__long": mean("close", rules.long)})
    known = thresholds(known, rules, key, order)
    recent = F.collect_list("hurst").over(along.rowsBetween(-CONSISTENT, -1))
    known = known.withColumns({"__seven": recent, "__m10": (F.try_divide("close", F.lag("close", 10).over(along)) - 1) * 100, "__m50": (F.try_divide("close", F.lag("close", 50).over(along)) - 1) * 100})
    few = F.size("__seven") < NEED
    low, high = F.col("hurst") < F.col("mr"), F.col("hurst") > F.col("tr")
    steady_low = few | F.forall("__seven", lambda h: h < F.col("mr") + 0.03)
    steady_high = few | F.forall("__seven", lambda h: h > F.col("tr") - 0.03)
    momentum, bull, bear = F.coalesce("__m10", F.lit(0.0)), F.coalesce(F.col("__m50") > 5, F.lit(False)), F.coalesce(F.col("__m50") < -5, F.lit(False))
    c, short, long = F.col("close"), F.col("__short"), F.col("__long")
    back = F.when((c > short * 1.015) & (F.col("rsi") > 75), -1).when((c < short * 0.985) & (F.col("rsi") < 25), 1)
    follow = F.when((short > long * 1.01) & (momentum > 1.5) & (~bear | (momentum > 3)), 1).when((short < long * 0.99) & (momentum < -1.5) & (~bull | (momentum < -3)), -1)
    ready = (F.col("__i") >= max(rules.window, rules.long)) & F.col("hurst").isNotNull()
    signal = F.when(low & steady_low, back).when(high & ~low & steady_high, follow)
    return known.select(
        key, order, "close", "hurst", "atr", "mr", "tr", "regime", ready.alias("ready"),
        F.when(ready, F.coalesce(signal, F.lit(0))).otherwise(0).alias("signal"), F.when(low, 1).when(high, 2).otherwise(0).alias("kind"),
    )


class HurstMachine:
    """One key's position, its entry, its kind and the rows it is held."""

    def __init__(self, rules: HurstRules):
        self.rules, self.position, self.entry, self.kind, self.held = rules, 0, 0.0, 0, 0

    def _leaves(self, close: float, atr: float, hurst: float) -> bool:
        side, rules = self.position, self.rules
        gain = side * (close - self.entry) / self.entry
        reversion = rules.by_type and self.kind == 1
        if rules.by_type and ((self.kind == 2 and hurst < rules.high - 0.15) or (self.kind == 1 and hurst > rules.low + 0.15)):
            return True
        if gain > 0.03:
            stop = side * max(side * self.entry, side * (close - side * 0.4 * rules.stop * atr))
        elif gain > 0.015:
            stop = side * max(side * self.entry * (1 - side * 0.002), side * (close - side * 0.6 * rules.stop * atr))
        else:
            stop = self.entry - side * rules.stop * atr
        target = self.entry + side * (1.8 if reversion else rules.profit) * atr
        if rules.by_type:
            most = 8 if reversion else 15
            if (self.held > most and gain < 0.01) or self.held > 1.5 * most:
                return True
        return side * close <= side * stop or side * close >= side * target

    def step(self, ready: bool, close: float, hurst: float, atr: float, signal: int, kind: int) -> int:
        if not ready:
            return 0
        if self.position:
            self.held += 1
            if not np.isnan(atr) and self._leaves(close, atr, hurst):
                self.position = 0
        elif signal:
            self.position, self.entry, self.kind, self.held = signal, close, kind, 0
        return self.position

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        columns = [rows[c].to_numpy() for c in ("ready", "close", "hurst", "atr", "signal", "kind")]
        position = [self.step(bool(r), float(c), float(h), float(a), int(s), int(k)) for r, c, h, a, s, k in zip(*columns, strict=True)]
        return rows.drop(columns=["ready", "atr", "signal", "kind"]).assign(position=np.array(position, np.int32))


def hurst_strategy(prices: DataFrame, hurst: DataFrame, rules: HurstRules = HurstRules(), key: str = "ticker", order: str = "date") -> DataFrame:  # noqa: B008
    """key, order, close, hurst, mr, tr, regime, position and strategy_return (yesterday's position times the return).

    prices: key, order, high, low, close; hurst: key, order, hurst (rows without one stay flat)."""
    placed = entries(prices, hurst, rules, key, order)
    kinds = dict(placed.dtypes)
    kept = [key, order, "close", "hurst", "mr", "tr", "regime"]
    found = carried(placed.select(*kept, "ready", "atr", "signal", "kind"), [key], [order], lambda: HurstMachine(rules), ", ".join(f"{c} {kinds[c]}" for c in kept) + ", position int")
    along = Window.partitionBy(key).orderBy(order)
    made = F.lag("position").over(along) * (F.try_divide("close", F.lag("close").over(along)) - 1)
    return found.withColumn("strategy_return", F.coalesce(made, F.lit(0.0)))


def evaluate(trades: DataFrame, key: str = "ticker") -> DataFrame:
    """Per key and side of the position: days, total and mean return, annual volatility and Sharpe ratio, share of days that earn."""
    side = F.when(F.col("__held") > 0, "long").when(F.col("__held") < 0, "short").otherwise("flat")
    held = trades.withColumn("__held", F.lag("position").over(Window.partitionBy(key).orderBy("date"))).withColumn("side", side)
    r = F.col("strategy_return")
    return held.groupBy(key, "side").agg(
        F.count("*").alias("days"), (F.product(1 + r) - 1).alias("total"), F.avg(r).alias("mean"), (F.stddev_samp(r) * 252**0.5).alias("volatility"),
        F.try_divide(F.avg(r) * 252**0.5, F.stddev_samp(r)).alias("sharpe"), F.avg((r > 0).cast("double")).alias("earning"),
    )
