"""Strategies: curve, pair and currency trades, risk parity and baskets.

Signals, ranks, baskets and accounts are windows and groups; only positions
that depend on their own past are a fold over one key's dates.  Windows over all
dates hold one row per date.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .statistics import coint_statistics


def zscore(x: Column, rows: int, w) -> Column:
    """Departure from the mean of the last ``rows`` values in sample deviations; NULL until there are as many."""
    last = w.rowsBetween(1 - rows, 0)
    return F.when(F.count(x).over(last) == rows, F.try_divide(x - F.avg(x).over(last), F.stddev_samp(x).over(last)))


def _folded(df: DataFrame, key: str, order: str, name: str, fold) -> DataFrame:
    """df with a column that ``fold`` makes of a key's ordered rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        return group.assign(**{name: np.asarray(fold(group), float)})

    return df.groupBy(key).applyInPandas(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def curve_positions(z: np.ndarray, enter: float, hold: int, stop: float, take: float) -> list[float]:
    """Buy below -enter, sell above enter; leave at a stop or a gain against the entry, or after ``hold`` rows, and stay out on that row."""
    at, entry, age, out = 0.0, 0.0, 0, []
    for v in z:
        if at:
            age += 1
            gain = at * (v - entry)
            if gain < -stop or gain > take or age >= hold:
                at = 0.0
        elif v < -enter or v > enter:
            at, entry, age = (1.0 if v < 0 else -1.0), v, 0
        out.append(at)
    return out


def curve_trade(legs: DataFrame, butterfly: bool = False, rows: int = 60, enter: float = 1.5, hold: int = 20, stop: float = 3.0, take: float = 0.5, key: str = "curve", order: str = "date") -> DataFrame:
    """Steepener (long minus short yield) or butterfly (twice the middle less both ends) of each curve.

    legs: key, date, short, long and, for the butterfly, mid; a row that lacks
    one is left out.  The return is that of yesterday's position on the
    difference of the ends' relative moves, or of the wings' mean and the middle's.
    """
    ends = ["short", "long", *(["mid"] if butterfly else [])]
    w = Window.partitionBy(key).orderBy(order)
    spread = 2 * F.col("mid") - F.col("short") - F.col("long") if butterfly else F.col("long") - F.col("short")
    known = legs.dropna(subset=ends).withColumn("spread", spread).withColumn("i", F.row_number().over(w)).withColumn("z", zscore(F.col("spread"), rows, w))
    moves = {f"__{e}": 1 - F.try_divide(F.col(e), F.lag(e).over(w)) for e in ends}  # a price falls when its yield rises
    known = known.withColumns(moves)

    def fold(g: pd.DataFrame) -> np.ndarray:
        z = np.where(g["i"] > rows, g["z"].to_numpy(float), np.nan)
        return curve_positions(z, enter, hold, stop, take)

    kept = _folded(known.select(key, order, "spread", "z", "i", *moves), key, order, "position", fold)
    move = 2 * F.col("__mid") - F.col("__short") - F.col("__long") if butterfly else F.col("__long") - F.col("__short")
    return kept.select(key, order, "spread", "z", "position", (F.lag("position").over(w) * move).alias("ret"))


def pair_positions(z: np.ndarray, enter: float, hold: int) -> list[float]:
    """Sell above enter, buy below -enter; leave when z crosses 0 or after ``hold`` rows, and enter again on that row if z asks for it."""
    at, age, out = 0.0, 0, []
    for v in z:
        if at:
            age += 1
            if age >= hold or at * v > 0:
                at = 0.0
        if not at and (v > enter or v < -enter):
            at, age = (-1.0 if v > 0 else 1.0), 0
        out.append(at)
    return out


def pairs_zscore(prices: DataFrame, rows: int = 252, enter: float = 2.0, hold: int = 20, x: str = "close", key: str = "ticker", on: str = "date") -> DataFrame:
    """The pair with the least Dickey-Fuller t, hedged without an intercept, and its positions and returns."""
    best = F.broadcast(coint_statistics(prices, x, key, on).orderBy(F.col("t").asc_nulls_last(), "a", "b").limit(1).select("a", "b"))  # one row
    p, q = (prices.join(best.select(F.col(c).alias(key)), key).select(on, F.col(key).alias(c), F.col(x).alias(v)) for c, v in (("a", "p"), ("b", "q")))
    both = p.join(q, on)
    hedge = F.broadcast(both.agg(F.try_divide(F.sum(F.col("p") * F.col("q")), F.sum(F.col("q") * F.col("q"))).alias("hedge")))  # one row
    w = Window.partitionBy("a", "b").orderBy(on)
    known = both.join(hedge, how="cross").withColumn("spread", F.col("p") - F.col("hedge") * F.col("q")).withColumn("z", zscore(F.col("spread"), rows, w)).withColumn("i", F.row_number().over(w))
    known = known.withColumn("__m", F.try_divide("p", F.lag("p").over(w)) - 1 - F.col("hedge") * (F.try_divide("q", F.lag("q").over(w)) - 1))
    kept = _folded(known, "a", on, "position", lambda g: pair_positions(np.where(g["i"] > rows, g["z"].to_numpy(float), np.nan), enter, hold))
    return kept.select("a", "b", on, "hedge", "spread", "z", "position", (F.lag("position").over(w) * F.col("__m")).alias("ret"))


def _days(moves: DataFrame) -> DataFrame:
    """Dates numbered from 0, and how many there are: one row per date."""
    days = moves.select("date").distinct()
    return days.withColumn("i", F.row_number().over(Window.orderBy("date")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))


def _moves(rates: DataFrame) -> DataFrame:
    """Returns of the closes, and rates less the date's mean."""
    w = Window.partitionBy("ticker").orderBy("date")
    diff = F.col("rate") - F.avg("rate").over(Window.partitionBy("date"))
    return rates.select("ticker", "date", (F.try_divide("close", F.lag("close").over(w)) - 1).alias("ret"), "rate", diff.alias("diff"))


def _accounts(held: DataFrame, weight: str, diff: str) -> DataFrame:
    """Of each date: return of yesterday's weights, carry of today's, and both compounded."""
    w = Window.partitionBy("ticker").orderBy("date")
    known = held.withColumn("__y", F.lag(weight).over(w))
    daily = known.groupBy("date").agg(F.coalesce(F.sum(F.col("__y") * F.col("ret")), F.lit(0.0)).alias("fx"), F.coalesce(F.sum(F.col(weight) * F.col(diff)) / 252, F.lit(0.0)).alias("carry"))
    total = F.col("fx") + F.col("carry")
    wealth = F.product(1 + total).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return daily.select("date", "fx", "carry", total.alias("ret"), wealth.alias("wealth"))


def carry_trade(rates: DataFrame, n: int = 3, every: int = 21, rows: int = 63, target: float = 0.10) -> DataFrame:
    """Long the n highest and short the n lowest rates, chosen at each ``every``-th date and kept until chosen again.

    rates: ticker, date, close, rate.  Weights are scaled to a target volatility
    (at most three times) once ``rows`` dates are known.  Ties by ticker.
    """
    moves = _moves(rates).where(F.col("ret").isNotNull())
    high = F.row_number().over(Window.partitionBy("date").orderBy(F.col("rate").desc_nulls_last(), "ticker"))
    low = F.row_number().over(Window.partitionBy("date").orderBy(F.col("rate").asc_nulls_last(), F.col("ticker").desc()))
    known = moves.withColumn("__h", high).withColumn("__l", low).join(F.broadcast(_days(moves)), "date")  # a row per date
    chosen = (F.col("i") % every == 0) & (F.col("i") + rows < F.col("n"))
    w = Window.partitionBy("ticker").orderBy("date")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    side = F.when(chosen & (F.col("__l") <= n), -1.0 / n).when(chosen & (F.col("__h") <= n), 1.0 / n)
    known = known.withColumn("w", F.coalesce(F.last(side, ignorenulls=True).over(upto), F.lit(0.0)))
    known = known.withColumn("d", F.coalesce(F.last(F.when(chosen, F.col("diff")), ignorenulls=True).over(upto), F.lit(0.0)))
    raw = known.withColumn("__y", F.lag("w").over(w)).groupBy("date").agg(F.coalesce(F.sum(F.col("__y") * F.col("ret")), F.lit(0.0)).alias("r"))
    days = Window.orderBy("date").rowsBetween(1 - rows, 0)
    vol = F.when(F.count("*").over(days) == rows, F.stddev_samp("r").over(days) * 252**0.5)
    scale = raw.select("date", F.coalesce(F.when(vol == 0, 3.0).otherwise(F.least(target / F.nullif(vol, F.lit(0.0)), F.lit(3.0))), F.lit(1.0)).alias("s"), vol.alias("v"))
    scale = scale.select("date", F.when(F.col("v").isNull(), 1.0).otherwise(F.col("s")).alias("s"))
    return _accounts(known.join(F.broadcast(scale), "date").withColumn("w", F.col("w") * F.col("s")), "w", "d")


def rate_differential(rates: DataFrame, n: int = 5, rows: int = 63, enter: float = 1.0, hold: int = 21) -> DataFrame:
    """Short the rates furthest above, long those furthest below their own mean, and hold each entry ``hold`` rows."""
    w = Window.partitionBy("ticker").orderBy("date")
    moves = _moves(rates).withColumn("z", zscore(F.col("diff"), rows, w)).where(F.col("ret").isNotNull())
    high = F.row_number().over(Window.partitionBy("date").orderBy(F.col("z").desc_nulls_last(), "ticker"))
    low = F.row_number().over(Window.partitionBy("date").orderBy(F.col("z").asc_nulls_last(), F.col("ticker").desc()))
    known = moves.withColumn("__h", high).withColumn("__l", low).join(F.broadcast(_days(moves)), "date")  # a row per date
    side = F.when((F.col("__l") <= n) & (F.col("z") < -enter), 1.0 / n).when((F.col("__h") <= n) & (F.col("z") > enter), -1.0 / n).otherwise(0.0)
    known = known.withColumn("signal", F.when(F.col("i") >= rows, side).otherwise(0.0))

    def fold(g: pd.DataFrame) -> np.ndarray:
        at = g["signal"].to_numpy(float).copy()
        entries = np.flatnonzero((at[1:] != 0) & (at[:-1] == 0)) + 1
        for e in entries:
            at[e : min(e + hold, len(at) - 1)] = at[e]
        return at

    return _accounts(_folded(known.select("ticker", "date", "ret", "diff", "signal"), "ticker", "date", "position", fold), "position", "diff")


def risk_budget_weights(x: np.ndarray, budget: np.ndarray, rounds: int = 100, tolerance: float = 1e-8) -> np.ndarray:
    """Weights whose shares of the risk are the budget; x: dates by assets, and no matrix of assets by assets is made.

    Steps multiply by the root of budget over share: whole steps never settle where assets are uncorrelated.
    """
    x = x - x.mean(0)
    w = np.full(x.shape[1], 1 / x.shape[1])
    for _ in range(rounds):
        part = w * (x.T @ (x @ w))
        if not part.sum() > 0:
            break
        part = part / part.sum()
        if np.abs(part - budget).sum() < tolerance:
            break
        w = w * np.sqrt(np.divide(budget, part, out=np.zeros_like(w), where=part > 0))
        w = w / w.sum()
    return w


def risk_parity(returns: DataFrame, every: int = 21, rows: int = 252, most: float = 1.5, target: float = 0.10, x: str = "ret", key: str = "ticker") -> DataFrame:
    """Weights with equal risk shares at each ``every``-th date, from the ``rows`` dates before it.

    Scaled to a target volatility, at most ``most`` times.  A group holds the
    returns of one rebalance, rows by assets; a missing return is the asset's
    mean, and assets that do not move get no weight.
    """
    known = returns.where(F.col(x).isNotNull())
    days = known.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    # A row belongs to the rebalances at i0 = every * k with i0 - rows <= i < i0.
    k = F.floor(F.col("i") / every) + 1
    dated = known.join(F.broadcast(days), "date").withColumn("k", F.explode(F.sequence(k, F.floor((F.col("i") + rows) / every))))
    dated = dated.where(F.col("k") * every >= rows).join(F.broadcast(days.select((F.col("i") / every).cast("long").alias("k"), (F.col("i") % every).alias("m"), F.col("date").alias("rebalance")).where("m = 0").drop("m")), "k")
    kind = dict(returns.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        wide = g.pivot_table(index="date", columns=key, values=x)
        v = (wide - wide.mean()).fillna(0.0)
        v = v.loc[:, (v != 0).any()]
        if not v.shape[1]:
            return pd.DataFrame({"rebalance": [], key: [], "weight": []})
        w = risk_budget_weights(v.to_numpy(), np.full(v.shape[1], 1 / v.shape[1]))
        vol = (v.to_numpy() @ w).std(ddof=1) * 252**0.5
        return pd.DataFrame({"rebalance": g["rebalance"].iloc[0], key: v.columns, "weight": w * min(target / vol if vol > 0 else most, most)})

    return dated.groupBy("rebalance").applyInPandas(run, f"rebalance {kind['date']}, {key} {kind[key]}, weight double")


def basket_value(basket: DataFrame, by: str = "basket", key: str = "ticker", date: str = "date") -> DataFrame:
    """Value of a rebalanced basket, 1 at the second date.

    basket: by, key, date, open, close, weight, rate, cost, a row for every key
    and date.  Holdings are set from the weights of the row after a change of
    weights and the next open, and stay; a value grows by holdings times the
    move (close less open on the day they are set, else close less close) plus
    cost.  Within a regime of holdings the growth is a plain sum and a regime
    starts from the product of those before, so that no fold is needed.
    """
    own = Window.partitionBy(by, key).orderBy(date)
    known = basket.withColumn("__d", F.col("close") - F.lag("close").over(own)).withColumn("__o", F.lead("open").over(own))
    known = known.withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("i", F.row_number().over(own))
    known = known.withColumn("__size", F.sum(F.abs("weight")).over(Window.partitionBy(by, date)))
    known = known.withColumn("__h", F.try_divide(F.try_divide("weight", "__size"), F.col("__o") * F.col("rate")))
    # The second row starts holdings; the fourth does so for the first weights seen, later ones after a change.
    moved = F.when(F.col("i") == 4, F.lag("weight").over(own) != 0).when(F.col("i") > 4, F.lag("weight").over(own) != F.lag("weight", 2).over(own)).otherwise(F.col("i") == 2)
    known = known.withColumn("__s", F.max(moved.cast("int")).over(Window.partitionBy(by, date))).where("i > 1")
    known = known.withColumn("regime", F.sum("__s").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.first("__h").over(Window.partitionBy(by, key, "regime").orderBy(date))
    move = F.when((F.col("__s") == 1) & (F.col("i") > 2), F.col("close") - F.col("open")).otherwise(F.col("__d"))
    grown = known.withColumn("__g", F.when(F.col("i") > 2, held * F.col("rate") * (move + F.col("cost"))))
    daily = grown.groupBy(by, date, "regime").agg(F.coalesce(F.sum("__g"), F.lit(0.0)).alias("g"))
    daily = daily.withColumn("g", F.sum("g").over(Window.partitionBy(by, "regime").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)))
    ends = daily.groupBy(by, "regime").agg((1 + F.max_by("g", date)).alias("__e"))
    base = F.coalesce(F.product("__e").over(Window.partitionBy(by).orderBy("regime").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    return daily.join(ends.select(by, "regime", base.alias("__b")), [by, "regime"]).select(by, date, (F.col("__b") * (1 + F.col("g"))).alias("value"))
