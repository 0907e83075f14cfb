"""Sector tables, portfolio sums, momentum portfolios, performance and classification measures."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import norm_cdf


def _w(key: str = "ticker", order: str = "date") -> Window:
    return Window.partitionBy(key).orderBy(order)


def join_benchmark(prices: DataFrame, benchmark: DataFrame, columns: tuple[str, ...] = ("open", "close")) -> DataFrame:
    """prices with the benchmark's columns of the same date, as bm_*."""
    return prices.join(benchmark.select("date", *[F.col(c).alias(f"bm_{c}") for c in columns]), "date", "left")


def of_members(df: DataFrame, members: DataFrame, key: str = "ticker") -> DataFrame:
    """The rows of the keys that are members (of a sector, of a selection)."""
    return df.join(members.select(key), key, "left_semi")


def sector_heatmap(index: DataFrame, days: int = 1) -> DataFrame:
    """date, and a column per sector: its change over some rows, in per cent; index: sector, date, total."""
    change = (F.try_divide("total", F.lag("total", days).over(_w("sector"))) - 1) * 100
    sectors = [r[0] for r in index.select("sector").distinct().orderBy("sector").collect()]  # columns of the result
    return index.select("sector", "date", change.alias("change")).groupBy("date").pivot("sector", sectors).agg(F.first("change"))


def portfolio_sum(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy("date").agg(*[F.sum(c).alias(c) for c in columns], F.count("*").alias("n"))


def momentum(rows: int) -> Column:
    return F.try_divide("close", F.lag("close", rows).over(_w())) - 1


def best_asset(prices: DataFrame, rows: int) -> DataFrame:
    """The ticker with the largest momentum of each date (ties: the smallest)."""
    known = prices.select("ticker", "date", momentum(rows).alias("momentum")).where("momentum IS NOT NULL")
    return known.groupBy("date").agg(F.min_by(F.struct("ticker", "momentum"), F.struct(-F.col("momentum"), F.col("ticker"))).alias("b")).select("date", "b.*")


def dual_momentum(prices: DataFrame, rows: int, riskless: float = 0.0) -> DataFrame:
    """Return of holding, from the day after, the best asset while its momentum beats a riskless rate for the time."""
    best = best_asset(prices, rows)
    chosen = best.select("date", F.when(F.col("momentum") > riskless * rows / 252, F.col("ticker")).alias("pick"))
    held = chosen.select("date", F.lag("pick").over(Window.orderBy("date")).alias("held"))  # a row per date
    r = prices.select(F.col("ticker").alias("held"), "date", (F.try_divide("close", F.lag("close").over(_w())) - 1).alias("ret"))
    return held.join(r, ["date", "held"], "left").select("date", "held", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def cross_momentum(prices: DataFrame, rows: int, hold: int, n: int) -> DataFrame:
    """Return of the n tickers with the largest momentum less that of the n with the smallest, chosen each ``hold`` dates, from the day after."""
    dates = prices.select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).alias("k"))  # a row per date
    known = prices.select("ticker", "date", momentum(rows).alias("m"), (F.try_divide("close", F.lag("close").over(_w())) - 1).alias("ret")).join(dates, "date")
    period = F.floor((F.col("k") - 2) / hold)
    chosen = known.where((F.col("m").isNotNull()) & ((F.col("k") - 1) % hold == 0)).withColumn("period", F.floor((F.col("k") - 1) / hold))
    high = F.row_number().over(Window.partitionBy("period").orderBy(F.col("m").desc(), "ticker"))
    low = F.row_number().over(Window.partitionBy("period").orderBy("m", "ticker"))
    sides = chosen.withColumn("h", high).withColumn("l", low).select("period", "ticker", F.when(F.col("h") <= n, 1.0).when(F.col("l") <= n, -1.0).alias("side")).where("side IS NOT NULL")
    held = known.where("ret IS NOT NULL").withColumn("period", period).join(sides, ["period", "ticker"])
    return held.groupBy("date").agg((F.sum(F.col("side") * F.col("ret")) / n).alias("ret"), F.count("*").alias("n"))


def lagged_regime(prices: DataFrame, rows: int = 50, threshold: float = 0.05) -> DataFrame:
    """1, -1 or 0: the change over the rows before the last one was above, below or within the threshold."""
    past = F.try_divide(F.lag("close", 1).over(_w()), F.lag("close", rows + 1).over(_w())) - 1
    known = prices.select("ticker", "date", past.alias("change"))
    return known.withColumn("regime", F.when(F.col("change") > threshold, 1).when(F.col("change") < -threshold, -1).when(F.col("change").isNotNull(), 0))


def price_ratio(prices: DataFrame, calendar: DataFrame, rows: int) -> DataFrame:
    """Change over some rows on every date of a calendar, gaps filled from the next known one."""
    change = prices.select("ticker", "date", (F.try_divide("close", F.lag("close", rows).over(_w())) - 1).alias("ratio"))
    grid = prices.select("ticker").distinct().join(F.broadcast(calendar.select("date").distinct()), how="cross")  # the result's own rows
    ahead = _w().rowsBetween(0, Window.unboundedFollowing)
    return grid.join(change, ["ticker", "date"], "left").withColumn("ratio", F.first("ratio", ignorenulls=True).over(ahead))


def flips(positions: DataFrame, x: str = "position") -> DataFrame:
    """Dates at which a position is closed, changes its side, or ends."""
    last, after = F.lag(x).over(_w()), F.lead("date").over(_w())
    closed = (F.col(x) == 0) & (last != 0)
    turned = F.col(x) * last < 0
    return positions.withColumn("__e", closed | turned | after.isNull()).where("__e").select("ticker", "date")


def index_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Keys on one side only, and which."""
    left, right = (x.select(*columns).distinct() for x in (a, b))
    return left.join(right, columns, "left_anti").withColumn("side", F.lit("left")).unionByName(right.join(left, columns, "left_anti").withColumn("side", F.lit("right")))


def returns_metrics(returns: DataFrame, x: str = "ret", periods: int = 252) -> DataFrame:
    """Total and annual return, volatility, Sharpe, Sortino, maximum drawdown, Calmar, share of gains, and gain over loss."""
    upto = _w().rowsBetween(Window.unboundedPreceding, 0)
    known = returns.where(F.col(x).isNotNull()).withColumn("__v", F.exp(F.sum(F.log1p(x)).over(upto)))
    known = known.withColumn("__d", F.col("__v") / F.greatest(F.max("__v").over(upto), F.lit(1.0)) - 1)
    r = F.col(x)
    a = known.groupBy("ticker").agg(
        F.count("*").alias("n"), F.max_by("__v", "date").alias("v"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.stddev_samp(F.when(r < 0, r)).alias("down"),
        F.min("__d").alias("max_drawdown"), F.avg((r > 0).cast("double")).alias("win_rate"), F.sum(F.when(r > 0, r)).alias("gain"), F.sum(F.when(r < 0, -r)).alias("loss"),
    )
    annual = F.pow("v", periods / F.col("n")) - 1
    return a.select(
        "ticker", (F.col("v") - 1).alias("total_return"), annual.alias("annual_return"), (F.col("std") * math.sqrt(periods)).alias("volatility"), (F.try_divide("mean", "std") * math.sqrt(periods)).alias("sharpe"),
        (F.try_divide("mean", "down") * math.sqrt(periods)).alias("sortino"), "max_drawdown", F.try_divide(annual, -F.col("max_drawdown")).alias("calmar"), "win_rate", F.try_divide("gain", "loss").alias("profit_factor"),
    )


def tail_risk(returns: DataFrame, alpha: float = 0.05, x: str = "ret") -> DataFrame:
    """Value at risk (the upper of the two values at the quantile), the mean at or below it, and the mean of drawdowns at or above their own quantile."""
    upto = _w().rowsBetween(Window.unboundedPreceding, 0)
    known = returns.where(F.col(x).isNotNull()).withColumn("__c", F.sum(x).over(upto))
    known = known.withColumn("d", F.max("__c").over(upto) - F.col("__c"))
    n = F.count("*").over(Window.partitionBy("ticker"))
    ranked = known.withColumn("i", F.row_number().over(_w(order=x))).withColumn("j", F.row_number().over(_w(order="d"))).withColumn("n", n)
    at, top = F.ceil(alpha * (F.col("n") - 1)) + 1, F.ceil((1 - alpha) * (F.col("n") - 1)) + 1
    edges = ranked.groupBy("ticker").agg(F.max(F.when(F.col("i") == at, F.col(x))).alias("var"), F.max(F.when(F.col("j") == top, F.col("d"))).alias("dar"))
    both = known.join(edges, "ticker")
    return both.groupBy("ticker").agg(F.max("var").alias("var"), F.avg(F.when(F.col(x) <= F.col("var"), F.col(x))).alias("es"), F.avg(F.when(F.col("d") >= F.col("dar"), F.col("d"))).alias("cdar"))


def kelly(returns: DataFrame, x: str = "ret") -> DataFrame:
    """Share of gains, mean gain over mean loss, and the Kelly fraction they make."""
    r = F.col(x)
    a = returns.where(r.isNotNull()).groupBy("ticker").agg(F.avg((r > 0).cast("double")).alias("p"), F.try_divide(F.avg(F.when(r > 0, r)), F.avg(F.when(r < 0, -r))).alias("b"))
    return a.select("ticker", "p", "b", (F.col("p") - F.try_divide(1 - F.col("p"), F.col("b"))).alias("kelly"))


def strategy_risk(bets: DataFrame, target: float = 2.0, per_year: float = 252.0, x: str = "ret") -> DataFrame:
    """The precision that a target Sharpe ratio asks of the bets' mean gain and loss, and the probability of less."""
    r = F.col(x)
    a = bets.where(r.isNotNull()).groupBy("ticker").agg(F.avg(F.when(r > 0, r)).alias("pt"), F.avg(F.when(r <= 0, r)).alias("sl"), F.avg((r > 0).cast("double")).alias("p"), F.count("*").alias("k"))
    gap = F.col("pt") - F.col("sl")
    q = (per_year + target * target) * gap * gap
    b = (2 * per_year * F.col("sl") - target * target * gap) * gap
    c = per_year * F.col("sl") * F.col("sl")
    least = (-b + F.sqrt(b * b - 4 * q * c)) / (2 * q)
    known = a.withColumn("implied", least)
    z = (F.col("implied") - F.col("p")) / F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("k"))
    return known.select("ticker", "p", "implied", norm_cdf(z).alias("failure"))


def holding_period(positions: DataFrame, x: str = "position", key: str = "ticker", order: str = "date") -> DataFrame:
    """Mean days that a position is held, weighted by what is closed (a recurrence of the mean entry time)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        p = g[x].to_numpy(float)
        days = (pd.to_datetime(g[order]) - pd.to_datetime(g[order]).iloc[0]).dt.total_seconds().to_numpy() / 86400
        entry, closed = 0.0, []
        for i in range(1, len(p)):
            step = p[i] - p[i - 1]
            if step * p[i - 1] >= 0:
                if p[i]:
                    entry = (entry * p[i - 1] + days[i] * step) / p[i]
            elif p[i] * p[i - 1] < 0:
                closed.append((days[i] - entry, abs(p[i - 1])))
                entry = days[i]
            else:
                closed.append((days[i] - entry, abs(step)))
        w = sum(b for _, b in closed)
        return pd.DataFrame({key: [g[key].iloc[0]], "days": [sum(a * b for a, b in closed) / w if w else np.nan]})

    return positions.select(key, order, x).groupBy(key).applyInPandas(run, f"{key} {dict(positions.dtypes)[key]}, days double")


def expected_returns(returns: DataFrame, x: str = "ret", periods: int = 252) -> DataFrame:
    return returns.groupBy("ticker").agg((F.avg(x) * periods).alias("expected"))


def classification_report(scored: DataFrame, label: str = "label", predicted: str = "prediction") -> DataFrame:
    """Precision, recall, F1, specificity and accuracy of the class 1, in one row."""

    def n(a: int, b: int) -> Column:
        return F.sum(F.when((F.col(label) == a) & (F.col(predicted) == b), 1.0).otherwise(0.0))

    t = scored.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return t.select(
        "tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"),
        F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"), ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"),
    )


def bet_by_probability(p: Column, quantity: int, classes: int = 2) -> Column:
    """Whole units bet on a probability: the size of its statistic times the quantity."""
    return F.round(F.abs(F.try_divide(p - 1 / classes, F.sqrt(p * (1 - p)))) * quantity)


def mutual_information(df: DataFrame, x: str, y: str, bins: int = 10, key: str = "ticker") -> DataFrame:
    """Entropies, mutual information and variation of information of two columns on equally wide bins of each key."""
    ends = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(key).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(ends, key)

    def box(v: str, lo: str, hi: str) -> Column:
        return F.coalesce(F.least(F.floor(F.try_divide(F.col(v) - F.col(lo), F.col(hi) - F.col(lo)) * bins), F.lit(bins - 1)), F.lit(0))

    cells = known.groupBy(key, box(x, "x0", "x1").alias("a"), box(y, "y0", "y1").alias("b")).agg(F.count("*").alias("n"))
    cells = cells.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(key)))
    cells = cells.withColumn("pa", F.sum("p").over(Window.partitionBy(key, "a"))).withColumn("pb", F.sum("p").over(Window.partitionBy(key, "b")))
    # Each cell's share of a margin's entropy: -p log(margin).
    e = cells.groupBy(key).agg(F.sum(-F.col("p") * F.ln("pa")).alias("hx"), F.sum(-F.col("p") * F.ln("pb")).alias("hy"), F.sum(-F.col("p") * F.ln("p")).alias("hxy"))
    return e.select(key, "hx", "hy", (F.col("hx") + F.col("hy") - F.col("hxy")).alias("mi"), (2 * F.col("hxy") - F.col("hx") - F.col("hy")).alias("vi"))


def side_letter() -> Column:
    """a for a tick that is up, b for down, c for none."""
    return F.when(F.col("side") == 1, "a").when(F.col("side") == -1, "b").otherwise("c")


def nearest_edge(x: Column, edges: Column) -> Column:
    """The place (from 0) of the edge nearest to x; ties go to the lower one, null, NaN and infinite x to the first."""
    return F.array_min(F.transform(edges, lambda e, k: F.struct(F.abs(x - e).alias("far"), k.alias("k"))))["k"]


def tick_letters(sided: DataFrame, key: str = "symbol", order: tuple[str, ...] = ("ts", "seq"), reset: str = "day") -> DataFrame:
    """The tick sides of each key and day as one message: a for up, b for down, c for none."""
    rows = F.array_sort(F.collect_list(F.struct(*order, side_letter().alias("l"))))
    return sided.groupBy(key, F.to_date("ts").alias(reset)).agg(F.array_join(F.transform(rows, lambda r: r["l"]), "").alias("message"))


def quantile_letters(df: DataFrame, x: str, letters: int = 10, key: str = "ticker") -> DataFrame:
    """Each value's place among its key's quantile edges: the number of the nearest edge (ties: the lower)."""
    shares = F.array(*[F.lit((k + 0.5) / letters) for k in range(letters)])
    edges = df.groupBy(key).agg(F.percentile(x, shares).alias("__e"))
    return df.join(edges, key).withColumn("letter", F.when(F.col(x).isNotNull(), nearest_edge(F.col(x), F.col("__e")))).drop("__e")


def quarters_between(spark, start: str, end: str) -> DataFrame:
    """report_name (year/Qn) and last day of each quarter from start to end."""
    days = spark.range(1).select(F.explode(F.sequence(F.date_trunc("quarter", F.lit(start).cast("date")), F.lit(end).cast("timestamp"), F.expr("INTERVAL 3 MONTHS"))).alias("d"))
    return days.select(F.concat_ws("/Q", F.year("d"), F.quarter("d")).alias("report_name"), F.last_day(F.add_months(F.col("d").cast("date"), 2)).alias("report_date"))
