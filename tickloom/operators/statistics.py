"""Normal distribution, backtest statistics, bet sizes and strategy accounting."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .panel import by_pair_blocks

EULER = 0.5772156649


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def norm_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 26.2.17; absolute error below 7.5e-8."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    # Fixed values of the approximation.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = norm_pdf(x) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def norm_ppf(p: Column) -> Column:
    """Abramowitz and Stegun 26.2.23 with one Newton step on norm_cdf."""
    q = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.ln(q))
    # Fixed values of the approximation.
    z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    first = F.when(p < 0.5, -z).otherwise(z)
    return F.when((p > 0) & (p < 1), first - (norm_cdf(first) - p) / norm_pdf(first))


def sharpe_statistics(returns: DataFrame, x: str = "ret", key: str = "ticker", periods: int = 252, benchmark: float = 0.0, alpha: float = 0.05) -> DataFrame:
    """Sharpe ratio, annualised, its deviation, the probability of exceeding a benchmark, and the least track record."""
    m = returns.where(F.col(x).isNotNull()).groupBy(key).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt")
    )
    m = m.withColumn("sharpe", F.try_divide("mean", "std"))
    sr, skew, kurt, n = F.col("sharpe"), F.col("skew"), F.col("kurt"), F.col("n")
    inner = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return m.select(
        key, "n", "skew", "kurt", "sharpe", (sr * math.sqrt(periods)).alias("annual"),
        F.sqrt((1 + sr * sr / 2 - skew * sr + (kurt - 3) / 4 * sr * sr) / (n - 1)).alias("sharpe_std"),
        norm_cdf((sr - benchmark) * F.sqrt(n - 1) / F.sqrt(inner)).alias("psr"),
        (1 + inner * F.pow(norm_ppf(F.lit(1 - alpha)) / (sr - benchmark), F.lit(2.0))).alias("min_track_record"),
    )


def deflated_benchmark(estimates: DataFrame, x: str = "sharpe") -> DataFrame:
    """The Sharpe ratio to beat after N trials: the expected maximum of N unskilled ones."""
    s = estimates.agg(F.stddev_pop(x).alias("dev"), F.count(x).cast("double").alias("trials"))
    n = F.col("trials")
    return s.select("trials", (F.col("dev") * ((1 - EULER) * norm_ppf(1 - 1 / n) + EULER * norm_ppf(1 - 1 / (n * math.e)))).alias("benchmark"))


def deflated_sharpe(estimates: DataFrame, key: str = "ticker", x: str = "sharpe") -> DataFrame:
    """The probability that each Sharpe ratio (with n, skew, kurt) exceeds the best of as many unskilled trials."""
    known = estimates.join(F.broadcast(deflated_benchmark(estimates, x)), how="cross")  # one row
    inner = 1 - F.col("skew") * F.col(x) + (F.col("kurt") - 1) / 4 * F.col(x) * F.col(x)
    return known.select(key, "trials", x, "benchmark", norm_cdf((F.col(x) - F.col("benchmark")) * F.sqrt(F.col("n") - 1) / F.sqrt(inner)).alias("dsr"))


def drawdowns(returns: DataFrame, x: str = "ret", key: str = "ticker", order: str = "date") -> DataFrame:
    """For each high-water mark the deepest fall below it and the years (of 365.25 days) until the next mark."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    wealth = returns.withColumn("__v", F.exp(F.sum(F.log1p(F.coalesce(x, F.lit(0.0)))).over(w)))
    marked = wealth.withColumn("hwm", F.max("__v").over(w))
    deep = marked.groupBy(key, "hwm").agg(F.min("__v").alias("lo"), F.min(order).alias("start"), F.count("*").alias("n")).where("n > 1")
    after = F.lead("start").over(Window.partitionBy(key).orderBy("start"))
    return deep.select(key, "start", "hwm", (1 - F.col("lo") / F.col("hwm")).alias("drawdown"), (F.datediff(after, "start") / 365.25).alias("years"))


def risk(returns: DataFrame, x: str = "ret", key: str = "ticker") -> DataFrame:
    """Volatility, downside deviation, value at risk (historical and parametric) and expected shortfall."""
    edges = returns.groupBy(key).agg(
        F.stddev_samp(x).alias("std"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.05)).alias("var95"), F.percentile(x, F.lit(0.01)).alias("var99"),
        F.sqrt(F.avg(F.when(F.col(x) < 0, F.col(x) * F.col(x)).when(F.col(x).isNotNull(), 0.0))).alias("downside"),
    )
    short = returns.join(edges.select(key, "var95"), key).where(F.col(x) <= F.col("var95")).groupBy(key).agg(F.avg(x).alias("cvar95"))
    return edges.join(short, key).select(
        key, (F.col("std") * math.sqrt(252)).alias("volatility"), (F.col("downside") * math.sqrt(252)).alias("downside"), "var95", "var99", "cvar95", (F.col("mean") - 1.6448536269514722 * F.col("std")).alias("var95_normal"),
    )


def ou_parameters(df: DataFrame, x: str = "close", key: str = "ticker", order: str = "date") -> DataFrame:
    """phi, residual deviation and half-life of the log price around its mean."""
    w = Window.partitionBy(key).orderBy(order)
    whole = Window.partitionBy(key)
    known = df.withColumn("__y", F.ln(x) - F.avg(F.ln(x)).over(whole)).withColumn("__x", F.lag("__y").over(w)).where("__x IS NOT NULL")
    fit = known.groupBy(key).agg(F.regr_slope("__y", "__x").alias("phi"), F.regr_intercept("__y", "__x").alias("c"))
    rest = known.join(fit, key).withColumn("__e", F.col("__y") - F.col("c") - F.col("phi") * F.col("__x"))
    sigma = rest.groupBy(key).agg(F.max("phi").alias("phi"), F.stddev_pop("__e").alias("sigma"))
    return sigma.withColumn("half_life", F.when((F.col("phi") > 0) & (F.col("phi") < 1), -math.log(2) / F.ln("phi")))


def bet_gaussian(p: Column, classes: int = 2, side: Column | None = None) -> Column:
    """2 Phi(z) - 1 of a probability p, times the side."""
    clipped = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    z = (clipped - 1 / classes) / F.sqrt(clipped * (1 - clipped))
    size = 2 * norm_cdf(z) - 1
    return size if side is None else size * side


def bet_mixture(c: Column, means: tuple[float, float], deviations: tuple[float, float], share: float) -> Column:
    """Bet size of c under a mixture of two normal laws: its distance in probability from 0, over what lies on that side."""

    def law(x: Column) -> Column:
        return share * norm_cdf((x - means[0]) / deviations[0]) + (1 - share) * norm_cdf((x - means[1]) / deviations[1])

    zero = law(F.lit(0.0))
    return F.when(c >= 0, (law(c) - zero) / (1 - zero)).otherwise((law(c) - zero) / zero)


def bet_sigmoid(divergence: Column, w: Column) -> Column:
    return divergence / F.sqrt(w + divergence * divergence)


def bet_power(divergence: Column, w: Column) -> Column:
    return F.signum(divergence) * F.pow(F.abs(divergence), w)


def bet_dynamic(prices: DataFrame, w: float, most: int) -> DataFrame:
    """Target position and limit price from columns pos, price, forecast."""
    d = F.col("forecast") - F.col("price")
    target = (bet_sigmoid(d, F.lit(w)) * most).cast("int")  # towards zero, so that no share of the most is one
    between = F.sequence((F.abs(F.col("pos") + F.signum(F.col("target") - F.col("pos")))).cast("int"), F.abs("target").cast("int"))

    def inverse(m: Column) -> Column:
        return F.col("forecast") - m * F.sqrt(F.lit(w) / (1 - m * m))

    known = prices.withColumn("target", target)
    total = F.aggregate(between, F.lit(0.0), lambda s, j: s + inverse(j / float(most)))
    steps = F.abs(F.col("target") - F.col("pos"))
    return known.withColumn("limit", F.when(steps > 0, total / steps))


def concurrent_sides(events: DataFrame) -> DataFrame:
    """Active longs and shorts (t0 <= t < t1) at each change, and the budget bet size they make."""
    ends = [events.select("symbol", F.col(t).alias("ts"), F.when(F.col("side") > 0, k).otherwise(0).alias("l"), F.when(F.col("side") < 0, k).otherwise(0).alias("s")) for t, k in (("t0", 1), ("t1", -1))]
    steps = ends[0].unionByName(ends[1]).groupBy("symbol", "ts").agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    known = steps.withColumn("longs", F.sum("l").over(w)).withColumn("shorts", F.sum("s").over(w))
    whole = Window.partitionBy("symbol")
    size = F.coalesce(F.try_divide("longs", F.max("longs").over(whole)), F.lit(0.0)) - F.coalesce(F.try_divide("shorts", F.max("shorts").over(whole)), F.lit(0.0))
    return known.withColumn("size", size).select("symbol", "ts", "longs", "shorts", "size")


def positions(df: DataFrame, signal: str, hold: int, key: str = "ticker", order: str = "date") -> DataFrame:
    """Enter on a non-zero signal when flat, leave after ``hold`` rows or at the opposite signal: a fold per key."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        pos, age, out = 0.0, 0, []
        for s in np.nan_to_num(group[signal].to_numpy(float)):
            if pos:
                age += 1
                if age >= hold or s == -pos:
                    pos = 0.0
            if not pos and s:
                pos, age = s, 0
            out.append(pos)
        return group.assign(position=out)

    return df.groupBy(key).applyInPandas(run, T.StructType([*df.schema.fields, T.StructField("position", T.DoubleType())]))


def accounted(df: DataFrame, key: str = "ticker", order: str = "date") -> DataFrame:
    """Return of yesterday's position."""
    held = F.lag("position").over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("strategy_return", held * F.col("ret"))


def inverse_variance(returns: DataFrame, x: str = "ret", key: str = "ticker") -> DataFrame:
    """Weights in proportion to one over the variance; the window has a row per key of an aggregate."""
    v = returns.groupBy(key).agg(F.try_divide(F.lit(1.0), F.var_samp(x)).alias("p"))
    total = v.agg(F.sum("p").alias("__all"))
    return v.join(F.broadcast(total), how="cross").select(key, (F.col("p") / F.col("__all")).alias("weight"))


def coint_statistics(df: DataFrame, x: str = "close", key: str = "ticker", on: str = "date", size: int = 128) -> DataFrame:
    """Hedge ratio and Dickey-Fuller t of the residual of every pair (a < b) over their common dates, by blocks of keys."""

    def one(x: np.ndarray, y: np.ndarray) -> tuple:
        both = ~(np.isnan(x) | np.isnan(y))
        x, y = x[both], y[both]
        dx = x - x.mean() if len(x) else x
        xx = dx @ dx
        if not xx > 0 or len(x) < 2:
            return max(len(x) - 1, 0), None, None
        beta = dx @ (y - y.mean()) / xx
        e = y - y.mean() - beta * dx
        lag, d = e[:-1], np.diff(e)
        with np.errstate(all="ignore"):
            g = (lag @ d) / (lag @ lag)
            t = g / np.sqrt((d @ d - g * (lag @ d)) / (len(e) - 2) / (lag @ lag))
        return len(e) - 1, beta, t if np.isfinite(t) else None

    def run(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        u, v = left.to_numpy(float), right.to_numpy(float)
        out = []
        for i, p in enumerate(left.columns):
            for j, q in enumerate(right.columns):
                if p < q:
                    out.append((p, q, *one(u[:, i], v[:, j])))
                elif q < p and not same:
                    out.append((q, p, *one(v[:, j], u[:, i])))
        found = pd.DataFrame(out, columns=["a", "b", "n", "beta", "t"])
        return found[found["n"] > 0]

    kind = dict(df.dtypes)[key]
    logs = df.select(key, on, F.ln(x).alias("__x"))
    return by_pair_blocks(logs, "__x", key, on, size, run, f"a {kind}, b {kind}, n long, beta double, t double")


def word_entropy(words: Column) -> Column:
    """Entropy (bits) of the words of an array, 0 of none."""
    n = F.size(words).cast("double")
    counts = F.transform(F.array_distinct(words), lambda v: F.size(F.filter(words, lambda u: u == v)) / n)
    return F.aggregate(counts, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def message_entropies(df: DataFrame, message: str, width: int = 2) -> DataFrame:
    """Shannon entropy of the letters and plug-in entropy of the words of ``width`` letters (the last word left out)."""
    letters = F.filter(F.split(message, ""), lambda c: c != "")
    last = F.length(message) - width
    words = F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(F.col(message), i, F.lit(width))))
    return df.withColumn("shannon", word_entropy(letters)).withColumn("plug_in", word_entropy(words) / width)


@F.pandas_udf(T.DoubleType())
def lempel_ziv(message: pd.Series) -> pd.Series:
    """Distinct phrases of a greedy parse over the length."""

    def one(s: str) -> float | None:
        seen, i = set(), 0
        while i < len(s):
            j = i + 1
            while j < len(s) and s[i:j] in seen:
                j += 1
            seen.add(s[i:j])
            i = j
        return len(seen) / len(s) if s else None

    return message.map(one)


def konto(message: str, window: int = 0) -> float | None:
    """Mean of log2 of the history's length over the longest match in it, plus one."""
    n = len(message)
    if window > 0:
        window = min(window, n // 2)
        points = range(window, n - window + 1) if window else range(0)
    else:
        points = range(1, n // 2 + 1)
    total = 0.0
    for i in points:
        back = window if window > 0 else i
        length = 0
        # A match of some length implies those of all shorter ones.
        while length < back and i + length < n and message.find(message[i : i + length + 1], i - back, i + length) >= 0:
            length += 1
        total += np.log2(back + 1) / (length + 1)
    return float(total / len(points)) if len(points) else 0.0


def konto_entropy(window: int = 0):
    """Arrow UDF of the match-length entropy of a message, its history ``window`` letters or, if 0, all before."""

    @F.pandas_udf(T.DoubleType())
    def of(message: pd.Series) -> pd.Series:
        return message.map(lambda s: None if s is None else konto(s, window))

    return of


def entropy_bins(n: float) -> int:
    """The number of bins that is best for the marginal entropy of n values."""
    z = (8 + 324 * n + 12 * (36 * n + 729 * n * n) ** 0.5) ** (1 / 3)
    return round(z / 6 + 2 / (3 * z) + 1 / 3)


@F.pandas_udf(T.DoubleType())
def histogram_entropy(window: pd.Series, n: pd.Series) -> pd.Series:
    """Entropy (natural) of the histogram of a window, its bins best for n values."""

    def one(x, k: int) -> float:
        share = np.histogram(np.asarray(x, float), entropy_bins(k))[0] / len(x)
        share = share[share > 0]
        return float(-(share * np.log(share)).sum())

    return pd.Series([one(x, k) for x, k in zip(window, n, strict=True)], dtype="float64")


def continuous_entropy(returns: DataFrame, rows: int = 50, x: str = "ret", key: str = "ticker", order: str = "date") -> DataFrame:
    """At each row the entropy of the ``rows`` values before it; a key's number of values sets the bins."""
    w = Window.partitionBy(key).orderBy(order)
    known = returns.where(F.col(x).isNotNull()).select(key, order, x)
    known = known.withColumn("__n", F.count("*").over(Window.partitionBy(key))).withColumn("__x", F.collect_list(x).over(w.rowsBetween(-rows, -1)))
    return known.where(F.size("__x") == rows).select(key, order, histogram_entropy("__x", "__n").alias("entropy"))


def js_divergence(returns: DataFrame, x: str = "ret", key: str = "ticker", on: str = "date", size: int = 64) -> DataFrame:
    """Jensen-Shannon divergence of the Gaussian kernel densities of every pair over common dates, summed over a grid of as many points."""

    def density(v: np.ndarray, grid: np.ndarray) -> np.ndarray:
        h = v.std(ddof=1) * len(v) ** -0.2
        return np.concatenate([np.exp(-(((g[:, None] - v) / h) ** 2) / 2).sum(1) for g in np.array_split(grid, len(grid) // 512 + 1)]) / (len(v) * h * math.sqrt(2 * math.pi))

    def one(a: np.ndarray, b: np.ndarray) -> float | None:
        both = ~(np.isnan(a) | np.isnan(b))
        a, b = a[both], b[both]
        if len(a) < 2 or not a.std() > 0 or not b.std() > 0:
            return None
        grid = np.linspace(min(a.min(), b.min()), max(a.max(), b.max()), len(a))
        p, q = density(a, grid), density(b, grid)
        m = (p + q) / 2
        with np.errstate(all="ignore"):
            return float(sum(np.where((f > 0) & (m > 0), f * np.log(f / m), 0.0).sum() / 2 for f in (p, q)))

    def run(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        u, v = left.to_numpy(float), right.to_numpy(float)
        out = [(min(p, q), max(p, q), one(u[:, i], v[:, j])) for i, p in enumerate(left.columns) for j, q in enumerate(right.columns) if p < q or (p > q and not same)]
        return pd.DataFrame(out, columns=["a", "b", "js"])

    kind = dict(returns.dtypes)[key]
    return by_pair_blocks(returns, x, key, on, size, run, f"a {kind}, b {kind}, js double")


@F.pandas_udf(T.DoubleType())
def hurst_rs(window: pd.Series) -> pd.Series:
    """Rescaled-range exponent of a window of values, over all chunk lengths from 2 to 19."""

    found = pd.Series(np.nan, index=window.index)
    for _, same in window.groupby(window.map(len)):
        x = np.stack([np.asarray(v, float) for v in same])
        sizes = range(2, min(20, x.shape[1] + 1))
        if len(sizes) < 2:
            continue
        logs = []
        for n in sizes:
            parts = x[:, : x.shape[1] // n * n].reshape(len(x), -1, n)
            dev = np.cumsum(parts - parts.mean(2, keepdims=True), 2)
            s = parts.std(2)
            with np.errstate(divide="ignore"):
                logs.append(np.log(((dev.max(2) - dev.min(2)) / np.where(s == 0, 1, s)).mean(1)))
        t = np.log(sizes) - np.log(sizes).mean()
        with np.errstate(invalid="ignore"):
            slope = t @ np.array(logs) / (t @ t)
        found[same.index] = np.where(np.isfinite(slope), slope, np.nan)
    return found.astype(object).where(found.notna(), None)


def _slope(x, y, w=None) -> float:
    """Of a line through the points; w weighs the squared departures."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    w = np.ones_like(x) if w is None else np.asarray(w, float)
    dx = x - (w @ x) / w.sum()
    return float((w * dx) @ y / ((w * dx) @ dx)) if (dx != 0).any() else math.nan


def hurst_dfa(x: np.ndarray, least: int = 10) -> float:
    """Growth of the departures from lines in boxes of 10 to a quarter of the values, weighted by box size."""
    n = len(x)
    if n // 4 < least:
        return math.nan
    y = np.cumsum(x - x.mean())
    sizes, logs = [], []
    for size in np.unique(np.logspace(np.log10(least), np.log10(n // 4), 30).astype(int)):
        parts = y[: n // size * size].reshape(-1, size)
        t = np.arange(size) - (size - 1) / 2
        flat = parts - parts.mean(1, keepdims=True)
        off = flat - np.outer(flat @ t / (t @ t), t)
        if (f := np.sqrt((off * off).mean())) > 0:
            sizes.append(size)
            logs.append(np.log(f))
    return _slope(np.log(sizes), logs, sizes) if len(sizes) > 1 else math.nan


def hurst_aggvar(x: np.ndarray, most: int = 20) -> float:
    """From the fall of the variance of means of 1 to ``most`` values."""
    ks = [k for k in range(1, most + 1) if len(x) // k >= 2]
    v = [x[: len(x) // k * k].reshape(-1, k).mean(1).var() for k in ks]
    return _slope(np.log(ks), np.log(v)) / 2 + 1 if len(ks) > 1 and min(v) > 0 else math.nan


def hurst_higuchi(x: np.ndarray, most: int = 20) -> float:
    """Slope of the curve's length, measured at steps of 1 to ``most`` values."""
    n, ks, logs = len(x), [], []
    for k in range(1, min(most, n - 1) + 1):
        subs = [x[m::k] for m in range(k) if len(x[m::k]) > 1]
        length = sum(np.abs(np.diff(s)).sum() * (n - 1) / (k * k * len(s)) for s in subs) / k
        if length > 0:
            ks.append(k)
            logs.append(np.log(length))
    return _slope(np.log(ks), logs) if len(ks) > 1 else math.nan


def _each(one):
    @F.pandas_udf(T.DoubleType())
    def of(window: pd.Series) -> pd.Series:
        found = [one(np.asarray(v, float)) for v in window]
        return pd.Series([h if math.isfinite(h) else None for h in found], dtype="object")

    return of


HURST = {"rs": lambda: hurst_rs, "dfa": lambda: _each(hurst_dfa), "aggvar": lambda: _each(hurst_aggvar), "higuchi": lambda: _each(hurst_higuchi)}


def rolling_hurst(returns: DataFrame, width: int = 128, step: int = 1, method: str = "rs", x: str = "ret", key: str = "ticker", order: str = "date") -> DataFrame:
    """The exponent (method: rs, dfa, aggvar or higuchi) of each full window of ``width`` values, at every ``step``-th row from the first on."""
    w = Window.partitionBy(key).orderBy(order)
    known = returns.where(F.col(x).isNotNull()).withColumn("i", F.row_number().over(w)).withColumn("x", F.collect_list(x).over(w.rowsBetween(1 - width, 0)))
    return known.where((F.col("i") >= width) & ((F.col("i") - width) % step == 0)).select(key, order, HURST[method]()("x").alias("hurst"))


def alpha_momentum(returns: DataFrame, windows: tuple[int, ...] = (10, 20, 60), x: str = "ret", key: str = "ticker", order: str = "date") -> DataFrame:
    """alpha_n and beta_n: the last n returns of a key regressed on the mean return of their dates; NULL before n returns.

    Two exchanges: by date for the mean, which is partial first, and by key."""
    known = returns.where(F.col(x).isNotNull()).select(key, order, x)
    market = known.groupBy(order).agg(F.avg(x).alias("market"))
    joined = known.join(market, order)
    made = {}
    for n in windows:
        w = Window.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0)
        full = F.count("*").over(w) == n
        made[f"alpha_{n}"] = F.when(full, F.regr_intercept(x, "market").over(w))
        made[f"beta_{n}"] = F.when(full, F.regr_slope(x, "market").over(w))
    return joined.select(key, order, *[c.alias(n) for n, c in made.items()])


def classification_scores(scored: DataFrame, keys: list[str], threshold: float = 0.5, gain: float = 100.0, loss: float = -100.0) -> DataFrame:
    """Per group of rows (label 0 or 1, p its probability of 1): accuracy weighted by confidence, profit by a fixed gain and loss, and the area under the ROC curve.

    The area is that of ranks, ties by half; rows are counted by score first."""
    hit = (F.col("p") > threshold) == (F.col("label") == 1)
    sure = F.greatest(F.col("p"), 1 - F.col("p")) - 0.5
    plain = scored.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.sum(F.when(hit, sure).otherwise(0.0)), F.sum(sure)), F.lit(0.0)).alias("weighted_accuracy"),
        F.sum(F.when(hit, gain).otherwise(loss)).alias("profit"),
    )
    counts = scored.groupBy(*keys, "p").agg(F.sum(F.col("label").cast("double")).alias("up"), F.sum(1.0 - F.col("label")).alias("down"))
    below = F.coalesce(F.sum("down").over(Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    area = counts.withColumn("below", below).groupBy(*keys).agg(F.try_divide(F.sum(F.col("up") * (F.col("below") + F.col("down") / 2)), F.sum("up") * F.sum("down")).alias("auc"))
    return plain.join(area, keys)


def month_concentration(events: DataFrame, on: str = "t0", key: str = "symbol") -> DataFrame:
    """Normalised concentration of a key's events over the months that have any; NULL for two months or fewer."""
    counts = events.groupBy(key, F.date_trunc("month", on).alias("month")).agg(F.count("*").cast("double").alias("n"))
    share = F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))
    months = F.count("*")
    return counts.groupBy(key).agg(months.alias("months"), F.when(months > 2, (share - 1 / months) / (1 - 1 / months)).alias("concentration"))


def top_features(importances: DataFrame, n: int, by: str = "method") -> DataFrame:
    """Features among the n most or n least important ones of any method, once each, with the methods that name them."""
    high, low = (F.row_number().over(Window.partitionBy(by).orderBy(o, "feature")) for o in (F.col("importance").desc(), F.col("importance")))
    chosen = importances.withColumn("__h", high).withColumn("__l", low).where((F.col("__h") <= n) | (F.col("__l") <= n))
    return chosen.groupBy("feature").agg(F.array_join(F.array_sort(F.collect_set(by)), ",").alias("methods"))


def ranked(results: DataFrame, by: str, key: str = "ticker") -> DataFrame:
    """Results with their place, best first, ties by key; the window has a row per result."""
    return results.withColumn("place", F.row_number().over(Window.orderBy(F.col(by).desc(), key)))
