"""Structural breaks, filters, bootstrap and roll operators: small dense work per key.

Each runs as one grouped pass over a key's ordered values; SADF is spread
further, over blocks of end points, since every end point is independent.
"""

from __future__ import annotations

import math
from collections import deque
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.factors.market import fractional_weights
from .carried import carried


def _fold(df: DataFrame, key: str, order: str, run, schema: str) -> DataFrame:
    return df.groupBy(key).applyInPandas(lambda g: run(g.sort_values(order)), schema)


def _head(df: DataFrame, key: str, order: str) -> str:
    kinds = dict(df.dtypes)
    return f"{key} {kinds[key]}, {order} {kinds[order]}"


def csw_cusum(df: DataFrame, x: str = "close", two_sided: bool = False, key: str = "ticker", order: str = "date") -> DataFrame:
    """At each row from the third on the largest standardised departure (its size, if two-sided) of the log level from an earlier one, and its critical value."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        y = np.log(g[x].to_numpy(float))
        steps = np.r_[np.nan, np.diff(y) ** 2]
        stat, crit = np.full(len(y), np.nan), np.full(len(y), np.nan)
        for t in range(2, len(y)):
            var = np.nansum(steps[1 : t + 1]) / (t - 1)
            k = np.arange(t)
            gap = y[t] - y[:t]
            s = (np.abs(gap) if two_sided else gap) / (var * np.sqrt(t - k)) if var > 0 else np.full(t, np.nan)
            if np.isfinite(s).any():
                best = int(np.nanargmax(s))
                stat[t], crit[t] = s[best], math.sqrt(4.6 + math.log(t - best))
        return g[[key, order]].assign(stat=stat, critical=crit)

    return _fold(df.select(key, order, x), key, order, run, f"{_head(df, key, order)}, stat double, critical double")


def chow_df(df: DataFrame, x: str = "close", key: str = "ticker", order: str = "date") -> DataFrame:
    """Dickey-Fuller t with the lag zeroed before each possible break: suffix sums, no fold."""
    w = Window.partitionBy(key).orderBy(order)
    ahead, whole = w.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(key)
    known = df.select(key, order, F.ln(x).alias("y")).withColumn("l", F.lag("y").over(w)).withColumn("d", F.col("y") - F.col("l")).where("l IS NOT NULL")
    s = known.withColumn("xx", F.sum(F.col("l") * F.col("l")).over(ahead)).withColumn("xd", F.sum(F.col("l") * F.col("d")).over(ahead))
    s = s.withColumn("dd", F.sum(F.col("d") * F.col("d")).over(whole)).withColumn("n", F.count("*").over(whole))
    beta = F.try_divide("xd", "xx")
    se = F.sqrt(F.try_divide((F.col("dd") - beta * F.col("xd")) / (F.col("n") - 1), F.col("xx")))
    return s.where("n > 2").select(key, order, F.try_divide(beta, se).alias("t"))


def bde_cusum(df: DataFrame, x: str = "ret", key: str = "ticker", order: str = "date") -> DataFrame:
    """Brown-Durbin-Evans sums with running mean and variance; the shift looked for is the key's median.

    s is the one-sided sum, g its rise above its least value so far (or 0), up
    and down the rises for a shift of either sign.
    """
    w = Window.partitionBy(key).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    known = df.where(F.col(x).isNotNull()).withColumn("__m", F.percentile(x, F.lit(0.5)).over(Window.partitionBy(key)))
    first = F.row_number().over(w) == 1
    known = known.withColumn("__u", F.when(first, 0.0).otherwise(F.avg(x).over(upto))).withColumn("__v", F.when(first, 1.0).otherwise(F.var_pop(x).over(upto)))
    m, size, gap = F.col("__m"), F.abs("__m"), F.col(x) - F.col("__u")
    steps = {"s": m * (gap - m / 2), "up": size * (gap - size / 2), "down": -size * (gap + size / 2)}
    known = known.withColumns({f"__{n}": F.sum(F.coalesce(F.try_divide(c, "__v"), F.lit(0.0))).over(upto) for n, c in steps.items()})

    def rise(c: str):
        return F.col(c) - F.least(F.min(c).over(upto), F.lit(0.0))

    return known.select(key, order, F.col("__s").alias("s"), rise("__s").alias("g"), rise("__up").alias("up"), rise("__down").alias("down"))


#: Trend of each model, and whether it is a regression on trends alone.
SADF_MODELS = {"none": (), "linear": (1,), "quadratic": (2,), "sm_poly_1": (1, 2), "sm_poly_2": (1, 2), "sm_exp": (1,), "sm_power": ("log",)}


def _sadf_data(level: np.ndarray, model: str, lags: int, constant: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Regressors (the tested one first), response and the row of the first response."""
    if constant and len(level):
        level = level - level.mean()  # which no t can tell
    d = np.diff(level)
    n = max(len(d) - lags, 0)
    skip = int(model == "sm_power" and n > 0)  # the log of row 0 is not finite
    k = np.arange(skip, n, dtype=float)
    trends = [np.log(k) if t == "log" else (k / max(n, 1)) ** t for t in SADF_MODELS[model]]  # the scale does not change a t
    if model.startswith("sm_"):
        return np.stack([trends[-1], np.ones(n - skip), *trends[:-1]], 1), level[lags + 1 + skip :], lags + 1 + skip
    columns = [level[lags:-1] if n else level[:0], *(d[lags - j : len(d) - j] for j in range(1, lags + 1)), *trends]
    if constant:
        columns.append(np.ones(n))
    return np.stack(columns, 1), d[lags:], lags + 1


class _Sums:
    """Prefix sums of a regression, which give the normal equations of every start and end."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        zero = np.zeros((1, x.shape[1]))
        with np.errstate(invalid="ignore"):
            self.xx = np.concatenate([zero[:, :, None] * zero[:, None, :], np.cumsum(x[:, :, None] * x[:, None, :], 0)])
            self.xy, self.yy = np.concatenate([zero, np.cumsum(x * y[:, None], 0)]), np.r_[0.0, np.cumsum(y * y)]
        self.columns = x.shape[1]

    def largest_t(self, rows: int, least: int) -> float:
        """Of the first regressor over all starts that leave at least ``least`` of the first rows; NaN without one."""
        starts = slice(0, rows - least + 1)
        xx, xy, yy, n = self.xx[rows] - self.xx[starts], self.xy[rows] - self.xy[starts], self.yy[rows] - self.yy[starts], rows - np.arange(rows - least + 1)
        with np.errstate(all="ignore"):
            scale = np.sqrt(np.diagonal(xx, axis1=1, axis2=2))
            unit = xx / scale[:, :, None] / scale[:, None, :]
            solid = np.linalg.det(unit) > 1e-13
            if not solid.any():
                return math.nan
            inverse, v = np.linalg.inv(unit[solid]), (xy / scale)[solid]
            beta = np.einsum("sij,sj->si", inverse, v)
            t = beta[:, 0] / np.sqrt((yy[solid] - (beta * v).sum(1)) / (n[solid] - self.columns) * inverse[:, 0, 0])
        t = t[np.isfinite(t)]
        return float(t.max()) if len(t) else math.nan


def sadf(df: DataFrame, model: str = "none", lags: int = 0, constant: bool = True, x: str = "close", least: int = 40, every: int = 1, block: int = 200, key: str = "ticker", order: str = "date") -> DataFrame:
    """Largest t of the explosiveness term over all starts, at every end point with more than ``least`` rows (each ``every``-th, if asked), in blocks of end points.

    model: none, linear or quadratic (a Dickey-Fuller regression of the log's
    differences with that trend, ``lags`` lagged differences and a constant), or
    sm_poly_1 (of the level itself), sm_poly_2, sm_exp, sm_power (of its log),
    which test a trend term.  Each block is given the key's history, which the
    regressions of its end points read whole.
    """
    level = F.col(x).cast("double") if model == "sm_poly_1" else F.ln(x)
    path = df.select(key, order, level.alias("y")).where("y IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "y"))).alias("p"))
    ends = path.withColumn("b", F.explode(F.sequence(F.lit(0), F.floor(F.size("p") / F.lit(every * block)).cast("int"))))
    # The blocks of a key are spread over tasks.
    ends = ends.repartition(key, "b")
    kinds = dict(df.dtypes)

    def run(parts):
        for part in parts:
            out = []
            for row in part.itertuples():
                known, y, first = _sadf_data(np.array([p["y"] for p in row.p], float), model, lags, constant)
                sums = _Sums(known, y)
                for end in range(row.b * every * block + every - 1, min(len(row.p), (row.b + 1) * every * block), every):
                    if end - lags > least:
                        t = sums.largest_t(end - first + 1, least)
                        if math.isfinite(t):
                            out.append((getattr(row, key), row.p[end][order], t))
            yield pd.DataFrame(out, columns=[key, order, "sadf"])

    return ends.mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, sadf double")


#: 95 % points of the trace and largest-eigenvalue statistics with a constant, for 1 to 7 series.
TRACE_95 = (3.8415, 15.4943, 29.7961, 47.8545, 69.8189, 95.7542, 125.6185)
EIGEN_95 = (3.8415, 14.2639, 21.1314, 27.5858, 33.8777, 40.0763, 46.2299)


def johansen(df: DataFrame, basket: str, x: str = "close", key: str = "ticker", order: str = "date") -> DataFrame:
    """Cointegration ranks of the log prices of each basket of 2 to 7 keys (one lag, constant), over the dates that all have.

    A group is one basket; its size in keys is bounded by the tables of critical values, and larger ones raise.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        y = np.log(g.pivot_table(index=order, columns=key, values=x)).dropna().to_numpy()
        n = y.shape[1]
        if n > len(TRACE_95):
            raise ValueError(f"a basket holds {n} keys, more than {len(TRACE_95)}")
        if len(y) < 3 * n + 3:
            return pd.DataFrame({"basket": [], "r": [], "trace": [], "eigen": [], "trace_rank": [], "eigen_rank": []})
        d = np.diff(y - y.mean(0), axis=0)
        z = d[:-1] - d[:-1].mean(0)

        def rest(v: np.ndarray) -> np.ndarray:
            v = v - v.mean(0)
            return v - z @ np.linalg.lstsq(z, v, rcond=None)[0]

        r0, rk = rest(d[1:]), rest(y[1:-1])
        s00, skk, sk0 = r0.T @ r0 / len(r0), rk.T @ rk / len(r0), rk.T @ r0 / len(r0)
        root = np.linalg.inv(np.linalg.cholesky(skk))
        values = np.sort(np.linalg.eigvalsh(root @ sk0 @ np.linalg.solve(s00, sk0.T) @ root.T))[::-1]
        logs = -len(r0) * np.log(1 - np.clip(values, 0, 1 - 1e-12))
        trace = np.cumsum(logs[::-1])[::-1]

        def rank(stat: np.ndarray, table: tuple) -> int:
            passed = stat > np.array(table[:n])[::-1]
            return int(np.argmin(passed)) if not passed.all() else n

        return pd.DataFrame({"basket": g[basket].iloc[0], "r": range(n), "trace": trace, "eigen": logs, "trace_rank": rank(trace, TRACE_95), "eigen_rank": rank(logs, EIGEN_95)})

    return df.groupBy(basket).applyInPandas(run, f"basket {dict(df.dtypes)[basket]}, r int, trace double, eigen double, trace_rank int, eigen_rank int")


def adf(y: np.ndarray) -> tuple[float, float, int]:
    """Augmented Dickey-Fuller t with one lag and a constant, its 5 % point and the number of rows."""
    d = np.diff(y)
    n = len(d) - 1
    a = np.column_stack([y[1:-1], d[:-1], np.ones(n)])
    inverse = np.linalg.pinv(a.T @ a)
    beta = inverse @ a.T @ d[1:]
    rest = d[1:] - a @ beta
    # Fixed values of the response surface of the 5 % point.
    point = -2.86154 - 2.8903 / n - 4.234 / n**2 - 40.04 / n**3
    return float(beta[0] / math.sqrt(max(rest @ rest / (n - 3) * inverse[0, 0], 1e-300))), point, n


def ffd_search(df: DataFrame, steps: int = 20, least: float = 1e-2, x: str = "close", key: str = "ticker", order: str = "date") -> DataFrame:
    """For d from 0 to 1 the test of the fractional difference of the log level, its correlation with the level, and whether d is the least that is stationary at 5 %.

    Each key and d is a group of its own.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        d = float(g["d"].iloc[0])
        y, w = np.log(g.sort_values(order)[x].to_numpy(float)), np.array(fractional_weights(d, least))
        if len(y) < len(w) + 10:
            return pd.DataFrame({key: [], "d": [], "adf": [], "critical": [], "n": [], "corr": []})
        moved = np.convolve(y, w, "valid")
        stat, point, n = adf(moved)
        with np.errstate(all="ignore"):
            corr = np.corrcoef(y[len(w) - 1 :], moved)[0, 1]
        return pd.DataFrame({key: [g[key].iloc[0]], "d": d, "adf": stat, "critical": point, "n": n, "corr": corr})

    each = df.select(key, order, x).where(F.col(x) > 0).withColumn("d", F.explode(F.array(*[F.lit(round(k / steps, 10)) for k in range(steps + 1)])))
    found = each.groupBy(key, "d").applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, d double, adf double, critical double, n long, corr double")
    first = F.min(F.when(F.col("adf") < F.col("critical"), F.col("d"))).over(Window.partitionBy(key))
    return found.withColumn("optimal", F.coalesce(F.col("d") == first, F.lit(False)))


def kalman(df: DataFrame, q: float = 1e-3, r: float = 1.0, x: str = "close", key: str = "ticker", order: str = "date") -> DataFrame:
    """Level and slope of a constant-velocity filter with discrete white noise q, and the level smoothed back over the whole series (Rauch, Tung and Striebel).

    It starts at level 0 and slope 1 with covariance 10 I.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        y = g[x].to_numpy(float)
        f, h = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([1.0, 0.0])
        noise = q * np.array([[0.25, 0.5], [0.5, 1.0]])
        s, p, out, cov = np.array([0.0, 1.0]), 10 * np.eye(2), [], []
        for v in y:
            s, p = f @ s, f @ p @ f.T + noise
            k = p @ h / (h @ p @ h + r)
            s, p = s + k * (v - h @ s), p - np.outer(k, h @ p)
            out.append(s)
            cov.append(p)
        smooth = [out[-1]]
        for s, p in zip(out[-2::-1], cov[-2::-1], strict=True):
            ahead = f @ p @ f.T + noise
            smooth.append(s + p @ f.T @ np.linalg.solve(ahead, smooth[-1] - f @ s))
        out = np.array(out)
        return g[[key, order]].assign(level=out[:, 0], slope=out[:, 1], smooth=np.array(smooth[::-1])[:, 0])

    return _fold(df.select(key, order, x), key, order, run, f"{_head(df, key, order)}, level double, slope double, smooth double")


def fracdiff(df: DataFrame, d: float = 0.4, least: float = 1e-5, x: str = "close", key: str = "ticker", order: str = "date") -> DataFrame:
    """Fixed-width fractional difference of the log level, weights down to ``least``; NULL until the window is full."""
    w = np.array(fractional_weights(d, least))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        y = np.log(g[x].to_numpy(float))
        out = np.full(len(y), np.nan)
        if len(y) >= len(w):
            out[len(w) - 1 :] = np.convolve(y, w, "valid")
        return g[[key, order]].assign(fracdiff=out)

    return _fold(df.select(key, order, x), key, order, run, f"{_head(df, key, order)}, fracdiff double")


def fracdiff_expanding(df: DataFrame, d: float = 0.4, loss: float = 0.01, x: str = "close", key: str = "ticker", order: str = "date") -> DataFrame:
    """Fractional difference of the log level over all earlier rows; NULL while the weights left out exceed ``loss`` of all."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        y = np.log(g[x].to_numpy(float))
        w = np.r_[1.0, np.cumprod(-(d - np.arange(len(y) - 1)) / np.arange(1, len(y)))]
        share = np.cumsum(np.abs(w[::-1])) / np.abs(w).sum()
        out = np.convolve(y, w)[: len(y)]
        out[: int((share > loss).sum())] = np.nan
        return g[[key, order]].assign(fracdiff=out)

    return _fold(df.select(key, order, x), key, order, run, f"{_head(df, key, order)}, fracdiff double")


def sequential_bootstrap(spans: DataFrame, draws: int | None = None, seed: int = 7) -> DataFrame:
    """Labels (symbol, i0, i1: row spans) drawn in proportion to their average uniqueness given the draws so far; as many as a symbol has labels, unless told."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        n = len(g) if draws is None else draws
        g = g.sort_values(["i0", "i1"])
        a, b = g["i0"].to_numpy(), g["i1"].to_numpy()
        low = a.min()
        count = np.zeros(b.max() - low + 2)
        rng = np.random.default_rng([seed, int.from_bytes(str(g["symbol"].iloc[0]).encode()[:8], "little")])
        drawn = []
        for _ in range(n):
            prefix = np.r_[0.0, np.cumsum(1 / (count + 1))]
            unique = (prefix[b - low + 1] - prefix[a - low]) / (b - a + 1)
            pick = int(rng.choice(len(a), p=unique / unique.sum()))
            count[a[pick] - low : b[pick] - low + 1] += 1
            drawn.append((a[pick], b[pick]))
        return pd.DataFrame({"symbol": g["symbol"].iloc[0], "draw": range(n), "i0": [x for x, _ in drawn], "i1": [y for _, y in drawn]})

    return spans.select("symbol", "i0", "i1").groupBy("symbol").applyInPandas(run, f"symbol {dict(spans.dtypes)['symbol']}, draw int, i0 int, i1 int")


def roll_gaps(df: DataFrame, contract: str, key: str = "ticker", order: str = "date", backward: bool = True) -> DataFrame:
    """Cumulative gap between a new contract's open and the old one's close."""
    w = Window.partitionBy(key).orderBy(order)
    changed = F.col(contract) != F.lag(contract).over(w)
    known = df.withColumn("__g", F.when(changed, F.col("open") - F.lag("close").over(w)).otherwise(0.0))
    known = known.withColumn("gap", F.sum("__g").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last("gap").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return known.withColumn("gap", F.col("gap") - last if backward else F.col("gap")).drop("__g")


class DynamicZScore:
    """Signals of a robust online z-score; state: the last ``lag`` filtered values, their mean and deviation, and the count."""

    def __init__(self, lag: int = 30, threshold: float = 3.0, influence: float = 0.5, ring=(), mean: float = 0.0, dev: float = 0.0, n: int = 0, x: str = ""):
        self.lag, self.threshold, self.influence, self.x = lag, threshold, influence, x
        self.ring, self.mean, self.dev, self.n = deque(ring, maxlen=lag), mean, dev, n

    def step(self, y: float) -> int:
        """The mean and deviation that a value is held against end two values before it, but for the first one's."""
        signal, kept = 0, y
        if self.n > self.lag:
            if abs(y - self.mean) > self.threshold * self.dev:
                signal = 1 if y > self.mean else -1
                kept = self.influence * y + (1 - self.influence) * self.ring[-1]
        if self.n >= self.lag:
            held = np.fromiter(self.ring, float)
            self.mean, self.dev = float(held.mean()), float(held.std())
        self.ring.append(kept)
        self.n += 1
        return signal

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        signal = np.fromiter((self.step(y) for y in rows[self.x].astype(float)), np.int32, len(rows))
        return rows.drop(columns=self.x).assign(signal=signal)


def dynamic_zscore(df: DataFrame, lag: int = 30, threshold: float = 3.0, influence: float = 0.5, x: str = "close", key: str = "ticker", order: str = "date") -> DataFrame:
    """Signal of a robust online z-score over the last filtered values, in sorted batches."""
    read = df.select(key, order, x)
    return carried(read, [key], [order], lambda: DynamicZScore(lag, threshold, influence, x=x), f"{_head(df, key, order)}, signal int")


class RecursiveLeastSquares:
    """Products of regressors and values of the rows so far; residuals of each next row against a fit to those before it."""

    def __init__(self, y: str, xs: list[str], ridge: float):
        self.y, self.xs, self.ridge = y, xs, ridge
        p = len(xs) + 1
        self.xx, self.xy, self.n = np.zeros((p, p)), np.zeros(p), 0

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.c_[np.ones(len(rows)), rows[self.xs].to_numpy(float)]
        y = rows[self.y].to_numpy(float)
        # Sums up to and without each row, whose fits are then solved together.
        xx = np.concatenate([self.xx[None], self.xx + np.cumsum(x[:, :, None] * x[:, None, :], axis=0)])
        xy = np.concatenate([self.xy[None], self.xy + np.cumsum(x * y[:, None], axis=0)])
        self.xx, self.xy = xx[-1], xy[-1]
        inverse = np.linalg.pinv(xx[:-1], hermitian=True)
        expected = np.einsum("ni,nij,nj->n", x, inverse, xy[:-1])
        spread = np.einsum("ni,nij,nj->n", x, np.linalg.inv(xx[:-1] + self.ridge * np.eye(x.shape[1])), x)
        residual = (y - expected) / np.sqrt(1 + spread)
        if not self.n:
            residual[:1] = 0.0
        i = self.n + np.arange(len(rows))
        self.n += len(rows)
        return rows.drop(columns=[self.y, *self.xs]).assign(i=i, residual=residual)


def recursive_residuals(df: DataFrame, y: str, xs: list[str], alpha: float = 0.05, ridge: float = 1e-5, key: str = "ticker", order: str = "date") -> DataFrame:
    """Recursive residuals of a regression (with a constant), their cumulated sum over their deviation, and its critical bound.

    Each row is held against the least-squares fit to the rows before it (of
    least norm while those are too few), over the root of 1 plus its ridged
    leverage; the first residual is 0. Rows with a null among them are left out.
    """
    read = df.select(key, order, *[F.col(c).cast("double").alias(c) for c in (y, *xs)]).dropna(subset=[y, *xs])
    found = carried(read, [key], [order], lambda: RecursiveLeastSquares(y, xs, ridge), f"{_head(df, key, order)}, i long, residual double")
    whole, upto = Window.partitionBy(key), Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(whole)
    z = NormalDist().inv_cdf(1 - alpha / 2)
    cusum = F.try_divide(F.sum("residual").over(upto), F.stddev_pop("residual").over(whole))
    return found.withColumn("cusum", cusum).withColumn("critical", F.sqrt(n.cast("double")) * (1 + 2 * F.col("i") / n) * z).drop("i")
