"""Cross-sectional and screening operators over long panels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sector_index(panel: DataFrame, column: str = "amount", days: int = 1) -> DataFrame:
    """Sum over a sector's members by date, and its change over days."""
    summed = panel.groupBy("sector", "date").agg(F.sum(column).alias("total"))
    w = Window.partitionBy("sector").orderBy("date")
    return summed.withColumn("change", F.try_divide("total", F.lag("total", days).over(w)) - 1)


def standardize(df: DataFrame, x: str, by: str = "date") -> DataFrame:
    w = Window.partitionBy(by)
    return df.withColumn(f"{x}_z", F.try_divide(F.col(x) - F.avg(x).over(w), F.stddev_samp(x).over(w)))


def neutral_dummy(df: DataFrame, x: str, by: tuple[str, ...] = ("date", "sector")) -> DataFrame:
    """Residual of x on sector dummies: what is left of x after its group's mean."""
    return df.withColumn(f"{x}_neutral", F.col(x) - F.avg(x).over(Window.partitionBy(*by)))


def industry_ratio(df: DataFrame, x: str, by: tuple[str, ...] = ("date", "sector")) -> DataFrame:
    filled = F.coalesce(F.col(x), F.lit(0.0))
    return df.withColumn(f"{x}_ratio", F.try_divide(filled, F.avg(filled).over(Window.partitionBy(*by))))


def winsor_quantile(df: DataFrame, x: str, by: str = "date", low: float = 0.025, high: float = 0.975, drop: bool = False) -> DataFrame:
    """Clip x to its group's quantiles, or drop the rows outside."""
    edges = df.groupBy(by).agg(F.percentile(x, F.array(F.lit(low), F.lit(high))).alias("__q"))
    joined = df.join(edges, by)
    lo, hi = F.get("__q", F.lit(0)), F.get("__q", F.lit(1))
    out = joined.where(F.col(x).between(lo, hi)) if drop else joined.withColumn(x, F.greatest(F.least(F.col(x), hi), lo))
    return out.drop("__q")


def winsor_mad(df: DataFrame, x: str, by: str = "date", n: float = 3.0, drop: bool = False) -> DataFrame:
    """Clip x to its group's median plus or minus n times 1.483 mean absolute deviations (medians of both)."""
    middle = df.groupBy(by).agg(F.median(x).alias("__m"))
    joined = df.join(middle, by)
    spread = joined.groupBy(by).agg(F.median(F.abs(F.col(x) - F.col("__m"))).alias("__d"))
    joined = joined.join(spread, by)
    lo, hi = F.col("__m") - n * 1.483 * F.col("__d"), F.col("__m") + n * 1.483 * F.col("__d")
    out = joined.where(F.col(x).isNull() | F.col(x).between(lo, hi)) if drop else joined.withColumn(x, F.greatest(F.least(F.col(x), hi), lo))
    return out.drop("__m", "__d")


def bin_quantile(df: DataFrame, x: str, boxes: int, by: str = "date") -> DataFrame:
    """Quantile boxes of the distinct values, the smallest in the last box; NULL with fewer distinct values than boxes."""
    shares = F.array(*[F.lit(k / boxes) for k in range(1, boxes)])
    edges = df.select(by, x).distinct().groupBy(by).agg(F.percentile(x, shares).alias("__e"), F.count(x).alias("__n"))
    above = F.size(F.filter("__e", lambda e: F.col(x) > e))
    box = F.when((F.col("__n") >= boxes) & F.col(x).isNotNull(), F.lit(boxes) - above)
    return df.join(edges, by).withColumn("box", box).drop("__e", "__n")


def screen_all(df: DataFrame, condition: Column, key: str = "ticker") -> DataFrame:
    """Rows of the keys whose every row satisfies the condition."""
    good = df.groupBy(key).agg(F.bool_and(condition).alias("__all")).where("__all").select(key)
    return df.join(good, key, "left_semi")


def screen_gain(df: DataFrame, least: float, key: str = "ticker") -> DataFrame:
    """Last close over the first, times 100, of the keys that exceed ``least``."""
    ends = df.groupBy(key).agg(F.min_by("close", "date").alias("a"), F.max_by("close", "date").alias("b"))
    return ends.select(key, (F.try_divide("b", "a") * 100).alias("gain")).where(F.col("gain") > least)


def enough_rows(df: DataFrame, least: int = 3, key: str = "ticker") -> DataFrame:
    return df.join(df.groupBy(key).count().where(F.col("count") > least).select(key), key, "left_semi")


def drop_zero_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table without those of the columns that are 0, false or NULL in all rows; truth values become 1 and 0. One aggregate decides."""
    kinds = dict(df.dtypes)
    as_number = {c: F.col(c).cast("int") if kinds[c] == "boolean" else F.col(c) for c in columns}
    top = df.agg(*[F.max(F.abs(as_number[c])).alias(c) for c in columns]).first()
    return df.withColumns({c: as_number[c] for c in columns if kinds[c] == "boolean"}).drop(*[c for c in columns if not top[c]])


def drop_constant(df: DataFrame, x: str, key: str = "ticker") -> DataFrame:
    """Rows of the keys whose x takes more than one value."""
    varied = df.groupBy(key).agg(F.min(x).alias("a"), F.max(x).alias("b")).where("a < b").select(key)
    return df.join(varied, key, "left_semi")


def rank_score(df: DataFrame, columns: list[str], key: str = "ticker") -> DataFrame:
    """Mean over columns of the ascending rank (ties: the largest) of each key's mean.

    The window has a row per key of an aggregate: the universe, not the data.
    """
    means = df.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns])
    ranked = [F.count(c).over(Window.orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow)) for c in columns]
    return means.select(key, F.round(sum(ranked[1:], ranked[0]) / len(columns), 2).alias("score"))


def minmax_score(df: DataFrame, columns: list[str], key: str = "ticker") -> DataFrame:
    means = df.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns])
    ends = means.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = [F.try_divide(F.col(c) - F.col(f"{c}_lo"), F.col(f"{c}_hi") - F.col(f"{c}_lo")) for c in columns]
    return means.join(F.broadcast(ends), how="cross").select(key, (sum(scaled[1:], scaled[0]) / len(columns) * 100).alias("score"))


def top_bottom(df: DataFrame, score: str, n: int, by: str = "date", key: str = "ticker") -> DataFrame:
    """The n largest and n smallest of each date, ties by key."""
    high = F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), key))
    low = F.row_number().over(Window.partitionBy(by).orderBy(F.col(score), key))
    known = df.where(F.col(score).isNotNull()).withColumn("__h", high).withColumn("__l", low)
    side = F.when(F.col("__h") <= n, 1).when(F.col("__l") <= n, -1)
    return known.withColumn("side", side).where("side IS NOT NULL").drop("__h", "__l")


def by_pair_blocks(df: DataFrame, x: str, key: str, on: str, size: int, run, schema: str, by: str | None = None) -> DataFrame:
    """``run(left, right, same)`` for every pair of blocks of about ``size`` keys; yields the rows of schema.

    left and right are tables of x, dates by keys, NULL where a key has no value;
    same: both are one block.  A row is copied once for each block of keys, not
    once for each other key, and a group holds two blocks of keys over the dates.
    Keys and dates are not repeated, else the last value of a date counts. With
    ``by``, a column that comes first in the result, its values are worked out
    apart.
    """
    period = [F.col(by).alias("p")] if by else []
    known = df.where(F.col(x).isNotNull()).select(F.col(key).alias("k"), F.col(on).alias("t"), F.col(x).alias("x"), *period)
    blocks = max(1, -(-known.select("k").distinct().count() // size))
    own = known.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    spread = own.withColumn("o", other).select("k", "t", "x", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), *(["p"] if by else []))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        wide = group.pivot_table(index="t", columns="k", values="x", aggfunc="last", sort=True)
        block = group.drop_duplicates("k").set_index("k")["b"].reindex(wide.columns)
        found = run(wide.loc[:, (block == i).to_numpy()], wide.loc[:, (block == j).to_numpy()], i == j)
        if by:
            found.insert(0, by, group["p"].iloc[0])
        return found

    if by:
        return spread.groupBy("p", "i", "j").applyInPandas(solve, f"{by} {dict(df.dtypes)[by]}, {schema}")
    return spread.groupBy("i", "j").applyInPandas(solve, schema)


def pair_statistics(df: DataFrame, x: str = "ret", key: str = "ticker", on: str = "date", size: int = 256, by: str | None = None, diagonal: bool = False) -> DataFrame:
    """Correlation, covariance, slope and intercept of every pair of keys (a < b; a = b, too, with ``diagonal``) over common dates, by products of blocks of keys."""

    def run(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        def sums(table: pd.DataFrame):
            v = table.to_numpy(float)
            there = ~np.isnan(v)
            centre = np.nan_to_num(np.nanmean(v, 0)) if v.size else np.zeros(v.shape[1])
            v = np.where(there, v - centre, 0.0)
            return v, there.astype(float), centre

        (u, m, cu), (v, k, cv) = sums(left), sums(right)
        a, b = np.meshgrid(left.columns.to_numpy(), right.columns.to_numpy(), indexing="ij")
        n = m.T @ k
        with np.errstate(all="ignore"):
            su, sv = u.T @ k, m.T @ v
            cov, vu, vv = ((s - p / n) / (n - 1) for s, p in ((u.T @ v, su * sv), ((u * u).T @ k, su * su), (m.T @ (v * v), sv * sv)))
            mu, mv = su / n + cu[:, None], sv / n + cv[None, :]
            corr = cov / np.sqrt(vu * vv)
            turned = a > b  # the smaller key is a
            slope = cov / np.where(turned, vv, vu)
            intercept = np.where(turned, mu - slope * mv, mv - slope * mu)
        keep = (n > 0) & (((a <= b) if diagonal else (a < b)) if same else np.ones_like(turned))
        made = pd.DataFrame({"a": np.where(turned, b, a)[keep], "b": np.where(turned, a, b)[keep], "n": n[keep].astype(int), "cov": cov[keep], "corr": corr[keep], "slope": slope[keep], "intercept": intercept[keep]})
        return made.replace([np.inf, -np.inf], np.nan)

    kind = dict(df.dtypes)[key]
    return by_pair_blocks(df, x, key, on, size, run, f"a {kind}, b {kind}, n long, cov double, corr double, slope double, intercept double", by)


def return_moments(df: DataFrame, x: str = "ret", key: str = "ticker") -> DataFrame:
    """Mean, sample deviation, skewness and kurtosis (3 for the normal)."""
    return df.groupBy(key).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt"))


def hhi(df: DataFrame, x: str = "ret", key: str = "ticker") -> DataFrame:
    """Normalised concentration of positive and of negative values; NULL with two or fewer."""

    def of(values: Column) -> Column:
        n, s = F.count(values), F.sum(values)
        share = F.try_divide(F.sum(values * values), s * s)
        return F.when(n > 2, F.try_divide(share - F.try_divide(F.lit(1.0), n), 1 - F.try_divide(F.lit(1.0), n)))

    return df.groupBy(key).agg(of(F.when(F.col(x) >= 0, F.col(x))).alias("hhi_positive"), of(F.when(F.col(x) < 0, F.col(x))).alias("hhi_negative"))
