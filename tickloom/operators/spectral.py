"""Eigenvalues, orthogonal features, clusters and nested portfolios of a universe.

Covariances and correlations come from :func:`panel.pair_statistics`, by blocks
of keys, so no task sees the universe's rows.  What is solved as one piece is a
matrix of keys by keys of one period (a few thousand keys: some 100 MB), in one
task per period, or per period and number of clusters.  Values between two keys
are over the dates that both have; pairs without such count as uncorrelated,
and keys that do not vary are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .panel import pair_statistics


def moments(returns: DataFrame, by: str, x: str = "ret", key: str = "ticker", on: str = "date", size: int = 256) -> DataFrame:
    """by, a, b, cov, corr for all pairs a <= b of each period."""
    return pair_statistics(returns, x, key, on, size, by=by, diagonal=True).select(by, "a", "b", "cov", "corr")


def matrix(pairs: pd.DataFrame, value: str) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys that vary, their symmetric matrix)."""
    own = pairs[pairs["a"] == pairs["b"]]
    keys = np.sort(own.loc[own["corr"].notna(), "a"].to_numpy())
    known = pairs[pairs["a"].isin(keys) & pairs["b"].isin(keys)]
    i, j = np.searchsorted(keys, known["a"].to_numpy()), np.searchsorted(keys, known["b"].to_numpy())
    m = np.zeros((len(keys), len(keys)))
    m[i, j] = m[j, i] = np.nan_to_num(known[value].to_numpy(float))
    return keys, m


def descending(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and vectors, each with its largest part positive."""
    values, vectors = np.linalg.eigh(m)
    values, vectors = values[::-1], vectors[:, ::-1]
    if len(values):
        largest = np.abs(vectors).argmax(axis=0)
        vectors = vectors * np.where(vectors[largest, np.arange(len(values))] < 0, -1.0, 1.0)
    return values, vectors


def eigen(pairs: DataFrame, by: str) -> DataFrame:
    """by, k (from 1), value, share and cumulative share of the correlation's eigenvalues, with keys and loadings as arrays."""
    kinds = dict(pairs.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys, corr = matrix(group, "corr")
        values, vectors = descending(corr)
        share = values / values.sum() if len(values) else values
        return pd.DataFrame({by: group[by].iloc[0], "k": np.arange(1, len(values) + 1), "value": values, "share": share, "cumulative": share.cumsum(), "keys": pd.Series([list(keys)] * len(keys), dtype=object), "loadings": pd.Series(list(vectors.T), dtype=object)})

    return pairs.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, k int, value double, share double, cumulative double, keys array<{kinds['a']}>, loadings array<double>")


def projections(returns: DataFrame, found: DataFrame, by: str, keep: int, x: str = "ret", key: str = "ticker", on: str = "date") -> DataFrame:
    """by, date, k, score: the standardised values of each date on the first components; keys without a value that date add nothing."""
    loadings = found.where(F.col("k") <= keep).select(by, "k", F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("loadings").alias("loading"))).alias("z")).select(by, "k", F.col("z.key").alias(key), F.col("z.loading").alias("loading"))
    scale = returns.groupBy(by, key).agg(F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s")).where("__s > 0")
    z = F.col("loading") * (F.col(x) - F.col("__m")) / F.col("__s")
    return returns.where(F.col(x).isNotNull()).join(loadings.join(scale, [by, key]), [by, key]).groupBy(by, on, "k").agg(F.sum(z).alias("score"))


def gram(df: DataFrame, columns: list[str], means: dict[str, float]) -> np.ndarray:
    """Sum over rows of the products of centred columns: a matrix per task, added up by place; rows with a null in them are left out."""
    centre = np.array([means[c] for c in columns])

    def run(batches):
        total = np.zeros((len(columns), len(columns)))
        for batch in batches:
            v = batch.to_numpy(float) - centre
            total += v.T @ v
        yield pd.DataFrame({"i": np.repeat(np.arange(len(columns)), len(columns)), "j": np.tile(np.arange(len(columns)), len(columns)), "v": total.ravel()})

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna().mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    m = np.zeros((len(columns), len(columns)))
    m[rows["i"], rows["j"]] = rows["v"]
    return m


def feature_pairs(df: DataFrame, features: list[str]) -> DataFrame:
    """by (one value), a, b, cov, corr of all pairs of features, for :func:`clusters`; of rows without a null among them, in one pass of sums."""
    known = df.select(*[F.col(c).cast("double").alias(c) for c in features]).dropna()
    seen = known.agg(*[F.avg(c).alias(c) for c in features], F.count("*").alias("__n")).first()
    n = seen["__n"]
    m = gram(known, features, {c: seen[c] for c in features}) / max(n - 1, 1) if n else np.zeros((len(features),) * 2)
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = m / np.sqrt(np.outer(np.diag(m), np.diag(m)))
    rows = []
    for i, a in enumerate(features):
        for j, b in enumerate(features):
            if a <= b:
                rows.append((1, a, b, float(m[i, j]), float(corr[i, j]) if np.isfinite(corr[i, j]) else None))
    return df.sparkSession.createDataFrame(rows, "by int, a string, b string, cov double, corr double")


def orthogonal(df: DataFrame, features: list[str], keep: float = 0.95) -> tuple[DataFrame, pd.DataFrame]:
    """(df with pc_1, pc_2 and so on, table of loadings with the eigenvalues): as many components as explain the share ``keep``.

    Features are standardised; one with a null or without variation is left out."""
    seen = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count))], F.count("*").alias("__all")).first()
    used = [c for c in features if seen[f"{c}__n"] == seen["__all"] and seen[f"{c}__s"]]
    if not used:
        return df, pd.DataFrame(columns=["feature"])
    std = np.array([seen[f"{c}__s"] for c in used])
    values, vectors = descending(gram(df, used, {c: seen[f"{c}__m"] for c in used}) / np.outer(std, std))
    n = int(np.searchsorted(np.cumsum(values) / values.sum(), keep)) + 1
    n = min(n, len(used))
    z = [(F.col(c).cast("double") - seen[f"{c}__m"]) / float(s) for c, s in zip(used, std, strict=True)]
    made = {f"pc_{k + 1}": sum((z[i] * float(vectors[i, k]) for i in range(1, len(used))), z[0] * float(vectors[0, k])) for k in range(n)}
    table = pd.DataFrame(vectors[:, :n], columns=list(made))
    table.insert(0, "feature", used)
    table.attrs["values"] = values[:n]
    return df.withColumns(made), table


def weighted_tau(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau with weights 1 / (1 + rank), hyperbolic and additive: the mean over ranks by (x, y) and by (y, x), largest first.

    Of a few hundred values (one per feature); ties as in the definition, NaN where x or y has one value."""
    x, y = np.asarray(x, float), np.asarray(y, float)

    def tau(first: np.ndarray, second: np.ndarray) -> float:
        rank = np.empty(len(x), int)
        rank[np.lexsort((second, first))[::-1]] = np.arange(len(x))
        w = 1 / (1 + rank)
        pair = np.triu(w[:, None] + w[None, :], 1)
        sx, sy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
        with np.errstate(invalid="ignore"):
            return float((pair * sx * sy).sum() / np.sqrt((pair * sx * sx).sum() * (pair * sy * sy).sum()))

    return (tau(x, y) + tau(y, x)) / 2


def rank_tau(importance: dict[str, float], table: pd.DataFrame) -> dict[str, float]:
    """How an importance agrees with the components: Pearson, Spearman and Kendall's tau-b with all |value x loading|, and the weighted tau with the reciprocal rank of the features by their sum."""
    features = [f for f in table["feature"] if f in importance]
    own = np.array([importance[f] for f in features], float)
    size = np.abs(table.set_index("feature").loc[features].to_numpy(float) * table.attrs["values"])
    a, b = np.tile(own, size.shape[1]), size.T.ravel()
    total = pd.Series(size.sum(axis=1)).rank(ascending=False).to_numpy()
    sx, sy = np.sign(a[:, None] - a[None, :]), np.sign(b[:, None] - b[None, :])
    with np.errstate(invalid="ignore", divide="ignore"):
        tau = float((sx * sy).sum() / np.sqrt((sx * sx).sum() * (sy * sy).sum()))
        ranks = [pd.Series(v).rank().to_numpy() for v in (a, b)]
        return {"pearson": float(np.corrcoef(a, b)[0, 1]), "spearman": float(np.corrcoef(*ranks)[0, 1]), "kendall": tau, "weighted": weighted_tau(own, 1 / total)}


def silhouettes(far: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Silhouette of every row from the distances between rows; 0 in a cluster of one."""
    names = np.unique(labels)
    member = (labels[:, None] == names[None, :]).astype(float)
    size = member.sum(axis=0)
    total = far @ member
    at = np.searchsorted(names, labels)
    rows = np.arange(len(labels))
    inside = total[rows, at] / np.maximum(size[at] - 1, 1)
    other = total / size
    other[rows, at] = np.inf
    nearest = other.min(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        s = (nearest - inside) / np.maximum(nearest, inside)
    return np.where(size[at] > 1, np.nan_to_num(s), 0.0)


def k_means(rows: np.ndarray, k: int, rng: np.random.Generator, steps: int = 100) -> np.ndarray:
    """Labels by Lloyd's steps from centres that are drawn far from each other."""
    centres = [rows[rng.integers(len(rows))]]
    for _ in range(k - 1):
        d = np.min([((rows - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(rows[rng.choice(len(rows), p=d / d.sum())] if d.sum() > 0 else rows[rng.integers(len(rows))])
    centres, labels = np.array(centres), None
    for _ in range(steps):
        d = (rows**2).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(axis=1)[None, :]
        new = d.argmin(axis=1)
        if labels is not None and (new == labels).all():
            break
        labels = new
        for j in range(k):
            if (labels == j).any():
                centres[j] = rows[labels == j].mean(axis=0)
    return labels


def distances(corr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the correlation distance, distances between those rows)."""
    rows = np.sqrt(np.clip(1 - corr, 0, None) / 2)
    square = (rows**2).sum(axis=1)
    far = np.sqrt(np.clip(square[:, None] + square[None, :] - 2 * rows @ rows.T, 0, None))
    np.fill_diagonal(far, 0.0)
    return rows, far


def quality(s: np.ndarray) -> float:
    return float(s.mean() / s.std()) if s.std() > 0 else -np.inf


def clusters(pairs: DataFrame, by: str, most: int = 10, draws: int = 10, seed: int = 0) -> DataFrame:
    """by, key, cluster (from 0, in order of their least keys), silhouette and quality of the best clustering of each period.

    One task per period and number of clusters (2 to ``most``, at most half the
    keys) makes ``draws`` runs; the largest mean over deviation of the silhouettes
    wins, ties by fewer clusters. Fewer than four keys are one cluster."""
    kinds = dict(pairs.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys, corr = matrix(group, "corr")
        k = int(group["k"].iloc[0])
        head = {by: group[by].iloc[0], "k": k}
        if not len(keys) or k > max(2, len(keys) // 2):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in (by, "k", "key", "cluster", "silhouette", "quality")})
        if len(keys) < 4:
            return pd.DataFrame(head | {"key": keys, "cluster": 0, "silhouette": 0.0, "quality": 0.0})
        rows, far = distances(corr)
        best = (-np.inf, np.zeros(len(keys)), np.zeros(len(keys), int))
        for draw in range(draws):
            labels = k_means(rows, k, np.random.default_rng([seed, k, draw]))
            s = silhouettes(far, labels)
            if len(np.unique(labels)) > 1 and (q := quality(s)) > best[0]:
                best = (q, s, labels)
        _, first = np.unique(best[2], return_index=True)
        order = np.empty(best[2].max() + 1, int)
        order[best[2][np.sort(first)]] = np.arange(len(first))
        return pd.DataFrame(head | {"key": keys, "cluster": order[best[2]], "silhouette": best[1], "quality": best[0]})

    trials = pairs.withColumn("k", F.explode(F.sequence(F.lit(2), F.lit(max(2, most)))))
    found = trials.groupBy(by, "k").applyInPandas(run, f"{by} {kinds[by]}, k int, key {kinds['a']}, cluster int, silhouette double, quality double")
    # One row of a clustering tells its quality.
    best = found.groupBy(by).agg(F.max(F.struct("quality", (-F.col("k")).alias("less"))).alias("b")).select(by, (-F.col("b.less")).alias("k"))
    return found.join(best, [by, "k"]).select(by, "key", "cluster", "silhouette", "quality")


def least_variance(cov: np.ndarray, mu: np.ndarray | None = None) -> np.ndarray:
    """Weights of the closed form (least variance; with mu, largest Sharpe ratio), summing to 1; singular matrices by pseudo-inverse."""
    w = np.linalg.pinv(cov, hermitian=True) @ (np.ones(len(cov)) if mu is None else mu)
    return w / w.sum()


def closed_form(pairs: DataFrame, by: str) -> DataFrame:
    """by, key, weight of the portfolio of least variance of each period."""
    kinds = dict(pairs.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys, cov = matrix(group, "cov")
        return pd.DataFrame({by: group[by].iloc[0], "key": keys, "weight": least_variance(cov) if len(keys) else []})

    return pairs.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, key {kinds['a']}, weight double")


def nested_weights(pairs: DataFrame, grouped: DataFrame, by: str) -> DataFrame:
    """by, key, cluster, weight: least variance within every cluster, then among the clusters' portfolios.

    Clusters are solved apart; the covariance among them is a sum over pairs of
    weight times covariance times weight, and has a row per pair of clusters."""
    kinds = dict(pairs.dtypes)
    side = lambda c: grouped.select(by, F.col("key").alias(c), F.col("cluster").alias(f"c{c}"))
    placed = pairs.join(side("a"), [by, "a"]).join(side("b"), [by, "b"])

    def within(group: pd.DataFrame) -> pd.DataFrame:
        keys, cov = matrix(group, "cov")
        return pd.DataFrame({by: group[by].iloc[0], "key": keys, "cluster": group["ca"].iloc[0], "inner": least_variance(cov) if len(keys) else []})

    inner = placed.where("ca = cb").groupBy(by, "ca").applyInPandas(within, f"{by} {kinds[by]}, key {kinds['a']}, cluster int, inner double")
    weight = lambda c: inner.select(by, F.col("key").alias(c), F.col("inner").alias(f"w{c}"))
    twice = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    part = F.coalesce("cov", F.lit(0.0)) * F.col("wa") * F.col("wb")
    between = (
        placed.join(weight("a"), [by, "a"]).join(weight("b"), [by, "b"])
        .groupBy(by, F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
        .agg(F.sum(F.when(F.col("ca") == F.col("cb"), part * twice).otherwise(part)).alias("cov")).withColumn("corr", F.lit(1.0))
    )

    def among(group: pd.DataFrame) -> pd.DataFrame:
        names, cov = matrix(group, "cov")
        return pd.DataFrame({by: group[by].iloc[0], "cluster": names, "outer": least_variance(cov)})

    outer = between.groupBy(by).applyInPandas(among, f"{by} {kinds[by]}, cluster int, outer double")
    return inner.join(outer, [by, "cluster"]).select(by, "key", "cluster", (F.col("inner") * F.col("outer")).alias("weight"))


def denoised(pairs: DataFrame, by: str, keep: int = 3, how: str = "constant", alpha: float = 0.0, market: int = 0) -> DataFrame:
    """by, a, b (a < b), corr without what lies beyond the first ``keep`` eigenvalues.

    how: ``constant`` sets those eigenvalues to their mean and scales the
    diagonal to 1; ``shrink`` keeps the share ``alpha`` of their part off the
    diagonal. ``market``: so many of the first components are taken out after."""
    kinds = dict(pairs.dtypes)

    def scaled(c: np.ndarray) -> np.ndarray:
        d = np.sqrt(np.clip(np.diag(c), 1e-300, None))
        return np.clip(c / np.outer(d, d), -1.0, 1.0)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys, corr = matrix(group, "corr")
        values, vectors = descending(corr)
        if how == "constant":
            flat = values.copy()
            flat[keep:] = flat[keep:].mean() if len(flat) > keep else flat[keep:]
            made = scaled((vectors * flat) @ vectors.T) if len(keys) else corr
        else:
            left, right = ((vectors[:, s] * values[s]) @ vectors[:, s].T for s in (slice(0, keep), slice(keep, None)))
            made = left + alpha * right + (1 - alpha) * np.diag(np.diag(right))
        if market and len(keys):
            values, vectors = descending(made)
            made = scaled(made - (vectors[:, :market] * values[:market]) @ vectors[:, :market].T)
        i, j = np.triu_indices(len(keys), 1)
        return pd.DataFrame({by: group[by].iloc[0], "a": keys[i], "b": keys[j], "corr": made[i, j]})

    return pairs.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, a {kinds['a']}, b {kinds['b']}, corr double")


def single_linkage(far: np.ndarray) -> list[int]:
    """Leaves in the order of their merges: clusters are joined by nearest members, the earlier one to the left."""
    n = len(far)
    if n < 2:
        return list(range(n))
    # A minimum spanning tree holds all merges of single linkage.
    inside, near, link = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    edges, at = [], 0
    for _ in range(n - 1):
        inside[at] = True
        closer = ~inside & (far[at] < near)
        near[closer], link[closer] = far[at][closer], at
        at = int(np.where(inside, np.inf, near).argmin())
        edges.append((near[at], *sorted((at, int(link[at])))))
    owner, members = list(range(n)), {i: [i] for i in range(n)}
    born = {i: i for i in range(n)}
    for k, (_, a, b) in enumerate(sorted(edges)):
        x, y = owner[a], owner[b]
        x, y = (x, y) if born[x] < born[y] else (y, x)
        joined = members.pop(x) + members.pop(y)
        for i in joined:
            owner[i] = x
        members[x], born[x] = joined, n + k
    return members[owner[0]]


def hrp(pairs: DataFrame, by: str) -> DataFrame:
    """by, key, weight: hierarchical risk parity from each period's covariances."""
    kinds = dict(pairs.dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys, corr = matrix(group, "corr")
        _, cov = matrix(group, "cov")
        weights = np.ones(len(keys))

        def variance(items: list[int]) -> float:
            v = cov[np.ix_(items, items)]
            w = 1 / np.diag(v)
            w = w / w.sum()
            return float(w @ v @ w)

        todo = [single_linkage(distances(corr)[1])]
        while todo:
            items = todo.pop()
            if len(items) > 1:
                a, b = items[: len(items) // 2], items[len(items) // 2 :]
                va, vb = variance(a), variance(b)
                share = 1 - va / (va + vb) if va + vb else 0.5
                weights[a], weights[b] = weights[a] * share, weights[b] * (1 - share)
                todo += [a, b]
        return pd.DataFrame({by: group[by].iloc[0], "key": keys, "weight": weights})

    return pairs.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, key {kinds['a']}, weight double")
