"""What a fitted model makes of its features: linear, non-linear and pairwise effects.

A feature's partial dependence is the model's mean prediction over all rows
with the feature set to each of its quantiles. The rows are copied per value
inside a projection, scored and averaged in one pass with partial sums; only
the means, a few dozen per feature and as many squared per pair, reach the
driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validation import assembled

ACCURACY = 100_000


def quantiles(df: DataFrame, features: list[str], n: int) -> dict[str, list[float]]:
    """n values of each feature at equal steps of probability."""
    at = [float(q) for q in np.linspace(0, 1, n)]
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), at, ACCURACY).alias(f) for f in features]).first()
    return {f: list(row[f] or []) for f in features}


def _predicted(kind: str) -> Column:
    return F.get(vector_to_array("probability"), F.lit(1)) if kind == "probability" else F.col("prediction")


def dependence(df: DataFrame, model: Model, features: list[str], values: dict[str, list[float]], pairs: list[tuple[str, str]] = (), kind: str = "probability") -> pd.DataFrame:
    """a, i, b, j, mean: the mean prediction with feature a at its i-th value and, for pairs, b at its j-th."""

    def grid(names: tuple[str, ...]) -> Column:
        """All places of the named features' values, as an array."""
        spread = F.sequence(F.lit(0), F.lit(len(values[names[0]]) - 1))
        if len(names) == 1:
            return F.transform(spread, lambda i: F.struct(i.alias("i"), F.lit(-1).alias("j")))
        other = F.sequence(F.lit(0), F.lit(len(values[names[1]]) - 1))
        return F.flatten(F.transform(spread, lambda i: F.transform(other, lambda j: F.struct(i.alias("i"), j.alias("j")))))

    means = []
    read = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    for names in [(f,) for f in features] + list(pairs):
        placed = read.select("*", F.inline(grid(names)))
        for f, at in zip(names, ("i", "j"), strict=False):
            placed = placed.withColumn(f, F.get(F.array(*[F.lit(v) for v in values[f]]), F.col(at)))
        scored = model.transform(assembled(placed, features))
        found = scored.groupBy("i", "j").agg(F.avg(_predicted(kind)).alias("mean")).toPandas()
        found.insert(0, "a", names[0])
        found.insert(2, "b", names[1] if len(names) > 1 else "")
        means.append(found)
    return pd.concat(means, ignore_index=True) if means else pd.DataFrame(columns=["a", "i", "b", "j", "mean"])


def fingerprint(df: DataFrame, model: Model, features: list[str], pairs: list[tuple[str, str]] = (), n: int = 50, kind: str = "probability") -> DataFrame:
    """effect (linear, non-linear or pair), feature, raw and share of the effect's sum.

    linear: mean distance of the line fitted to the dependence from its mean;
    non-linear: of the dependence from that line; pair: of the centred joint
    dependence from the sum of the two centred ones."""
    spark = df.sparkSession
    values = quantiles(df, features, n)
    if not all(values.values()):
        return spark.createDataFrame([], "effect string, feature string, raw double, share double")
    found = dependence(df, model, features, values, list(pairs), kind)
    single = {f: found[(found["a"] == f) & (found["b"] == "")].sort_values("i")["mean"].to_numpy() for f in features}
    raw: dict[str, dict[str, float]] = {"linear": {}, "non-linear": {}, "pair": {}}
    for f, y in single.items():
        x = np.array(values[f])
        slope = ((x - x.mean()) @ (y - y.mean())) / ((x - x.mean()) @ (x - x.mean())) if np.ptp(x) > 0 else 0.0
        line = y.mean() + slope * (x - x.mean())
        raw["linear"][f], raw["non-linear"][f] = float(np.abs(line - y.mean()).mean()), float(np.abs(line - y).mean())
    for a, b in pairs:
        joint = found[(found["a"] == a) & (found["b"] == b)].pivot(index="i", columns="j", values="mean").to_numpy()
        alone = (single[a] - single[a].mean())[:, None] + (single[b] - single[b].mean())[None, :]
        raw["pair"][f"{a}, {b}"] = float(np.abs(joint - joint.mean() - alone).mean())
    rows = [(e, f, v, v / sum(vs.values()) if sum(vs.values()) else None) for e, vs in raw.items() for f, v in vs.items()]
    return spark.createDataFrame(rows, "effect string, feature string, raw double, share double")
