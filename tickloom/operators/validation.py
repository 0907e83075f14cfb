"""Purged cross-validation, parameter search, importance and walk-forward models.

Rows are events (t0, t1, label, weight, features).  :func:`purged` gives every
row its test fold and the folds that it may train in: none whose test span, its
embargo included, its own interval touches.  The fits of a search are
independent Spark jobs, a few at a time, over one persisted table; scores are
aggregates, so no prediction reaches the driver.  Estimators are those of
``pyspark.ml`` (label, features, weight columns as here).

Bounds: the driver holds the ends of the folds or blocks and one row of scores
per fit.  A split has one row per distinct t0 in one window.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEATURES, LABEL, WEIGHT = "features", "label", "weight"
AT_ONCE = 4
#: Rows of one partition of the table that folds are fitted on.
ROWS = 100_000
#: Logarithms of probabilities are taken no nearer to 0 and 1.
EPS = 2.220446049250313e-16
METRICS = ("neg_log_loss", "accuracy", "f1")
BUCKETS = 256


@dataclass(frozen=True)
class Span:
    """A test fold: first and last t0 of its rows, and the end of what they and their embargo reach."""

    fold: int
    first: object
    last: object
    reach: object


def spans(events: DataFrame, folds: int, embargo: float = 0.0) -> list[Span]:
    """Contiguous folds over the distinct t0, of nearly equal numbers of rows; ``embargo`` is a share of the times."""
    times = events.where("t0 IS NOT NULL AND t1 IS NOT NULL").groupBy("t0").agg(F.count("*").alias("n"), F.max("t1").alias("end"))
    w = Window.orderBy("t0")  # a row per time
    before, total = F.sum("n").over(w) - F.col("n"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    known = times.withColumn("i", F.row_number().over(w)).withColumn("fold", F.floor(before * folds / total).cast("int") + 1).persist()
    ends = known.groupBy("fold").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.min("t0").alias("first"), F.max("t0").alias("last"), F.count("*").alias("k")).orderBy("fold").collect()
    step = int(sum(r["k"] for r in ends) * embargo)
    reach = known.agg(*[F.max(F.when(F.col("i").between(r["a"], r["b"] + step), F.col("end"))).alias(f"r{r['fold']}") for r in ends]).first() if ends else {}
    known.unpersist()
    return [Span(r["fold"], r["first"], r["last"], reach[f"r{r['fold']}"]) for r in ends]


def purged(events: DataFrame, folds: list[Span]) -> DataFrame:
    """events with ``test``, their fold, and ``train``, the folds in which they train; rows without t0 or t1 are left out."""
    test, train = F.lit(None).cast("int"), []
    for s in folds:
        test = F.when(F.col("t0").between(F.lit(s.first), F.lit(s.last)), s.fold).otherwise(test)
        train.append(F.when((F.col("t0") > F.lit(s.reach)) | (F.col("t1") < F.lit(s.first)), F.lit(s.fold)))
    train = F.array_compact(F.array(*train)) if train else F.array().cast("array<int>")
    return events.where("t0 IS NOT NULL AND t1 IS NOT NULL").withColumn("test", test).withColumn("train", train)


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="skip").transform(df.drop(FEATURES))


def metric_columns(label: Column, weight: Column) -> list[Column]:
    """Weighted scores of a scored table as aggregates: minus the log loss, the accuracy and the F1 of label 1."""
    p = F.get(vector_to_array("probability"), label.cast("int"))
    p = F.least(F.greatest(F.coalesce(p, F.lit(0.0)), F.lit(EPS)), F.lit(1 - EPS))
    hit = F.col("prediction") == label
    tp = F.sum(F.when(hit & (label == 1), weight).otherwise(0.0))
    wrong = F.sum(F.when(~hit & ((label == 1) | (F.col("prediction") == 1)), weight).otherwise(0.0))
    return [
        F.try_divide(F.sum(weight * F.log(p)), F.sum(weight)).alias("neg_log_loss"), F.try_divide(F.sum(F.when(hit, weight).otherwise(0.0)), F.sum(weight)).alias("accuracy"),
        F.try_divide(2 * tp, 2 * tp + wrong).alias("f1"), F.count("*").alias("n_test"),
    ]


def together(spark: SparkSession, jobs: Iterable[Callable], at_once: int = AT_ONCE) -> list:
    """The results of Spark jobs, a few running at a time, in their order."""
    jobs = [inheritable_thread_target(spark)(job) for job in jobs]
    if not jobs:
        return []
    with ThreadPool(min(at_once, len(jobs))) as pool:
        return pool.map(lambda job: job(), jobs)


def weighted(estimator: Estimator) -> Estimator:
    """The estimator with the column names of this module."""
    made = estimator.copy()
    made.setParams(featuresCol=FEATURES, labelCol=LABEL)
    if made.hasParam("weightCol"):
        made.set(made.getParam("weightCol"), WEIGHT)
    return made


def _ready(events: DataFrame, folds: list[Span], columns: list[str]) -> DataFrame:
    made = events if WEIGHT in events.columns else events.withColumn(WEIGHT, F.lit(1.0))
    return purged(made.select("t0", "t1", F.col(LABEL).cast("double").alias(LABEL), F.col(WEIGHT).cast("double").alias(WEIGHT), *columns), folds)


def _dealt(data: DataFrame) -> DataFrame:
    """data in even partitions of about ``ROWS`` rows.

    A fit passes over its rows dozens of times, one task a partition: what
    windows leave, a few full partitions among the shuffle's many empty ones,
    costs a fit far more in tasks than in rows.
    """
    return data.repartition(max(1, math.ceil(data.count() / ROWS)))


def cross_validate(events: DataFrame, candidates: dict[str, tuple[Estimator, list[str]]], folds: list[Span]) -> DataFrame:
    """name, fold, n_train, n_test and the scores of every candidate (an estimator and its features) in every fold."""
    columns = sorted({f for _, fs in candidates.values() for f in fs})
    data = _dealt(_ready(events, folds, columns)).persist()

    def job(name: str, fold: int):
        estimator, features = candidates[name]

        def run():
            train = assembled(data.where(F.array_contains("train", fold)), features)
            test = assembled(data.where(F.col("test") == fold), features)
            n = train.count()
            if not n:
                return (name, fold, 0, test.count(), None, None, None)
            model = weighted(estimator).fit(train)
            r = model.transform(test).agg(*metric_columns(F.col(LABEL), F.col(WEIGHT))).first()
            return (name, fold, n, r["n_test"], r["neg_log_loss"], r["accuracy"], r["f1"])

        return run

    rows = together(events.sparkSession, (job(name, s.fold) for name in candidates for s in folds))
    data.unpersist()
    return events.sparkSession.createDataFrame(rows, "name string, fold int, n_train long, n_test long, neg_log_loss double, accuracy double, f1 double")


@dataclass(frozen=True)
class LogUniform:
    """A parameter whose logarithm is uniform between those of a and b."""

    a: float
    b: float

    def draw(self, rng: random.Random) -> float:
        return math.exp(rng.uniform(math.log(self.a), math.log(self.b)))


def grid(**values: Iterable) -> list[dict]:
    """All combinations of the parameters' values."""
    return [dict(zip(values, v, strict=True)) for v in itertools.product(*values.values())]


def sampled(n: int, seed: int = 0, **values) -> list[dict]:
    """n combinations drawn at random from lists or distributions."""
    rng = random.Random(seed)
    return [{k: v.draw(rng) if hasattr(v, "draw") else rng.choice(list(v)) for k, v in values.items()} for _ in range(n)]


@dataclass(frozen=True)
class Search:
    """What a search found: the best parameters, all scores and the model fitted on all rows."""

    best: dict
    scores: DataFrame
    model: Model | Bagged


def hyper_fit(events: DataFrame, features: list[str], estimator: Estimator, choices: list[dict], folds: list[Span], scoring: str | None = None, bagging: tuple[int, float, float] | None = None, seed: int = 0) -> Search:
    """The choice of parameters with the best mean score over the purged folds, fitted again on all rows.

    Scored by F1 where labels are 0 and 1, by log loss otherwise, unless
    ``scoring`` says which. ``bagging`` is the number of models and the shares
    of rows and of features that each of them sees.
    """
    if scoring is None:
        few = {r[0] for r in events.select(F.col(LABEL).cast("double")).distinct().limit(3).collect()}
        scoring = "f1" if few == {0.0, 1.0} else "neg_log_loss"
    named = {repr(sorted(c.items())): c for c in choices}

    def with_parameters(choice: dict) -> Estimator:
        return estimator.copy({estimator.getParam(k): v for k, v in choice.items()})

    scores = cross_validate(events, {name: (with_parameters(c), features) for name, c in named.items()}, folds)
    means = {r["name"]: r["m"] for r in scores.groupBy("name").agg(F.avg(scoring).alias("m")).collect()}
    best = max(named, key=lambda name: -math.inf if means.get(name) is None else means[name])
    fitted = with_parameters(named[best])
    data = _dealt(_ready(events, [], features)).persist()
    model = weighted(fitted).fit(assembled(data, features)) if bagging is None else bag(data, features, fitted, *bagging, seed=seed)
    data.unpersist()
    return Search(named[best], scores, model)


@dataclass(frozen=True)
class Bagged:
    """Models over draws of rows and features; probabilities are their mean."""

    models: list[tuple[Model, list[str]]]

    def transform(self, df: DataFrame) -> DataFrame:
        made, columns = df, df.columns
        for k, (model, features) in enumerate(self.models):
            made = model.transform(assembled(made, features)).withColumn(f"__p{k}", vector_to_array("probability")).drop("probability", "rawPrediction", "prediction", FEATURES)
        n = len(self.models)
        total = F.col("__p0")
        for k in range(1, n):
            total = F.zip_with(total, f"__p{k}", lambda x, y: x + y)
        p = F.transform(total, lambda x: x / n)
        return made.withColumn("__p", p).select(*columns, array_to_vector("__p").alias("probability"), (F.array_position("__p", F.array_max("__p")) - 1).cast("double").alias("prediction"))


def bag(data: DataFrame, features: list[str], estimator: Estimator, n: int, rows: float = 1.0, share: float = 1.0, seed: int = 0) -> Bagged:
    """n models, each of a draw with replacement of the rows and of a share of the features."""
    rng = random.Random(seed)
    chosen = [sorted(rng.sample(features, max(1, round(share * len(features)))), key=features.index) for _ in range(n)]
    fits = together(data.sparkSession, (lambda k=k: weighted(estimator).fit(assembled(data.sample(True, rows, seed + k), chosen[k])) for k in range(n)))
    return Bagged(list(zip(fits, chosen, strict=True)))


def _mean_and_error(rows: DataFrame, by: str, x: str) -> DataFrame:
    """Mean over folds and its standard error."""
    return rows.groupBy(by).agg(F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.coalesce(F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x).cast("double"))), F.lit(0.0)).alias("error"))


def single_feature(events: DataFrame, features: list[str], estimator: Estimator, folds: list[Span], scoring: str = "neg_log_loss") -> DataFrame:
    """feature, mean and error of the score of a model that sees that feature alone."""
    scores = cross_validate(events, {f: (estimator, [f]) for f in features}, folds)
    return _mean_and_error(scores, "name", scoring).withColumnRenamed("name", "feature")


def numbered(df: DataFrame, by: str, key: Column, name: str) -> DataFrame:
    """Rows of each group numbered from 0 in the order of a hash, without a group in one task.

    Rows fall into buckets by hash; a bucket's rows are numbered and the counts
    of the buckets before it, at most ``BUCKETS`` per group, are added."""
    placed = df.withColumn("__h", key).withColumn("__b", F.pmod(F.shiftright("__h", 20), F.lit(BUCKETS)))
    ahead = Window.partitionBy(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(by, "__b").agg(F.count("*").alias("__n")).select(by, "__b", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(by, "__b").orderBy("__h")) - 1
    return placed.withColumn("__own", own).join(counts, [by, "__b"]).withColumn(name, F.col("__own") + F.col("__before")).drop("__h", "__b", "__own", "__before")


def permuted(df: DataFrame, by: str, columns: list[str], seed: int) -> DataFrame:
    """df with ``p_<column>``: the values of another row of the group, by one random permutation of its rows."""
    first = numbered(df, by, F.xxhash64(F.lit(seed), *df.columns), "__r")
    second = numbered(df, by, F.xxhash64(F.lit(seed + 1_000_003), *df.columns), "__r").select(by, "__r", *[F.col(c).alias(f"p_{c}") for c in columns])
    return first.join(second, [by, "__r"]).drop("__r")


def permutation_importance(events: DataFrame, features: list[str], estimator: Estimator, folds: list[Span], scoring: str = "neg_log_loss", seed: int = 0) -> DataFrame:
    """feature, mean and error over the folds of the share of the score that is lost when the feature's test values are permuted."""
    data = _ready(events, folds, features).persist()
    tests = permuted(data.where("test IS NOT NULL"), "test", features, seed).persist()

    def job(fold: int):
        def run():
            train = assembled(data.where(F.array_contains("train", fold)), features)
            if train.isEmpty():
                return []
            model = weighted(estimator).fit(train)
            # The rows as they are (name '') and once per feature with that one's values permuted.
            each = [F.struct(F.lit(n).alias("feature"), *[F.col(f"p_{f}" if f == n else f).alias(f) for f in features]) for n in ("", *features)]
            test = tests.where(F.col("test") == fold).select(LABEL, WEIGHT, F.inline(F.array(*each)))
            return model.transform(assembled(test, features)).groupBy("feature").agg(*metric_columns(F.col(LABEL), F.col(WEIGHT))).select(F.lit(fold).alias("fold"), "feature", scoring).collect()

        return run

    rows = [tuple(r) for part in together(events.sparkSession, (job(s.fold) for s in folds)) for r in part]
    tests.unpersist()
    data.unpersist()
    scores = events.sparkSession.createDataFrame(rows, "fold int, feature string, score double")
    base = scores.where("feature = ''").select("fold", F.col("score").alias("base"))
    scale = -F.col("score") if scoring == "neg_log_loss" else 1 - F.col("score")
    lost = scores.where("feature <> ''").join(base, "fold").withColumn("lost", F.try_divide(F.col("base") - F.col("score"), scale))
    return _mean_and_error(lost, "feature", "lost")


def impurity_importance(model: Model, features: list[str], spark, groups: dict[str, str] | None = None) -> DataFrame:
    """feature, mean and error over the trees of a forest, in shares of the means' sum.

    A feature's mean is over the trees that use it. With ``groups`` (feature to
    cluster) a tree's importances are summed by cluster first, and every tree counts."""
    rows = []
    for k, tree in enumerate(model.trees):
        found: dict[str, float] = {}
        for f, v in zip(features, tree.featureImportances.toArray(), strict=True):
            name = f if groups is None else groups[f]
            found[name] = found.get(name, 0.0) + float(v)
        rows += [(k, f, v) for f, v in found.items()]
    trees = spark.createDataFrame(rows, "tree int, feature string, v double")
    if groups is None:
        trees = trees.withColumn("v", F.expr("nullif(v, 0D)"))
    n = F.lit(float(len(model.trees)))
    by = trees.groupBy("feature").agg(F.avg("v").alias("m"), F.try_divide(F.stddev_samp("v"), F.sqrt(n)).alias("e"))
    total = F.sum("m").over(Window.partitionBy())  # a row per feature
    return by.select("feature", F.coalesce(F.try_divide("m", total), F.lit(0.0)).alias("mean"), F.coalesce(F.try_divide("e", total), F.lit(0.0)).alias("error"))


@dataclass(frozen=True)
class Block:
    """A stretch of test dates and the first of them, before which its model's labels must have ended."""

    number: int
    first: object
    last: object


def blocks(events: DataFrame, start, every: int) -> list[Block]:
    """Test blocks of ``every`` distinct dates from ``start`` on."""
    dates = events.where(F.col("t0") >= (start if isinstance(start, Column) else F.lit(start))).select("t0").distinct().withColumn("b", F.floor((F.row_number().over(Window.orderBy("t0")) - 1) / every).cast("int"))  # a row per date
    return [Block(r["b"], r["first"], r["last"]) for r in dates.groupBy("b").agg(F.min("t0").alias("first"), F.max("t0").alias("last")).orderBy("b").collect()]


def walk_forward(events: DataFrame, features: list[str], estimator: Estimator, schedule: list[Block], keep: list[str], window: str | None = None) -> DataFrame:
    """keep, block, prediction and probability (of label 1) of every row of the test blocks.

    Each block has a model of its own, fitted to all rows whose label was known
    before the block begins (t1 < its first date); ``window`` is an interval
    ('4 years') that limits how far back they go. A block without such rows of
    two labels has no predictions.
    """
    made = events if WEIGHT in events.columns else events.withColumn(WEIGHT, F.lit(1.0))
    data = made.withColumn(LABEL, F.col(LABEL).cast("double"))

    def job(b: Block):
        def run():
            known = data.where(F.col("t1") < F.lit(b.first))
            if window:
                known = known.where(F.col("t0") >= F.lit(b.first) - F.expr(f"INTERVAL {window}"))
            train = assembled(known, features)
            two = train.agg(F.min(LABEL).alias("a"), F.max(LABEL).alias("b")).first()
            return None if two["a"] == two["b"] else weighted(estimator).fit(train)

        return run

    models = together(events.sparkSession, (job(b) for b in schedule))
    out = None
    for b, model in zip(schedule, models, strict=True):
        if model is None:
            continue
        test = assembled(data.where(F.col("t0").between(F.lit(b.first), F.lit(b.last))), features)
        scored = model.transform(test).select(*keep, F.lit(b.number).alias("block"), "prediction", F.get(vector_to_array("probability"), F.lit(1)).alias("probability"))
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        return data.select(*keep, F.lit(0).alias("block"), F.lit(0.0).alias("prediction"), F.lit(0.0).alias("probability")).limit(0)
    return out
