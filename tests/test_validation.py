"""Purged cross-validation, search, importance and walk-forward models against plain loops."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tickloom.operators import validation as v

DAY = dt.date(2020, 1, 1)
SCHEMA = "symbol string, t0 date, t1 date, f1 double, f2 double, noise double, label double, weight double"


def events(n=240, seed=3, span=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        day = DAY + dt.timedelta(days=i // 2)
        f1, f2, noise = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        label = float(rng.random() < 1 / (1 + math.exp(-(1.5 * f1 - 0.7 * f2))))
        out.append((f"s{i % 2}", day, day + dt.timedelta(days=rng.randint(0, span)), f1, f2, noise, label, rng.choice([0.5, 1.0, 3.0])))
    return out


def frame(rows):
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def newton(x, y, w):
    """Weighted logistic regression without penalty."""
    x = np.c_[np.ones(len(x)), x]
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x, x.T @ (w * (y - p)))
    return beta


def loop_folds(df, folds, embargo):
    times = sorted(df["t0"].unique())
    counts = df.groupby("t0").size().reindex(times).cumsum().shift(fill_value=0).to_numpy()
    fold = (counts * folds // len(df)).astype(int) + 1
    step = int(len(times) * embargo)
    for k in range(1, folds + 1):
        at = np.flatnonzero(fold == k)
        test = df["t0"].isin([times[i] for i in at])
        reach = df.loc[df["t0"].isin(times[at[0] : at[-1] + step + 1]), "t1"].max()
        yield k, ~((df["t0"] <= reach) & (df["t1"] >= times[at[0]])), test


@pytest.mark.parametrize("embargo", [0.0, 0.05])
def test_scores_equal_a_loop_and_train_rows_touch_no_test_span(spark, embargo):
    rows = events()
    df = spark.createDataFrame(rows, SCHEMA)
    folds = v.spans(df, 4, embargo)
    marked = v.purged(df, folds).select("t0", "t1", "test", "train").collect()
    assert {r.test for r in marked} == {1, 2, 3, 4}
    for s in folds:
        held = [r for r in marked if r.test == s.fold]
        for r in marked:
            if s.fold in r.train:
                assert r.test != s.fold and all(r.t0 > h.t1 or r.t1 < h.t0 for h in held)
    got = {r.fold: r for r in v.cross_validate(df, {"lr": (LogisticRegression(regParam=0.0, standardization=False, maxIter=200, tol=1e-10), ["f1", "f2"])}, folds).collect()}
    table = frame(rows)
    for k, train, test in loop_folds(table, 4, embargo):
        x = table[["f1", "f2"]].to_numpy()
        beta = newton(x[train], table["label"][train].to_numpy(), table["weight"][train].to_numpy())
        p = 1 / (1 + np.exp(-(np.c_[np.ones(test.sum()), x[test]] @ beta)))
        y, w = table["label"][test].to_numpy(), table["weight"][test].to_numpy()
        assert (got[k].n_train, got[k].n_test) == (train.sum(), test.sum())
        assert got[k].neg_log_loss == pytest.approx((w * np.log(np.where(y == 1, p, 1 - p))).sum() / w.sum(), abs=1e-5)
        hit = (p > 0.5) == (y == 1)
        assert got[k].accuracy == pytest.approx((w * hit).sum() / w.sum(), abs=1e-9)
        tp, wrong = (w * (hit & (y == 1))).sum(), (w * ~hit).sum()
        assert got[k].f1 == pytest.approx(2 * tp / (2 * tp + wrong), abs=1e-9)


def test_fits_run_on_few_even_partitions(spark, monkeypatch):
    sizes = []

    class Recording(LogisticRegression):
        def _fit(self, dataset):
            sizes.append(dataset.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())
            return super()._fit(dataset)

    # As windows by key leave them: two full partitions among many empty ones.
    df = spark.createDataFrame(events(), SCHEMA).repartition(40, "symbol")
    folds = v.spans(df, 4, 0.02)
    candidates = {"lr": (Recording(), ["f1", "f2"])}
    scores = [v.cross_validate(df, candidates, folds).orderBy("fold").collect()]
    assert [len(s) for s in sizes] == [1] * 4
    sizes.clear()
    monkeypatch.setattr(v, "ROWS", 30)
    scores.append(v.cross_validate(df, candidates, folds).orderBy("fold").collect())
    assert [len(s) for s in sizes] == [8] * 4 and all(0 < min(s) and max(s) <= 30 for s in sizes)
    assert sum(map(sum, sizes)) == sum(r.n_train for r in scores[0])
    for a, b in zip(*scores, strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=1e-6)


def test_weights_change_the_fit_and_the_score(spark):
    rows = events()
    flat = [(*r[:-1], 1.0) for r in rows]
    scores = []
    for table in (rows, flat):
        df = spark.createDataFrame(table, SCHEMA)
        scores.append([r.neg_log_loss for r in v.cross_validate(df, {"a": (LogisticRegression(), ["f1"])}, v.spans(df, 3)).orderBy("fold").collect()])
    assert scores[0] != scores[1]
    # Without a weight column all rows weigh the same.
    plain = spark.createDataFrame(flat, SCHEMA).drop("weight")
    got = [r.neg_log_loss for r in v.cross_validate(plain, {"a": (LogisticRegression(), ["f1"])}, v.spans(plain, 3)).orderBy("fold").collect()]
    assert got == pytest.approx(scores[1])


def test_search_takes_the_best_mean_and_fits_all_rows(spark):
    df = spark.createDataFrame(events(), SCHEMA)
    folds = v.spans(df, 3, 0.02)
    choices = v.grid(regParam=[0.0, 0.1, 50.0], elasticNetParam=[0.0])
    found = v.hyper_fit(df, ["f1", "f2", "noise"], LogisticRegression(), choices, folds, scoring="neg_log_loss")
    means = {r["name"]: r["m"] for r in found.scores.groupBy("name").agg(F.avg("neg_log_loss").alias("m")).collect()}
    assert found.scores.count() == 9 and repr(sorted(found.best.items())) == max(means, key=means.get)
    assert found.best["regParam"] < 50
    again = v.weighted(LogisticRegression().copy()).setParams(**found.best).fit(v.assembled(df, ["f1", "f2", "noise"]))
    assert list(found.model.coefficients) == pytest.approx(list(again.coefficients), abs=1e-6)


def test_random_search_bagging_and_default_score(spark):
    df = spark.createDataFrame(events(), SCHEMA)
    choices = v.sampled(3, seed=5, regParam=v.LogUniform(1e-3, 1.0), elasticNetParam=[0.0, 0.5])
    assert choices == v.sampled(3, seed=5, regParam=v.LogUniform(1e-3, 1.0), elasticNetParam=[0.0, 0.5])
    assert all(1e-3 <= c["regParam"] <= 1 for c in choices)
    found = v.hyper_fit(df, ["f1", "f2", "noise"], LogisticRegression(), choices, v.spans(df, 3), bagging=(4, 0.8, 0.67))
    assert all(len(fs) == 2 for _, fs in found.model.models)
    scored = found.model.transform(df.drop("weight"))
    assert scored.count() == 240 and set(df.drop("weight").columns) < set(scored.columns)
    hit = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert hit > 0.6
    p = [r.probability.toArray() for r in scored.select("probability").collect()]
    assert np.allclose([x.sum() for x in p], 1)


def test_permutation_is_one_within_folds(spark):
    df = spark.createDataFrame([(k % 3, k, float(k)) for k in range(500)], "test int, k long, x double")
    moved = v.permuted(df, "test", ["k", "x"], 9).collect()
    for fold in range(3):
        mine = [r for r in moved if r.test == fold]
        assert sorted(r.p_k for r in mine) == sorted(r.k for r in mine) and all(r.p_x == r.p_k for r in mine)
        assert sum(r.p_k == r.k for r in mine) < 8
        assert abs(np.corrcoef([r.k for r in mine], [r.p_k for r in mine])[0, 1]) < 0.25
    assert [tuple(r) for r in v.permuted(df, "test", ["k"], 9).orderBy("k").collect()] == [tuple(r) for r in v.permuted(df.repartition(7), "test", ["k"], 9).orderBy("k").collect()]


def test_importance_finds_what_counts_and_leaves_noise_at_nought(spark):
    df = spark.createDataFrame(events(900, seed=8), SCHEMA)
    folds, lr = v.spans(df, 5, 0.01), LogisticRegression(maxIter=30)
    lost = {r.feature: r for r in v.permutation_importance(df, ["f1", "f2", "noise"], lr, folds).collect()}
    assert lost["f1"].mean > lost["f2"].mean > 2 * lost["f2"].error
    assert abs(lost["noise"].mean) <= 2 * lost["noise"].error + 0.01
    alone = {r.feature: r.mean for r in v.single_feature(df, ["f1", "f2", "noise"], lr, folds).collect()}
    assert alone["f1"] > alone["f2"] > alone["noise"] and alone["noise"] == pytest.approx(-math.log(2), abs=0.03)
    accuracy = {r.feature: r.mean for r in v.permutation_importance(df, ["f1", "noise"], lr, folds, "accuracy").collect()}
    assert accuracy["f1"] > 0.1 > abs(accuracy["noise"])


def test_impurity_importance_per_tree(spark):
    from pyspark.ml.classification import RandomForestClassifier

    df = v.assembled(spark.createDataFrame(events(), SCHEMA), ["f1", "f2", "noise"])
    model = v.weighted(RandomForestClassifier(numTrees=6, maxDepth=2, seed=3)).fit(df)
    got = {r.feature: (r.mean, r.error) for r in v.impurity_importance(model, ["f1", "f2", "noise"], spark).collect()}
    trees = pd.DataFrame([t.featureImportances.toArray() for t in model.trees], columns=["f1", "f2", "noise"]).replace(0, np.nan)
    want = pd.DataFrame({"m": trees.mean(), "e": trees.std() * 6**-0.5})
    want = (want / want["m"].sum()).fillna(0.0)
    for f in got:
        assert got[f] == pytest.approx(tuple(want.loc[f]))


def test_clustered_importance_sums_each_tree(spark):
    from pyspark.ml.classification import RandomForestClassifier

    from tickloom.operators import spectral

    raw = spark.createDataFrame(events(), SCHEMA).withColumn("twin", F.col("f1") * 2 + F.col("noise") / 50)
    names = ["f1", "f2", "noise", "twin"]
    pairs = spectral.feature_pairs(raw, names)
    table = raw.select(*names).toPandas()
    for r in pairs.collect():
        assert r.corr == pytest.approx(table[r.a].corr(table[r.b])) and r.cov == pytest.approx(table[r.a].cov(table[r.b]))
    found = {r.key: r.cluster for r in spectral.clusters(pairs, "by", most=3).collect()}
    assert found["f1"] == found["twin"] and found["f2"] != found["f1"]
    model = v.weighted(RandomForestClassifier(numTrees=5, maxDepth=2, seed=3)).fit(v.assembled(raw, names))
    groups = {k: f"C_{c}" for k, c in found.items()}
    got = {r.feature: (r.mean, r.error) for r in v.impurity_importance(model, names, spark, groups).collect()}
    trees = pd.DataFrame([t.featureImportances.toArray() for t in model.trees], columns=names).T.groupby(groups).sum().T
    want = pd.DataFrame({"m": trees.mean(), "e": trees.std() * 5**-0.5}) / trees.mean().sum()
    assert set(got) == set(groups.values())
    for c in got:
        assert got[c] == pytest.approx(tuple(want.loc[c]))


def test_walk_forward_sees_no_future(spark):
    rows = events(200)
    df = spark.createDataFrame(rows, SCHEMA)
    start = DAY + dt.timedelta(days=40)
    schedule = v.blocks(df, start, 20)
    assert [b.number for b in schedule] == [0, 1, 2] and schedule[0].first == start
    lr = LogisticRegression(maxIter=20)
    key = ["symbol", "t0", "t1", "label"]
    got = {(r.symbol, r.t0): (r.block, r.probability) for r in v.walk_forward(df, ["f1", "f2"], lr, schedule, key).collect()}
    assert len(got) == 120
    for b in schedule:
        # Whatever is not known before the block begins may change: its model does not.
        rng = random.Random(b.number)
        other = [r if r[2] < b.first else (*r[:6], float(rng.random() < 0.5), rng.random()) for r in rows]
        again = v.walk_forward(spark.createDataFrame(other, SCHEMA), ["f1", "f2"], lr, [b], key).collect()
        assert len(again) == 40
        for r in again:
            assert got[r.symbol, r.t0] == (b.number, pytest.approx(r.probability, abs=1e-9))
    assert len({p for _, p in got.values()}) > 100
    nothing = v.walk_forward(df, ["f1"], lr, v.blocks(df, DAY, 500), ["t0"]).collect()
    assert nothing == []


def test_empty_events(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert v.spans(df, 3) == [] and v.blocks(df, DAY, 5) == []
    assert v.cross_validate(df, {"a": (LogisticRegression(), ["f1"])}, []).count() == 0
