"""Queries of eigenvalues, orthogonal features, clusters and portfolios of the universe."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from ..operators import spectral as sp, validation as v
from .operator_queries import query, returns
from .validation_queries import FEATURES, labelled


def yearly(spark, sf_dir):
    return returns(spark, sf_dir).select(F.year("date").alias("year"), "ticker", "date", "ret")


def moments(spark, sf_dir):
    """Covariances and correlations of each year; persisted, since several steps read them."""
    return sp.moments(yearly(spark, sf_dir), "year").persist()


@query()
def corr_eigen(spark, sf_dir):
    return sp.eigen(moments(spark, sf_dir), "year").select("year", "k", "value", "share", "cumulative")


@query()
def pca_projection(spark, sf_dir):
    """The dates' returns on the first three components of their year's correlation."""
    r = yearly(spark, sf_dir)
    return sp.projections(r, sp.eigen(moments(spark, sf_dir), "year"), "year", 3)


@query()
def pca_orthogonal(spark, sf_dir):
    events = labelled(spark, sf_dir).persist()
    made, table = sp.orthogonal(events, FEATURES)
    return made.select("ticker", F.col("t0").alias("date"), *table.columns[1:])


@query()
def pca_rank_tau(spark, sf_dir):
    """How a forest's impurity importance agrees with the principal components."""
    events = labelled(spark, sf_dir).persist()
    model = v.weighted(RandomForestClassifier(numTrees=10, maxDepth=4, seed=7)).fit(v.assembled(events, FEATURES))
    importance = {r["feature"]: r["mean"] for r in v.impurity_importance(model, FEATURES, spark).collect()}
    _, table = sp.orthogonal(events, FEATURES)
    return spark.createDataFrame(sorted(sp.rank_tau(importance, table).items()), "measure string, value double")


@query()
def asset_clusters(spark, sf_dir):
    return sp.clusters(moments(spark, sf_dir), "year")


@query()
def nested_clusters(spark, sf_dir):
    pairs = moments(spark, sf_dir)
    return sp.nested_weights(pairs, sp.clusters(pairs, "year").persist(), "year")


@query()
def closed_form_minvar(spark, sf_dir):
    return sp.closed_form(moments(spark, sf_dir), "year")


@query()
def hrp(spark, sf_dir):
    return sp.hrp(moments(spark, sf_dir), "year").withColumnRenamed("key", "ticker")


@query()
def denoise_corr(spark, sf_dir):
    return sp.denoised(moments(spark, sf_dir), "year")


@query()
def denoise_corr_shrunk(spark, sf_dir):
    return sp.denoised(moments(spark, sf_dir), "year", how="shrink", alpha=0.3)


@query()
def detone_corr(spark, sf_dir):
    return sp.denoised(moments(spark, sf_dir), "year", market=1)


@query()
def clustered_mdi(spark, sf_dir):
    """Impurity importance of a forest by clusters of correlated features."""
    events = labelled(spark, sf_dir).persist()
    model = v.weighted(RandomForestClassifier(numTrees=10, maxDepth=4, seed=7)).fit(v.assembled(events, FEATURES))
    groups = {r["key"]: f"C_{r['cluster']}" for r in sp.clusters(sp.feature_pairs(events, FEATURES), "by", most=4).collect()}
    return v.impurity_importance(model, FEATURES, spark, groups).withColumnRenamed("feature", "cluster")
