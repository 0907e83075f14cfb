"""Queries of purged cross-validation, search, importance and walk-forward models."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.factors import market
from ..functions.rolling import Frame
from ..operators import validation as v
from ..sources.views import PANEL, panel
from .operator_queries import query

FEATURES = ["ret_backward_1", "ret_backward_5", "ret_backward_10", "ret_backward_20", "breakout_20", "price_mom_10", "time_trend_20"]
HORIZON = 5
EMBARGO = 0.01


def labelled(spark, sf_dir: str) -> DataFrame:
    """Every row of the panel as an event: its factors, whether the price rises over five rows, that move as weight, and when it is known."""
    frame = Frame(PANEL)
    made = market.returns(frame) | market.trend(frame)
    factors = frame.apply(panel(spark, sf_dir).repartition("ticker"), {n: made[n] for n in [*FEATURES, f"ret_forward_{HORIZON}"]})
    t1 = F.lead("date", HORIZON).over(Window.partitionBy("ticker").orderBy("date"))
    move = F.col(f"ret_forward_{HORIZON}")
    known = factors.withColumn("t1", t1).where(move.isNotNull()).dropna(subset=FEATURES)
    return known.select("ticker", F.col("date").alias("t0"), "t1", *FEATURES, (move > 0).cast("double").alias("label"), F.abs(move).alias("weight"))


@query()
def cv_score(spark, sf_dir):
    """Scores per purged fold of a logistic model, weighted by the size of the move."""
    events = labelled(spark, sf_dir).persist()
    return v.cross_validate(events, {"logistic": (LogisticRegression(maxIter=20), FEATURES)}, v.spans(events, 5, EMBARGO))


@query()
def hyper_fit(spark, sf_dir):
    """Every choice of a small grid in every purged fold, and whether it is the best by mean F1."""
    events = labelled(spark, sf_dir).persist()
    choices = v.grid(regParam=[0.0, 0.01, 0.1], elasticNetParam=[0.0])
    found = v.hyper_fit(events, FEATURES, LogisticRegression(maxIter=20), choices, v.spans(events, 3, EMBARGO))
    return found.scores.withColumn("best", F.col("name") == repr(sorted(found.best.items())))


@query()
def single_feature_importance(spark, sf_dir):
    events = labelled(spark, sf_dir).persist()
    return v.single_feature(events, FEATURES[:4], LogisticRegression(maxIter=20), v.spans(events, 3, EMBARGO))


@query()
def feature_importance(spark, sf_dir):
    """Of a forest: impurity importance over its trees (mdi) and loss of log likelihood by permutation in purged folds (mda)."""
    events = labelled(spark, sf_dir).persist()
    forest = RandomForestClassifier(numTrees=10, maxDepth=4, seed=7)
    mda = v.permutation_importance(events, FEATURES, forest, v.spans(events, 3, EMBARGO))
    model = v.weighted(forest).fit(v.assembled(events, FEATURES))
    mdi = v.impurity_importance(model, FEATURES, spark)
    return mdi.select("feature", F.col("mean").alias("mdi"), F.col("error").alias("mdi_error")).join(mda.select("feature", F.col("mean").alias("mda"), F.col("error").alias("mda_error")), "feature")


@query()
def factor_classifier_job(spark, sf_dir):
    """A forest on factors, fitted anew every 100 dates of the test years to all labels known by then."""
    events = labelled(spark, sf_dir).persist()
    cut = F.to_date(F.lit("1999-01-01"))
    schedule = v.blocks(events, cut, 100)
    forest = RandomForestClassifier(numTrees=10, maxDepth=4, seed=7)
    scored = v.walk_forward(events, FEATURES, forest, schedule, ["ticker", "t0", "label"])
    return scored.withColumnRenamed("t0", "date")
