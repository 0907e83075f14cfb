"""Queries of the strategies, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, strategies
from ..sources.views import panel, sql
from .operator_queries import P, _r, query, returns

RATES = "SELECT CAST(s_nationkey AS INT) AS ticker, CAST(l_shipdate AS DATE) AS date, round(avg(l_tax), 6) AS rate FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, CAST(l_shipdate AS DATE)"
CURVES = """SELECT CAST(n_regionkey AS INT) AS curve, CAST(l_shipdate AS DATE) AS date, avg(CASE WHEN l_linenumber = 1 THEN 0.01 + l_tax END) AS short,
  avg(CASE WHEN l_linenumber IN (2, 3) THEN 0.01 + l_tax END) AS mid, avg(CASE WHEN l_linenumber > 3 THEN 0.01 + l_tax END) AS long
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey, CAST(l_shipdate AS DATE)"""


def _rates(spark, sf_dir):
    return panel(spark, sf_dir).select("ticker", "date", "close").join(sql(spark, sf_dir, RATES, "lineitem", "supplier"), ["ticker", "date"])


def _curves(spark, sf_dir):
    return sql(spark, sf_dir, CURVES, "lineitem", "supplier", "nation")


@query()
def yield_steepener(spark, sf_dir):
    return strategies.curve_trade(_curves(spark, sf_dir))


@query()
def yield_butterfly(spark, sf_dir):
    return strategies.curve_trade(_curves(spark, sf_dir), butterfly=True, enter=2.0, stop=4.0, take=1.0)


@query()
def pairs_zscore(spark, sf_dir):
    return strategies.pairs_zscore(panel(spark, sf_dir))


_DIFF = f"""{P}, rate AS ({RATES}), m AS (SELECT p.ticker, p.date, close / lag(close) OVER (PARTITION BY p.ticker ORDER BY p.date) - 1 AS ret, rate, rate - avg(rate) OVER (PARTITION BY p.date) AS diff
  FROM panel p JOIN rate ON p.ticker = rate.ticker AND p.date = rate.date)"""


@query(f"""{_DIFF}, k AS (SELECT * FROM m WHERE ret IS NOT NULL),
  days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM k)),
  c AS (SELECT k.*, i, (i % 21 = 0 AND i + 63 < n) AS chosen, row_number() OVER (PARTITION BY k.date ORDER BY rate DESC, ticker) AS h, row_number() OVER (PARTITION BY k.date ORDER BY rate, ticker DESC) AS l FROM k JOIN days ON k.date = days.date),
  w AS (SELECT *, coalesce(last_value(CASE WHEN chosen AND l <= 3 THEN -1.0 / 3 WHEN chosen AND h <= 3 THEN 1.0 / 3 END IGNORE NULLS) OVER u, 0) AS w, coalesce(last_value(CASE WHEN chosen THEN diff END IGNORE NULLS) OVER u, 0) AS d FROM c WINDOW u AS (PARTITION BY ticker ORDER BY date)),
  r AS (SELECT date, coalesce(sum(y * ret), 0) AS r FROM (SELECT *, lag(w) OVER (PARTITION BY ticker ORDER BY date) AS y FROM w) GROUP BY date),
  s AS (SELECT date, CASE WHEN count(*) OVER b < 63 THEN 1.0 ELSE coalesce(least(0.1 / nullif(stddev_samp(r) OVER b * sqrt(252), 0), 3.0), 3.0) END AS s FROM r WINDOW b AS (ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
  x AS (SELECT w.*, w * s AS x, lag(w * s) OVER (PARTITION BY ticker ORDER BY w.date) AS y FROM w JOIN s ON w.date = s.date),
  g AS (SELECT date, coalesce(sum(y * ret), 0) AS fx, coalesce(sum(x * d) / 252, 0) AS carry FROM x GROUP BY date)
  SELECT CAST(date AS VARCHAR) AS date, {_r("fx", 6)} AS fx, {_r("carry", 6)} AS carry FROM g""", digits=6)
def carry_trade(spark, sf_dir):
    return strategies.carry_trade(_rates(spark, sf_dir)).select("date", "fx", "carry")


@query()
def rate_differential(spark, sf_dir):
    return strategies.rate_differential(_rates(spark, sf_dir)).drop("wealth")


@query(digits=6)
def risk_parity(spark, sf_dir):
    return strategies.risk_parity(returns(spark, sf_dir).select("ticker", "date", "ret"))


@query()
def etf_trick(spark, sf_dir):
    """Each region's basket, weights by last month's amounts."""
    p = panel(spark, sf_dir)
    month = p.groupBy("ticker", F.add_months(F.date_trunc("month", "date"), 1).alias("month")).agg(F.sum("amount").alias("weight"))
    full = joins.align_calendar(p.select("ticker", "date", "open", "close"), ["open", "close"]).join(p.select("ticker", "sector").distinct(), "ticker").withColumn("month", F.date_trunc("month", "date").cast("date")).join(month, ["ticker", "month"], "left")
    return strategies.basket_value(full.select(F.col("sector").alias("basket"), "ticker", "date", "open", "close", "weight", F.lit(1.0).alias("rate"), F.lit(0.0).alias("cost")))
