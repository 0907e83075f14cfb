"""Queries of position machines, model fingerprints and the smaller scores, and their SQL."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bars, fingerprint as fp, hurst_trades as ht, joins, labels, panel as cross, reversion as rv, statistics as st, validation as v
from ..sources.views import panel, ticks
from .operator_queries import P, RET, T, _r, query, returns
from .validation_queries import FEATURES, labelled


def prices(spark, sf_dir):
    return returns(spark, sf_dir).select("ticker", "date", "close", "ret")


@query()
def band_reversion(spark, sf_dir):
    return st.accounted(rv.band_positions(prices(spark, sf_dir), partial=True, hold=10))


@query()
def rsi_reversion(spark, sf_dir):
    return st.accounted(rv.rsi_positions(prices(spark, sf_dir)))


@query()
def hurst_reversion(spark, sf_dir):
    p = prices(spark, sf_dir)
    return st.accounted(rv.hurst_positions(p, st.rolling_hurst(p).select("ticker", "date", "hurst"), below=0.6))


@query()
def term_structure(spark, sf_dir):
    """The tickers of even number as front contracts, their successors as back ones."""
    p = panel(spark, sf_dir).select("ticker", "date", "close")
    return rv.term_structure(p.where("ticker % 2 = 0"), p.where("ticker % 2 = 1").withColumn("ticker", F.col("ticker") - 1))


@query()
def model_fingerprint(spark, sf_dir):
    events = labelled(spark, sf_dir).persist()
    model = v.weighted(RandomForestClassifier(numTrees=5, maxDepth=3, seed=7)).fit(v.assembled(events, FEATURES[:4]))
    return fp.fingerprint(events, model, FEATURES[:4], [("ret_backward_1", "ret_backward_5")], n=12)


@query(f"{P} SELECT ticker, CAST(date AS VARCHAR) AS date, CAST(close > open AS INT) AS rose, {_r('close - open')} AS body FROM panel")
def drop_zero_cols(spark, sf_dir):
    table = panel(spark, sf_dir).select("ticker", "date", (F.col("close") > F.col("open")).alias("rose"), (F.col("close") - F.col("open")).alias("body"), (F.col("close") < 0).alias("never"), (F.col("volume") * 0).alias("nought"))
    return cross.drop_zero_columns(table, ["rose", "body", "never", "nought"])


@query(f"{T} SELECT symbol, CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS start, {_r('sum(CASE WHEN side = -1 THEN volume ELSE 0 END)')} AS bid, {_r('sum(CASE WHEN side = 1 THEN volume ELSE 0 END)')} AS ask FROM sided GROUP BY ALL")
def depth_by_interval(spark, sf_dir):
    return bars.depth_by_interval(ticks(spark, sf_dir), 21600)


@query(f"""{RET}, s AS (SELECT ticker, CASE WHEN lead(ret) OVER (PARTITION BY ticker ORDER BY date) > 0 THEN 1 ELSE 0 END AS label, round(1 / (1 + exp(2 * ret)), 3) AS p, lead(ret) OVER (PARTITION BY ticker ORDER BY date) AS nx FROM r WHERE ret IS NOT NULL),
  k AS (SELECT * FROM s WHERE nx IS NOT NULL),
  a AS (SELECT x.ticker, sum(CASE WHEN x.p > y.p THEN 1.0 WHEN x.p = y.p THEN 0.5 ELSE 0 END) / count(*) AS auc FROM k x JOIN k y ON x.ticker = y.ticker AND x.label = 1 AND y.label = 0 GROUP BY x.ticker)
  SELECT k.ticker, {_r('sum(CASE WHEN (p > 0.5) = (label = 1) THEN greatest(p, 1 - p) - 0.5 ELSE 0 END) / sum(greatest(p, 1 - p) - 0.5)')} AS weighted_accuracy,
    {_r('sum(CASE WHEN (p > 0.5) = (label = 1) THEN 100.0 ELSE -100.0 END)')} AS profit, {_r('max(auc)')} AS auc FROM k JOIN a ON k.ticker = a.ticker GROUP BY k.ticker""")
def profit_score(spark, sf_dir):
    """A forecast that the next move is against the last one, and what it earns."""
    r = returns(spark, sf_dir).where("ret IS NOT NULL")
    after = F.lead("ret").over(Window.partitionBy("ticker").orderBy("date"))
    scored = r.select("ticker", (1 / (1 + F.exp(2 * F.col("ret")))).alias("p"), after.alias("nx")).where("nx IS NOT NULL")
    scored = scored.select("ticker", F.round("p", 3).alias("p"), (F.col("nx") > 0).cast("int").alias("label"))
    return st.classification_scores(scored, ["ticker"])


@query(f"{P}, j AS (SELECT a.ticker AS a, b.ticker AS b, year(a.date) AS year, ln(b.close / a.close) AS l, a.date FROM panel a JOIN panel b ON a.date = b.date AND b.ticker = a.ticker + 1), y AS (SELECT *, l - avg(l) OVER (PARTITION BY a, year) AS y FROM j), x AS (SELECT *, lag(y) OVER (PARTITION BY a, year ORDER BY date) AS x FROM y), f AS (SELECT a, year, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c FROM x WHERE x IS NOT NULL GROUP BY ALL) SELECT x.a, x.year, {_r('max(phi)')} AS phi, {_r('stddev_pop(y - c - phi * x)')} AS sigma FROM x JOIN f ON x.a = f.a AND x.year = f.year WHERE x IS NOT NULL GROUP BY x.a, x.year")
def ratio_spread_ou(spark, sf_dir):
    """Ornstein-Uhlenbeck parameters, year by year, of the price ratio of each ticker's successor to it."""
    p = panel(spark, sf_dir).select("ticker", "date", "close")
    other = p.select((F.col("ticker") - 1).alias("ticker"), "date", F.col("close").alias("other"))
    ratio = p.join(other, ["ticker", "date"]).select(F.struct(F.col("ticker").alias("a"), F.year("date").alias("year")).alias("key"), "date", (F.col("other") / F.col("close")).alias("close"))
    return st.ou_parameters(ratio, key="key").select("key.a", "key.year", "phi", "sigma")


@query(f"{P}, m AS (SELECT ticker, date_trunc('month', date) AS month, CAST(count(*) AS DOUBLE) AS n FROM panel GROUP BY ALL) SELECT ticker, count(*) AS months, {_r('(sum(n * n) / (sum(n) * sum(n)) - 1.0 / count(*)) / (1 - 1.0 / count(*))', 6)} AS concentration FROM m GROUP BY ticker", concentration=6)
def hhi_months(spark, sf_dir):
    return st.month_concentration(panel(spark, sf_dir), "date", "ticker")


@query(f"{RET}, i AS (SELECT ticker, year(date) AS method, {_r('avg(ret)', 6)} AS importance FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY importance DESC, ticker) AS h, row_number() OVER (PARTITION BY method ORDER BY importance, ticker) AS l FROM i) SELECT ticker AS feature, string_agg(DISTINCT CAST(method AS VARCHAR), ',' ORDER BY CAST(method AS VARCHAR)) AS methods FROM k WHERE h <= 2 OR l <= 2 GROUP BY ticker")
def top_factors(spark, sf_dir):
    """Tickers among the two best or worst mean returns of any year."""
    means = returns(spark, sf_dir).groupBy(F.col("ticker").alias("feature"), F.year("date").cast("string").alias("method")).agg((F.round(F.avg("ret") * 1e6, 0) / 1e6).alias("importance"))
    return st.top_features(means, 2)


@query(f"{RET}, c AS (SELECT ticker, {_r('avg(ret) / stddev_samp(ret)')} AS sharpe FROM r GROUP BY ticker) SELECT ticker, sharpe, row_number() OVER (ORDER BY sharpe DESC, ticker) AS place FROM c")
def order_result(spark, sf_dir):
    r = returns(spark, sf_dir).groupBy("ticker").agg((F.round(F.avg("ret") / F.stddev_samp("ret") * 1e4, 0) / 1e4).alias("sharpe"))
    return st.ranked(r, "sharpe")


@query(f"{P}, k AS (SELECT ticker AS symbol, date AS t0, lead(date, 5) OVER (PARTITION BY ticker ORDER BY date) AS t1, year(date) AS y FROM panel), t AS (SELECT symbol, min(t0) AS a, max(t1) AS b FROM k WHERE y = 1997 AND t1 IS NOT NULL GROUP BY symbol) SELECT k.symbol, CAST(k.t0 AS VARCHAR) AS t0, CAST(k.t1 AS VARCHAR) AS t1 FROM k WHERE k.t1 IS NOT NULL AND k.y <> 1997 AND NOT EXISTS (FROM k x WHERE x.y = 1997 AND x.t1 IS NOT NULL AND x.symbol = k.symbol AND x.t0 <= k.t1 AND k.t0 <= x.t1)")
def purge_antijoin(spark, sf_dir):
    """The spans of all years but 1997 that touch none of its own of the same symbol."""
    spans = panel(spark, sf_dir).select(F.col("ticker").alias("symbol"), F.col("date").alias("t0"), F.lead("date", 5).over(Window.partitionBy("ticker").orderBy("date")).alias("t1")).where("t1 IS NOT NULL")
    return joins.purge(spans.where("year(t0) <> 1997"), spans.where("year(t0) = 1997"))


@query(f"""{P}, d AS (SELECT ticker, date, open / close - 1 AS d FROM panel) SELECT ticker, CAST(date AS VARCHAR) AS date, {_r('d / sqrt(0.5 + d * d)')} AS sigmoid, {_r('sign(d) * pow(abs(d), 1.5)')} AS power,
  {_r('greatest(least(round_even(d / sqrt(0.5 + d * d) / 0.1, 0) * 0.1, 1), -1)')} AS stepped FROM d""")
def bet_forms(spark, sf_dir):
    """Bet sizes of the open against the close: sigmoid, power, and the sigmoid in steps of a tenth."""
    d = F.col("open") / F.col("close") - 1
    known = panel(spark, sf_dir).select("ticker", "date", d.alias("d"))
    size = st.bet_sigmoid(F.col("d"), F.lit(0.5))
    return known.select("ticker", "date", size.alias("sigmoid"), st.bet_power(F.col("d"), F.lit(1.5)).alias("power"), labels.discrete(size, 0.1).alias("stepped"))


def _hurst_trades(spark, sf_dir):
    p = panel(spark, sf_dir).select("ticker", "date", "high", "low", "close")
    return ht.hurst_strategy(p, st.rolling_hurst(returns(spark, sf_dir), width=90), ht.HurstRules(by_type=True))


@query()
def hurst_strategy(spark, sf_dir):
    return _hurst_trades(spark, sf_dir)


@query()
def evaluate_by_type(spark, sf_dir):
    """What the trades by the Hurst exponent earn, by side."""
    return ht.evaluate(_hurst_trades(spark, sf_dir))
