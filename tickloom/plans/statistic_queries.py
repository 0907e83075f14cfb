"""Queries of statistics, bets, fundamentals, strategies and entropies, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import breaks, fundamentals, statistics as st
from ..sources.views import panel, sql
from .operator_queries import P, RET, _r, query, returns

QUARTERS = """SELECT c_nationkey AS ticker, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS report_date,
  concat(CAST(year(o_orderdate) AS {s}), '/Q', CAST(quarter(o_orderdate) AS {s})) AS report_name, sum(o_totalprice) AS revenue, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS cost,
  sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS profit, sum(o_totalprice) * 2 AS asset, sum(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice ELSE 0 END) AS debt,
  sum(CASE WHEN o_orderpriority LIKE '2%' THEN o_totalprice ELSE 0 END) AS equity, sum(CASE WHEN o_orderpriority LIKE '3%' THEN o_totalprice ELSE 0 END) AS cash
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""
Q = f"WITH q AS ({QUARTERS.format(s='VARCHAR')})"


def quarters(spark, sf_dir):
    return sql(spark, sf_dir, QUARTERS.format(s="STRING").replace("GROUP BY ALL", "GROUP BY 1, 2, 3"), "orders", "customer")


@query(f"{Q} SELECT ticker, CAST(report_date AS VARCHAR) AS report_date, report_name, " + ", ".join(f"{_r(f'CASE WHEN report_name LIKE {chr(39)}%Q1{chr(39)} THEN {c} ELSE {c} - lag({c}) OVER (PARTITION BY ticker ORDER BY report_name) END', 2)} AS {c}" for c in ("revenue", "cost")) + " FROM q", digits=2)
def stmt_quarterise(spark, sf_dir):
    return fundamentals.quarterise(quarters(spark, sf_dir).select("ticker", "report_date", "report_name", "revenue", "cost"), ["revenue", "cost"])


@query(f"{Q} SELECT ticker, CAST(report_date AS VARCHAR) AS report_date, {_r('revenue', 2)} AS revenue, {_r('CASE WHEN count(revenue) OVER w = 4 THEN sum(revenue) OVER w END', 2)} AS revenue_ttm FROM q WINDOW w AS (PARTITION BY ticker ORDER BY report_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", digits=2)
def ttm(spark, sf_dir):
    return fundamentals.trailing(quarters(spark, sf_dir).select("ticker", "report_date", "revenue"), ["revenue"])


_RATIOS = {
    "roe": "profit / nullif(equity, 0) * 100", "roa": "profit / nullif(asset, 0) * 100", "roi": "profit / nullif(debt + equity - cash, 0) * 100", "profit_revenue": "profit / nullif(revenue, 0) * 100",
    "gross_profit_revenue": "(revenue - cost) / nullif(revenue, 0) * 100", "profit_cost": "profit / nullif(cost, 0) * 100", "debt_asset": "debt / nullif(asset, 0)", "debt_equity": "debt / nullif(equity, 0)",
    "debt_net_asset": "debt / nullif(equity, 0)", "revenue_asset": "revenue / nullif(asset, 0) * 100",
    **{f"{x}_q2q": f"coalesce({x} / nullif(lag({x}, 3) OVER (PARTITION BY ticker ORDER BY report_date), 0) - 1, 0) * 100" for x in ("revenue", "profit", "cost", "asset", "debt")},
}


@query(f"{Q} SELECT ticker, CAST(report_date AS VARCHAR) AS report_date, " + ", ".join(f"{_r(x)} AS {n}" for n, x in _RATIOS.items()) + " FROM q")
def fundamental_ratios(spark, sf_dir):
    return fundamentals.ratios(quarters(spark, sf_dir))


@query(f"{RET}, e AS (SELECT ticker, stddev_samp(ret) AS sd, avg(ret) AS mu, quantile_cont(ret, 0.05) AS v5, quantile_cont(ret, 0.01) AS v1, sqrt(avg(CASE WHEN ret < 0 THEN ret * ret WHEN ret IS NOT NULL THEN 0 END)) AS ds FROM r GROUP BY ticker), s AS (SELECT r.ticker, avg(ret) AS cv FROM r JOIN e ON r.ticker = e.ticker WHERE ret <= v5 GROUP BY r.ticker) SELECT e.ticker, {_r('sd * sqrt(252.0)')} AS volatility, {_r('ds * sqrt(252.0)')} AS downside, {_r('v5')} AS var95, {_r('v1')} AS var99, {_r('cv')} AS cvar95, {_r('mu - 1.6448536269514722 * sd')} AS var95_normal FROM e JOIN s ON e.ticker = s.ticker")
def risk_metrics(spark, sf_dir):
    return st.risk(returns(spark, sf_dir))


@query(f"{P}, y AS (SELECT *, ln(close) - avg(ln(close)) OVER (PARTITION BY ticker) AS y FROM panel), x AS (SELECT *, lag(y) OVER (PARTITION BY ticker ORDER BY date) AS x FROM y), f AS (SELECT ticker, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c FROM x WHERE x IS NOT NULL GROUP BY ticker) SELECT x.ticker, {_r('max(phi)')} AS phi, {_r('stddev_pop(y - c - phi * x)')} AS sigma, {_r('CASE WHEN max(phi) > 0 AND max(phi) < 1 THEN -ln(2.0) / ln(max(CASE WHEN phi > 0 THEN phi END)) END')} AS half_life FROM x JOIN f ON x.ticker = f.ticker WHERE x IS NOT NULL GROUP BY x.ticker")
def ou_params(spark, sf_dir):
    return st.ou_parameters(panel(spark, sf_dir))


@query()
def bet_size_dynamic(spark, sf_dir):
    known = panel(spark, sf_dir).select("ticker", "date", F.col("close").alias("price"), F.col("open").alias("forecast"), F.lit(0.0).alias("pos"))
    return st.bet_dynamic(known, 1e6, 10)


@query()
def bollinger_positions(spark, sf_dir):
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-19, 0)
    z = F.try_divide(F.col("close") - F.avg("close").over(w), F.stddev_samp("close").over(w))
    known = returns(spark, sf_dir).select("ticker", "date", "close", "ret", F.when(z < -1.5, 1.0).when(z > 1.5, -1.0).otherwise(0.0).alias("signal"))
    return st.accounted(st.positions(known, "signal", 10))


@query(f"{RET} SELECT ticker, {_r('(1 / var_samp(ret)) / sum(1 / var_samp(ret)) OVER ()')} AS weight FROM r GROUP BY ticker")
def inverse_variance(spark, sf_dir):
    return st.inverse_variance(returns(spark, sf_dir))


@query(f"{P}, j AS (SELECT a.date, a.ticker AS a, b.ticker AS b, ln(a.close) AS x, ln(b.close) AS y FROM panel a JOIN panel b ON a.date = b.date AND a.ticker < b.ticker), f AS (SELECT a, b, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha FROM j GROUP BY ALL), e AS (SELECT j.a, j.b, date, y - alpha - beta * x AS e, beta FROM j JOIN f ON j.a = f.a AND j.b = f.b), l AS (SELECT *, lag(e) OVER (PARTITION BY a, b ORDER BY date) AS l FROM e), s AS (SELECT a, b, count(*) AS n, max(beta) AS beta, sum(l * (e - l)) AS ld, sum(l * l) AS ll, sum((e - l) * (e - l)) AS dd FROM l WHERE l IS NOT NULL GROUP BY ALL) SELECT a, b, n, {_r('beta')} AS beta, {_r('(ld / ll) / sqrt((dd - ld / ll * ld) / (n - 1) / ll)')} AS t FROM s")
def coint_pairs(spark, sf_dir):
    return st.coint_statistics(panel(spark, sf_dir))


@query()
def message_entropies(spark, sf_dir):
    r = returns(spark, sf_dir).where("ret IS NOT NULL")
    letters = r.groupBy("ticker", F.year("date").alias("year")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", "ret"))), lambda x: F.when(x["ret"] > 0, "a").otherwise("b")), "").alias("message"))
    return st.message_entropies(letters, "message").withColumn("lempel_ziv", st.lempel_ziv("message")).drop("message")


@query()
def rolling_hurst(spark, sf_dir):
    return st.rolling_hurst(returns(spark, sf_dir))


@query(f"{P} SELECT ticker, CAST(week AS VARCHAR) AS week, {_r('close')} AS close, {_r('close / lag(close) OVER (PARTITION BY ticker ORDER BY week) - 1')} AS ret FROM (SELECT ticker, CAST(date_trunc('week', date) AS DATE) AS week, arg_max(close, date) AS close FROM panel GROUP BY ALL)")
def resample_last(spark, sf_dir):
    weekly = panel(spark, sf_dir).groupBy("ticker", F.date_trunc("week", "date").cast("date").alias("week")).agg(F.max_by("close", "date").alias("close"))
    return weekly.withColumn("ret", F.try_divide("close", F.lag("close").over(Window.partitionBy("ticker").orderBy("week"))) - 1)


@query(f"{RET}, m AS (SELECT date, avg(ret) AS market FROM r GROUP BY date) SELECT ticker, {_r('regr_slope(ret, market)')} AS beta, {_r('regr_intercept(ret, market)')} AS alpha, {_r('regr_r2(ret, market)')} AS r2 FROM r JOIN m ON r.date = m.date WHERE ret IS NOT NULL GROUP BY ticker")
def factor_exposure(spark, sf_dir):
    r = returns(spark, sf_dir).where("ret IS NOT NULL")
    market = r.groupBy("date").agg(F.avg("ret").alias("market"))
    return r.join(market, "date").groupBy("ticker").agg(F.regr_slope("ret", "market").alias("beta"), F.regr_intercept("ret", "market").alias("alpha"), F.regr_r2("ret", "market").alias("r2"))


@query(f"{RET}, m AS (SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS month, product(1 + ret) - 1 AS ret FROM r WHERE ret IS NOT NULL GROUP BY ALL) SELECT ticker, CAST(month AS VARCHAR) AS month, {_r('ret')} AS ret FROM m")
def monthly_return(spark, sf_dir):
    r = returns(spark, sf_dir).where("ret IS NOT NULL")
    return r.groupBy("ticker", F.date_trunc("month", "date").cast("date").alias("month")).agg((F.product(1 + F.col("ret")) - 1).alias("ret"))


@query()
def csw_cusum(spark, sf_dir):
    return breaks.csw_cusum(panel(spark, sf_dir))


@query(f"{P}, l AS (SELECT ticker, date, ln(close) AS y, lag(ln(close)) OVER (PARTITION BY ticker ORDER BY date) AS l FROM panel), s AS (SELECT ticker, date, sum(l * l) OVER w AS xx, sum(l * (y - l)) OVER w AS xd, sum((y - l) * (y - l)) OVER (PARTITION BY ticker) AS dd, count(*) OVER (PARTITION BY ticker) AS n FROM l WHERE l IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT ticker, CAST(date AS VARCHAR) AS date, {_r('(xd / xx) / sqrt((dd - xd / xx * xd) / (n - 1) / xx)')} AS t FROM s WHERE n > 2")
def chow_df(spark, sf_dir):
    return breaks.chow_df(panel(spark, sf_dir))


@query()
def sadf(spark, sf_dir):
    return breaks.sadf(panel(spark, sf_dir))


@query()
def kalman_filter(spark, sf_dir):
    return breaks.kalman(panel(spark, sf_dir))


@query()
def fracdiff_ffd(spark, sf_dir):
    return breaks.fracdiff(panel(spark, sf_dir))


@query()
def fracdiff_expanding(spark, sf_dir):
    return breaks.fracdiff_expanding(panel(spark, sf_dir))


@query()
def csw_cusum_two_sided(spark, sf_dir):
    return breaks.csw_cusum(panel(spark, sf_dir), two_sided=True)


@query()
def seq_bootstrap(spark, sf_dir):
    w = Window.partitionBy("ticker").orderBy("date")
    i = panel(spark, sf_dir).select(F.col("ticker").alias("symbol"), F.row_number().over(w).alias("i0"))
    return breaks.sequential_bootstrap(i.withColumn("i1", F.col("i0") + 15))


@query(f"{P}, c AS (SELECT *, year(date) AS contract FROM panel), g AS (SELECT *, CASE WHEN contract <> lag(contract) OVER w THEN open - lag(close) OVER w ELSE 0 END AS g FROM c WINDOW w AS (PARTITION BY ticker ORDER BY date)), k AS (SELECT ticker, date, sum(g) OVER (PARTITION BY ticker ORDER BY date) AS gap, sum(g) OVER (PARTITION BY ticker) AS total FROM g) SELECT ticker, CAST(date AS VARCHAR) AS date, {_r('gap - total')} AS gap FROM k")
def futures_roll_gaps(spark, sf_dir):
    return breaks.roll_gaps(panel(spark, sf_dir).withColumn("contract", F.year("date")), "contract").select("ticker", "date", "gap")


@query()
def dynamic_zscore(spark, sf_dir):
    return breaks.dynamic_zscore(panel(spark, sf_dir))


@query(f"""{RET}, k AS (SELECT ticker, date, ret, median(ret) OVER (PARTITION BY ticker) AS m, row_number() OVER w AS i, avg(ret) OVER w AS u, var_pop(ret) OVER w AS v FROM r WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date)),
  q AS (SELECT *, CASE WHEN i = 1 THEN 0 ELSE u END AS u1, CASE WHEN i = 1 THEN 1 ELSE nullif(v, 0) END AS v1 FROM k),
  c AS (SELECT ticker, date, sum(coalesce(m * (ret - u1 - m / 2) / v1, 0)) OVER w AS s, sum(coalesce(abs(m) * (ret - u1 - abs(m) / 2) / v1, 0)) OVER w AS p, sum(coalesce(-abs(m) * (ret - u1 + abs(m) / 2) / v1, 0)) OVER w AS n FROM q WINDOW w AS (PARTITION BY ticker ORDER BY date))
  SELECT ticker, CAST(date AS VARCHAR) AS date, {_r("s")} AS s, {_r("s - least(min(s) OVER w, 0)")} AS g, {_r("p - least(min(p) OVER w, 0)")} AS up, {_r("n - least(min(n) OVER w, 0)")} AS down FROM c WINDOW w AS (PARTITION BY ticker ORDER BY date)""")
def bde_cusum(spark, sf_dir):
    return breaks.bde_cusum(returns(spark, sf_dir))


@query()
def sadf_linear(spark, sf_dir):
    return breaks.sadf(panel(spark, sf_dir), "linear", lags=2)


@query()
def sadf_sm_exp(spark, sf_dir):
    return breaks.sadf(panel(spark, sf_dir), "sm_exp")


@query()
def johansen_rank(spark, sf_dir):
    return breaks.johansen(panel(spark, sf_dir), "sector")


@query()
def min_ffd_search(spark, sf_dir):
    return breaks.ffd_search(panel(spark, sf_dir))


@query()
def hurst_dfa(spark, sf_dir):
    return st.rolling_hurst(returns(spark, sf_dir), step=10, method="dfa")


@query()
def hurst_aggvar(spark, sf_dir):
    return st.rolling_hurst(returns(spark, sf_dir), step=10, method="aggvar")


@query()
def hurst_higuchi(spark, sf_dir):
    return st.rolling_hurst(returns(spark, sf_dir), step=10, method="higuchi")


@query()
def entropy_konto(spark, sf_dir):
    r = returns(spark, sf_dir).where("ret IS NOT NULL")
    letters = r.groupBy("ticker", F.year("date").alias("year")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", "ret"))), lambda x: F.when(x["ret"] > 0, "a").otherwise("b")), "").alias("message"))
    return letters.select("ticker", "year", st.konto_entropy()("message").alias("konto"), st.konto_entropy(20)("message").alias("konto_20"))


@query()
def continuous_entropy(spark, sf_dir):
    return st.continuous_entropy(returns(spark, sf_dir))


@query()
def dist_js(spark, sf_dir):
    return st.js_divergence(returns(spark, sf_dir), size=8)


MARKET = f"{RET}, k AS (SELECT ticker, date, ret, avg(ret) OVER (PARTITION BY date) AS market FROM r WHERE ret IS NOT NULL)"


@query(
    f"{MARKET} SELECT ticker, CAST(date AS VARCHAR) AS date, "
    + ", ".join(
        f"{_r(f'CASE WHEN count(*) OVER w{n} = {n} THEN avg(ret) OVER w{n} - avg(market) OVER w{n} * covar_pop(ret, market) OVER w{n} / var_pop(market) OVER w{n} END')} AS alpha_{n}, "
        f"{_r(f'CASE WHEN count(*) OVER w{n} = {n} THEN covar_pop(ret, market) OVER w{n} / var_pop(market) OVER w{n} END')} AS beta_{n}"
        for n in (10, 20, 60)
    )
    + " FROM k WINDOW "
    + ", ".join(f"w{n} AS (PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING)" for n in (10, 20, 60))
)
def trend_alpha_mom(spark, sf_dir):
    return st.alpha_momentum(returns(spark, sf_dir))


@query(f"""{MARKET}, b AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS total,
    count(*) OVER w AS n, sum(market) OVER w AS sx, sum(market * market) OVER w AS sxx, sum(ret) OVER w AS sy, sum(market * ret) OVER w AS sxy
    FROM k WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  e AS (SELECT *, CASE WHEN n >= 2 THEN (sy - sx * (n * sxy - sx * sy) / (n * sxx - sx * sx)) / n + market * (n * sxy - sx * sy) / (n * sxx - sx * sx)
      WHEN n = 1 THEN sy * (1 + sx * market) / (1 + sx * sx) END AS expected,
    (sxx + 1e-5 - 2 * sx * market + (n + 1e-5) * market * market) / ((n + 1e-5) * (sxx + 1e-5) - sx * sx) AS spread FROM b),
  w AS (SELECT ticker, date, i, total, CASE WHEN i = 0 THEN 0 ELSE (ret - expected) / sqrt(1 + spread) END AS residual FROM e)
  SELECT ticker, CAST(date AS VARCHAR) AS date, {_r('residual')} AS residual,
    {_r('sum(residual) OVER (PARTITION BY ticker ORDER BY date) / stddev_pop(residual) OVER (PARTITION BY ticker)')} AS cusum,
    {_r('sqrt(total) * (1 + 2 * i / total) * 1.959963984540054')} AS critical FROM w""")
def bde_recursive_residuals(spark, sf_dir):
    r = returns(spark, sf_dir).where("ret IS NOT NULL").select("ticker", "date", "ret")
    known = r.join(r.groupBy("date").agg(F.avg("ret").alias("market")), "date")
    return breaks.recursive_residuals(known, "ret", ["market"])
