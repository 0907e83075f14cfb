"""Queries of labels, portfolios and performance, and their SQL, written by hand from the definitions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bars, fundamentals, joins, labels, panel as cross, portfolio, statistics as st
from ..sources.views import PANEL_SQL, panel, sql, ticks
from .operator_queries import BAR, P, RET, SPANS, STATEMENTS_SQL, T, _r, _spans, bar_view, query, returns, statements

B = f"{P}, b AS (SELECT ticker AS symbol, CAST(date AS TIMESTAMP) AS ts, close FROM panel)"
V = f"{B}, d AS (SELECT b.symbol, b.ts, b.close, r.ts AS prev_ts, r.close AS prev_close FROM b ASOF JOIN b r ON b.symbol = r.symbol AND b.ts - INTERVAL 1 DAY > r.ts)"


def _cdf(x: str) -> str:
    """The normal distribution by Abramowitz and Stegun 26.2.17 (fixed values)."""
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    tail = f"exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


def _ppf(p: str) -> str:
    """Its inverse by 26.2.23 (fixed values) and one Newton step."""
    t = f"sqrt(-2 * ln(least({p}, 1 - ({p}))))"
    z = f"({t} - (2.515517 + {t} * (0.802853 + {t} * 0.010328)) / (1 + {t} * (1.432788 + {t} * (0.189269 + {t} * 0.001308))))"
    first = f"(CASE WHEN {p} < 0.5 THEN -{z} ELSE {z} END)"
    return f"({first} - ({_cdf(first)} - ({p})) / (exp(-{first} * {first} / 2) / sqrt(2 * pi())))"


@query(f"{V} SELECT symbol, ts, {_r('close')} AS close, prev_ts, {_r('prev_close')} AS prev_close FROM d")
def prev_day_lookup(spark, sf_dir):
    return labels.previous_day(bar_view(spark, sf_dir).select("symbol", "ts", "close"))


@query()
def daily_volatility(spark, sf_dir):
    return labels.daily_volatility(bar_view(spark, sf_dir))


@query(f"{B}, k AS (SELECT *, CASE WHEN count(close) OVER m = 20 THEN avg(close) OVER m END + 1.5 * CASE WHEN count(close) OVER s = 30 THEN stddev_samp(close) OVER s END AS level FROM b WINDOW m AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), s AS (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING)) SELECT symbol, ts, {_r('close')} AS close, {_r('level')} AS level FROM k WHERE close >= level")
def z_score_filter(spark, sf_dir):
    return labels.z_score_events(bar_view(spark, sf_dir), 20, 30, 1.5)


def _events(spark, sf_dir):
    """Every bar to the bar ten rows later, with a fixed target."""
    return _spans(spark, sf_dir).withColumn("trgt", F.lit(0.2))


OUT = f"{SPANS}, q AS (SELECT e.symbol, e.t0, e.t1, ln(y.close / x.close) AS r FROM e JOIN b x ON e.symbol = x.symbol AND e.i0 = x.i JOIN b y ON e.symbol = y.symbol AND e.i1 = y.i), s AS (SELECT *, CASE WHEN r > 2 * 0.2 THEN 1 WHEN r < -0.2 THEN -1 ELSE 0 END AS bin FROM q)"


@query(f"{OUT} SELECT symbol, t0, t1, {_r('exp(r) - 1')} AS ret, CAST(0.2 AS DOUBLE) AS trgt, bin FROM s")
def barrier_outcomes(spark, sf_dir):
    return labels.outcomes(_events(spark, sf_dir), bar_view(spark, sf_dir), 2.0, 1.0)


@query(f"{OUT} SELECT symbol, t0, t1, bin AS side, {_r('exp(r * bin) - 1')} AS ret, CAST(0.2 AS DOUBLE) AS trgt, CASE WHEN r * bin <= 0 THEN 0 WHEN r * bin > 2 * 0.2 THEN 1 ELSE 0 END AS bin FROM s")
def meta_labeling(spark, sf_dir):
    return labels.meta_labels(_events(spark, sf_dir), bar_view(spark, sf_dir), 2.0, 1.0)


@query()
def meta_labeling_job(spark, sf_dir):
    """Volatility target, barriers at two and one targets and seven calendar days for every bar from the third on, sides, and the meta labels of those sides."""
    bars_ = bar_view(spark, sf_dir)
    known = bars_.join(labels.daily_volatility(bars_, 60), ["symbol", "ts"], "left")
    events = labels.triple_barrier_days(known.select("symbol", "ts", "close", "trgt"), 7, 2.0, 1.0, least=0.01, skip=2)
    return labels.meta_labels(events, bars_, 2.0, 1.0)


@query(f"{OUT} SELECT bin, count(*) AS n, {_r('count(*) / sum(count(*)) OVER ()')} AS share FROM s GROUP BY bin")
def label_balance(spark, sf_dir):
    return labels.label_balance(labels.outcomes(_events(spark, sf_dir), bar_view(spark, sf_dir), 2.0, 1.0))


@query(f"{OUT}, n AS (SELECT bin, count(*) AS n FROM s GROUP BY bin), r AS (SELECT bin FROM n WHERE n <= 0.4 * (SELECT sum(n) FROM n) AND (SELECT count(*) FROM n) > 2 ORDER BY n, bin LIMIT 1) SELECT symbol, t0, t1, {_r('exp(r) - 1')} AS ret, CAST(0.2 AS DOUBLE) AS trgt, bin FROM s WHERE bin NOT IN (SELECT bin FROM r)")
def drop_labels(spark, sf_dir):
    return labels.drop_rare_labels(labels.outcomes(_events(spark, sf_dir), bar_view(spark, sf_dir), 2.0, 1.0), 0.4)


@query(f"{B}, r AS (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM b), a AS (SELECT symbol, ts, r / nullif(stddev_samp(r) OVER w, 0) AS adjusted, count(r) OVER w AS n FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)), k AS (SELECT * FROM a WHERE n = 20 AND adjusted IS NOT NULL), e AS (SELECT ts, quantile_cont(adjusted, 0.1) AS lo, quantile_cont(adjusted, 0.9) AS hi FROM k GROUP BY ts) SELECT symbol, k.ts, {_r('adjusted')} AS adjusted, CASE WHEN adjusted <= lo THEN -1 WHEN adjusted > hi THEN 1 ELSE 0 END AS label FROM k JOIN e ON k.ts = e.ts")
def tail_sets(spark, sf_dir):
    return labels.tail_sets(bar_view(spark, sf_dir).select("symbol", "ts", "close"))


@query(f"{SPANS} SELECT e.symbol, e.t0, b.ts FROM e JOIN b ON e.symbol = b.symbol AND b.ts BETWEEN e.t0 AND e.t1")
def indicator_pairs(spark, sf_dir):
    return labels.indicator_pairs(bar_view(spark, sf_dir), _spans(spark, sf_dir))


@query(f"{SPANS}, u AS (SELECT e.symbol, t0, t1, avg(1.0 / c) AS u FROM e JOIN c ON e.symbol = c.symbol AND c.i BETWEEN i0 AND i1 GROUP BY ALL) SELECT symbol, t0, t1, {_r('greatest(0, 1 - 0.5 / a * a + 0.5 / a * x)')} AS weight FROM (SELECT *, sum(u) OVER (PARTITION BY symbol ORDER BY t0, t1) AS x, sum(u) OVER (PARTITION BY symbol) AS a FROM u)")
def weights_by_time_decay(spark, sf_dir):
    return labels.weights_by_time(labels.average_uniqueness(bar_view(spark, sf_dir), _spans(spark, sf_dir)), 0.5)


@query(f"{SPANS}, n AS (SELECT symbol, t0, t1, ntile(4) OVER (PARTITION BY symbol ORDER BY t0, t1) AS own FROM e), g AS (SELECT symbol, own AS g, min(t0) AS a, max(t1) AS z FROM n GROUP BY ALL), s AS (SELECT * FROM (VALUES (0, 1, 2), (1, 1, 3), (2, 1, 4), (3, 2, 3), (4, 2, 4), (5, 3, 4)) AS t(split, x, y)) SELECT n.symbol, t0, t1, CAST(split AS INT) AS split, CASE WHEN own IN (x, y) THEN 'test' ELSE 'train' END AS role FROM n, s WHERE own IN (x, y) OR NOT EXISTS (FROM g WHERE g.symbol = n.symbol AND g IN (x, y) AND t0 <= z AND a <= t1)")
def combinatorial_purged(spark, sf_dir):
    return labels.combinatorial_folds(_spans(spark, sf_dir), 4, 2)


@query(f"{P}, i AS (SELECT date, avg(open) AS o, avg(close) AS c FROM panel GROUP BY date) SELECT ticker, CAST(p.date AS VARCHAR) AS date, {_r('close')} AS close, {_r('o')} AS bm_open, {_r('c')} AS bm_close FROM panel p JOIN i ON p.date = i.date")
def join_benchmark(spark, sf_dir):
    prices = panel(spark, sf_dir)
    index = prices.groupBy("date").agg(F.avg("open").alias("open"), F.avg("close").alias("close"))
    return portfolio.join_benchmark(prices.select("ticker", "date", "close"), index)


@query(f"{P} SELECT ticker, CAST(date AS VARCHAR) AS date, {_r('close')} AS close FROM panel WHERE ticker IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
def semi_members(spark, sf_dir):
    members = sql(spark, sf_dir, "SELECT CAST(n_nationkey AS INT) AS ticker FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'", "nation", "region")
    return portfolio.of_members(panel(spark, sf_dir).select("ticker", "date", "close"), members)


@query(f"{P}, t AS (SELECT sector, date, sum(amount) AS total FROM panel GROUP BY ALL), c AS (SELECT sector, date, (total / lag(total, 5) OVER (PARTITION BY sector ORDER BY date) - 1) * 100 AS x FROM t) SELECT CAST(date AS VARCHAR) AS date, " + ", ".join(f"{_r(f'max(CASE WHEN sector = {k} THEN x END)')} AS \"{k}\"" for k in range(5)) + " FROM c GROUP BY date")
def sector_heatmap(spark, sf_dir):
    return portfolio.sector_heatmap(cross.sector_index(panel(spark, sf_dir), "amount"), 5)


@query(f"{P} SELECT CAST(date AS VARCHAR) AS date, {_r('sum(volume)')} AS volume, {_r('sum(amount)')} AS amount, {_r('sum(cap)')} AS cap, count(*) AS n FROM panel GROUP BY date")
def portfolio_sum(spark, sf_dir):
    return portfolio.portfolio_sum(panel(spark, sf_dir), ["volume", "amount", "cap"])


@query(f"{P}, s AS ({STATEMENTS_SQL}) SELECT p.ticker, CAST(p.date AS VARCHAR) AS date, {_r('p.cap')} AS cap, {_r('s.revenue')} AS revenue, {_r('p.cap / nullif(s.revenue, 0)')} AS multiple FROM panel p ASOF LEFT JOIN s ON p.ticker = s.ticker AND p.date >= s.report_date")
def value_multiple(spark, sf_dir):
    return fundamentals.daily_multiple(statements(spark, sf_dir), panel(spark, sf_dir), "revenue")


@query(f"{P}, s AS (SELECT ticker, arg_max(report_date, report_date) AS report_date, arg_max(revenue, report_date) AS revenue, year(report_date) AS year FROM ({STATEMENTS_SQL}) GROUP BY ticker, year(report_date)), f AS (SELECT ticker, min(date) AS d, arg_min(close, date) AS c FROM panel GROUP BY ticker) SELECT s.ticker, CAST(s.year AS INT) AS year, CAST(s.report_date AS VARCHAR) AS report_date, {_r('s.revenue')} AS revenue, CAST(coalesce(p.date, f.d) AS VARCHAR) AS price_date, {_r('coalesce(p.close, f.c)')} AS close FROM s ASOF LEFT JOIN panel p ON s.ticker = p.ticker AND s.report_date >= p.date LEFT JOIN f ON s.ticker = f.ticker")
def stmt_yearly_with_price(spark, sf_dir):
    return fundamentals.yearly_with_price(statements(spark, sf_dir).select("ticker", "report_date", "revenue"), panel(spark, sf_dir))


MOM = f"{P}, m AS (SELECT ticker, date, close / lag(close, 20) OVER (PARTITION BY ticker ORDER BY date) - 1 AS m, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM panel), best AS (SELECT date, ticker, m FROM m WHERE m IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY m DESC, ticker) = 1)"


@query(f"{MOM} SELECT CAST(date AS VARCHAR) AS date, ticker, {_r('m')} AS momentum FROM best")
def best_asset(spark, sf_dir):
    return portfolio.best_asset(panel(spark, sf_dir), 20)


@query(f"{MOM}, h AS (SELECT date, lag(CASE WHEN m > 3.0 * 20 / 252 THEN ticker END) OVER (ORDER BY date) AS held FROM best) SELECT CAST(h.date AS VARCHAR) AS date, held, {_r('coalesce(ret, 0)')} AS ret FROM h LEFT JOIN m ON h.date = m.date AND h.held = m.ticker")
def dual_momentum(spark, sf_dir):
    return portfolio.dual_momentum(panel(spark, sf_dir), 20, 3.0)


@query(f"{MOM}, k AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM panel)), a AS (SELECT m.*, k FROM m JOIN k ON m.date = k.date), s AS (SELECT (k - 1) // 21 AS period, ticker, row_number() OVER (PARTITION BY k ORDER BY m DESC, ticker) AS h, row_number() OVER (PARTITION BY k ORDER BY m, ticker) AS l FROM a WHERE m IS NOT NULL AND (k - 1) % 21 = 0) SELECT CAST(date AS VARCHAR) AS date, {_r('sum(CASE WHEN h <= 3 THEN ret ELSE -ret END) / 3')} AS ret, count(*) AS n FROM a JOIN s ON a.ticker = s.ticker AND (k + 19) // 21 - 1 = period WHERE (h <= 3 OR l <= 3) AND ret IS NOT NULL GROUP BY date")
def xs_momentum(spark, sf_dir):
    return portfolio.cross_momentum(panel(spark, sf_dir), 20, 21, 3)


@query(f"{P}, x AS (SELECT ticker, date, lag(close) OVER w / lag(close, 51) OVER w - 1 AS change FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)) SELECT ticker, CAST(date AS VARCHAR) AS date, {_r('change')} AS change, CASE WHEN change > 0.05 THEN 1 WHEN change < -0.05 THEN -1 WHEN change IS NOT NULL THEN 0 END AS regime FROM x")
def regime_lagged(spark, sf_dir):
    return portfolio.lagged_regime(panel(spark, sf_dir))


@query(f"{P}, x AS (SELECT ticker, date, close / lag(close, 5) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ratio FROM panel), g AS (SELECT ticker, date FROM (SELECT DISTINCT ticker FROM panel), (SELECT DISTINCT date FROM panel)) SELECT ticker, CAST(date AS VARCHAR) AS date, {_r('ratio')} AS ratio FROM (SELECT g.ticker, g.date, first_value(ratio IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ratio FROM g LEFT JOIN x ON g.ticker = x.ticker AND g.date = x.date)")
def price_ratio_on_calendar(spark, sf_dir):
    prices = panel(spark, sf_dir)
    return portfolio.price_ratio(prices, prices, 5)


@query(f"{RET}, p AS (SELECT ticker, date, sign(round(coalesce(ret, 0) * 2, 0)) AS position FROM r), x AS (SELECT *, lag(position) OVER w AS l, lead(date) OVER w AS n FROM p WINDOW w AS (PARTITION BY ticker ORDER BY date)) SELECT ticker, CAST(date AS VARCHAR) AS date FROM x WHERE (position = 0 AND l <> 0) OR position * l < 0 OR n IS NULL")
def flatten_flips(spark, sf_dir):
    known = returns(spark, sf_dir).select("ticker", "date", F.signum(F.round(F.coalesce("ret", F.lit(0.0)) * 2, 0)).alias("position"))
    return portfolio.flips(known)


@query(f"{P}, o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), a AS (SELECT DISTINCT date FROM panel) SELECT CAST(date AS VARCHAR) AS date, 'left' AS side FROM (FROM a EXCEPT FROM o) UNION ALL SELECT CAST(date AS VARCHAR), 'right' FROM (FROM o EXCEPT FROM a)")
def index_difference(spark, sf_dir):
    return portfolio.index_difference(panel(spark, sf_dir), sql(spark, sf_dir, "SELECT CAST(o_orderdate AS DATE) AS date FROM orders", "orders"), ["date"])


CURVE = f"{RET}, v AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY ticker ORDER BY date)) AS v FROM r WHERE ret IS NOT NULL), w AS (SELECT *, v / greatest(1, max(v) OVER (PARTITION BY ticker ORDER BY date)) - 1 AS d FROM v)"


@query(f"{CURVE}, a AS (SELECT ticker, arg_max(v, date) - 1 AS t, power(arg_max(v, date), 252.0 / count(*)) - 1 AS y, stddev_samp(ret) AS sd, avg(ret) AS mu, stddev_samp(CASE WHEN ret < 0 THEN ret END) AS dn, min(d) AS dd, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS win, sum(CASE WHEN ret > 0 THEN ret END) / sum(CASE WHEN ret < 0 THEN -ret END) AS pf FROM w GROUP BY ticker) SELECT ticker, {_r('t')} AS total_return, {_r('y')} AS annual_return, {_r('sd * sqrt(252.0)')} AS volatility, {_r('mu / sd * sqrt(252.0)')} AS sharpe, {_r('mu / dn * sqrt(252.0)')} AS sortino, {_r('dd')} AS max_drawdown, {_r('y / -dd')} AS calmar, {_r('win')} AS win_rate, {_r('pf')} AS profit_factor FROM a")
def returns_metrics(spark, sf_dir):
    return portfolio.returns_metrics(returns(spark, sf_dir))


@query(f"{CURVE}, h AS (SELECT ticker, date, v, max(v) OVER (PARTITION BY ticker ORDER BY date) AS hwm FROM (SELECT ticker, date, exp(sum(ln(1 + coalesce(ret, 0))) OVER (PARTITION BY ticker ORDER BY date)) AS v FROM r)), g AS (SELECT ticker, hwm, min(v) AS lo, min(date) AS start FROM h GROUP BY ticker, hwm HAVING count(*) > 1) SELECT ticker, CAST(start AS VARCHAR) AS start, {_r('hwm')} AS hwm, {_r('1 - lo / hwm')} AS drawdown, {_r('date_diff(' + chr(39) + 'day' + chr(39) + ', start, lead(start) OVER (PARTITION BY ticker ORDER BY start)) / 365.25')} AS years FROM g")
def hwm_drawdown_tuw(spark, sf_dir):
    return st.drawdowns(returns(spark, sf_dir))


@query(f"{RET}, c AS (SELECT *, sum(ret) OVER (PARTITION BY ticker ORDER BY date) AS c FROM r WHERE ret IS NOT NULL), d AS (SELECT *, max(c) OVER (PARTITION BY ticker ORDER BY date) - c AS d FROM c), n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ret) AS i, row_number() OVER (PARTITION BY ticker ORDER BY d) AS j, count(*) OVER (PARTITION BY ticker) AS n FROM d), e AS (SELECT ticker, max(CASE WHEN i = ceil(0.05 * (n - 1)) + 1 THEN ret END) AS q, max(CASE WHEN j = ceil(0.95 * (n - 1)) + 1 THEN d END) AS u FROM n GROUP BY ticker) SELECT e.ticker, {_r('max(q)')} AS var, {_r('avg(CASE WHEN ret <= q THEN ret END)')} AS es, {_r('avg(CASE WHEN d >= u THEN d END)')} AS cdar FROM n JOIN e ON n.ticker = e.ticker GROUP BY e.ticker")
def var_es_cdar(spark, sf_dir):
    return portfolio.tail_risk(returns(spark, sf_dir))


@query(f"{RET}, a AS (SELECT ticker, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS p, avg(CASE WHEN ret > 0 THEN ret END) / avg(CASE WHEN ret < 0 THEN -ret END) AS b FROM r WHERE ret IS NOT NULL GROUP BY ticker) SELECT ticker, {_r('p')} AS p, {_r('b')} AS b, {_r('p - (1 - p) / b')} AS kelly FROM a")
def kelly(spark, sf_dir):
    return portfolio.kelly(returns(spark, sf_dir))


@query(f"{RET}, a AS (SELECT ticker, avg(CASE WHEN ret > 0 THEN ret END) AS pt, avg(CASE WHEN ret <= 0 THEN ret END) AS sl, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END) AS p, count(*) AS k FROM r WHERE ret IS NOT NULL GROUP BY ticker), b AS (SELECT *, (252 + 4) * (pt - sl) * (pt - sl) AS qa, (504 * sl - 4 * (pt - sl)) * (pt - sl) AS qb, 252 * sl * sl AS qc FROM a), i AS (SELECT *, (-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) AS x FROM b), z AS (SELECT *, (x - p) / sqrt(p * (1 - p) / k) AS z FROM i) SELECT ticker, {_r('p')} AS p, {_r('x')} AS implied, {_r(_cdf('z'))} AS failure FROM z")
def strategy_risk(spark, sf_dir):
    return portfolio.strategy_risk(returns(spark, sf_dir))


@query()
def holding_period(spark, sf_dir):
    return portfolio.holding_period(returns(spark, sf_dir).select("ticker", "date", F.signum(F.round(F.coalesce("ret", F.lit(0.0)) * 2, 0)).alias("position")))


@query(f"{RET} SELECT ticker, {_r('avg(ret) * 252')} AS expected FROM r GROUP BY ticker")
def exp_returns(spark, sf_dir):
    return portfolio.expected_returns(returns(spark, sf_dir))


@query(f"{RET}, x AS (SELECT CASE WHEN lead(close) OVER w > close THEN 1 WHEN lead(close) OVER w IS NOT NULL THEN 0 END AS y, CASE WHEN ret < 0 THEN 1 ELSE 0 END AS p FROM r WINDOW w AS (PARTITION BY ticker ORDER BY date)), c AS (SELECT CAST(sum(CASE WHEN y = 1 AND p = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN y = 0 AND p = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp, CAST(sum(CASE WHEN y = 1 AND p = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn, CAST(sum(CASE WHEN y = 0 AND p = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn FROM x) SELECT tp, fp, fn, tn, {_r('tp / (tp + fp)')} AS precision, {_r('tp / (tp + fn)')} AS recall, {_r('2 * tp / (2 * tp + fp + fn)')} AS f1, {_r('tn / (tn + fp)')} AS specificity, {_r('(tp + tn) / (tp + fp + fn + tn)')} AS accuracy FROM c")
def classification_report(spark, sf_dir):
    ahead = F.lead("close").over(Window.partitionBy("ticker").orderBy("date"))
    known = returns(spark, sf_dir).select((ahead > F.col("close")).cast("int").alias("label"), F.when(F.col("ret") < 0, 1).otherwise(0).alias("prediction"))
    return portfolio.classification_report(known)


@query(f"{P}, x AS (SELECT ticker, date, CAST(rank() OVER (PARTITION BY ticker ORDER BY close) AS DOUBLE) / (count(*) OVER (PARTITION BY ticker) + 1) AS p FROM panel) SELECT ticker, CAST(date AS VARCHAR) AS date, {_r('p')} AS p, round(abs((p - 0.5) / sqrt(p * (1 - p))) * 100) AS units FROM x")
def prob_bet_rule(spark, sf_dir):
    w = Window.partitionBy("ticker")
    p = F.rank().over(w.orderBy("close")) / (F.count("*").over(w) + 1)
    return panel(spark, sf_dir).select("ticker", "date", p.alias("p")).withColumn("units", portfolio.bet_by_probability(F.col("p"), 100))


@query(f"{RET}, k AS (SELECT ticker, close AS x, volume AS y FROM panel), g AS (SELECT ticker, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM k GROUP BY ticker), c AS (SELECT k.ticker, least(floor((x - x0) / (x1 - x0) * 10), 9) AS a, least(floor((y - y0) / (y1 - y0) * 10), 9) AS b, count(*) AS n FROM k JOIN g ON k.ticker = g.ticker GROUP BY ALL), p AS (SELECT ticker, a, b, n / sum(n) OVER (PARTITION BY ticker) AS p FROM c), ha AS (SELECT ticker, -sum(q * ln(q)) AS h FROM (SELECT ticker, a, sum(p) AS q FROM p GROUP BY ALL) GROUP BY ticker), hb AS (SELECT ticker, -sum(q * ln(q)) AS h FROM (SELECT ticker, b, sum(p) AS q FROM p GROUP BY ALL) GROUP BY ticker), hc AS (SELECT ticker, -sum(p * ln(p)) AS h FROM p GROUP BY ticker) SELECT ha.ticker, {_r('ha.h')} AS hx, {_r('hb.h')} AS hy, {_r('ha.h + hb.h - hc.h')} AS mi, {_r('2 * hc.h - ha.h - hb.h')} AS vi FROM ha JOIN hb ON ha.ticker = hb.ticker JOIN hc ON ha.ticker = hc.ticker")
def dist_mutual_info(spark, sf_dir):
    known = panel(spark, sf_dir).select("ticker", F.col("close").alias("x"), F.col("volume").alias("y"))
    return portfolio.mutual_information(known, "x", "y")


@query(f"{RET}, j AS (SELECT x.ticker AS a, y.ticker AS b, count(*) AS n, corr(x.ret, y.ret) AS c FROM r x JOIN r y ON x.date = y.date AND x.ticker < y.ticker WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY ALL) SELECT a, b, {_r('sqrt(2 * n * (1 - c))')} AS dist FROM j")
def dist_corr(spark, sf_dir):
    pairs = cross.pair_statistics(returns(spark, sf_dir))
    return pairs.select("a", "b", F.sqrt(2 * F.col("n") * (1 - F.col("corr"))).alias("dist"))


@query(f"{T} SELECT symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, string_agg(CASE side WHEN 1 THEN 'a' WHEN -1 THEN 'b' ELSE 'c' END, '' ORDER BY ts, seq) AS message FROM sided GROUP BY symbol, CAST(ts AS DATE)")
def encode_tick_rule(spark, sf_dir):
    return portfolio.tick_letters(bars.tick_rule(ticks(spark, sf_dir)))


@query(f"{RET}, e AS (SELECT ticker, quantile_cont(ret, [0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95]) AS e FROM r GROUP BY ticker) SELECT r.ticker, CAST(date AS VARCHAR) AS date, {_r('ret')} AS ret, CAST(CASE WHEN ret IS NOT NULL THEN list_position(list_transform(e, lambda x: abs(ret - x)), list_min(list_transform(e, lambda x: abs(ret - x)))) - 1 END AS INT) AS letter FROM r JOIN e ON r.ticker = e.ticker")
def quantile_mapping(spark, sf_dir):
    return portfolio.quantile_letters(returns(spark, sf_dir).select("ticker", "date", "ret"), "ret")


@query(f"{T} SELECT symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {_r('sum(CASE WHEN side = 1 THEN volume ELSE 0 END)')} AS bought, {_r('sum(CASE WHEN side = -1 THEN volume ELSE 0 END)')} AS sold, {_r('sum(CASE WHEN side = 0 THEN volume ELSE 0 END)')} AS unsided FROM sided GROUP BY symbol, CAST(ts AS DATE)")
def side_volume(spark, sf_dir):
    return bars.side_volume(ticks(spark, sf_dir))


TICK_BARS = f"{T}, n AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1) // 20 AS bar_id, coalesce(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq), 0) AS dp, coalesce(ln(price) - ln(lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq)), 0) AS dl FROM sided)"


@query(f"{TICK_BARS}, b AS (SELECT symbol, bar_id, {BAR} FROM n GROUP BY symbol, bar_id HAVING count(*) = 20), c AS (SELECT symbol, date_trunc('week', date_time) AS w, count(*) AS n FROM b GROUP BY ALL) SELECT symbol, count(*) AS periods, {_r('avg(n)')} AS mean, {_r('var_samp(n)')} AS variance, {_r('var_samp(n) / avg(n)')} AS dispersion FROM c GROUP BY symbol")
def bar_count_stability(spark, sf_dir):
    return bars.count_stability(bars.tick_bars(ticks(spark, sf_dir), 20))


#: Edges by which volumes and log changes become letters.
VOLUME_EDGES = [5.0, 15.0, 25.0, 35.0, 45.0, 55.0, 65.0, 75.0, 85.0, 95.0]
RETURN_EDGES = [-4.0, -3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0, 4.0]
MESSAGES = ("tick", "volume", "return")
ENTROPIES = ("shannon", "plug_in", "lempel_ziv", "konto")


def _nearest_sql(x: str, edges: list[float]) -> str:
    far = f"list_transform({edges}, lambda e: abs({x} - e))"
    return f"chr(CAST(96 + coalesce(list_position({far}, list_min({far})), 1) AS INT))"


def _entropies_sql(m: str, n: int) -> str:
    """The four entropies of the message <m>_m of n letters."""
    c, k = f"{m}_m", n // 2
    seen = "contains(a.lib, ',' || a.word || b || ',')"
    parse = f"list_reduce(string_split({c}, ''), lambda a, b: CASE WHEN {seen} THEN {{'lib': a.lib, 'word': a.word || b}} ELSE {{'lib': a.lib || a.word || b || ',', 'word': ''}} END, {{'lib': ',', 'word': ''}}).lib"
    # At letter i the matches of the longest length, i at most, and of all shorter ones begin before it.
    match = f"len(list_filter(range(1, least(i, {n} - i) + 1), lambda l: contains(substr({c}, 1, i + l - 1), substr({c}, i + 1, l))))"
    found = {
        "shannon": f"list_aggregate(string_split({c}, ''), 'entropy')", "plug_in": f"list_aggregate(string_split(substr({c}, 1, {n - 1}), ''), 'entropy')",
        "lempel_ziv": f"(len({parse}) - len(replace({parse}, ',', '')) - 1) / {n}", "konto": f"list_sum(list_transform(range(1, {k + 1}), lambda i: log2(i + 1) / ({match} + 1))) / {k}",
    }
    return ", ".join(f"{_r(found[e])} AS {m}_{e}" for e in ENTROPIES)


MESSAGES_SQL = f"string_agg(CASE side WHEN 1 THEN 'a' WHEN -1 THEN 'b' ELSE 'c' END, '' ORDER BY ts, seq) AS tick_m, string_agg({_nearest_sql('volume', VOLUME_EDGES)}, '' ORDER BY ts, seq) AS volume_m, string_agg({_nearest_sql('dl', RETURN_EDGES)}, '' ORDER BY ts, seq) AS return_m"


@query(f"{TICK_BARS}, f AS (SELECT symbol, bar_id, {_r('sum(price * volume) / sum(volume)')} AS vwap, {_r('avg(volume)')} AS avg_tick_size, {_r('sum(side)')} AS net_side, {_r('sum(side * volume * dp) / nullif(sum(side * side * volume * volume), 0)', 6)} AS kyle, {_r('sum(price * volume * abs(dl)) / nullif(sum(price * price * volume * volume), 0)', 6)} AS amihud, {_r('sum(sqrt(price * volume) * side * abs(dl)) / nullif(sum(price * volume * side * side), 0)', 6)} AS hasbrouck, max(ts) AS date_time, {MESSAGES_SQL} FROM n GROUP BY symbol, bar_id HAVING count(*) = 20) SELECT * EXCLUDE (tick_m, volume_m, return_m), {', '.join(_entropies_sql(m, 20) for m in MESSAGES)} FROM f", kyle=6, amihud=6, hasbrouck=6)
def bar_micro_features(spark, sf_dir):
    numbered = bars.with_changes(ticks(spark, sf_dir)).withColumn("bar_id", F.floor(F.col("i") / 20))
    made = bars.ohlcv(numbered, more=bars.flow_features(numbered, VOLUME_EDGES, RETURN_EDGES)).where("cum_ticks = 20")
    entropies = [f"{m}_{e}" for m in MESSAGES for e in ENTROPIES]
    return bars.with_entropies(made).select("symbol", "bar_id", "vwap", "avg_tick_size", "net_side", "kyle", "amihud", "hasbrouck", "date_time", *entropies)


@query(f"{TICK_BARS}, b AS (SELECT symbol, bar_id, sum(volume) AS v, sum(CASE WHEN side = 1 THEN volume ELSE 0 END) AS u FROM n GROUP BY symbol, bar_id HAVING count(*) = 20) SELECT symbol, bar_id, {_r('CASE WHEN count(*) OVER w = 10 THEN sum(abs(2 * u - v)) OVER w / sum(v) OVER w END')} AS vpin FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_id ROWS 9 PRECEDING)")
def vpin_volume_bars(spark, sf_dir):
    return bars.vpin_bars(bars.tick_bars(ticks(spark, sf_dir), 20), 10).select("symbol", "bar_id", "vpin")


@query(f"{T}, g AS (SELECT symbol, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS bar_id, {BAR} FROM sided GROUP BY ALL), a AS (SELECT symbol, unnest(range(min(bar_id), max(bar_id) + 3600, 3600)) AS bar_id FROM g GROUP BY symbol) SELECT a.symbol, a.bar_id, open, high, low, close, volume, cum_buy_volume, cum_ticks, cum_dollar_value FROM a LEFT JOIN g ON a.symbol = g.symbol AND a.bar_id = g.bar_id")
def resample_ohlc(spark, sf_dir):
    return bars.resample_ohlc(ticks(spark, sf_dir), 3600)


@query(f"{P}, s AS ({STATEMENTS_SQL}), k AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM panel), b AS (SELECT s.ticker, s.report_date, k.date AS db, k.rn AS rb, k.n FROM s ASOF LEFT JOIN k ON s.ticker = k.ticker AND s.report_date >= k.date), f AS (SELECT s.ticker, s.report_date, k.date AS da, k.rn AS ra, k.n FROM s ASOF LEFT JOIN k ON s.ticker = k.ticker AND s.report_date <= k.date), e AS (SELECT b.ticker, b.report_date, CASE WHEN db IS NULL OR da - b.report_date < b.report_date - db THEN da ELSE db END AS date, CASE WHEN db IS NULL OR da - b.report_date < b.report_date - db THEN ra ELSE rb END AS rn, coalesce(b.n, f.n) AS n FROM b JOIN f ON b.ticker = f.ticker AND b.report_date = f.report_date) SELECT e.ticker, CAST(e.report_date AS VARCHAR) AS report_date, CAST(e.date AS VARCHAR) AS date, {_r('y.close / x.close - 1')} AS change FROM e JOIN k x ON e.ticker = x.ticker AND x.rn = greatest(e.rn - 5, 1) JOIN k y ON e.ticker = y.ticker AND y.rn = least(e.rn + 10, e.n)")
def event_window_return(spark, sf_dir):
    return joins.event_window_return(panel(spark, sf_dir), statements(spark, sf_dir).select("ticker", "report_date"), 5, 10)


SR = f"{RET}, c AS (SELECT ticker, ret, avg(ret) OVER (PARTITION BY ticker) AS mu FROM r WHERE ret IS NOT NULL), m AS (SELECT ticker, count(*) AS n, avg(ret) / stddev_samp(ret) AS sr, avg(power(ret - mu, 3)) / power(avg(power(ret - mu, 2)), 1.5) AS sk, avg(power(ret - mu, 4)) / power(avg(power(ret - mu, 2)), 2) AS ku FROM c GROUP BY ticker), i AS (SELECT *, 1 - sk * sr + (ku - 1) / 4 * sr * sr AS q FROM m)"


@query(f"{SR} SELECT ticker, n, {_r('sk', 3)} AS skew, {_r('ku', 3)} AS kurt, {_r('sr')} AS sharpe, {_r('sr * sqrt(252.0)')} AS annual, {_r('sqrt((1 + sr * sr / 2 - sk * sr + (ku - 3) / 4 * sr * sr) / (n - 1))')} AS sharpe_std, {_r(_cdf('(sr * sqrt(n - 1) / sqrt(q))'))} AS psr, {_r('1 + q * power(' + _ppf('0.95') + ' / sr, 2)', 2)} AS min_track_record FROM i", skew=3, kurt=3, min_track_record=2)
def sharpe_family(spark, sf_dir):
    return st.sharpe_statistics(returns(spark, sf_dir))


@query(f"{SR}, d AS (SELECT stddev_pop(sr) AS dev, CAST(count(*) AS DOUBLE) AS n FROM m), t AS (SELECT n, dev * ((1 - 0.5772156649) * {_ppf('1 - 1 / n')} + 0.5772156649 * {_ppf('1 - 1 / (n * 2.718281828459045)')}) AS b FROM d) SELECT ticker, t.n AS trials, {_r('sr')} AS sharpe, {_r('b')} AS benchmark, {_r(_cdf('((sr - b) * sqrt(i.n - 1) / sqrt(q))'))} AS dsr FROM i, t")
def deflated_sharpe(spark, sf_dir):
    return st.deflated_sharpe(st.sharpe_statistics(returns(spark, sf_dir)))


@query(f"{RET}, x AS (SELECT ticker, date, ret, least(greatest(CAST(rank() OVER (PARTITION BY ticker ORDER BY close) AS DOUBLE) / count(*) OVER (PARTITION BY ticker), 1e-9), 1 - 1e-9) AS c, CAST(rank() OVER (PARTITION BY ticker ORDER BY close) AS DOUBLE) / count(*) OVER (PARTITION BY ticker) AS p FROM r) SELECT ticker, CAST(date AS VARCHAR) AS date, {_r('p')} AS p, {_r('(2 * ' + _cdf('((c - 0.5) / sqrt(c * (1 - c)))') + ' - 1) * sign(ret)')} AS size FROM x")
def bet_size_probability(spark, sf_dir):
    p = F.rank().over(Window.partitionBy("ticker").orderBy("close")) / F.count("*").over(Window.partitionBy("ticker"))
    known = returns(spark, sf_dir).withColumn("p", p)
    return known.select("ticker", "date", "p", st.bet_gaussian(F.col("p"), 2, F.signum("ret")).alias("size"))


@query(f"{SPANS}, s AS (SELECT symbol, t0, t1, CASE WHEN i0 % 3 = 0 THEN -1 ELSE 1 END AS side FROM e), u AS (SELECT symbol, t0 AS ts, CASE WHEN side > 0 THEN 1 ELSE 0 END AS l, CASE WHEN side < 0 THEN 1 ELSE 0 END AS k FROM s UNION ALL SELECT symbol, t1, CASE WHEN side > 0 THEN -1 ELSE 0 END, CASE WHEN side < 0 THEN -1 ELSE 0 END FROM s), g AS (SELECT symbol, ts, sum(l) AS l, sum(k) AS k FROM u GROUP BY ALL), a AS (SELECT symbol, ts, sum(l) OVER (PARTITION BY symbol ORDER BY ts) AS longs, sum(k) OVER (PARTITION BY symbol ORDER BY ts) AS shorts FROM g) SELECT symbol, ts, CAST(longs AS BIGINT) AS longs, CAST(shorts AS BIGINT) AS shorts, {_r('coalesce(longs / nullif(max(longs) OVER (PARTITION BY symbol), 0), 0) - coalesce(shorts / nullif(max(shorts) OVER (PARTITION BY symbol), 0), 0)')} AS size FROM a")
def bet_size_budget(spark, sf_dir):
    i = F.row_number().over(Window.partitionBy("symbol").orderBy("t0"))
    return st.concurrent_sides(_spans(spark, sf_dir).withColumn("side", F.when(i % 3 == 0, -1).otherwise(1)))


def _dollar_sql() -> str:
    from .operator_queries import SQL, THRESHOLD

    return SQL["bars_volume"].replace("s := volume", "s := volume * price").replace(str(THRESHOLD), "50000.0")


@query(_dollar_sql())
def bars_dollar(spark, sf_dir):
    return bars.recurrent_bars(ticks(spark, sf_dir), "threshold", "dollar", 50_000.0)
