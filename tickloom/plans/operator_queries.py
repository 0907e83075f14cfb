"""Queries of the joins, panel, bar, label and weight operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rolling import NUDGE
from ..operators import bars, joins, labels, panel as cross
from ..sources.views import PANEL_SQL, TICKS_SQL, panel, sql, ticks

STATEMENTS_SQL = """SELECT c_nationkey AS ticker, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS report_date, sum(o_totalprice) AS revenue,
  sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS cost, count(*) AS n_orders
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, CAST(date_trunc('quarter', o_orderdate) AS DATE)"""
P = f"WITH panel AS ({PANEL_SQL})"
RET = f"{P}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM panel)"
T = f"WITH ticks AS ({TICKS_SQL}), stepped AS (SELECT *, sign(price - lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq)) AS d FROM ticks), sided AS (SELECT *, CAST(coalesce(last_value(CASE WHEN d <> 0 THEN d END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq), 0) AS DOUBLE) AS side FROM stepped)"
BAR = "max(ts) AS date_time, arg_min(price, row(ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, row(ts, seq)) AS close, round(sum(volume), 4) AS volume, round(sum(CASE WHEN side = 1 THEN volume ELSE 0 END), 4) AS cum_buy_volume, count(*) AS cum_ticks, round(sum(price * volume), 4) AS cum_dollar_value"
THRESHOLD = 1000.0

QUERIES: dict = {}
SQL: dict = {}


def query(check: str | None = None, **rounded: int):
    """Register a query by its function's name; ``rounded``: digits of float columns."""

    def held(make):
        def run(spark, sf_dir: str):
            df = make(spark, sf_dir)
            for c, kind in df.dtypes:
                if kind == "date":
                    df = df.withColumn(c, F.col(c).cast("string"))
                elif kind == "double":
                    k = float(10 ** rounded.get(c, rounded.get("digits", 4)))
                    df = df.withColumn(c, F.round(F.col(c) * k + NUDGE, 0) / k + 0.0)
            return df

        QUERIES[make.__name__] = run
        if check:
            SQL[make.__name__] = check
        return make

    return held


def _r(x: str, digits: int = 4) -> str:
    k = f"CAST(1e{digits} AS DOUBLE)"
    return f"round(({x}) * {k} + {NUDGE}, 0) / {k} + 0.0"


def returns(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("ticker").orderBy("date")
    return panel(spark, sf_dir).withColumn("ret", F.try_divide("close", F.lag("close").over(w)) - 1)


def bar_view(spark, sf_dir):
    return panel(spark, sf_dir).select(F.col("ticker").alias("symbol"), F.col("date").cast("timestamp_ntz").alias("ts"), "close", "high", "low")


def statements(spark, sf_dir):
    return sql(spark, sf_dir, STATEMENTS_SQL, "orders", "customer")


@query(f"{P} SELECT sector, CAST(date AS VARCHAR) AS date, {_r('total')} AS total, {_r('total / nullif(lag(total, 5) OVER (PARTITION BY sector ORDER BY date), 0) - 1')} AS change FROM (SELECT sector, date, sum(amount) AS total FROM panel GROUP BY ALL)")
def sector_index(spark, sf_dir):
    return cross.sector_index(panel(spark, sf_dir), "amount", 5)


@query(f"{P}, s AS ({STATEMENTS_SQL}) SELECT p.ticker, CAST(p.date AS VARCHAR) AS date, {_r('p.close')} AS close, CAST(s.report_date AS VARCHAR) AS report_date, {_r('s.revenue')} AS revenue FROM panel p ASOF LEFT JOIN s ON p.ticker = s.ticker AND p.date >= s.report_date")
def asof_backward(spark, sf_dir):
    right = statements(spark, sf_dir).select("ticker", "report_date", "revenue")
    return joins.asof(panel(spark, sf_dir).select("ticker", "date", "close"), right, "ticker", "date", "report_date")


@query(f"{P}, s AS ({STATEMENTS_SQL}), b AS (SELECT p.ticker, p.date, s.report_date AS rb, s.revenue AS vb FROM panel p ASOF LEFT JOIN s ON p.ticker = s.ticker AND p.date >= s.report_date), f AS (SELECT p.ticker, p.date, s.report_date AS ra, s.revenue AS va FROM panel p ASOF LEFT JOIN s ON p.ticker = s.ticker AND p.date <= s.report_date) SELECT b.ticker, CAST(b.date AS VARCHAR) AS date, CAST(CASE WHEN rb IS NULL OR ra - b.date < b.date - rb THEN ra ELSE rb END AS VARCHAR) AS report_date, {_r('CASE WHEN rb IS NULL OR ra - b.date < b.date - rb THEN va ELSE vb END')} AS revenue FROM b JOIN f USING (ticker, date)")
def asof_nearest(spark, sf_dir):
    right = statements(spark, sf_dir).select("ticker", "report_date", "revenue")
    return joins.asof(panel(spark, sf_dir).select("ticker", "date"), right, "ticker", "date", "report_date", "nearest")


@query(f"{P}, d AS (SELECT CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM panel), g AS (SELECT ticker, date FROM (SELECT DISTINCT ticker FROM panel), d WHERE isodow(date) < 6), j AS (SELECT g.ticker, g.date, close, volume FROM g LEFT JOIN panel p ON g.ticker = p.ticker AND g.date = p.date) SELECT ticker, CAST(date AS VARCHAR) AS date, " + ", ".join(f"{_r(f'coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date), first_value({c} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS {c}" for c in ("close", "volume")) + " FROM j")
def align_calendar(spark, sf_dir):
    return joins.align_calendar(panel(spark, sf_dir), ["close", "volume"])


@query(f"{P} SELECT ticker, CAST(date AS VARCHAR) AS date, {_r('close')} AS close, {_r('(close - avg(close) OVER (PARTITION BY date)) / nullif(stddev_samp(close) OVER (PARTITION BY date), 0)')} AS close_z FROM panel")
def standardize(spark, sf_dir):
    return cross.standardize(panel(spark, sf_dir).select("ticker", "date", "close"), "close")


@query(f"{P} SELECT ticker, CAST(date AS VARCHAR) AS date, sector, {_r('close')} AS close, {_r('close - avg(close) OVER (PARTITION BY date, sector)')} AS close_neutral FROM panel")
def neutral_dummy(spark, sf_dir):
    return cross.neutral_dummy(panel(spark, sf_dir).select("ticker", "date", "sector", "close"), "close")


@query(f"{P} SELECT ticker, CAST(date AS VARCHAR) AS date, sector, {_r('close')} AS close, {_r('close / nullif(avg(close) OVER (PARTITION BY date, sector), 0)')} AS close_ratio FROM panel")
def neu_industry_ratio(spark, sf_dir):
    return cross.industry_ratio(panel(spark, sf_dir).select("ticker", "date", "sector", "close"), "close")


@query(f"{P}, q AS (SELECT date, quantile_cont(close, 0.025) AS lo, quantile_cont(close, 0.975) AS hi FROM panel GROUP BY date) SELECT ticker, CAST(p.date AS VARCHAR) AS date, {_r('greatest(least(close, hi), lo)')} AS close FROM panel p JOIN q ON p.date = q.date")
def winsor_quantile(spark, sf_dir):
    return cross.winsor_quantile(panel(spark, sf_dir).select("ticker", "date", "close"), "close")


@query(f"{P}, m AS (SELECT *, median(close) OVER (PARTITION BY date) AS m FROM panel), d AS (SELECT date, median(abs(close - m)) AS d FROM m GROUP BY date) SELECT ticker, CAST(m.date AS VARCHAR) AS date, {_r('greatest(least(close, m + 3.0 * 1.483 * d), m - 3.0 * 1.483 * d)')} AS close FROM m JOIN d ON m.date = d.date")
def winsor_mad(spark, sf_dir):
    return cross.winsor_mad(panel(spark, sf_dir).select("ticker", "date", "close"), "close")


@query(f"{P}, e AS (SELECT date, quantile_cont(close, [0.2, 0.4, 0.6, 0.8]) AS e, count(*) AS n FROM (SELECT DISTINCT date, close FROM panel) GROUP BY date) SELECT ticker, CAST(p.date AS VARCHAR) AS date, {_r('close')} AS close, CASE WHEN n >= 5 THEN 5 - (SELECT 0) - CAST((close > e[1]) AS INT) - CAST((close > e[2]) AS INT) - CAST((close > e[3]) AS INT) - CAST((close > e[4]) AS INT) END AS box FROM panel p JOIN e ON p.date = e.date")
def bin_quantile(spark, sf_dir):
    return cross.bin_quantile(panel(spark, sf_dir).select("ticker", "date", "close"), "close", 5)


@query(f"{P} SELECT ticker, CAST(date AS VARCHAR) AS date, {_r('close')} AS close FROM panel WHERE ticker IN (SELECT ticker FROM panel GROUP BY ticker HAVING bool_and(close > 900))")
def screen_all(spark, sf_dir):
    return cross.screen_all(panel(spark, sf_dir).select("ticker", "date", "close"), F.col("close") > 900)


@query(f"{P} SELECT ticker, {_r('arg_max(close, date) / arg_min(close, date) * 100')} AS gain FROM panel GROUP BY ticker HAVING arg_max(close, date) / arg_min(close, date) * 100 > 50")
def screen_gain(spark, sf_dir):
    return cross.screen_gain(panel(spark, sf_dir), 50)


@query(f"{P}, m AS (SELECT ticker, avg(close) AS a, avg(volume) AS b FROM panel GROUP BY ticker) SELECT ticker, {_r('round((count(*) OVER (ORDER BY a) + count(*) OVER (ORDER BY b)) / 2.0, 2)')} AS score FROM m")
def rank_score(spark, sf_dir):
    return cross.rank_score(panel(spark, sf_dir), ["close", "volume"])


@query(f"{P}, m AS (SELECT ticker, avg(close) AS a, avg(volume) AS b FROM panel GROUP BY ticker) SELECT ticker, {_r('((a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) + (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ())) / 2 * 100')} AS score FROM m")
def minmax_score(spark, sf_dir):
    return cross.minmax_score(panel(spark, sf_dir), ["close", "volume"])


@query(f"{RET}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ret DESC, ticker) AS h, row_number() OVER (PARTITION BY date ORDER BY ret, ticker) AS l FROM r WHERE ret IS NOT NULL) SELECT ticker, CAST(date AS VARCHAR) AS date, {_r('ret')} AS ret, CASE WHEN h <= 3 THEN 1 ELSE -1 END AS side FROM k WHERE h <= 3 OR l <= 3")
def topk_momentum(spark, sf_dir):
    return cross.top_bottom(returns(spark, sf_dir).select("ticker", "date", "ret"), "ret", 3)


@query(f"{RET} SELECT x.ticker AS a, y.ticker AS b, count(*) AS n, {_r('covar_samp(x.ret, y.ret)')} AS cov, {_r('covar_samp(x.ret, y.ret) / (stddev_samp(x.ret) * stddev_samp(y.ret))')} AS corr, {_r('regr_slope(y.ret, x.ret)')} AS slope, {_r('regr_intercept(y.ret, x.ret)')} AS intercept FROM r x JOIN r y ON x.date = y.date AND x.ticker < y.ticker WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL GROUP BY ALL")
def pair_statistics(spark, sf_dir):
    return cross.pair_statistics(returns(spark, sf_dir))


@query(f"{RET}, m AS (SELECT ticker, ret, avg(ret) OVER (PARTITION BY ticker) AS mu FROM r WHERE ret IS NOT NULL) SELECT ticker, {_r('avg(ret)')} AS mean, {_r('stddev_samp(ret)')} AS std, {_r('avg(power(ret - mu, 3)) / power(avg(power(ret - mu, 2)), 1.5)', 3)} AS skew, {_r('avg(power(ret - mu, 4)) / power(avg(power(ret - mu, 2)), 2)', 3)} AS kurt FROM m GROUP BY ticker", skew=3, kurt=3)
def return_moments(spark, sf_dir):
    return cross.return_moments(returns(spark, sf_dir))


@query(f"{RET} SELECT ticker, " + ", ".join(f"{_r(f'CASE WHEN count(CASE WHEN {c} THEN ret END) > 2 THEN (sum(CASE WHEN {c} THEN ret * ret END) / power(sum(CASE WHEN {c} THEN ret END), 2) - 1.0 / count(CASE WHEN {c} THEN ret END)) / (1 - 1.0 / count(CASE WHEN {c} THEN ret END)) END', 6)} AS hhi_{n}" for c, n in (("ret >= 0", "positive"), ("ret < 0", "negative"))) + " FROM r GROUP BY ticker", digits=6)
def hhi_concentration(spark, sf_dir):
    return cross.hhi(returns(spark, sf_dir))


@query(f"{T} SELECT symbol, ts, seq, price, volume, side FROM sided")
def tick_rule(spark, sf_dir):
    return bars.tick_rule(ticks(spark, sf_dir))


@query(f"{T} SELECT symbol, bar_id, {BAR} FROM (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1) // 50 AS bar_id FROM sided) GROUP BY symbol, bar_id HAVING count(*) = 50")
def bars_tick(spark, sf_dir):
    return bars.tick_bars(ticks(spark, sf_dir), 50)


@query(f"{T}, b AS (SELECT symbol, bar_id, {BAR} FROM (SELECT *, (CAST(floor(epoch(ts) / 21600) AS BIGINT) + 1) * 21600 AS bar_id FROM sided) GROUP BY symbol, bar_id) SELECT * FROM b WHERE bar_id < (SELECT max(bar_id) FROM b c WHERE c.symbol = b.symbol)")
def bars_time(spark, sf_dir):
    return bars.time_bars(ticks(spark, sf_dir), 21600)


@query(f"""{T}, RECURSIVE_FREE AS (SELECT 1),
 n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS i FROM sided),
 l AS (SELECT symbol, list_reduce(list_prepend(struct_pack(k := CAST(0 AS BIGINT), s := CAST(0 AS DOUBLE), ids := CAST([] AS BIGINT[])), list(struct_pack(k := CAST(0 AS BIGINT), s := volume, ids := CAST([] AS BIGINT[])) ORDER BY i)),
   lambda a, x: struct_pack(k := CASE WHEN a.s + x.s >= {THRESHOLD} THEN a.k + 1 ELSE a.k END, s := CASE WHEN a.s + x.s >= {THRESHOLD} THEN 0.0 ELSE a.s + x.s END, ids := list_append(a.ids, a.k))) AS z FROM n GROUP BY symbol),
 m AS (SELECT n.*, z.ids[i] AS bar_id, z.k AS closed FROM n JOIN l ON n.symbol = l.symbol)
 SELECT symbol, bar_id, {BAR} FROM m WHERE bar_id < closed GROUP BY symbol, bar_id""".replace("RECURSIVE_FREE AS (SELECT 1),\n ", ""))
def bars_volume(spark, sf_dir):
    return bars.recurrent_bars(ticks(spark, sf_dir), "threshold", "volume", THRESHOLD)


@query()
def imbalance_bars(spark, sf_dir):
    return bars.recurrent_bars(ticks(spark, sf_dir), "imbalance", "volume")


@query()
def run_bars(spark, sf_dir):
    return bars.recurrent_bars(ticks(spark, sf_dir), "run", "volume")


@query()
def cusum_filter(spark, sf_dir):
    return labels.cusum_events(bar_view(spark, sf_dir), 500.0)


@query(f"{P} SELECT ticker AS symbol, CAST(date AS TIMESTAMP) AS ts, {_r('close')} AS close, {_r('fwd')} AS fwd, CASE WHEN round(fwd * 1e8, 0) > 1e6 THEN 1 WHEN round(fwd * 1e8, 0) < -1e6 THEN -1 WHEN fwd IS NOT NULL THEN 0 END AS label FROM (SELECT *, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) / close - 1 AS fwd FROM panel)")
def fixed_horizon_label(spark, sf_dir):
    return labels.fixed_horizon(bar_view(spark, sf_dir).select("symbol", "ts", "close"), 5, 0.01)


def _targets(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("ts")
    r = F.try_divide("close", F.lag("close").over(w)) - 1
    known = bar_view(spark, sf_dir).withColumn("__r", r)
    return known.withColumn("trgt", F.avg(F.abs("__r")).over(w.rowsBetween(-19, 0))).select("symbol", "ts", "close", "trgt")


@query(f"""{RET}, t AS (SELECT ticker AS symbol, CAST(date AS TIMESTAMP) AS ts, close, avg(abs(ret)) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS trgt, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM r),
 j AS (SELECT a.symbol, a.ts AS t0, a.trgt, b.ts AS tb, b.close / a.close - 1 AS x FROM t a JOIN t b ON a.symbol = b.symbol AND b.i BETWEEN a.i AND a.i + 10 WHERE a.trgt > 0.01),
 f AS (SELECT symbol, t0, trgt, max(tb) AS te, min(CASE WHEN x > 2.0 * trgt THEN tb END) AS tu, min(CASE WHEN x < -1.0 * trgt THEN tb END) AS td, count(*) AS n FROM j GROUP BY ALL)
 SELECT f.symbol, f.t0, least(te, tu, td) AS t1, {_r('j.x')} AS ret, {_r('f.trgt')} AS trgt, CASE WHEN tu = least(te, tu, td) THEN 1 WHEN td = least(te, tu, td) THEN -1 ELSE 0 END AS bin
 FROM f JOIN j ON f.symbol = j.symbol AND f.t0 = j.t0 AND j.tb = least(te, tu, td) WHERE n > 1""")
def triple_barrier(spark, sf_dir):
    return labels.triple_barrier(_targets(spark, sf_dir), 10, 2.0, 1.0, least=0.01)


_TREND = {n: f"regr_slope(close, k) OVER w{n} / sqrt(nullif(regr_syy(close, k) OVER w{n} - pow(regr_slope(close, k) OVER w{n}, 2) * regr_sxx(close, k) OVER w{n}, 0) / ({n} - 2) / regr_sxx(close, k) OVER w{n})" for n in (5, 10, 15)}


@query(
    f"{P}, b AS (SELECT ticker AS symbol, CAST(date AS TIMESTAMP) AS ts, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM panel), t AS (SELECT symbol, ts, count(*) OVER w15 AS n, "
    + ", ".join(f"{sql_} AS t{n}, last_value(ts) OVER w{n} AS e{n}" for n, sql_ in _TREND.items())
    + " FROM b WINDOW "
    + ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY k ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)" for n in _TREND)
    + "), c AS (SELECT *, CASE WHEN abs(t5) >= abs(t10) AND abs(t5) >= abs(t15) THEN 5 WHEN abs(t10) >= abs(t15) THEN 10 ELSE 15 END AS h FROM t WHERE n = 15) "
    + f"SELECT symbol, ts, CASE h WHEN 5 THEN e5 WHEN 10 THEN e10 ELSE e15 END AS t1, h AS horizon, {_r('CASE h WHEN 5 THEN t5 WHEN 10 THEN t10 ELSE t15 END')} AS t_value, "
    + "CAST(sign(CASE h WHEN 5 THEN t5 WHEN 10 THEN t10 ELSE t15 END) AS INT) AS label FROM c"
)
def trend_label(spark, sf_dir):
    return labels.trend_labels(bar_view(spark, sf_dir), (5, 10, 15))


def _spans(spark, sf_dir):
    """Every bar to the bar ten rows later."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("ts")
    known = bar_view(spark, sf_dir).withColumn("t1", F.lead("ts", 10).over(w))
    return known.where("t1 IS NOT NULL").select("symbol", F.col("ts").alias("t0"), "t1")


SPANS = f"{P}, b AS (SELECT ticker AS symbol, CAST(date AS TIMESTAMP) AS ts, close, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, lead(CAST(date AS TIMESTAMP), 10) OVER (PARTITION BY ticker ORDER BY date) AS t1 FROM panel), e AS (SELECT symbol, ts AS t0, t1, i AS i0, i + 10 AS i1 FROM b WHERE t1 IS NOT NULL), c AS (SELECT b.symbol, b.i, b.ts, b.close, count(e.t0) AS c FROM b LEFT JOIN e ON b.symbol = e.symbol AND b.i BETWEEN e.i0 AND e.i1 GROUP BY ALL)"


@query(f"{SPANS} SELECT symbol, ts, {_r('close')} AS close, c FROM c")
def concurrent_events(spark, sf_dir):
    return labels.concurrency(bar_view(spark, sf_dir).select("symbol", "ts", "close"), _spans(spark, sf_dir))


@query(f"{SPANS} SELECT e.symbol, t0, t1, {_r('avg(1.0 / c)')} AS uniqueness FROM e JOIN c ON e.symbol = c.symbol AND c.i BETWEEN i0 AND i1 GROUP BY ALL")
def avg_uniqueness(spark, sf_dir):
    return labels.average_uniqueness(bar_view(spark, sf_dir), _spans(spark, sf_dir))


@query(f"{SPANS}, l AS (SELECT symbol, i, coalesce(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY i)), 0) AS r, c FROM c), w AS (SELECT e.symbol, t0, t1, abs(sum(r / c)) AS x FROM e JOIN l ON e.symbol = l.symbol AND l.i BETWEEN i0 AND i1 GROUP BY ALL) SELECT symbol, t0, t1, {_r('x * count(*) OVER (PARTITION BY symbol) / sum(x) OVER (PARTITION BY symbol)')} AS weight FROM w")
def weights_by_return(spark, sf_dir):
    return labels.weights_by_return(bar_view(spark, sf_dir), _spans(spark, sf_dir))


@query(f"{SPANS}, n AS (SELECT symbol, t0, t1, ntile(4) OVER (PARTITION BY symbol ORDER BY t0, t1) AS own FROM e), s AS (SELECT symbol, own AS fold, min(t0) AS a, max(t1) AS b FROM n GROUP BY ALL) SELECT n.symbol, t0, t1, CAST(fold AS INT) AS fold, CASE WHEN own = fold THEN 'test' ELSE 'train' END AS role FROM n JOIN s ON n.symbol = s.symbol WHERE own = fold OR NOT (t0 <= b AND a <= t1)")
def purged_kfold(spark, sf_dir):
    return labels.purged_folds(_spans(spark, sf_dir), 4)


@query(f"{SPANS}, g AS (SELECT symbol, t0, t1, CASE WHEN i0 % 2 = 0 THEN 1.0 ELSE -0.5 END AS s FROM e), u AS (SELECT symbol, t0 AS ts, s, 1 AS n FROM g UNION ALL SELECT symbol, t1, -s, -1 FROM g), a AS (SELECT symbol, ts, sum(s) AS s, sum(n) AS n FROM u GROUP BY ALL), k AS (SELECT symbol, ts, sum(s) OVER (PARTITION BY symbol ORDER BY ts) AS s, sum(n) OVER (PARTITION BY symbol ORDER BY ts) AS n FROM a) SELECT symbol, ts, {_r('CASE WHEN n > 0 THEN s / n ELSE 0 END')} AS signal FROM k")
def avg_active_signals(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("t0")
    known = _spans(spark, sf_dir).withColumn("k", F.row_number().over(w))
    return labels.active_signals(known.withColumn("signal", F.when(F.col("k") % 2 == 0, 1.0).otherwise(-0.5)))
