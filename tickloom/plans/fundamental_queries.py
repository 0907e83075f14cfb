"""The thirty fundamental ratios and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fundamentals
from ..sources.views import panel, sql
from .operator_queries import P, _r, query

_ITEMS = """SELECT c_nationkey AS ticker, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS report_date,
  sum(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice ELSE 0 END) + 1000 AS equity, sum(CASE WHEN o_orderpriority LIKE '2%' THEN o_totalprice ELSE 0 END) + 500 AS debt, sum(o_totalprice) + 1500 AS asset,
  sum(CASE WHEN o_orderpriority LIKE '3%' THEN o_totalprice ELSE 0 END) / 50 AS goodwill, sum(CASE WHEN o_orderpriority LIKE '4%' THEN o_totalprice ELSE 0 END) / 40 AS intangible, sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) AS non_current,
  sum(o_totalprice) AS revenue, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) + 100 AS cost, count(*) * 1000.0 AS tax, sum(o_totalprice) / 5 AS pretax, sum(o_totalprice) / 5 - count(*) * 1000.0 AS profit,
  max(o_totalprice) AS operating_cash, min(o_totalprice) AS cash, avg(o_totalprice) AS cash_end, sum(CASE WHEN o_orderpriority LIKE '5%' THEN o_totalprice ELSE 0 END) / 30 AS depreciation
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, CAST(date_trunc('quarter', o_orderdate) AS DATE)"""
_DAILY = "SELECT ticker, date, close / open AS pe, high / low AS ps, volume AS pcf, close * volume AS market_capital FROM panel"


def _growth(x: str) -> str:
    past = f"lag({x}, 3) OVER (PARTITION BY ticker ORDER BY report_date)"
    return f"CASE WHEN {past} IS NOT NULL THEN coalesce({x} / nullif({past}, 0) - 1, 0) * 100 END"


_SQL = {
    "roe": "profit / nullif(equity, 0) * 100", "roa": "profit / nullif(asset, 0) * 100", "roi": "(pretax - tax) / nullif(equity + debt - cash, 0) * 100", "profit_revenue": "profit / nullif(revenue, 0) * 100",
    "gross_profit_revenue": "(revenue - cost) / nullif(revenue, 0) * 100", "profit_cost": "profit / nullif(cost, 0) * 100", "equity_incr_rate": _growth("equity"), "revenue_increase_q2q_rate": _growth("revenue"),
    "profit_increase_q2q_rate": _growth("profit"), "cash_increase_q2q_rate": _growth("operating_cash"), "asset_increase_q2q_rate": _growth("asset"), "debt_increase_q2q_rate": _growth("debt"),
    "debt_asset_ratio": "debt / nullif(asset, 0)", "debt_equity_ratio": "debt / nullif(equity, 0)", "debt_net_asset_ratio": "coalesce(debt / nullif(equity - intangible, 0), 0)", "revenue_asset_ratio": "revenue / nullif(asset, 0) * 100",
    "goodwell_equity_ratio": "goodwill / nullif(equity, 0) * 100", "CFO2EV": "operating_cash / nullif(ev, 0) * 100", "EDITDA2EV": "(pretax + depreciation) / nullif(ev, 0) * 100", "BB2P": "depreciation / nullif(market_capital, 0) * 100",
    "BB2EV": "depreciation / nullif(ev, 0) * 100", "B2P": "equity / nullif(market_capital, 0)", "S2EV": "revenue / nullif(ev, 0) * 100", "OL": "equity / nullif(asset, 0) * 100",
    "NCO2A": "(intangible + goodwill + non_current) / nullif(asset, 0) * 100", "E2EV": "profit / nullif(ev, 0) * 100", "pe": "pe", "ps": "ps", "pcf": "pcf", "market_capital": "market_capital",
}


@query(
    f"{P}, i AS ({_ITEMS}), d AS ({_DAILY}), b AS (SELECT i.*, d.date AS db FROM i ASOF LEFT JOIN d ON i.ticker = d.ticker AND i.report_date >= d.date), f AS (SELECT i.ticker, i.report_date, d.date AS df FROM i ASOF LEFT JOIN d ON i.ticker = d.ticker AND i.report_date <= d.date), "
    "n AS (SELECT b.*, CASE WHEN db IS NULL OR df - b.report_date < b.report_date - db THEN df ELSE db END AS at FROM b JOIN f ON b.ticker = f.ticker AND b.report_date = f.report_date), "
    "k AS (SELECT n.*, d.pe, d.ps, d.pcf, d.market_capital, d.market_capital + n.debt - n.cash_end AS ev FROM n LEFT JOIN d ON n.ticker = d.ticker AND n.at = d.date) "
    "SELECT ticker, CAST(report_date AS VARCHAR) AS report_date, " + ", ".join(f"{_r(x)} AS {n}" for n, x in _SQL.items()) + " FROM k"
)
def fundamental_ratios_30(spark, sf_dir):
    daily = panel(spark, sf_dir).select("ticker", "date", (F.col("close") / F.col("open")).alias("pe"), (F.col("high") / F.col("low")).alias("ps"), F.col("volume").alias("pcf"), (F.col("close") * F.col("volume")).alias("market_capital"))
    return fundamentals.full_ratios(sql(spark, sf_dir, _ITEMS, "orders", "customer"), daily)
