"""Statements to quarters, trailing sums and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof, first_of


def quarterise(df: DataFrame, items: list[str], market: str = "us") -> DataFrame:
    """Cumulative items to single periods; a market's first report of a year stays (Q1, or Q2 for hk)."""
    w = Window.partitionBy("ticker").orderBy("report_name")
    first = "Q2" if market == "hk" else "Q1"
    return df.withColumns({c: F.when(F.col("report_name").endswith(first), F.col(c)).otherwise(F.col(c) - F.lag(c).over(w)) for c in items})


def trailing(df: DataFrame, items: list[str], reports: int = 4, order: str = "report_date") -> DataFrame:
    """Sum over the last reports, NULL until there are as many."""
    w = Window.partitionBy("ticker").orderBy(order).rowsBetween(-(reports - 1), 0)
    return df.withColumns({f"{c}_ttm": F.when(F.count(c).over(w) == reports, F.sum(c).over(w)) for c in items})


def _growth(x: str) -> Column:
    w = Window.partitionBy("ticker").orderBy("report_date")
    return F.coalesce(F.try_divide(F.col(x), F.lag(x, 3).over(w)) - 1, F.lit(0.0)) * 100


def ratios(df: DataFrame) -> DataFrame:
    """Profitability, growth, leverage and turnover of revenue, cost, profit, asset, debt, equity, cash (missing items are 0)."""
    have = {c: F.coalesce(F.col(c), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in ("revenue", "cost", "profit", "asset", "debt", "equity", "cash", "tax", "intangible")}
    d = F.try_divide
    known = df.withColumns(have)
    r = {
        "roe": d("profit", "equity") * 100, "roa": d("profit", "asset") * 100, "roi": d(F.col("profit") - F.col("tax"), F.col("debt") + F.col("equity") - F.col("cash")) * 100,
        "profit_revenue": d("profit", "revenue") * 100, "gross_profit_revenue": d(F.col("revenue") - F.col("cost"), F.col("revenue")) * 100, "profit_cost": d("profit", "cost") * 100,
        "debt_asset": d("debt", "asset"), "debt_equity": d("debt", "equity"), "debt_net_asset": d(F.col("debt"), F.col("equity") - F.col("intangible")), "revenue_asset": d("revenue", "asset") * 100,
        **{f"{x}_q2q": _growth(x) for x in ("revenue", "profit", "cost", "asset", "debt")},
    }
    return known.select("ticker", "report_date", *[c.alias(n) for n, c in r.items()])


#: Items that the ratios need: the first of the columns that a table has, or 0 where the item is optional.
ITEMS = {
    "equity": ("equity",), "asset": ("asset",), "debt": ("debt",), "goodwill": ("goodwill", 0.0), "intangible": ("intangible", 0.0), "non_current": ("non_current", "asset"),
    "revenue": ("revenue", "total_revenue"), "tax": ("tax",), "pretax": ("pretax",), "profit": ("profit",), "operating_cash": ("operating_cash",), "cash": ("cash", "cash_start"), "cash_end": ("cash_end",), "depreciation": ("depreciation", 0.0),
}
DAILY = ("pe", "ps", "pcf", "market_capital")


def standard_items(df: DataFrame) -> DataFrame:
    """ticker, report_date and the items of the ratios, taken from what the statements have; costs of banks and of tables without any are worked out."""
    have = set(df.columns)
    made = {}
    for item, sources in ITEMS.items():
        found = next((c for c in sources if c in have or not isinstance(c, str)), None)
        if found is None:
            raise ValueError(f"statements have no {item}: one of {sources}")
        made[item] = F.coalesce(F.col(found), F.lit(0.0)) if isinstance(found, str) else F.lit(found)
    revenue = made["revenue"]
    costs = [
        ({"cost"}, lambda: F.col("cost")), ({"interest_cost", "other_cost"}, lambda: F.col("interest_cost") + F.col("other_cost")), ({"revenue", "gross_profit"}, lambda: F.col("revenue") - F.col("gross_profit")),
        ({"operating_profit"}, lambda: revenue - F.col("operating_profit")), ({"total_revenue", "pretax"}, lambda: F.col("total_revenue") - F.col("pretax")),
    ]
    made["cost"] = next((F.coalesce(c(), F.lit(0.0)) for need, c in costs if need <= have), F.lit(0.0))
    return df.select("ticker", "report_date", *[c.cast("double").alias(n) for n, c in made.items()])


def full_ratios(statements: DataFrame, daily: DataFrame) -> DataFrame:
    """The thirty ratios of each report: 26 of its items and the market value, and the four daily values nearest to its date.

    daily: ticker, date, pe, ps, pcf, market_capital. Growth is over three
    reports, in per cent, 0 where it is infinite; other ratios by 0 are NULL."""
    near = asof(standard_items(statements), daily.select("ticker", "date", *DAILY), "ticker", "report_date", "date", "nearest")
    d, c = F.try_divide, F.col
    w = Window.partitionBy("ticker").orderBy("report_date")
    known = near.withColumn("ev", c("market_capital") + c("debt") - c("cash_end"))

    def growth(x: str) -> Column:
        past = F.lag(x, 3).over(w)
        return F.when(past.isNotNull(), F.coalesce(d(c(x), past) - 1, F.lit(0.0)) * 100)

    r = {
        "roe": d("profit", "equity") * 100, "roa": d("profit", "asset") * 100, "roi": d(c("pretax") - c("tax"), c("equity") + c("debt") - c("cash")) * 100, "profit_revenue": d("profit", "revenue") * 100,
        "gross_profit_revenue": d(c("revenue") - c("cost"), c("revenue")) * 100, "profit_cost": d("profit", "cost") * 100, "equity_incr_rate": growth("equity"), "revenue_increase_q2q_rate": growth("revenue"),
        "profit_increase_q2q_rate": growth("profit"), "cash_increase_q2q_rate": growth("operating_cash"), "asset_increase_q2q_rate": growth("asset"), "debt_increase_q2q_rate": growth("debt"),
        "debt_asset_ratio": d("debt", "asset"), "debt_equity_ratio": d("debt", "equity"), "debt_net_asset_ratio": F.coalesce(d(c("debt"), c("equity") - c("intangible")), F.lit(0.0)), "revenue_asset_ratio": d("revenue", "asset") * 100,
        "goodwell_equity_ratio": d("goodwill", "equity") * 100, "CFO2EV": d("operating_cash", "ev") * 100, "EDITDA2EV": d(c("pretax") + c("depreciation"), c("ev")) * 100, "BB2P": d("depreciation", "market_capital") * 100,
        "BB2EV": d("depreciation", "ev") * 100, "B2P": d("equity", "market_capital"), "S2EV": d("revenue", "ev") * 100, "OL": d("equity", "asset") * 100,
        "NCO2A": d(c("intangible") + c("goodwill") + c("non_current"), c("asset")) * 100, "E2EV": d("profit", "ev") * 100,
    }
    return known.select("ticker", "report_date", *[x.alias(n) for n, x in r.items()], *DAILY)


def join_statements(parts: list[DataFrame], how: str = "full_outer", keys: tuple[str, ...] = ("ticker", "report_name"), order: str = "report_date") -> DataFrame:
    """Statements side by side by report; of repeated keys the first by ``order`` counts (of equal ones the least row), and the first of equal columns."""
    out = None
    for part in parts:
        rest = [c for c in part.columns if c not in keys and c != order]
        part = first_of(part, list(keys), [F.col(c).asc_nulls_last() for c in ([order] if order in part.columns else []) + rest])
        out = part if out is None else out.join(part.drop(*[c for c in part.columns if c in out.columns and c not in keys]), list(keys), how)
    return out


def yearly_with_price(statements: DataFrame, prices: DataFrame) -> DataFrame:
    """Last statement of each year, with the close as of its report date (the first one after it, where none is before)."""
    year = F.year("report_date")
    last = statements.withColumn("year", year).groupBy("ticker", "year").agg(F.max_by(F.struct(*statements.columns), F.struct("report_date")).alias("s")).select("year", "s.*")
    right = prices.select("ticker", F.col("date").alias("price_date"), "close")
    return asof_clamped(last, right, "ticker", "report_date", "price_date")


def asof_clamped(left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str) -> DataFrame:
    """As of or before, and before the first right row that one."""
    back = asof(left, right, key, left_on, right_on)
    carried = [c for c in right.columns if c != key]
    first = right.groupBy(key).agg(F.min_by(F.struct(*carried), right_on).alias("__first"))
    found = back.join(first, key, "left")
    known = F.col(right_on).isNotNull()
    return found.withColumns({c: F.when(known, F.col(c)).otherwise(F.col(f"__first.{c}")) for c in carried}).drop("__first")


def daily_multiple(statements: DataFrame, prices: DataFrame, item: str, value: str = "cap") -> DataFrame:
    """Market value over the trailing item as of each day."""
    found = asof(prices.select("ticker", "date", value), statements.select("ticker", "report_date", item), "ticker", "date", "report_date")
    return found.select("ticker", "date", value, item, F.try_divide(value, item).alias("multiple"))
