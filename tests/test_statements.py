"""The chain from four statement files to ratios."""

import datetime as dt

import pytest

from tickloom.operators import fundamentals
from tickloom.sources import io

NAMES = {"2023FY": "2023/Q4", "2023年FY": "2023/Q4", "2023年Q9": "2023/Q3", "2023年Q6": "2023/Q2", "2023Q1": "2023/Q1", "2023年报": "2023/Q4", "2023三季报": "2023/Q3", "2023年半年报": "2023/Q2", "2023中报": "2023/Q2", "2023一季报": "2023/Q1", "2022Q2": "2022/Q2"}


def test_report_names(spark):
    got = {r.n: r.q for r in spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", io.report_name(io.F.col("n")).alias("q")).collect()}
    assert got == NAMES


def test_four_files_to_ratios(spark, tmp_path):
    files = {
        "income": "report_name,report_date,ctime,subtitle_x,营业收入,营业成本,所得税,税前利润,净利润\n2023年Q1,2023-03-31,1,a,\"[100.0, 0.1]\",60,5,25,20\n2023年Q6,2023-06-30,1,a,250,--,5,55,\"[50, None]\"\n",
        "cash": "report_name,report_date,ctime,经营活动产生的现金流量净额,期初现金,期末现金\n2023年Q1,2023-03-31,1,30,5,8\n2023年Q6,2023-06-30,1,70,8,_\n",
        "balance": "report_name,report_date,ctime,股东权益合计,资产合计,负债合计\n2023年Q1,2023-03-31,1,200,500,300\n2023年Q1,2023-04-01,2,1,1,1\n2023年Q6,2023-06-30,1,210,520,310\n",
    }
    for symbol in ("A", "B"):
        place = tmp_path / symbol / "xq"
        place.mkdir(parents=True)
        for kind, text in files.items():
            (place / f"{kind}.csv").write_text(text)
    titles = {"营业收入": "revenue", "营业成本": "cost", "所得税": "tax", "税前利润": "pretax", "净利润": "profit", "经营活动产生的现金流量净额": "operating_cash", "期初现金": "cash_start", "期末现金": "cash_end", "股东权益合计": "equity", "资产合计": "asset", "负债合计": "debt"}
    parts = io.statement_files(spark, f"file://{tmp_path}", titles=titles)
    assert len(parts) == 3 and all(not c.startswith("subtitle") for p in parts for c in p.columns)
    joined = fundamentals.join_statements(parts)
    rows = {(r.ticker, r.report_name): r for r in joined.collect()}
    assert set(rows) == {(s, q) for s in "AB" for q in ("2023/Q1", "2023/Q2")}
    a = rows["A", "2023/Q1"]
    assert (a.revenue, a.cost, a.equity, a.operating_cash) == (100.0, 60.0, 200.0, 30.0)  # the first of repeated reports
    assert (rows["B", "2023/Q2"].cost, rows["B", "2023/Q2"].profit, rows["B", "2023/Q2"].cash_end) == (0.0, 50.0, 0.0)
    daily = spark.createDataFrame([("A", dt.date(2023, 3, 30), 10.0, 2.0, 3.0, 1000.0), ("A", dt.date(2023, 4, 5), 11.0, 2.0, 3.0, 1100.0), ("B", dt.date(2024, 1, 1), 1.0, 1.0, 1.0, 50.0)], "ticker string, date date, pe double, ps double, pcf double, market_capital double")
    made = fundamentals.full_ratios(joined, daily)
    assert len(made.columns) == 32
    got = {(r.ticker, r.report_date.month): r for r in made.collect()}
    a = got["A", 3]
    assert (a.roe, a.roa, a.pe, a.market_capital) == (10.0, 4.0, 10.0, 1000.0)
    assert a.roi == pytest.approx(20 / 495 * 100) and a.gross_profit_revenue == 40 and a.NCO2A == 100 and a.goodwell_equity_ratio == 0
    assert a.EDITDA2EV == pytest.approx(25 / (1000 + 300 - 8) * 100) and a.debt_net_asset_ratio == 1.5 and a.equity_incr_rate is None
    assert got["A", 6].profit_cost is None and got["B", 3].market_capital == 50


def test_items_fall_back_to_what_there_is(spark):
    base = dict(ticker="x", report_date=dt.date(2023, 1, 1), equity=1.0, asset=2.0, debt=1.0, tax=0.0, pretax=3.0, profit=1.0, operating_cash=1.0, cash_start=4.0, cash_end=1.0)
    bank = fundamentals.standard_items(spark.createDataFrame([base | dict(total_revenue=9.0, interest_cost=2.0, other_cost=1.5)])).first()
    assert (bank.revenue, bank.cost, bank.non_current, bank.cash) == (9.0, 3.5, 2.0, 4.0)
    assert fundamentals.standard_items(spark.createDataFrame([base | dict(revenue=9.0, gross_profit=2.0)])).first().cost == 7.0
    assert fundamentals.standard_items(spark.createDataFrame([base | dict(total_revenue=9.0)])).first().cost == 6.0
    with pytest.raises(ValueError, match="equity"):
        fundamentals.standard_items(spark.createDataFrame([{k: v for k, v in base.items() if k != "equity"} | dict(revenue=1.0)]))
