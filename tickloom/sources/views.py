"""Market views over the given tables, for Spark and, as SQL, for the checks.

panel: daily bars, a row for each ticker and date with trades; ticker is the
nation of the supplier, sector its region, a trade is a line item; bm_open and
bm_close are the benchmark index, the mean over all tickers of a date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import Duck, Spark

PANEL = ["open", "high", "low", "close", "volume", "amount", "vwap", "cap", "ind", "bm_open", "bm_close"]


def _panel_sql(d) -> str:
    by = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    price = "(l_extendedprice / l_quantity)"
    return f"""
    SELECT ticker, date, sector, open, high, low, close, volume, amount, amount / volume AS vwap, amount / close AS cap,
           sum(amount) OVER (PARTITION BY sector, date) / sum(volume) OVER (PARTITION BY sector, date) AS ind,
           avg(open) OVER (PARTITION BY date) AS bm_open, avg(close) OVER (PARTITION BY date) AS bm_close
    FROM (SELECT CAST(s_nationkey AS INT) AS ticker, CAST(n_regionkey AS INT) AS sector, CAST(l_shipdate AS DATE) AS date,
                 {d.first_by(price, *by)} AS open, max({price}) AS high, min({price}) AS low, {d.last_by(price, *by)} AS close,
                 sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
          GROUP BY s_nationkey, n_regionkey, CAST(l_shipdate AS DATE))"""


PANEL_SQL = _panel_sql(Duck)


def _ticks_sql(k: str, symbol: str) -> str:
    return f"SELECT CAST({symbol} AS VARCHAR(64)) AS symbol, ts, event_id AS seq, value AS price, CAST({k} AS DOUBLE) AS volume FROM events WHERE value IS NOT NULL"


TICKS_SQL = _ticks_sql("json_extract_string(props, '$.k')", "event_type")
FINE_TICKS_SQL = _ticks_sql("json_extract_string(props, '$.k')", "user_id")


def _views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def sql(spark: SparkSession, sf_dir: str, query: str, *names: str, **frames: DataFrame) -> DataFrame:
    """A query over the given tables, and over other DataFrames, by name."""
    tables = {**_views(spark, sf_dir, *names), **frames}
    for name in tables:
        query = _braced(query, name)
    return spark.sql(query, **tables)


def _braced(query: str, name: str) -> str:
    import re

    return re.sub(rf"(?<=\bFROM ){name}\b|(?<=\bJOIN ){name}\b", "{" + name + "}", query)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, _panel_sql(Spark), "lineitem", "supplier", "nation")


def ticks(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    return sql(spark, sf_dir, _ticks_sql("get_json_object(props, '$.k')", symbol).replace("VARCHAR(64)", "STRING"), "events")
