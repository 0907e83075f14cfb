"""Readers and writers of prices, ticks, statements and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = T.StructType([T.StructField("date", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "amount", "market_capital", "pe", "ps", "pcf")]])
TICKS = T.StructType([T.StructField("date_time", T.TimestampType()), T.StructField("price", T.DoubleType()), T.StructField("volume", T.DoubleType())])
PLACEHOLDERS = ("--", "_", "None", "")


def prices(spark: SparkSession, pattern: str, ticker: str = r"/([^/]+)/[^/]+/daily[.]csv$", zero: bool = False) -> DataFrame:
    """Daily files of many instruments, the ticker taken from the path; zero: nulls become 0."""
    read = spark.read.schema(PRICES).option("header", True).csv(pattern).withColumn("ticker", F.regexp_extract(F.col("_metadata.file_path"), ticker, 1))
    return read.na.fill(0.0) if zero else read


def ticks(spark: SparkSession, pattern: str, symbol: str, stream: bool = False) -> DataFrame:
    """Three-column tick files, as a batch or a stream; a row that breaks the contract fails the read."""
    reader = spark.readStream if stream else spark.read
    read = reader.schema(TICKS).option("header", True).option("mode", "FAILFAST").csv(pattern)
    return read.select(F.lit(symbol).alias("symbol"), F.col("date_time").alias("ts"), "price", "volume")


def statement_items(df: DataFrame, items: list[str]) -> DataFrame:
    """Raw item cells to numbers: plain, placeholder (0) or a list text whose first value counts."""
    def number(c: str):
        cell = F.trim(c)
        listed = F.regexp_replace(F.when(cell.startswith("["), cell), r"\b(None|nan|NaN)\b", "null")
        first = F.get(F.from_json(listed, "array<double>"), F.lit(0))
        return F.when(cell.isin(*PLACEHOLDERS), 0.0).otherwise(F.coalesce(first, F.expr(f"try_cast(trim({c}) AS double)"), F.lit(0.0)))

    return df.withColumns({c: number(c) for c in items})


# What reports are called, and the quarter that they end.
QUARTERS = {"FY": "Q4", "Q9": "Q3", "Q6": "Q2", "Q1": "Q1", "三季报": "Q3", "半年报": "Q2", "中报": "Q2", "一季报": "Q1", "年报": "Q4"}


def report_name(name):
    """2023FY, 2023年Q6, 2023年报 and the like to year/Qn; other names keep what follows the year."""
    year, rest = F.regexp_extract(name, r"(\d{4})", 1), F.regexp_extract(name, r"\d{4}年?(.*)$", 1)
    quarter = rest
    for called, q in QUARTERS.items():
        quarter = F.when(rest == called.removeprefix("年"), q).when(rest == called, q).otherwise(quarter)
    return F.concat_ws("/", year, quarter)


STATEMENTS = ("income", "cash", "balance", "metrics")


def statement_files(spark: SparkSession, root: str, provider: str = "xq", titles: dict[str, str] | None = None) -> list[DataFrame]:
    """The four statement files of every symbol below root/<symbol>/<provider>, cleaned: ticker, report_name, report_date and items.

    Columns that begin with subtitle go, others are renamed by ``titles``, cells
    become numbers, and rows are named by quarter. Files of one kind have the
    same columns; a kind without any file is left out.
    """
    parts = []
    for kind in STATEMENTS:
        pattern = f"{root.rstrip('/')}/*/{provider}/{kind}.csv"
        glob = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        if not glob.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(glob):
            continue
        read = spark.read.option("header", True).option("multiLine", False).csv(pattern).withColumn("ticker", F.regexp_extract(F.col("_metadata.file_path"), rf"/([^/]+)/{provider}/{kind}[.]csv$", 1))
        read = read.drop(*[c for c in read.columns if c.startswith("subtitle") or c.startswith("Unnamed")]).withColumnsRenamed(titles or {})
        items = [c for c in read.columns if c not in ("ticker", "report_name", "report_date", "ctime")]
        cleaned = statement_items(read, items).withColumn("report_name", report_name(F.col("report_name"))).withColumn("report_date", F.to_date("report_date"))
        parts.append(cleaned.select("ticker", "report_name", "report_date", *items))
    return parts


def calendar(prices_: DataFrame, reference: str, start: str, end: str) -> DataFrame:
    """Trade dates of the reference instrument within the range."""
    return prices_.where((F.col("ticker") == reference) & F.col("date").between(start, end)).select("date").distinct()


def factor_range(spark: SparkSession, path: str, start: str, end: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).where(F.col("date").between(start, end)).select("ticker", "date", *columns)


def write_by_ticker(df: DataFrame, path: str) -> None:
    df.repartition("ticker").write.mode("overwrite").partitionBy("ticker").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
