"""As-of joins, calendar alignment and event windows.

An as-of join is one exchange by key: both sides are unioned, and a window
carries the last right row forward (or the next one back); no range join, no
candidate pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _merged(left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str) -> tuple[DataFrame, list[str]]:
    carried = [c for c in right.columns if c != key]
    a = left.select(key, F.col(left_on).alias("__at"), F.lit(True).alias("__left"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(F.struct(*carried)).schema[0].dataType).alias("__found"))
    b = right.select(key, F.col(right_on).alias("__at"), F.lit(False).alias("__left"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.struct(*carried).alias("__found"))
    return a.unionByName(b), carried


def asof(left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str, direction: str = "backward") -> DataFrame:
    """Each left row with the last right row at or before it (backward), the first
    at or after it (forward), or the nearer of both (nearest; ties go back).

    Left rows without a match keep nulls; null keys match nothing but each other.
    """
    merged, carried = _merged(left, right, key, left_on, right_on)
    # At equal times right rows come first going back, last going forward.
    back = Window.partitionBy(key).orderBy("__at", "__left").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy("__at", F.col("__left").desc()).rowsBetween(0, Window.unboundedFollowing)
    before, after = F.last("__found", ignorenulls=True).over(back), F.first("__found", ignorenulls=True).over(ahead)
    if direction == "nearest":
        both = merged.withColumn("__b", before).withColumn("__a", after)
        far_b = F.col("__at").cast("timestamp").cast("double") - F.col(f"__b.{right_on}").cast("timestamp").cast("double")
        far_a = F.col(f"__a.{right_on}").cast("timestamp").cast("double") - F.col("__at").cast("timestamp").cast("double")
        found = both.withColumn("__hit", F.when(F.col("__b").isNull() | (far_a < far_b), F.col("__a")).otherwise(F.col("__b")))
    else:
        found = merged.withColumn("__hit", before if direction == "backward" else after)
    rename = {c: c if c not in left.columns else f"{c}_right" for c in carried}
    return found.where("__left").select("__row.*", *[F.col(f"__hit.{c}").alias(rename[c]) for c in carried])


def align_calendar(prices: DataFrame, values: list[str], key: str = "ticker", date: str = "date", leading: str = "bfill") -> DataFrame:
    """Every weekday between the first and last date for every key; gaps filled
    forward, then (leading='bfill') from the first known row back."""
    span = prices.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias(date)).where(F.weekday(date) < 5)
    # Keys are the size of the universe, days that of the calendar: this product is the result itself.
    grid = prices.select(key).distinct().join(F.broadcast(days), how="cross")
    joined = grid.join(prices.select(key, date, *values), [key, date], "left")
    w = Window.partitionBy(key).orderBy(date)
    forward = {c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in values}
    backward = {c: F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)) for c in values}
    return joined.select(key, date, *[(F.coalesce(forward[c], backward[c]) if leading == "bfill" else forward[c]).alias(c) for c in values])


def event_window_return(prices: DataFrame, events: DataFrame, before: int, after: int, key: str = "ticker", on: str = "report_date") -> DataFrame:
    """Change of close from ``before`` rows ahead of the row nearest to each event to ``after`` rows behind it, clamped to the ends."""
    w = Window.partitionBy(key).orderBy("date")
    numbered = prices.select(key, "date", "close", F.row_number().over(w).alias("rn"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    near = asof(events, numbered.select(key, "date", "rn", "n"), key, on, "date", "nearest").where(F.col("rn").isNotNull())
    ends = near.withColumn("lo", F.greatest(F.col("rn") - before, F.lit(1))).withColumn("hi", F.least(F.col("rn") + after, F.col("n")))
    low = numbered.select(key, F.col("rn").alias("lo"), F.col("close").alias("close_before"))
    high = numbered.select(key, F.col("rn").alias("hi"), F.col("close").alias("close_after"))
    joined = ends.join(low, [key, "lo"]).join(high, [key, "hi"])
    return joined.select(key, on, "date", (F.try_divide("close_after", "close_before") - 1).alias("change"))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key (stored rows before new ones, for an upsert)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows, and the new ones whose keys are not stored."""
    return stored.unionByName(new.join(stored.select(*keys).distinct(), keys, "left_anti"))


def purge(train: DataFrame, test: DataFrame, by: str | None = "symbol") -> DataFrame:
    """Train events (t0, t1) that overlap no test interval, of their own symbol if there is one.

    A sweep: the test intervals that began by a train row's end, less those that
    ended before its start, are those that overlap it; two unions and prefix
    sums, and no join of intervals. Tables without symbols are one sweep, of one
    task. Rows without t0 or t1 overlap nothing."""
    keys = [by] if by and by in train.columns and by in test.columns else []
    columns = train.columns
    rows = train.withColumn("__row", F.lit(True))
    for name, at, mark, first in (("__began", "t1", "t0", 0), ("__ended", "t0", "t1", 2)):
        # Marks at a row's own time count if they began, not if they ended.
        marks = test.where(F.col("t0").isNotNull() & F.col("t1").isNotNull()).select(*keys, F.col(mark).alias("__t"), F.lit(first).alias("__k"))
        both = rows.withColumn("__t", F.col(at)).withColumn("__k", F.lit(1)).unionByName(marks, allowMissingColumns=True)
        w = Window.partitionBy(*keys).orderBy("__t", "__k").rowsBetween(Window.unboundedPreceding, 0)
        rows = both.withColumn(name, F.sum(F.when(F.col("__row").isNull(), 1).otherwise(0)).over(w)).where("__row").drop("__t", "__k")
    known = F.col("t0").isNotNull() & F.col("t1").isNotNull()
    return rows.where(~known | (F.col("__began") <= F.col("__ended"))).select(*columns)
