"""Scans of ticks in slots: equal to one window over a symbol, and no task with a hot symbol's ticks."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import bars

TICKS = "symbol string, ts timestamp_ntz, seq long, price double, volume double"
START = dt.datetime(2024, 1, 1)


def made(n=3000, seed=2):
    rng, out, price = random.Random(seed), [], {}
    for k in range(n):
        s = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c"])
        price[s] = price.get(s, 100.0) + rng.choice([0, 0, 0, 1, -1])
        out.append((s, START + dt.timedelta(seconds=rng.randint(0, 40 * 3600)), k, price[s] if rng.random() > 0.02 else None, float(rng.randint(1, 9))))
    out += [(None, START, 1, 5.0, 1.0), (None, START + dt.timedelta(days=1), 2, 6.0, 1.0), ("no time", None, 1, 1.0, 1.0), ("no time", START, 2, 2.0, 1.0), ("flat", START, 1, 1.0, 1.0), ("flat", START + dt.timedelta(days=2), 1, 1.0, 1.0)]
    return out


def plain(ticks):
    """The same as one window over each symbol."""
    w = Window.partitionBy("symbol").orderBy("ts", "seq")
    step = F.sign(F.col("price") - F.lag("price").over(w))
    known = ticks.withColumn("s", F.when(step != 0, step)).withColumn("i", F.row_number().over(w) - 1).withColumn("before", F.lag("price").over(w))
    return known.withColumn("side", F.coalesce(F.last("s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))


@pytest.mark.parametrize("seconds", [60, 3600, 10**7])
def test_slots_equal_one_window(spark, seconds):
    ticks = spark.createDataFrame(made(), TICKS).withColumn("side", F.lit("clash"))
    columns = ["symbol", "ts", "seq", "price", "side", "i", "before"]
    got = sorted(map(repr, map(tuple, bars.scanned(ticks, seconds).select(columns).collect())))
    want = sorted(map(repr, map(tuple, plain(ticks).select(columns).collect())))
    assert got == want
    assert {r.side for r in bars.tick_rule(ticks, seconds).where("symbol = 'flat'").collect()} == {0.0}


def test_no_task_holds_a_hot_symbol(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    n = 40_000
    ticks = spark.range(n, numPartitions=8).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("symbol"),
        (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") * 30).cast("decimal(18,6)"))).alias("ts"),
        F.col("id").alias("seq"), F.lit(1.0).alias("price"), F.lit(1.0).alias("volume"),
    )
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        sizes = [r["count"] for r in bars.scanned(ticks, 3600).where("side > -9 AND i >= 0").groupBy(F.spark_partition_id()).count().collect()]
        whole = [r["count"] for r in plain(ticks).where("side > -9 AND i >= 0").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == n and max(sizes) <= 2 * statistics.median(sizes)
    assert max(whole) > n / 2


def test_bars_on_slots(spark):
    ticks = spark.createDataFrame([t for t in made() if t[0] and t[1]], TICKS)
    got = {(r.symbol, r.bar_id): (r.cum_ticks, r.volume, r.cum_buy_volume) for r in bars.tick_bars(ticks, 50, 600).collect()}
    rows = plain(ticks).withColumn("bar", F.floor(F.col("i") / 50)).groupBy("symbol", "bar").agg(F.count("*").alias("n"), F.sum("volume").alias("v"), F.sum(F.when(F.col("side") == 1, F.col("volume")).otherwise(0.0)).alias("b")).where("n = 50")
    assert got == {(r.symbol, r.bar): (r.n, r.v, r.b) for r in rows.collect()} and len(got) > 30
    changes = bars.with_changes(ticks.where("price IS NOT NULL"), 600).agg(F.sum("dp").alias("dp")).first()
    ends = plain(ticks.where("price IS NOT NULL")).agg(F.sum(F.col("price") - F.col("before")).alias("dp")).first()
    assert changes.dp == pytest.approx(ends.dp)
    assert bars.scanned(ticks.limit(0)).count() == 0


def test_zero_prices_and_volumes_equal_the_sql(spark, tmp_path):
    import duckdb

    from tickloom.plans import catalog

    def price(s, k):
        return 0.0 if (s, k) in (("a", 7), ("b", 19), ("b", 20), ("c", 39)) else 5.0 + (k * 7 + ord(s)) % 11

    rows = [(100 * ord(s) + k, START + dt.timedelta(minutes=k), k, s, price(s, k), '{"k": %d}' % (0 if s == "d" and k < 20 else k % 9)) for s in "abcd" for k in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in catalog.QUERIES["bar_micro_features"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert list(map(repr, got)) == list(map(repr, sorted(con.sql(catalog.SQL["bar_micro_features"]).fetchall())))
    vwap, amihud = ({(r[0], r[1]): r[k] for r in got} for k in (2, 6))
    assert len(got) == 12 and repr(vwap["d", 0]) == "nan" and amihud["d", 0] is None
    # A move to 0 is -inf times 0 dollars; the next bar of c has only the move back.
    assert repr(amihud["a", 0]) == "nan" and amihud["c", 2] == float("inf") and 0 < amihud["a", 1] < 1
