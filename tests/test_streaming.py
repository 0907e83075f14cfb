"""Streams give what the batch operators give."""

import numpy as np

from tickloom.operators import bars, breaks, labels
from tickloom.streaming import stateful


def write(spark, path):
    rng = np.random.default_rng(2)
    rows = [(f"s{i % 2}", i, float(p), float(v)) for i, (p, v) in enumerate(zip(rng.normal(100, 3, 400), rng.integers(1, 9, 400)))]
    df = spark.createDataFrame(rows, "symbol string, seq long, price double, volume double").selectExpr("symbol", "timestamp_seconds(seq) AS ts", "seq", "price", "volume")
    for k in range(4):
        df.where(f"seq BETWEEN {k * 100} AND {k * 100 + 99}").coalesce(1).write.mode("append").parquet(path)
    return df


def drain(spark, frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "ticks")
    df = write(spark, path)

    def stream():
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    got = {(r.symbol, r.bar_id): (r.open, r.close, r.volume, r.cum_ticks) for r in drain(spark, stateful.threshold_bars(stream(), 30.0), "tb")}
    want = {(r.symbol, r.bar_id): (r.open, r.close, r.volume, r.cum_ticks) for r in bars.recurrent_bars(df, "threshold", "volume", 30.0).collect()}
    assert got == want
    got = {(r.symbol, r.ts) for r in drain(spark, stateful.cusum_events(stream(), 5.0), "ce")}
    want = {(r.symbol, r.ts) for r in labels.cusum_events(df.selectExpr("symbol", "ts", "price AS close"), 5.0).collect()}
    assert got == want
    closed = {(r.symbol, r.date_time.timestamp()): r.volume for r in drain(spark, stateful.time_bars(stream(), "60 seconds"), "tm")}
    batch = {(r.symbol, float(r.bar_id)): r.volume for r in bars.time_bars(df, 60).collect()}
    assert closed and all(batch[k] == v for k, v in closed.items())


def test_dynamic_zscore_over_uneven_batches_and_a_restart(spark, tmp_path):
    rng = np.random.default_rng(6)
    price = rng.normal(100, 1, 600)
    price[[130, 250, 251, 400, 555]] += [9, -8, 12, 7, -11]
    rows = [(f"s{i % 3 // 2}", i, float(p), 1.0) for i, p in enumerate(price)]
    df = spark.createDataFrame(rows, "symbol string, seq long, price double, volume double").selectExpr("symbol", "timestamp_seconds(seq) AS ts", "seq", "price", "volume")
    source, sink, checkpoint = (str(tmp_path / n) for n in ("ticks", "signals", "checkpoint"))

    def feed(*cuts):
        for a, b in zip(cuts, cuts[1:], strict=False):
            df.where(f"seq >= {a} AND seq < {b}").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = stateful.dynamic_zscore(stream, 20, 3.0, 0.3).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(120)

    feed(0, 7, 8, 131, 260)
    run()
    first = spark.read.parquet(sink).count()
    feed(260, 401, 402, 600)
    run()  # a new query that goes on from the checkpoint
    assert first == 260
    got = sorted((r.symbol, r.seq, r.signal) for r in spark.read.parquet(sink).collect())
    batch = breaks.dynamic_zscore(df, 20, 3.0, 0.3, x="price", key="symbol", order="seq").collect()
    assert got == sorted((r.symbol, r.seq, r.signal) for r in batch)
    assert {s for _, _, s in got} == {-1, 0, 1} and len(got) == 600
