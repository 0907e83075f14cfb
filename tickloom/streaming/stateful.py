"""Time bars, CUSUM events, threshold bars and z-score signals over a stream of ticks.

Each takes and returns a streaming DataFrame (symbol, ts, price, volume).
Time bars are a watermarked window in append mode: a bar is emitted once it is
closed.  The others keep a small state per symbol.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.breaks import DynamicZScore


def time_bars(ticks: DataFrame, width: str, late: str = "0 seconds") -> DataFrame:
    order = F.struct("ts", "seq")
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", width))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("cum_ticks"))
        .select("symbol", F.col("window.end").alias("date_time"), "open", "high", "low", "close", "volume", "cum_ticks")
    )


def cusum_events(ticks: DataFrame, h: float) -> DataFrame:
    """symbol, ts at which the symmetric CUSUM of price changes fires; state: both sums and the last price."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down, last, known = state.get if state.exists else (0.0, 0.0, 0.0, False)
        fired = []
        for row in pd.concat(list(parts)).sort_values(["ts", "seq"]).itertuples():
            d = row.price - last if known else 0.0
            up, down, last, known = max(0.0, up + d), min(0.0, down + d), float(row.price), True
            if down < -h:
                down = 0.0
                fired.append(row.ts)
            elif up > h:
                up = 0.0
                fired.append(row.ts)
        state.update((up, down, last, known))
        yield pd.DataFrame({"symbol": [key[0]] * len(fired), "ts": fired})

    return ticks.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp", "up double, down double, last double, known boolean", "append", GroupStateTimeout.NoTimeout)


def threshold_bars(ticks: DataFrame, threshold: float) -> DataFrame:
    """Volume bars; state: the open bar."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, 0)
        bar, o, h, l, v, n = held
        out = []
        for row in pd.concat(list(parts)).sort_values(["ts", "seq"]).itertuples():
            p = float(row.price)
            o, h, l = (p, p, p) if not n else (o, max(h, p), min(l, p))
            v, n = v + float(row.volume), n + 1
            if v >= threshold:
                out.append((key[0], bar, row.ts, o, h, l, p, v, n))
                bar, v, n = bar + 1, 0.0, 0
        state.update((bar, o, h, l, v, n))
        yield pd.DataFrame(out, columns=["symbol", "bar_id", "date_time", "open", "high", "low", "close", "volume", "cum_ticks"])

    out = "symbol string, bar_id long, date_time timestamp, open double, high double, low double, close double, volume double, cum_ticks long"
    return ticks.groupBy("symbol").applyInPandasWithState(step, out, "bar long, o double, h double, l double, v double, n long", "append", GroupStateTimeout.NoTimeout)


def dynamic_zscore(ticks: DataFrame, lag: int = 30, threshold: float = 3.0, influence: float = 0.5) -> DataFrame:
    """symbol, ts, seq, signal of every tick; state: the ring of the last filtered prices, their mean and deviation, the count.

    Ticks of a symbol are taken in the order of (ts, seq) within a micro-batch, and micro-batches as they come."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring, mean, dev, n = state.get if state.exists else ([], 0.0, 0.0, 0)
        held = DynamicZScore(lag, threshold, influence, ring, mean, dev, n, x="price")
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        yield held.feed(rows[["symbol", "ts", "seq", "price"]])
        state.update(([float(v) for v in held.ring], held.mean, held.dev, held.n))

    return ticks.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, seq long, signal int", "ring array<double>, mean double, dev double, n long", "append", GroupStateTimeout.NoTimeout)
