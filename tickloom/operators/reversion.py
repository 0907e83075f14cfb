"""Mean-reversion and term-structure positions: signals as windows, positions as machines that carry a few numbers.

The indicators are built-in window expressions; only the position, which
depends on its own past (entry, days held, stops), passes in sorted batches.
Rows are those of ``key`` by ``order``; a comparison with an unknown indicator
is false, so nothing is entered or left for it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carried import carried


def _window(n: int, key: str, order: str) -> Window:
    return Window.partitionBy(key).orderBy(order).rowsBetween(-(n - 1), 0)


def _full(c: Column, x: str, n: int, w: Window) -> Column:
    """The aggregate once n values are known."""
    return F.when(F.count(x).over(w) == n, c)


def bands(df: DataFrame, n: int = 20, deviations: float = 2.0, x: str = "close", key: str = "ticker", order: str = "date") -> DataFrame:
    """mean, dev, and signal: 1 below the lower band, -1 above the upper one, else 0."""
    w = _window(n, key, order)
    known = df.withColumn("mean", _full(F.avg(x).over(w), x, n, w)).withColumn("dev", _full(F.stddev_samp(x).over(w), x, n, w))
    up, down = F.col(x) > F.col("mean") + deviations * F.col("dev"), F.col(x) < F.col("mean") - deviations * F.col("dev")
    return known.withColumn("signal", F.when(down, 1).when(up, -1).otherwise(0))


def simple_rsi(df: DataFrame, n: int = 14, high: float = 70, low: float = 30, x: str = "close", key: str = "ticker", order: str = "date") -> DataFrame:
    """rsi from plain means of the last n gains and losses, and signal: 1 below ``low``, -1 above ``high``, else 0."""
    d = F.col(x) - F.lag(x).over(Window.partitionBy(key).orderBy(order))
    w = _window(n, key, order)
    known = df.withColumn("__d", d)
    gain, loss = (_full(F.avg(F.greatest(s * F.col("__d"), F.lit(0.0))).over(w), "__d", n, w) for s in (1, -1))
    rsi = F.when(loss > 0, 100 - 100 / (1 + gain / loss)).when(gain > 0, 100.0)
    known = known.withColumn("rsi", rsi).drop("__d")
    return known.withColumn("signal", F.when(F.col("rsi") < low, 1).when(F.col("rsi") > high, -1).otherwise(0))


class Machine:
    """Position, entry and days held of one key; ``leave`` says whether and how an open position goes."""

    def __init__(self, hold: int, columns: list[str], keep: list[str]):
        self.hold, self.columns, self.keep = hold, columns, keep
        self.position, self.entry, self.held, self.first = 0.0, 0.0, 0, True

    def leave(self, v: tuple) -> None:
        raise NotImplementedError

    def flat(self) -> None:
        self.position, self.held = 0.0, 0

    def step(self, signal: float, v: tuple) -> float:
        if self.first:  # the first row of a key has no position
            self.first = False
            return 0.0
        if self.position:
            self.held += 1
            if self.held >= self.hold:
                self.flat()
            else:
                self.leave(v)
        if not self.position and signal:
            self.position, self.entry, self.held = float(signal), v[0], 0
        return self.position

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        signal = np.nan_to_num(rows["signal"].to_numpy(float))
        values = zip(*[rows[c].to_numpy(float) for c in self.columns], strict=True)
        position = [self.step(s, v) for s, v in zip(signal, values, strict=True)]
        return rows[self.keep].assign(position=np.array(position, float))


class BandMachine(Machine):
    """Half of the position goes each row at which the price is back at the mean; all of it beyond the stop."""

    def __init__(self, hold: int, keep: list[str], partial: bool, stop: float):
        super().__init__(hold, ["close", "mean", "dev"], keep)
        self.partial, self.stop = partial, stop

    def leave(self, v: tuple) -> None:
        close, mean, dev = v
        back = close >= mean if self.position > 0 else close <= mean
        if self.partial and back:
            self.position /= 2
        elif close < self.entry - self.stop * dev if self.position > 0 else close > self.entry + self.stop * dev:
            self.flat()


class RsiMachine(Machine):
    """Left at the stop, a share of the entry, or when the RSI passes 50."""

    def __init__(self, hold: int, keep: list[str], stop: float):
        super().__init__(hold, ["close", "rsi"], keep)
        self.stop = stop

    def leave(self, v: tuple) -> None:
        close, rsi = v
        if self.position > 0:
            gone = close < self.entry * (1 - self.stop) or rsi > 50
        else:
            gone = close > self.entry * (1 + self.stop) or rsi < 50
        if gone:
            self.flat()


class TimedMachine(Machine):
    """Left after its days only."""

    def __init__(self, hold: int, keep: list[str]):
        super().__init__(hold, ["close"], keep)

    def leave(self, v: tuple) -> None:
        pass


class CurveMachine(Machine):
    """Left when z moves against the entry by the stop, or after its days; a row that leaves enters nothing."""

    def __init__(self, hold: int, keep: list[str], stop: float):
        super().__init__(hold, ["z"], keep)
        self.stop = stop

    def step(self, signal: float, v: tuple) -> float:
        z = v[0]
        if self.position:
            self.held += 1
            against = z < self.entry - self.stop if self.position > 0 else z > self.entry + self.stop
            if against or self.held >= self.hold:
                self.flat()
            return self.position
        if signal:
            self.position, self.entry, self.held = float(signal), z, 0
        return self.position


def _run(df: DataFrame, make, columns: list[str], key: str, order: str) -> DataFrame:
    keep = [key, order, *[c for c in ("close", "ret") if c in df.columns]]
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", position double"
    read = df.select(*dict.fromkeys([*keep, "signal", *columns]))
    return carried(read, [key], [order], lambda: make(keep), schema)


def band_positions(prices: DataFrame, n: int = 20, deviations: float = 2.0, hold: int = 5, partial: bool = False, stop: float = 3.0, key: str = "ticker", order: str = "date") -> DataFrame:
    """Positions of the band strategy with a stop of so many deviations and, if asked, partial exits at the mean."""
    return _run(bands(prices, n, deviations, key=key, order=order), lambda keep: BandMachine(hold, keep, partial, stop), ["close", "mean", "dev"], key, order)


def rsi_positions(prices: DataFrame, n: int = 14, high: float = 70, low: float = 30, hold: int = 5, stop: float = 0.05, key: str = "ticker", order: str = "date") -> DataFrame:
    return _run(simple_rsi(prices, n, high, low, key=key, order=order), lambda keep: RsiMachine(hold, keep, stop), ["close", "rsi"], key, order)


def hurst_positions(prices: DataFrame, hurst: DataFrame, below: float = 0.4, n: int = 20, deviations: float = 2.0, hold: int = 5, key: str = "ticker", order: str = "date") -> DataFrame:
    """The band signals of rows whose Hurst exponent (key, order, hurst) is below a bound."""
    known = bands(prices, n, deviations, key=key, order=order).join(hurst.select(key, order, F.col("hurst").alias("__h")), [key, order], "left")
    known = known.withColumn("signal", F.when(F.col("__h") < below, F.col("signal")).otherwise(0))
    return _run(known, lambda keep: TimedMachine(hold, keep), ["close"], key, order)


def term_structure(front: DataFrame, back: DataFrame, n: int = 60, threshold: float = 1.5, hold: int = 20, stop: float = 3.0, key: str = "ticker", order: str = "date") -> DataFrame:
    """Positions in the front contract (the back one's are the opposite) by the z-score of back over front, and the return they make.

    front, back: key, order, close. Long the front where the curve is steep
    beyond the threshold, short where it is inverted; the first n rows stay flat."""
    both = front.select(key, order, F.col("close").alias("front")).join(back.select(key, order, F.col("close").alias("back")), [key, order]).withColumn("ratio", F.try_divide("back", "front"))
    w, along = _window(n, key, order), Window.partitionBy(key).orderBy(order)
    z = F.try_divide(F.col("ratio") - F.avg("ratio").over(w), F.stddev_samp("ratio").over(w))
    known = both.withColumn("z", _full(z, "ratio", n, w)).withColumn("__i", F.row_number().over(along))
    signal = F.when(F.col("__i") <= n, 0).when(F.col("z") > threshold, 1).when(F.col("z") < -threshold, -1).otherwise(0)
    placed = _run(known.withColumn("signal", signal), lambda keep: CurveMachine(hold, keep, stop), ["z"], key, order)
    made = both.join(placed, [key, order])
    change = {c: F.try_divide(c, F.lag(c).over(along)) - 1 for c in ("front", "back")}
    held = F.lag("position").over(along)
    return made.select(key, order, "ratio", "position", (held * (change["front"] - change["back"])).alias("strategy_return"))
