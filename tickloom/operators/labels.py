"""Event filters, labels, sample weights and purged folds, over symbol, ts, close.

Everything that counts overlaps is a sweep: +1 where an interval starts, -1
behind its end, and prefix sums; no interval is joined with the bars in it.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .carried import carried
from .joins import asof


def _w(order: str = "ts") -> Window:
    return Window.partitionBy("symbol").orderBy(order)


class Cusum:
    """The two sums and the last value of one symbol."""

    def __init__(self, h: float):
        self.h, self.up, self.down, self.last = h, 0.0, 0.0, None

    def step(self, value: float) -> bool:
        """Whether the next value fires. A gap adds nothing, and so does the step after it."""
        d = 0.0 if self.last is None or value is None or np.isnan(value) or np.isnan(self.last) else value - self.last
        self.last = value
        return self.move(d)

    def move(self, d: float) -> bool:
        """Whether a change fires; the down side is tested first."""
        self.up, self.down = max(0.0, self.up + d), min(0.0, self.down + d)
        if self.down < -self.h:
            self.down = 0.0
            return True
        if self.up > self.h:
            self.up = 0.0
            return True
        return False

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        fired = [self.step(v) for v in rows["close"].astype(float)]
        return rows.loc[fired, ["symbol", "ts"]]


def cusum_steps(steps, h: float):
    """For each change whether the CUSUM fires."""
    held = Cusum(h)
    for d in steps:
        yield held.move(d)


def cusum_events(bars: DataFrame, h: float) -> DataFrame:
    """symbol, ts of the bars at which the symmetric CUSUM of close changes fires (a recurrence per symbol, in sorted batches)."""
    read = bars.select("symbol", "ts", "close")
    kinds = dict(read.dtypes)
    return carried(read, ["symbol"], ["ts"], lambda: Cusum(h), f"symbol {kinds['symbol']}, ts {kinds['ts']}")


def vertical_barrier(events: DataFrame, bars: DataFrame, seconds: int) -> DataFrame:
    """t1: the first bar at or after t0 plus the horizon; events past the end are dropped."""
    due = events.withColumn("due", F.timestamp_seconds(F.unix_timestamp(F.col("t0").cast("timestamp")) + seconds).cast("timestamp_ntz"))
    found = asof(due, bars.select("symbol", F.col("ts").alias("t1")), "symbol", "due", "t1", "forward")
    return found.where("t1 IS NOT NULL").drop("due")


def triple_barrier(bars: DataFrame, rows: int, pt: float, sl: float, target: str = "trgt", least: float = 0.0) -> DataFrame:
    """First touch within the next ``rows`` bars of every bar whose target exceeds ``least``.

    Frames of bounded length are folded in place: no join of events and bars.
    pt, sl: multiples of the target (0 or less: no barrier); bin: 1, -1 or 0.
    """
    ahead = _w().rowsBetween(0, rows)
    path = F.collect_list(F.struct("ts", "close")).over(ahead)
    seen = bars.withColumn("__path", path).where((F.col(target) > least) & (F.size("__path") > 1))
    change = F.transform("__path", lambda p: F.struct(p["ts"].alias("ts"), (F.try_divide(p["close"], F.col("close")) - 1).alias("r")))
    seen = seen.withColumn("__r", change)

    def first(condition) -> Column:
        return F.get(F.filter("__r", condition), F.lit(0))

    up = first(lambda p: p["r"] > pt * F.col(target)) if pt > 0 else F.lit(None).cast("struct<ts:timestamp_ntz,r:double>")
    down = first(lambda p: p["r"] < -sl * F.col(target)) if sl > 0 else F.lit(None).cast("struct<ts:timestamp_ntz,r:double>")
    end = F.element_at("__r", -1)
    touched = seen.withColumn("__u", up).withColumn("__d", down).withColumn("__e", end)
    t1 = F.least("__u.ts", "__d.ts", "__e.ts")
    ret = F.when(F.col("__u.ts") == t1, F.col("__u.r")).when(F.col("__d.ts") == t1, F.col("__d.r")).otherwise(F.col("__e.r"))
    bin_ = F.when(F.col("__u.ts") == t1, 1).when(F.col("__d.ts") == t1, -1).otherwise(0)
    return touched.select("symbol", F.col("ts").alias("t0"), t1.alias("t1"), ret.alias("ret"), F.col(target).alias("trgt"), bin_.alias("bin"))


def triple_barrier_days(bars: DataFrame, days: int, pt: float, sl: float, target: str = "trgt", least: float = 0.0, skip: int = 0) -> DataFrame:
    """symbol, t0, t1, trgt: the first touch of a barrier by the bars whose target exceeds ``least``, but for the first ``skip`` of a symbol.

    The vertical barrier is the first bar ``days`` calendar days or more after
    t0; near the end of the data, where there is none, only touches count, and
    events without one are left out. A frame of those days is folded in place.
    """
    seconds = days * 86_400
    numbered = bars.withColumn("__i", F.row_number().over(_w())).withColumn("__s", F.unix_timestamp(F.col("ts").cast("timestamp")))
    ahead = Window.partitionBy("symbol").orderBy("__s").rangeBetween(0, seconds)
    seen = numbered.withColumn("__path", F.collect_list(F.struct("ts", "close")).over(ahead)).where((F.col("__i") > skip) & (F.col(target) > least))
    due = vertical_barrier(seen.select("symbol", F.col("ts").alias("t0")), bars, seconds).select("symbol", F.col("t0").alias("ts"), F.col("t1").alias("__v"))
    closes = bars.select("symbol", F.col("ts").alias("__v"), F.col("close").alias("__vc"))
    known = seen.join(due.join(closes, ["symbol", "__v"]), ["symbol", "ts"], "left")
    # The barrier's bar may lie beyond the frame, where no bar is due on the day.
    later = F.col("__v").isNotNull() & (F.col("__v") > F.element_at("__path", -1)["ts"])
    path = F.when(later, F.concat("__path", F.array(F.struct(F.col("__v").alias("ts"), F.col("__vc").alias("close"))))).otherwise(F.col("__path"))

    def first(condition) -> Column:
        return F.get(F.filter(path, condition), F.lit(0))["ts"]

    up = first(lambda p: p["close"] / F.col("close") - 1 > pt * F.col(target)) if pt > 0 else F.lit(None)
    down = first(lambda p: p["close"] / F.col("close") - 1 < -sl * F.col(target)) if sl > 0 else F.lit(None)
    touched = known.withColumn("t1", F.least(up.cast("timestamp_ntz"), down.cast("timestamp_ntz"), "__v"))
    return touched.where("t1 IS NOT NULL").select("symbol", F.col("ts").alias("t0"), "t1", F.col(target).alias("trgt"))


def outcomes(events: DataFrame, bars: DataFrame, pt: float, sl: float, side: str | None = None) -> DataFrame:
    """symbol, t0, t1, ret, trgt, bin of events (symbol, t0, t1, trgt) that have a t1.

    The log return from t0 to t1 is held against pt and -sl targets: bin 1, -1,
    or 0 between.  With a side it is that times the side, and bin 0 unless it
    earns.  ret is the simple return that this makes.
    """
    extra = [side] if side else []
    ends = _ends(bars, events.select("symbol", "t0", "t1", "trgt", *extra).where(F.col("t1").isNotNull()), ["close"])
    r = F.ln(F.try_divide("close_1", "close_0")) * (F.col(side) if side else 1)
    known = ends.withColumn("__r", r)
    bin_ = F.when((F.col("__r") > 0) & (F.col("__r") > pt * F.col("trgt")), 1).when((F.col("__r") < 0) & (F.col("__r") < -sl * F.col("trgt")), -1).otherwise(0)
    if side:
        bin_ = F.when(F.col("__r") <= 0, 0).otherwise(bin_)
    return known.select("symbol", "t0", "t1", *extra, F.expm1("__r").alias("ret"), "trgt", bin_.alias("bin"))


def meta_labels(events: DataFrame, bars: DataFrame, pt: float, sl: float) -> DataFrame:
    """Outcomes without a side give the side; outcomes with it give the meta labels."""
    sided = outcomes(events, bars, pt, sl).withColumnRenamed("bin", "side")
    return outcomes(sided, bars, pt, sl, "side")


def previous_day(bars: DataFrame) -> DataFrame:
    """symbol, ts, close, and the time and close of the last bar older than a day before (rows without one are left out)."""
    due = bars.select("symbol", "ts", "close", (F.col("ts") - F.expr("INTERVAL '1 00:00:00.000001' DAY TO SECOND")).alias("due"))
    right = bars.select("symbol", F.col("ts").alias("prev_ts"), F.col("close").alias("prev_close"))
    return asof(due, right, "symbol", "due", "prev_ts").where("prev_ts IS NOT NULL").drop("due")


def ewm_std(df: DataFrame, x: str, span: int, name: str, key: str = "symbol", order: str = "ts") -> DataFrame:
    """Exponentially weighted deviation (all history, corrected for bias) of a key's values."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        return group.assign(**{name: group[x].astype(float).ewm(span=span).std()})

    return df.groupBy(key).applyInPandas(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def daily_volatility(bars: DataFrame, span: int = 100) -> DataFrame:
    """symbol, ts, trgt: deviation of returns over a day or more, the target of barriers."""
    r = previous_day(bars).select("symbol", "ts", (F.try_divide("close", "prev_close") - 1).alias("r"))
    return ewm_std(r, "r", span, "trgt").select("symbol", "ts", "trgt")


def z_score_events(bars: DataFrame, mean_rows: int, std_rows: int, z: float = 3.0) -> DataFrame:
    """Bars whose close is at least z rolling deviations above its rolling mean."""

    def over(n: int, agg: Column) -> Column:
        w = _w().rowsBetween(-(n - 1), 0)
        return F.when(F.count("close").over(w) == n, agg.over(w))

    level = over(mean_rows, F.avg("close")) + z * over(std_rows, F.stddev_samp("close"))
    return bars.select("symbol", "ts", "close", level.alias("level")).where(F.col("close") >= F.col("level"))


def label_balance(labels: DataFrame) -> DataFrame:
    """bin, n and share of each label; labels are few."""
    n = labels.groupBy("bin").agg(F.count("*").alias("n"))
    return n.select("bin", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def drop_rare_labels(labels: DataFrame, least: float = 0.05) -> DataFrame:
    """Rows without the rarest label, again and again while it has at most ``least`` of the rest and three labels are left."""
    counts = {r["bin"]: r["n"] for r in labels.where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n")).collect()}  # one row a label
    while len(counts) >= 3:
        rarest = min(counts, key=lambda k: (counts[k], k))
        if counts[rarest] / sum(counts.values()) > least:
            break
        del counts[rarest]
    return labels.where(F.col("bin").isin(list(counts)))


def tail_sets(bars: DataFrame, rows: int = 20) -> DataFrame:
    """1 in the top tenth, -1 in the bottom tenth of a time's log returns over their rolling deviation, else 0."""
    r = F.ln("close") - F.ln(F.lag("close").over(_w()))
    w = _w().rowsBetween(-(rows - 1), 0)
    known = bars.withColumn("__r", r).withColumn("adjusted", F.when(F.count("__r").over(w) == rows, F.try_divide("__r", F.stddev_samp("__r").over(w)))).where("adjusted IS NOT NULL")
    edges = known.groupBy("ts").agg(F.percentile("adjusted", F.array(F.lit(0.1), F.lit(0.9))).alias("__e"))
    joined = known.join(edges, "ts")
    label = F.when(F.col("adjusted") <= F.get("__e", F.lit(0)), -1).when(F.col("adjusted") > F.get("__e", F.lit(1)), 1).otherwise(0)
    return joined.select("symbol", "ts", "adjusted", label.alias("label"))


def indicator_pairs(bars: DataFrame, events: DataFrame) -> DataFrame:
    """symbol, t0, ts: each bar that an event spans, by the numbers of its first and last bar (no range join)."""
    numbered = bars.select("symbol", "ts", F.row_number().over(_w()).alias("i"))
    ends = _ends(numbered, events.select("symbol", "t0", "t1"), ["i"]).select("symbol", "t0", F.explode(F.sequence("i_0", "i_1")).alias("i"))
    return ends.join(numbered, ["symbol", "i"]).select("symbol", "t0", "ts")


def fixed_horizon(bars: DataFrame, rows: int, threshold: float) -> DataFrame:
    """Sign of the return over the next rows, 0 inside the threshold, NULL at the end."""
    r = F.try_divide(F.lead("close", rows).over(_w()), F.col("close")) - 1
    known = bars.withColumn("fwd", r)
    return known.withColumn("label", F.when(F.col("fwd") > threshold, 1).when(F.col("fwd") < -threshold, -1).when(F.col("fwd").isNotNull(), 0))


def _ranked(t: Column, n: int) -> Column:
    """By size, then the shorter horizon."""
    return F.struct(F.abs(t).alias("a"), F.lit(-n).alias("n"), t.alias("t"))


def trend_labels(bars: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """The horizon with the largest t-statistic of a linear trend ahead (ties: the shortest), its last bar t1, its t value and sign.

    Closed form from three forward sums per horizon, centred on the first close.
    """
    longest = max(horizons)
    ahead = _w().rowsBetween(0, longest - 1)
    seen = bars.withColumn("__p", F.collect_list("close").over(ahead)).withColumn("__at", F.collect_list("ts").over(ahead)).where(F.size("__p") == longest)

    def t_value(n: int) -> Column:
        y = F.transform(F.slice("__p", 1, n), lambda v, k: F.struct((v - F.col("close")).alias("y"), k.cast("double").alias("k")))
        sums = F.aggregate(y, F.struct(F.lit(0.0).alias("y"), F.lit(0.0).alias("ky"), F.lit(0.0).alias("yy")), lambda s, x: F.struct((s["y"] + x["y"]).alias("y"), (s["ky"] + x["k"] * x["y"]).alias("ky"), (s["yy"] + x["y"] * x["y"]).alias("yy")))
        sxx = n * (n * n - 1) / 12

        def value(s: Column) -> Column:
            beta = (s["ky"] - (n - 1) / 2 * s["y"]) / sxx
            sse = s["yy"] - s["y"] * s["y"] / n - beta * beta * sxx
            return F.when(sse > 1e-9, beta / F.sqrt(sse / ((n - 2) * sxx))).otherwise(0.0)

        return F.element_at(F.transform(F.array(sums), lambda s: _ranked(value(s), n)), 1)

    scored = seen.withColumn("__t", F.array(*[t_value(n) for n in horizons]))
    best = F.array_max("__t")
    return scored.select("symbol", "ts", F.get("__at", (-best["n"]).cast("int") - 1).alias("t1"), (-best["n"]).alias("horizon"), best["t"].alias("t_value"), F.sign(best["t"]).cast("int").alias("label"))


def concurrency(bars: DataFrame, events: DataFrame) -> DataFrame:
    """bars with c, the number of events (symbol, t0, t1, both ends included) alive at each bar."""
    changes = events.select("symbol", F.col("t0").alias("ts"), F.lit(1).alias("__n"), F.lit(0).alias("__k")).unionByName(events.select("symbol", F.col("t1").alias("ts"), F.lit(-1).alias("__n"), F.lit(2).alias("__k")))
    changes = changes.groupBy("symbol", "ts", "__k").agg(F.sum("__n").alias("__n"))
    rows = bars.select("*", F.lit(0).cast("long").alias("__n"), F.lit(1).alias("__k"))
    both = rows.unionByName(changes, allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("ts", "__k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("c", F.sum("__n").over(w)).where("__k = 1").drop("__n", "__k")


def _ends(bars: DataFrame, events: DataFrame, columns: list[str]) -> DataFrame:
    a = bars.select("symbol", F.col("ts").alias("t0"), *[F.col(c).alias(f"{c}_0") for c in columns])
    b = bars.select("symbol", F.col("ts").alias("t1"), *[F.col(c).alias(f"{c}_1") for c in columns])
    return events.join(a, ["symbol", "t0"]).join(b, ["symbol", "t1"])


def average_uniqueness(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Mean of 1 / c over each event's bars, by prefix sums; t0 and t1 are bar times."""
    w = _w().rowsBetween(Window.unboundedPreceding, 0)
    share = F.when(F.col("c") > 0, F.lit(1.0) / F.col("c")).otherwise(0.0)
    known = concurrency(bars, events).withColumn("__s", share).withColumn("p", F.sum("__s").over(w)).withColumn("i", F.row_number().over(_w()))
    ends = _ends(known.withColumn("q", F.col("p") - F.col("__s")), events, ["p", "q", "i"])
    return ends.select("symbol", "t0", "t1", ((F.col("p_1") - F.col("q_0")) / (F.col("i_1") - F.col("i_0") + 1)).alias("uniqueness"))


def weights_by_return(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Absolute sum of log returns shared among concurrent events, scaled to the number of events of the symbol."""
    w = _w().rowsBetween(Window.unboundedPreceding, 0)
    r = F.coalesce(F.log("close") - F.log(F.lag("close").over(_w())), F.lit(0.0))
    known = concurrency(bars, events).withColumn("__r", r).withColumn("__s", F.when(F.col("c") > 0, F.col("__r") / F.col("c")).otherwise(0.0))
    known = known.withColumn("p", F.sum("__s").over(w)).withColumn("q", F.col("p") - F.col("__s"))
    raw = _ends(known, events, ["p", "q"]).select("symbol", "t0", "t1", F.abs(F.col("p_1") - F.col("q_0")).alias("raw"))
    whole = Window.partitionBy("symbol")
    return raw.select("symbol", "t0", "t1", F.try_divide(F.col("raw") * F.count("*").over(whole), F.sum("raw").over(whole)).alias("weight"))


def weights_by_time(uniqueness: DataFrame, decay: float) -> DataFrame:
    """Piecewise linear decay along cumulative uniqueness, newest weight 1."""
    w = Window.partitionBy("symbol").orderBy("t0", "t1").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("uniqueness").over(Window.partitionBy("symbol"))
    slope = (1 - decay) / F.col("__all") if decay >= 0 else 1 / ((decay + 1) * F.col("__all"))
    known = uniqueness.withColumn("__c", F.sum("uniqueness").over(w)).withColumn("__all", total)
    return known.select("symbol", "t0", "t1", F.greatest(F.lit(0.0), 1 - slope * F.col("__all") + slope * F.col("__c")).alias("weight"))


def purged_folds(events: DataFrame, folds: int, embargo: float = 0.0) -> DataFrame:
    """symbol, t0, t1, fold, role: contiguous test folds; train rows that overlap the test span (with its embargo) are left out."""
    w = Window.partitionBy("symbol").orderBy("t0", "t1")
    numbered = events.withColumn("own", F.ntile(folds).over(w)).withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    spans = numbered.groupBy("symbol", F.col("own").alias("fold")).agg(F.min("t0").alias("a"), F.max("t1").alias("b"), F.max("i").alias("last"))
    step = F.floor(F.col("n") * embargo)
    each = numbered.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds)))).join(spans, ["symbol", "fold"])
    held = (F.col("i") > F.col("last")) & (F.col("i") <= F.col("last") + step)
    overlaps = (F.col("t0") <= F.col("b")) & (F.col("a") <= F.col("t1"))
    role = F.when(F.col("own") == F.col("fold"), "test").when(~overlaps & ~held, "train")
    return each.withColumn("role", role).where("role IS NOT NULL").select("symbol", "t0", "t1", "fold", "role")


def combinatorial_folds(events: DataFrame, groups: int, test_groups: int) -> DataFrame:
    """All choices of test groups; train rows that overlap any chosen group are left out."""
    choices = list(itertools.combinations(range(1, groups + 1), test_groups))
    w = Window.partitionBy("symbol").orderBy("t0", "t1")
    numbered = events.withColumn("own", F.ntile(groups).over(w))
    spans = numbered.groupBy("symbol", "own").agg(F.min("t0").alias("a"), F.max("t1").alias("b"))
    spans = spans.groupBy("symbol").agg(F.collect_list(F.struct("own", "a", "b")).alias("spans"))  # a row per group
    split = F.explode(F.array(*[F.struct(F.lit(k).alias("split"), F.array(*map(F.lit, c)).alias("test")) for k, c in enumerate(choices)]))
    each = numbered.join(spans, "symbol").select("symbol", "t0", "t1", "own", "spans", split.alias("s"))
    hit = F.exists("spans", lambda x: F.array_contains(F.col("s.test"), x["own"]) & (F.col("t0") <= x["b"]) & (x["a"] <= F.col("t1")))
    role = F.when(F.array_contains("s.test", F.col("own")), "test").when(~hit, "train")
    return each.withColumn("role", role).where("role IS NOT NULL").select("symbol", "t0", "t1", F.col("s.split").alias("split"), "role")


def active_signals(signals: DataFrame, x: str = "signal") -> DataFrame:
    """Mean of the signals alive at each start or end time, 0 if none is."""
    steps = signals.select("symbol", F.col("t0").alias("ts"), F.col(x).alias("s"), F.lit(1).alias("n")).unionByName(signals.select("symbol", F.col("t1").alias("ts"), (-F.col(x)).alias("s"), F.lit(-1).alias("n")))
    summed = steps.groupBy("symbol", "ts").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    known = summed.withColumn("s", F.sum("s").over(w)).withColumn("n", F.sum("n").over(w))
    return known.select("symbol", "ts", F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("signal"))


def discrete(signal: Column, step: float) -> Column:
    """Rounded half-even to steps, within -1 and 1."""
    return F.greatest(F.least(F.rint(signal / step) * step, F.lit(1.0)), F.lit(-1.0))
