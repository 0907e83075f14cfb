"""Entropies of the messages of a bar, against loops as published and, for the query, its SQL."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars
from tickloom.plans import catalog, portfolio_queries as plans

START = dt.datetime(2024, 1, 1)


def shannon(m):
    return -sum(m.count(c) / len(m) * math.log2(m.count(c) / len(m)) for c in set(m))


def lempel_ziv(m):
    library, i = [m[0]], 1
    while i < len(m):
        for j in range(i, len(m)):
            if m[i : j + 1] not in library:
                library.append(m[i : j + 1])
                break
        i = j + 1
    return len(library) / len(m)


def konto(m):
    total, points = 0.0, range(1, len(m) // 2 + 1)
    for i in points:
        longest = 0
        for length in range(i):
            if any(m[j : j + length + 1] == m[i : i + length + 1] for j in range(i)):
                longest = len(m[i : i + length + 1])
        total += math.log2(i + 1) / (longest + 1)
    return total / len(points) if points else 0.0


def entropies(m):
    return [shannon(m), shannon(m[:-1]) if m[:-1] else 0.0, lempel_ziv(m), konto(m)]


def nearest(x, edges):
    """The first of the edges that are as near as any; the first of all where none is (NaN, infinite or no x)."""
    far = [abs(x - e) if x is not None and math.isfinite(x) else 0.0 for e in edges]
    return chr(far.index(min(far)))


def messages(prices, volumes, volume_edges, return_edges):
    """Of each tick of a symbol: its three letters."""
    out, side = [], "c"
    for k, (p, v) in enumerate(zip(prices, volumes, strict=True)):
        before = prices[k - 1] if k else p
        side = "a" if p > before else "b" if p < before else side
        change = 0.0 if not k else math.nan if p == before == 0 else math.inf if before == 0 else -math.inf if p == 0 else math.log(p) - math.log(before)
        out.append((side, nearest(v, volume_edges), nearest(change, return_edges)))
    return out


def test_query_has_the_entropies_of_its_sql_and_of_loops(spark, tmp_path):
    import duckdb

    rng, rows, want = random.Random(5), [], {}
    for s in "abc":
        prices = [0.0 if rng.random() < 0.05 else round(math.exp(rng.choice([0, 0, 1, 2, -2, 5])), 2) for _ in range(90)]
        # 10 and 20 lie between two edges; a volume may be missing.
        volumes = [rng.choice([None, 0.0, 10.0, 20.0, 20.0, 47.0, 99.0]) for _ in prices]
        rows += [(1000 * ord(s) + k, START + dt.timedelta(minutes=k), k, s, p, "{}" if v is None else '{"k": %d}' % v) for k, (p, v) in enumerate(zip(prices, volumes, strict=True))]
        letters = messages(prices, volumes, plans.VOLUME_EDGES, plans.RETURN_EDGES)
        for b in range(4):
            want[s, b] = [x for m in zip(*letters[20 * b : 20 * b + 20], strict=True) for x in entropies("".join(m))]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    made = catalog.QUERIES["bar_micro_features"](spark, str(tmp_path))
    names = [f"{m}_{e}" for m in ("tick", "volume", "return") for e in ("shannon", "plug_in", "lempel_ziv", "konto")]
    assert made.columns[-13:] == ["date_time", *names]
    got = sorted(made.collect())
    assert {(r.symbol, r.bar_id): [r[n] for n in names] for r in got} == {k: pytest.approx(v, abs=6e-5) for k, v in want.items()}
    assert all(r.date_time == START + dt.timedelta(minutes=20 * r.bar_id + 19) for r in got)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    truth = con.sql(catalog.SQL["bar_micro_features"])
    assert truth.columns == made.columns
    assert [repr(tuple(r)) for r in got] == list(map(repr, sorted(truth.fetchall())))


def test_bars_of_any_length(spark):
    rng = random.Random(6)
    prices, volumes = [float(rng.randint(1, 4)) for _ in range(100)], [float(rng.randint(0, 300)) for _ in range(100)]
    rows = [("s", START + dt.timedelta(minutes=37 * k), k, p, v) for k, (p, v) in enumerate(zip(prices, volumes, strict=True))]
    edges = [float(k) for k in range(256)]
    ticks = bars.with_changes(spark.createDataFrame(rows[::-1], "symbol string, ts timestamp_ntz, seq long, price double, volume double"))
    # Bars of 1, 3, 5 ... 19 ticks.
    numbered = ticks.withColumn("bar_id", F.floor(F.sqrt("i")))
    got = {r.bar_id: r for r in bars.with_entropies(bars.ohlcv(numbered, more=bars.flow_features(numbered, edges, [-1.0, 0.0, 1.0]))).collect()}
    letters = messages(prices, volumes, edges, [-1.0, 0.0, 1.0])
    assert len(got) == 10
    for b, r in got.items():
        for name, m in zip(("tick", "volume", "return"), zip(*letters[b * b : (b + 1) ** 2], strict=True), strict=True):
            assert [r[f"{name}_{e}"] for e in plans.ENTROPIES] == pytest.approx(entropies("".join(m)), abs=1e-9), (b, m)
    assert [got[0][f"tick_{e}"] for e in plans.ENTROPIES] == [0.0, 0.0, 1.0, 0.0]
    plain = bars.with_entropies(bars.ohlcv(numbered, more=bars.flow_features(numbered)))
    assert [c for c in plain.columns if c.endswith(plans.ENTROPIES)] == [f"tick_{e}" for e in plans.ENTROPIES]
    for wrong in ([], [0.0] * 257):
        with pytest.raises(ValueError, match="edges"):
            bars.flow_features(numbered, wrong)
