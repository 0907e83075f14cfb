"""Rolling primitives over (key, ordered rows), named and staged.

Spark allows no window function inside another one.  A :class:`Frame` therefore
gives every windowed value a column of its own, once per distinct expression,
in the first stage in which its inputs exist; an :class:`X` is an expression
over such columns.  All stages partition by the same key, so a chain of them
costs one exchange.

Rules (all inputs DOUBLE): a window of n rows is NULL until it has n non-null
values; division by zero is NULL; ranks average their ties; comparisons and
ranks see values rounded to eight digits, so that float noise makes no order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from .dialect import Spark


def _sql(x) -> str:
    return x.sql if isinstance(x, X) else f"CAST({float(x)!r} AS DOUBLE)"


#: Keeps exact halves off the edge of rounding, where the order of a sum would decide.
NUDGE = 0.001953125
#: Comparisons and ranks see whole numbers of 1e-8.
_R = "round({} * CAST(1e8 AS DOUBLE), 0)"


def _stage(*xs) -> int:
    return max((x.stage for x in xs if isinstance(x, X)), default=0)


class X:
    """An expression over columns that exist from ``stage`` on."""

    def __init__(self, frame: Frame, sql: str, stage: int = 0):
        self.frame, self.sql, self.stage = frame, sql, stage

    def _of(self, template: str, *others) -> X:
        return X(self.frame, template.format(*map(_sql, (self, *others))), _stage(self, *others))

    def __add__(self, o): return self._of("({} + {})", o)
    def __radd__(self, o): return self._of("({1} + {0})", o)
    def __sub__(self, o): return self._of("({} - {})", o)
    def __rsub__(self, o): return self._of("({1} - {0})", o)
    def __mul__(self, o): return self._of("({} * {})", o)
    def __rmul__(self, o): return self._of("({1} * {0})", o)
    def __truediv__(self, o): return self._of("({} / nullif({}, CAST(0 AS DOUBLE)))", o)
    def __rtruediv__(self, o): return self._of("({1} / nullif({0}, CAST(0 AS DOUBLE)))", o)
    def __neg__(self): return self._of("(-{})")
    def __lt__(self, o): return self._of(f"({_R} < {_R})", o)
    def __gt__(self, o): return self._of(f"({_R} > {_R})", o)
    def __le__(self, o): return self._of(f"({_R} <= {_R})", o)
    def __ge__(self, o): return self._of(f"({_R} >= {_R})", o)
    def eq(self, o): return self._of(f"({_R} = {_R})", o)
    def __and__(self, o): return self._of("({} AND {})", o)
    def __or__(self, o): return self._of("({} OR {})", o)

    def abs(self): return self._of("abs({})")
    def sign(self): return self._of("CAST(sign({}) AS DOUBLE)")
    def log(self): return self._of("ln(CASE WHEN {0} > 0 THEN {0} END)")
    def exp(self): return self._of("exp({})")
    def sqrt(self): return self._of("sqrt(CASE WHEN {0} >= 0 THEN {0} END)")
    def fill(self, v): return self._of("coalesce({}, {})", v)
    def zero_as(self, v): return self._of("(CASE WHEN {0} = 0 THEN {1} ELSE {0} END)", v)

    def power(self, o) -> X:
        return self._of("(CASE WHEN {0} > 0 OR ({0} = 0 AND {1} > 0) OR ({0} < 0 AND {1} = floor({1})) THEN power({0}, {1}) END)", o)

    def flag(self) -> X:
        """1 or 0; an unknown comparison is 0."""
        return self._of("(CASE WHEN {} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)")


def where(condition: X, yes, no) -> X:
    return condition._of("(CASE WHEN {} THEN {} ELSE {} END)", yes, no)


def greatest(a: X, b) -> X:
    """NULL if either side is."""
    return where(a < b, b, where(a >= b, a, a * b))


def least(a: X, b) -> X:
    return where(a > b, b, where(a <= b, a, a * b))


class Frame:
    """Stages of named columns over a base relation with the columns key and order."""

    def __init__(self, columns: list[str], key: str = "ticker", order: str = "date", dialect=Spark):
        self.columns, self.key, self.order, self.d = columns, key, order, dialect
        self.stages: list[dict[str, str]] = []
        self.known: dict[str, X] = {}
        self.recursive: dict[str, tuple[str, float]] = {}

    def __getitem__(self, name: str) -> X:
        if name not in self.columns:
            raise KeyError(name)
        return X(self, f"CAST({name} AS DOUBLE)")

    def let(self, sql: str, stage: int) -> X:
        """The column for an expression, in the stage after ``stage``."""
        if sql not in self.known:
            while len(self.stages) <= stage:
                self.stages.append({})
            name = f"x{len(self.known)}"
            self.stages[stage][name] = sql
            self.known[sql] = X(self, name, stage + 1)
        return self.known[sql]

    def over(self, n: int | None = None, ahead: bool = False) -> str:
        base = f"PARTITION BY {self.key} ORDER BY {self.order}"
        if n is None:
            return base
        if ahead:
            return f"{base} ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING"
        return f"{base} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"

    def whole(self) -> str:
        return f"PARTITION BY {self.key}"

    # rolling

    def full(self, agg: str, n: int, *xs: X) -> X:
        """agg over n rows, NULL unless all inputs of all n rows are known."""
        x = " + ".join(f"0 * {v.sql}" for v in xs) if len(xs) > 1 else xs[0].sql
        w = self.over(n)
        return self.let(f"CASE WHEN count({x}) OVER ({w}) = {n} THEN {agg.format(*[v.sql for v in xs], w=w)} END", _stage(*xs))

    def sum(self, x: X, n: int) -> X: return self.full("sum({0}) OVER ({w})", n, x)
    def mean(self, x: X, n: int) -> X: return self.full("avg({0}) OVER ({w})", n, x)
    def min(self, x: X, n: int) -> X: return self.full("min({0}) OVER ({w})", n, x)
    def max(self, x: X, n: int) -> X: return self.full("max({0}) OVER ({w})", n, x)
    def std(self, x: X, n: int) -> X: return self.full("stddev_samp({0}) OVER ({w})", n, x)
    def std_pop(self, x: X, n: int) -> X: return self.full("stddev_pop({0}) OVER ({w})", n, x)
    def cov(self, x: X, y: X, n: int) -> X: return self.full("covar_samp({0}, {1}) OVER ({w})", n, x, y)

    def corr(self, x: X, y: X, n: int) -> X:
        sx, sy = self.std(x, n), self.std(y, n)
        return self.cov(x, y, n) / where((sx > 1e-9) & (sy > 1e-9), sx * sy, sx * 0.0)

    def product(self, x: X, n: int) -> X:
        """Of positive values (others are NULL)."""
        return self.sum(x.log(), n).exp()

    def lag(self, x: X, n: int = 1) -> X:
        return self.let(f"lag({x.sql}, {n}) OVER ({self.over()})", x.stage) if n else x

    def lead(self, x: X, n: int = 1) -> X:
        return self.let(f"lead({x.sql}, {n}) OVER ({self.over()})", x.stage)

    def delta(self, x: X, n: int = 1) -> X:
        return x - self.lag(x, n)

    def pct(self, x: X, n: int = 1) -> X:
        return x / self.lag(x, n) - 1.0

    def listed(self, x: X, n: int) -> X:
        r = x._of(_R)
        return self.let(f"CASE WHEN count({r.sql}) OVER ({self.over(n)}) = {n} THEN {self.d.listed(r.sql, self.over(n))} END", x.stage)

    def ts_rank(self, x: X, n: int) -> X:
        """Average rank, 1 to n, of the newest value."""
        items = self.listed(x, n)
        now = x._of(_R).sql
        less, same = self.d.count_if(items.sql, f"v < {now}"), self.d.count_if(items.sql, f"v = {now}")
        # Named at once, so that the array goes no further.
        return self.let(f"({less} + ({same} + 1) / CAST(2 AS DOUBLE))", items.stage)

    def argmax(self, x: X, n: int) -> X:
        """Place, 1 to n from the oldest, of the first largest value."""
        items = self.listed(x, n)
        return self.let(f"CAST({self.d.position_of_max(items.sql)} AS DOUBLE)", items.stage)

    def argmin(self, x: X, n: int) -> X:
        items = self.listed(x, n)
        return self.let(f"CAST({self.d.position_of_min(items.sql)} AS DOUBLE)", items.stage)

    def ffill(self, x: X) -> X:
        return self.let(self.d.last_known(x.sql, f"{self.over()} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"), x.stage)

    def bfill(self, x: X) -> X:
        return self.let(self.d.first_known(x.sql, f"{self.over()} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"), x.stage)

    def row_number(self) -> X:
        return self.let(f"CAST(row_number() OVER ({self.over()}) AS DOUBLE)", 0)

    def weighted(self, x: X, weights: list[float]) -> X:
        """Sum of weights[k] times the value k rows ago; NULL in the first rows."""
        total = x * weights[0]
        for k, w in enumerate(weights[1:], 1):
            total = total + self.lag(x, k) * w
        return total

    def decay(self, x: X, n: int) -> X:
        """Linear weights, newest heaviest, over values filled forward, then back, then with 0; the first rows keep their value."""
        filled = self.bfill(self.ffill(x)).fill(0.0)
        filled = self.let(filled.sql, filled.stage)
        smooth = self.weighted(filled, [2.0 * (n - k) / (n * (n + 1)) for k in range(n)])
        return where(self.row_number() < float(n), x, smooth)

    def wma(self, x: X, n: int, base: float | None = None) -> X:
        """Linear weights (or powers of base), NULL in the first rows."""
        w = [float(n - k) if base is None else base**k for k in range(n)]
        return self.weighted(x, [v / sum(w) for v in w])

    def slope(self, x: X, n: int) -> X:
        """Least-squares slope on 1..n over n rows."""
        mean = (n + 1) / 2
        sxx = n * (n * n - 1) / 12
        return self.weighted(x, [(n - k - mean) / sxx for k in range(n)])

    def beta_sequence(self, x: X, n: int) -> X:
        """Least-squares slope on 1..n through the origin over n rows."""
        return self.weighted(x, [(n - k) / (n * (n + 1) * (2 * n + 1) / 6) for k in range(n)])

    # over the key's whole history

    def total(self, x: X, agg: str = "sum") -> X:
        return self.let(f"{agg}({x.sql}) OVER ({self.whole()})", x.stage)

    def rank(self, x: X) -> X:
        """Average rank over the count of known values of the key's history."""
        v = self.let(_R.format(x.sql), x.stage)
        return self.let(
            f"CASE WHEN {v.sql} IS NOT NULL THEN (rank() OVER (PARTITION BY {self.key} ORDER BY {v.sql} NULLS LAST) + (count(*) OVER (PARTITION BY {self.key}, {v.sql}) - 1) / CAST(2 AS DOUBLE)) / count({v.sql}) OVER ({self.whole()}) END",
            v.stage,
        )

    def scale(self, x: X, k: float = 1.0) -> X:
        return x * k / self.total(x.abs())

    def neutralize(self, x: X, by: X) -> X:
        """Residual of a no-intercept regression on log(by) over the key's history, gaps of x filled."""
        filled = self.bfill(self.ffill(x))
        log = by.log()
        beta = self.total(filled * log) / self.total(log * log)
        return filled - beta * log

    def ewm(self, x: X, alpha: float, least: int = 0) -> X:
        """Recursive mean y = alpha x + (1 - alpha) y, from the first known value on; NULL until ``least`` values are known."""
        held = self.let(x.sql, x.stage)
        if least > 1:
            known = self.let(f"CAST(count({held.sql}) OVER ({self.over()} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)", held.stage)
            mean = self.ewm(x, alpha)
            return where(known >= float(least), mean, X(self, "CAST(NULL AS DOUBLE)"))
        name = f"{held.sql}_ewm_{round(alpha * 1e6)}"
        if name not in self.recursive:
            self.recursive[name] = (held.sql, alpha)
            while len(self.stages) <= held.stage:
                self.stages.append({})
            self.stages[held.stage][name] = ""
        return X(self, name, held.stage + 1)

    # results

    def final(self, outputs: dict[str, X], digits: int | dict[str, int] | None = None) -> dict[str, str]:
        """The outputs as columns; with digits (of all, or by name), rounded and without what no engine agrees on (for checks)."""
        clean = "CASE WHEN isnan({0}) OR abs({0}) > 1e30 THEN NULL ELSE round({0} * CAST({1} AS DOUBLE) + CAST({2} AS DOUBLE), 0) / CAST({1} AS DOUBLE) + CAST(0 AS DOUBLE) END"
        held = {}
        for name, x in outputs.items():
            column = self.let(f"CAST({x.sql} AS DOUBLE)", x.stage)
            held[name] = column.sql if digits is None else clean.format(column.sql, 10 ** (digits[name] if isinstance(digits, dict) else digits), NUDGE)
        return held

    def prune(self, outputs: dict[str, X]) -> None:
        """Forget the columns that no output needs."""
        needed = " ".join(x.sql for x in outputs.values())
        for k in range(len(self.stages) - 1, -1, -1):
            words = set(re.findall(r"[A-Za-z_]\w*", needed))
            self.stages[k] = {n: q for n, q in self.stages[k].items() if n in words}
            needed += " " + " ".join([*self.stages[k].values(), *(self.recursive[n][0] for n in self.stages[k] if n in self.recursive)])
        while self.stages and not self.stages[-1]:
            self.stages.pop()

    def apply(self, df, outputs: dict[str, X], digits: int | dict[str, int] | None = None):
        """The key, the order and the outputs, on a Spark DataFrame; rounded only if asked."""
        self.prune(outputs)
        final = self.final(outputs, digits)
        for stage in self.stages:
            plain = [f"{sql} AS {name}" for name, sql in stage.items() if sql]
            if plain:
                df = df.selectExpr("*", *plain)
            recursive = {n: self.recursive[n] for n, sql in stage.items() if not sql}
            if recursive:
                df = _recursive_means(df, self.key, self.order, recursive)
        return df.selectExpr(self.key, self.order, *[f"{sql} AS {name}" for name, sql in final.items()])

    def sql(self, base: str, outputs: dict[str, X], digits: int | dict[str, int] | None = None) -> str:
        """The same as one query over a base query (no recursive means)."""
        self.prune(outputs)
        final = self.final(outputs, digits)
        if any(not sql for stage in self.stages for sql in stage.values()):
            raise ValueError("recursive means have no SQL")
        steps = [f"s0 AS ({base})"]
        for k, stage in enumerate(self.stages, 1):
            columns = ", ".join(f"{sql} AS {name}" for name, sql in stage.items())
            steps.append(f"s{k} AS (SELECT *, {columns} FROM s{k - 1})" if columns else f"s{k} AS (SELECT * FROM s{k - 1})")
        columns = ", ".join(f"{sql} AS {name}" for name, sql in final.items())
        return f"WITH {', '.join(steps)} SELECT {self.key}, {self.order}, {columns} FROM s{len(self.stages)}"


def _recursive_means(df, key: str, order: str, wanted: dict[str, tuple[str, float]]):
    """All recursive means of one stage in one grouped pass (pandas computes each column in C)."""
    import pandas as pd
    from pyspark.sql import types as T

    schema = T.StructType(df.schema.fields + [T.StructField(name, T.DoubleType()) for name in wanted])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        for name, (source, alpha) in wanted.items():
            group[name] = group[source].astype(float).ewm(alpha=alpha, adjust=False).mean()
        return group

    return df.groupBy(key).applyInPandas(run, schema)


def build(make: Callable[[Frame], dict[str, X]], columns: list[str], dialect=Spark, **kw) -> tuple[Frame, dict[str, X]]:
    frame = Frame(columns, dialect=dialect, **kw)
    return frame, make(frame)
