"""Queries of the rolling factor families over the panel."""

from __future__ import annotations

from ..functions.dialect import Duck
from ..functions.factors import alpha101, alpha191, market
from ..functions.rolling import Frame
from ..sources.views import PANEL, PANEL_SQL, panel

#: Columns a query: plans stay small enough for code generation.
BATCH = 12
#: The 101 family nests deeper.
DEEP_BATCH = 6


#: Digits of the registered queries' results, so that sums in another order compare equal.
DIGITS = 4
#: Amounts beyond 1e10, whose fourth digit the order of a sum decides.
LARGE = ("alpha191_163",)


def digits(names) -> dict[str, int]:
    return {n: 0 if n in LARGE else DIGITS for n in names}


def run(make, spark, sf_dir: str, names=None):
    """One exchange by ticker; every stage that follows sorts within it."""
    frame = Frame(PANEL)
    made = make(frame)
    outputs = {n: made[n] for n in names or made}
    found = frame.apply(panel(spark, sf_dir).repartition("ticker"), outputs, digits(outputs))
    return found.withColumn("date", found["date"].cast("string"))


def check(make, names=None) -> str:
    frame = Frame(PANEL, dialect=Duck)
    made = make(frame)
    inner = frame.sql(PANEL_SQL, {n: made[n] for n in names or made}, digits(names or made))
    return f"SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM ({inner})"


QUERIES: dict = {}
SQL: dict = {}


def _register(name: str, make, names=None, has_sql: bool = True) -> None:
    QUERIES[name] = lambda spark, sf_dir, make=make, names=names: run(make, spark, sf_dir, names)
    if has_sql:
        SQL[name] = check(make, names)


#: Powers with an unbounded exponent: values beyond 1e20, whose last digits engines do not share.
UNBOUNDED = ("alpha084", "alpha191_017")
_names = sorted(n for n in alpha101.factors(Frame(PANEL)) if n not in UNBOUNDED)
for _k in range(0, len(_names), DEEP_BATCH):
    _part = _names[_k : _k + DEEP_BATCH]
    _register(f"alpha101_{_part[0][5:]}_{_part[-1][5:]}", alpha101.factors, _part)
_names = [n for n in alpha191.factors(Frame(PANEL)) if n not in UNBOUNDED]
for _k in range(0, len(_names), BATCH):
    _part = _names[_k : _k + BATCH]
    _register(f"{_part[0]}_{_part[-1][9:]}", alpha191.factors, _part)
_register("alpha101_084", alpha101.factors, ["alpha084"], has_sql=False)
_register("alpha191_017", alpha191.factors, ["alpha191_017"], has_sql=False)
_register("alpha191_recursive", alpha191.recursive, has_sql=False)
for _name, _make in {
    "returns": market.returns, "window_primitives": market.primitives, "volatility": market.volatility, "microstructure_daily": market.microstructure,
    "trend": market.trend, "strategy_signals": market.strategies, "performance_rolling": market.performance, "market_regime": market.regime,
}.items():
    _register(_name, _make)
_register("trend_recursive", market.trend_recursive, has_sql=False)


def flagship(frame: Frame):
    """Four alphas and the forward returns: the daily factor table."""
    alphas = alpha101.factors(frame)
    forward = {k: v for k, v in market.returns(frame).items() if k.startswith("ret_forward")}
    return {k: alphas[k] for k in ("alpha006", "alpha012", "alpha041", "alpha101")} | forward


_register("factor_panel", flagship)
