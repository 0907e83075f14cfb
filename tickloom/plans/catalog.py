"""All registered queries of the library and their SQL."""

from . import factor_queries, fundamental_queries, operator_queries, portfolio_queries, spectral_queries, statistic_queries, strategy_machine_queries, strategy_queries, validation_queries  # noqa: F401  (they register with operator_queries)

QUERIES: dict = {**factor_queries.QUERIES, **operator_queries.QUERIES}
SQL: dict = {**factor_queries.SQL, **operator_queries.SQL}
