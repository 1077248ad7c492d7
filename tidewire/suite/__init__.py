"""Queries on the given tables, each with the SQL that checks it where SQL can."""

from tidewire.suite import articles, exports, learned, market, metrics, modelling, news, signals, storage  # noqa: F401
from tidewire.suite.registry import oracle_sql, queries  # noqa: F401
