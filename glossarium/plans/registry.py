"""All queries of the library, by name, with their SQL where SQL can say the same."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
_MODULES = ("operators.lookup", "operators.linkage", "operators.summary", "operators.ranking", "operators.sets", "operators.curation", "operators.corpus", "functions.text", "functions.hangul", "functions.conjugation", "functions.values", "plans.search", "sources.readers", "streaming.reviews", "functions.writing", "operators.desk", "sources.sinks", "functions.english", "functions.korean", "functions.markup", "sources.dictionaries", "operators.lessons", "plans.postings", "plans.router", "plans.lexica", "sources.exports", "sources.archives", "operators.rules", "operators.library", "operators.longest", "operators.claims", "operators.capped", "operators.similar", "operators.bridge", "operators.hanja")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; sql is DuckDB's form of it."""

    def keep(f: Query) -> Query:
        if name in _queries and _queries[name] is not f:
            raise ValueError(f"two queries are called {name}")
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return keep


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"glossarium.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["qry05_gloss_tiers"](spark, sf_dir)
