"""Every query of the library with its SQL, collected from the modules of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder by name: Tables(spark, dir).orders."""

    def __init__(self, spark, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables under its own name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from plenum.plans import audits, budgets, dossiers, entities, finance, fulltext, graph, linking, monitoring, pages, predicates, profiles, relational, retrieval, search, speech, texts, transcripts, values  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
