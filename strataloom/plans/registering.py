"""A slice's queries and their SQL, kept side by side."""

from __future__ import annotations

from collections.abc import Callable


def slice_of() -> tuple[dict, dict, Callable]:
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
