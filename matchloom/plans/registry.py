"""A registry of queries by name, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Bank:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register the decorated function under its own name."""

        def put(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql:
                self.sql[query.__name__] = sql
            return query

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def indel_sql(a: str, b: str) -> str:
    """The normalised Indel ratio of two texts in SQL: the matrix of the longest common subsequence, row by row."""
    start = f"list_transform(range(length({b}) + 1), lambda z: CAST(0 AS BIGINT))"
    step = f"""lambda p, c: list_reduce(list_prepend([CAST(0 AS BIGINT)], list_transform(range(1, length({b}) + 1), lambda k: [CAST(k AS BIGINT)])),
      lambda n, j: list_append(n, CASE WHEN unicode({b}[j[1]]) = c[1] THEN p[j[1]] + 1 ELSE greatest(p[j[1] + 1], n[len(n)]) END))"""
    common = f"list_last(list_reduce(list_prepend({start}, list_transform(range(1, length({a}) + 1), lambda k: [CAST(unicode({a}[k]) AS BIGINT)])), {step}))"
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE 200.0 * {common} / (length({a}) + length({b})) END"
