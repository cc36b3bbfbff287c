"""The registered queries and the DuckDB SQL that they must equal."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TODAY = dt.date(2024, 10, 1)
TODAY_SQL = "DATE '2024-10-01'"


def query(sql: str | None = None, dates: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; its ``dates`` are compared as ISO strings."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return f(spark, sf).withColumns({d: F.col(d).cast("string") for d in dates})

        QUERIES[f.__name__] = run if dates else f
        if sql:
            listed = ", ".join(f"{d}::VARCHAR AS {d}" for d in dates)
            ORACLES[f.__name__] = f"SELECT * REPLACE ({listed}) FROM ({sql})" if dates else sql
        return f

    return register
