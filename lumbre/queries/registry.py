"""Registration of named queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lumbre.session import configure, table
from lumbre.sources.readers import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


class Tables:
    """Driver tables by attribute: ``t.events``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.base, name)

    def spread(self, name: str, *columns: str) -> DataFrame:
        """The table in one piece per core, for work that is heavy per row."""
        df = table(self.spark, self.base, name)
        return spread(df.select(*columns) if columns else df, self.spark.sparkContext.defaultParallelism)


def query(ops: str, sql: str | None = None):
    """Register a function of ``Tables`` under its name, with the operators it shows and its SQL."""
    def add(fn):
        @wraps(fn)
        def run(spark: SparkSession, base: str) -> DataFrame:
            return fn(Tables(configure(spark), base))
        QUERIES[fn.__name__] = run
        OPERATORS[fn.__name__] = ops
        if sql:
            ORACLES[fn.__name__] = sql.strip()
        return fn
    return add
