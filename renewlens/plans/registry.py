"""Registry of named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from renewlens.plans.compose import Sources
from renewlens.plans.oracle_tables import query

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def comparable(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Uniform result types: bigint, double rounded without -0.0, string."""
    out = []
    for f in df.schema.fields:
        c = f"`{f.name}`"
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            c = f"cast(cast({c} as int) as bigint)"
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = f"round(cast({c} as double), {digits}) + 0.0D"
        elif isinstance(f.dataType, T.ArrayType):
            c = f"concat_ws('|', {c})"
        out.append(f"{c} as `{f.name}`")
    return df.selectExpr(*out)


def register(name: str, sql: str | None = None, *needs: str, digits: int = DIGITS):
    """Register a function of :class:`Sources` under ``name``, with its SQL if there is one."""

    def wrap(fn: Callable[[Sources], DataFrame]) -> Callable[[Sources], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(fn(Sources.demo(spark, sf_dir)), digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = query(sql, *needs)
        return fn

    return wrap
