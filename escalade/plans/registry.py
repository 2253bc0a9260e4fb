"""Registry of named plans: ``name -> (spark_fn(spark, sf_dir), oracle_sql | None)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PlanFn = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, PlanFn] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    """Register a plan under ``name`` with its DuckDB oracle (None = rows only)."""
    def deco(fn: PlanFn) -> PlanFn:
        if name in PLANS:
            raise ValueError(f"duplicate plan {name}")
        PLANS[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, dp: int = 6) -> DataFrame:
    """Round every double column (report view; both engines round HALF_UP)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), dp).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
