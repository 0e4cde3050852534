"""Register the driver tables and the role views of the reference's schema.

``roles(spark, sf_dir)`` returns a namespace of lazy DataFrames, one per role
(``task``, ``task_history``, ``sub_task`` ...).  Nothing is read until an
action runs; Catalyst pushes filters and column pruning into the parquet
scans through the view definitions.
"""

from __future__ import annotations

import os
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession

from ..session import state_of
from .role_sql import ROLE_SQL

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")

_REGISTERED: dict[str, tuple] = {}


def register_tables(spark: SparkSession, sf_dir: str) -> None:
    """Expose every parquet table of ``sf_dir`` as a temp view of the same name."""
    for t in BASE_TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path) or "://" in sf_dir:
            spark.read.parquet(path).createOrReplaceTempView(t)


def register_roles(spark: SparkSession, sf_dir: str) -> None:
    key, state = spark.sparkContext.applicationId, (sf_dir, state_of(spark, sf_dir))
    if _REGISTERED.get(key) == state:
        return
    register_tables(spark, sf_dir)
    for name, sql in ROLE_SQL.items():
        spark.sql(sql).createOrReplaceTempView(name)
    _REGISTERED[key] = state


def roles(spark: SparkSession, sf_dir: str) -> SimpleNamespace:
    """Namespace of lazy role views for ``sf_dir``: filters and column pruning go
    through the view definitions to the given files."""
    register_roles(spark, sf_dir)
    return SimpleNamespace(**{n: spark.table(n) for n in ROLE_SQL}, spark=spark)


def role_df(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return getattr(roles(spark, sf_dir), name)


def with_roles(body: str, names: tuple[str, ...] | None = None) -> str:
    """Prefix ``body`` (a query that may start with its own ``WITH``) with the
    role views as CTEs, for the DuckDB oracle."""
    names = names or tuple(ROLE_SQL)
    ctes = ",\n".join(f"{n} AS (\n{ROLE_SQL[n].strip()}\n)" for n in names)
    b = body.strip()
    if b[:4].upper() == "WITH":
        return f"WITH {ctes},\n{b[4:].lstrip()}"
    return f"WITH {ctes}\n{b}"
