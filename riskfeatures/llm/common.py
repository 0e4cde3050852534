"""Shared pieces of the training-data operators."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# The six ASCII white-space characters, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the maximal runs of non-white-space characters."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the cluster's shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, but columnar: later scans read only
    the columns they need.  ``forget`` removes tables, ``drop_stored`` all of an
    application's.
    """
    spark = df.sparkSession
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def stored_buckets(df: DataFrame, name: str, column: str, n: int) -> DataFrame:
    """``stored`` in ``n`` hash buckets of ``column``, in which joins by it read the table.  The
    catalogue's entry goes at once, the files stay until ``forget``."""
    spark = df.sparkSession
    entry = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{_root(spark)}/{entry}"
    df.repartition(n, column).write.option("compression", "zstd").option("path", path).bucketBy(n, column).saveAsTable(entry)
    out = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` wrote, once nothing unwritten depends on them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Spark removes the shuffle files of finished jobs when the driver collects garbage;
    between large steps it is asked to."""
    spark._jvm.System.gc()


def small(table: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A stored table of narrow rows, to be broadcast if it has at most ``rows`` of
    them (some fifty megabytes) and to be joined by shuffle otherwise."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def drop_stored(spark: SparkSession) -> None:
    """Remove every table that ``stored`` wrote for this application."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def key_column(df: DataFrame, name: str) -> str:
    """``name`` if ``df`` has no such column (in either case), else with underscores before it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


_shipped: set[str] = set()


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package sent to the executors (once per application)."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _shipped:
        top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        name = os.path.join(tempfile.mkdtemp(), f"package-{uuid.uuid4().hex}")
        sc.addPyFile(shutil.make_archive(name, "zip", top, __package__.split(".")[0]))
        _shipped.add(sc.applicationId)
    return df.mapInArrow(fn, schema)
