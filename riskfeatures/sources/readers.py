"""Readers: database tables, checkpoint datasets, scenario artifacts, metadata."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHECKPOINT_ALIASES = {"halfway": "halfway", "tmid": "halfway", "creation": "creation", "t0": "creation"}


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int = 64,
              fetchsize: int = 10_000, properties: dict | None = None) -> DataFrame:
    """Parallel JDBC read of a table or ``(SELECT ...) q`` subquery.

    With a numeric ``partition_column`` and bounds Spark issues
    ``num_partitions`` range queries in parallel; predicates and column
    selections on the result are pushed into the database where supported.
    """
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetchsize)
    if partition_column:
        r = (r.option("partitionColumn", partition_column).option("lowerBound", lower)
             .option("upperBound", upper).option("numPartitions", num_partitions))
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    return r.load()


def checkpoint_path(data_dir: str, checkpoint: str) -> str:
    key = CHECKPOINT_ALIASES.get(checkpoint.lower()) if checkpoint else None
    if key is None:
        raise ValueError(f"unknown checkpoint {checkpoint!r}; use one of {sorted(CHECKPOINT_ALIASES)}")
    return os.path.join(data_dir, f"dataset_at_{key}_clean")


def load_checkpoint_dataset(spark: SparkSession, checkpoint: str, data_dir: str,
                            schema: StructType | None = None) -> DataFrame:
    """Read a checkpoint dataset written as CSV with header; aliases
    ``halfway``/``tmid`` and ``creation``/``t0``; error when missing."""
    path = checkpoint_path(data_dir, checkpoint)
    if not _exists(spark, path):
        raise FileNotFoundError(f"clean dataset not found at: {path}")
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def load_scenario_dataset(spark: SparkSession, checkpoint: str, data_dir: str, schema: StructType) -> DataFrame:
    """Like ``load_checkpoint_dataset`` but an empty frame (with schema) when absent."""
    try:
        return load_checkpoint_dataset(spark, checkpoint, data_dir, schema)
    except FileNotFoundError:
        return spark.createDataFrame([], schema)


def load_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    """Metrics JSON (pretty-printed object or JSON lines)."""
    return spark.read.option("multiLine", True).json(path)


ARTIFACT_SCHEMAS = {
    "roc_curve": "fpr double, tpr double, threshold double",
    "confusion_matrix": "actual string, predicted_0 long, predicted_1 long",
    "feature_importance": "feature string, importance double",
    "predictions": "id long, label int, score double",
    "shap_matrix": "id long, feature string, value double",
}


def load_matrix_csv(spark: SparkSession, path: str) -> DataFrame:
    """A matrix artifact, a row per ``id`` and a column per feature (such as exported SHAP
    values), in the long form of ``shap_matrix``; empty frame when absent."""
    if not _exists(spark, path):
        return spark.createDataFrame([], ARTIFACT_SCHEMAS["shap_matrix"])
    wide = spark.read.option("header", True).csv(path)
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in wide.columns if c != "id"]
    return wide.select(F.col("id").cast("long"), F.explode(F.array(*cells)).alias("x")).select("id", "x.feature", "x.value")


def load_artifact_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Artifact CSV with the per-artifact schema; empty frame when absent."""
    schema = ARTIFACT_SCHEMAS[kind]
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).schema(schema).csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def schema_rows(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """information_schema.columns-like rows (table, column, ordinal, type family).
    Metadata only — one row per column, built from each table's schema."""
    def family(t: str) -> str:
        t = t.lower()
        if t.startswith("array"):
            return "array"
        if t in ("bigint", "int", "smallint", "tinyint"):
            return "integer"
        if t in ("double", "float") or t.startswith("decimal"):
            return "float"
        if t.startswith("timestamp"):
            return "timestamp"
        return {"string": "string", "date": "date", "boolean": "boolean"}.get(t, t)
    rows = [(name, f.name, i + 1, family(f.dataType.simpleString()))
            for name, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position bigint, "
                                       "type_family string")


def normalise_timestamps(df: DataFrame, col: str, out: str) -> DataFrame:
    """Strings -> timestamp_ntz; unparseable values become NULL (never fail)."""
    return df.withColumn(out, F.expr(f"try_cast(`{col}` AS timestamp_ntz)"))


def load_summary_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """An analysis summary with its schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def load_model(spark: SparkSession, path: str):
    """The saved model, or None when there is none at ``path``."""
    from pyspark.ml import PipelineModel
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return PipelineModel.load(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None
