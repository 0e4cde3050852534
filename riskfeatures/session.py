"""SparkSession helpers: one place for the engine settings the plans rely on."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.ansi.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "riskfeatures") -> SparkSession:
    """Build (or reuse) a session with the settings every plan assumes."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("RF_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  Only when it is unset and the master is local (tests) a scratch folder is
    made; a machine-local folder on a cluster would scatter the parts.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="rf-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint (survives executor loss) into the shared folder."""
    spark = spark or df.sparkSession
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def stored_table(df, name: str):
    """``df`` written as Parquet into the shared folder and read back: cuts the
    lineage, survives executor loss, and later scans read only their columns.  The
    application's tables are removed when the driver program ends."""
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_buckets(df, name: str, column: str, n: int):
    """``stored_table`` in ``n`` hash buckets of ``column``: grouping the table by it, or by it and
    others, moves no rows.  The catalogue's entry goes at once, the files stay."""
    spark = df.sparkSession
    entry = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    df.write.option("compression", "zstd").option("path", f"{application_folder(spark)}/{entry}").bucketBy(n, column).saveAsTable(entry)
    out = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Spark removes the shuffle files of finished jobs when the driver collects garbage; between
    large steps it is asked to, so the steps' files do not add up."""
    spark._jvm.System.gc()


def forget(df, *but) -> None:
    """Remove the application's stored tables that ``df`` reads, but those that ``but`` read: once
    nothing unwritten depends on them."""
    spark = df.sparkSession
    mark = f"/{application_folder(spark).rsplit('/', 1)[1]}/"

    def tables(x) -> set[str]:
        return {before + mark + rest.split("/")[0] for before, found, rest in (f.partition(mark) for f in x.inputFiles()) if found}
    for table in tables(df).difference(*map(tables, but)):
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_folders: dict[str, str] = {}


def application_folder(spark: SparkSession) -> str:
    """The application's own folder in the shared one."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{app}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # still running
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def state_of(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of what lies in ``folder``: answers that are kept for a
    folder hold for one state of it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    total = fs.getContentSummary(path)
    return (total.getLength(), total.getFileCount(), *sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(path)))
