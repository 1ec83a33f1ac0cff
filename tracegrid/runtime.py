"""Session, scratch folder and guarded-broadcast helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Folders of intermediate tables that are deleted when the application ends.
_marked: set[str] = set()


def get_spark(app: str = "tracegrid", master: str = "local[8]", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", conf.pop("shuffle_partitions", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder shared by all executors that ``spark.checkpoint.dir`` names.

    Only where that setting is absent (a local session, as in tests) a temporary
    folder of this machine is used; on a cluster that is an error.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"tracegrid-{os.getuid()}")
    return f"{root.rstrip('/')}/tracegrid"


def _application_folder(spark: SparkSession) -> tuple[str, object, object]:
    """The folder of this application's intermediate tables, with its path and file system."""
    folder = f"{shared_root(spark)}/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return folder, path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name for an intermediate table; all of an application go when it ends."""
    folder, path, system = _application_folder(spark)
    if folder not in _marked:
        system.mkdirs(path)
        system.deleteOnExit(path)
        _marked.add(folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the intermediate tables of this application; results that still read them end with them."""
    folder, path, system = _application_folder(spark)
    system.delete(path, True)
    _marked.discard(folder)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and read it back.

    Cuts the lineage in a way that survives the loss of an executor.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows of a table whose size is fixed by its meaning, read with a check.

    Reads at most ``most + 1`` rows; more than ``most`` is an error, so that no
    growing table can reach the driver unnoticed.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows; not a reference table")
    return rows


def broadcast_if_small(df: DataFrame, most: int = 50_000) -> DataFrame:
    """``broadcast(df)`` if it has at most ``most`` rows, else ``df`` itself (a shuffle join)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Source bytes whose shuffled rows one task takes, about, and the number of partitions from which on tasks grow instead.
BYTES_A_TASK, MOST_TASKS = 256 << 20, 1 << 16


def spread(df: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """``df`` partitioned by ``keys``, in a number of partitions that follows the size of ``source``.

    The session's number of shuffle partitions counts until the source, by the
    statistics of its plan, is too large for it; then there are as many as it
    takes.  A window or join on the keys needs no further shuffle.
    """
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needed = -(-size // BYTES_A_TASK)
    # A size that Spark cannot tell is said to be enormous.
    known = size < 1 << 60
    return df.repartition(min(needed, MOST_TASKS), *keys) if known and usual < needed else df.repartition(*keys)


def columns_named(df: DataFrame, *names: str) -> DataFrame:
    """``df`` reduced to ``names``, so that extra columns cannot clash later on."""
    return df.select(*[F.col(f"`{n}`") for n in names])
