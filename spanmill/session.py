"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "spanmill", **conf) -> SparkSession:
    """Session with the settings the operators expect.

    On a cluster leave ``master`` unset; memory, executors and
    ``spark.checkpoint.dir`` come from spark-submit.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master is not None:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.host", "127.0.0.1").config(
                "spark.driver.bindAddress", "127.0.0.1"
            )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: The JVM interprets a method of more bytes than this instead of compiling it.
COMPILED_BYTES = 8000


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Inside, a chain of operators whose generated method the JVM would not compile runs operator by
    operator, in methods that it does."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, str(COMPILED_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables, seen by every executor.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session
    without that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    active = sc._jsc.sc().getCheckpointDir()
    if not active.isEmpty():
        return active.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="spanmill-")
    sc.setCheckpointDir(path)
    return path


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, *partition_cols: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = work_path(spark, name)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.partitionBy(*partition_cols).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the tables that each application has written as intermediate results.
_WRITTEN: dict[str, list[str]] = {}


def drop_written(spark: SparkSession) -> int:
    """Remove all tables of this application from :func:`written`; returns their number.

    For when the results are saved: frames that were built on them can no longer be read.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)
