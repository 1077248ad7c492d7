"""Session settings and the folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_roots: dict[str, str] = {}


def build_session(app: str = "tidewire", master: str | None = None, **conf: object) -> SparkSession:
    """A UTC session with adaptive execution; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only where that is unset, and the master is local as in tests, a folder of this
    machine takes its place.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="tidewire-")
    return _local_dirs[context.applicationId]


def stage_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other call gets; everything under it goes when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        root = f"{shared_dir(spark)}/tidewire-{app}"
        path, files = _file_system(spark, root)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _roots[app] = root
    return f"{_roots[app]}/{label}-{uuid.uuid4().hex}"


def row_slices(spark: SparkSession) -> int:
    """How many slices a total order is cut into: the session's shuffle width."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table once to the shared folder and read it back.

    For results that are costly and read more than once. The files outlive lost
    executors, and later filters and column choices reach the Parquet scan. They
    are removed by `unstage`, or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Remove the files behind a table that `staged` returned; nothing may read it any more."""
    hadoop_path, files = _file_system(df.sparkSession, df._staged_path)
    files.delete(hadoop_path, True)


def _file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
