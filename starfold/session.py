"""Session settings and the shared folder that iterative jobs write to."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Removes a query's shuffle files when it ends. Else they stay until the driver happens to collect its garbage, which with little
#: on its heap may be never. A DataFrame that is executed again is computed again.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "starfold", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are tuned for.

    On a cluster leave ``master`` unset; the submit command supplies it.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(FREE_SHUFFLES, "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="starfold-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", configured)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


_made: list[str] = []


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh, not yet existing path below the shared folder.

    A job that writes tables between its steps needs no shuffle files of the steps before.
    """
    if FREE_SHUFFLES not in spark.conf.getAll:
        spark.conf.set(FREE_SHUFFLES, "true")
    _made.append(f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}")
    return _made[-1]


def drop(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables this process has made; results that still read them become invalid.

    A local session without a shared folder of its own needs no call: its folder goes with the process.
    """
    while _made:
        drop(spark, _made.pop())
