"""Session helpers: a local session for tests, and the shared folder for tables written between stages."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_LOCAL: dict[str, str] = {}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with UTC time and adaptive execution."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where that is unset (tests)."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="verbatrix-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return "file://" + _LOCAL[app]


_WRITTEN: dict[str, list[str]] = {}


def clear_written(spark: SparkSession) -> int:
    """Delete the tables that this session wrote between stages, when no result needs them any more; their number."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        Written(spark, p).drop()
    return len(paths)


def give_back(spark: SparkSession) -> bool:
    """Have the driver collect its garbage and hand freed memory back to the system; whether that was done for native memory too.

    A session that plans and runs many small jobs has hundreds of threads, and what these have freed of native memory stays with the process
    unless it is asked to return it (a command of the JVM from 17.0.9 on; without it only the heap shrinks)."""
    gc.collect()  # Python's handles keep plans alive
    jvm = spark._jvm
    jvm.java.lang.System.gc()
    try:
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


class Written:
    """A table written to the shared folder: lineage ends there and a lost executor loses nothing."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | None = None):
        self.spark, self.path, self.schema = spark, path, schema

    @property
    def df(self) -> DataFrame:
        return (self.spark.read.schema(self.schema) if self.schema else self.spark.read).parquet(self.path)  # with a schema no job looks for it

    def drop(self) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def write_out(df: DataFrame, name: str = "t", by: list[str] | None = None) -> Written:
    """Write df as parquet into the shared folder, in subfolders by the columns `by`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/verbatrix/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path, partitionBy=by)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return Written(spark, path, None if by else df.schema)


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """df, written to the shared folder and read again (columnar, so later readers prune columns)."""
    return write_out(df, name).df
