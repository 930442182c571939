"""Spark session and intermediate tables.

The library never creates a session on its own inside an operator; callers
(tests, bench, the driver entry points) build one with :func:`build_session`.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def build_session(master: str | None = None, app: str = "tessera",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Return a session tuned for the operators in this package.

    AQE stays on: it coalesces small shuffles, turns joins whose runtime size
    is small into broadcast joins (a checked size, not a guess) and splits
    skewed join partitions.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf["spark.driver.memory"] = os.environ.get("TESSERA_DRIVER_MEMORY", f"{_machine_mb() // 3}m")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def _machine_mb() -> int:
    return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") >> 20


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only in local mode, where one machine is the whole cluster, an unset
    setting is replaced by a private folder; anywhere else it is an error,
    since a machine-local folder would lose data with its executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not _is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_SCRATCH: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH[path] = spark
    return path


def drop_scratch(*paths: str) -> None:
    """Delete scratch folders that this driver made: the given ones, or all when it ends."""
    for path in paths or list(_SCRATCH):
        spark = _SCRATCH.pop(path, None)
        if spark is None:
            continue
        try:
            jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: nothing reaches its storage any more
            continue


atexit.register(drop_scratch)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet on the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint, survives the loss of
    executors, and its readers still prune columns and push filters down.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few literal rows that no Python worker reads.

    Rows given to ``createDataFrame`` as a list are unpickled by Python workers of an
    environment of their own, which an executor keeps beside those of the Arrow functions.
    """
    types = StructType.fromDDL(schema)
    columns = {f.name: [row[i] for row in rows] for i, f in enumerate(types.fields)}
    return spark.createDataFrame(pa.table(columns), types)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in local-mode Python workers.

    Arrow/pandas functions are pickled by reference to this package, so the
    workers need it.  In local mode the zip is built once per driver and
    handed to Spark (like ``--py-files``).  On a cluster the package is
    shipped at submit time (``--py-files`` or an installed wheel) and nothing
    is written here.
    """
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED or not _is_local(spark):
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="tessera-py-"), "tessera.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def balance(df: DataFrame, min_factor: float = 1.0) -> DataFrame:
    """Round-robin repartition only when a scan yields fewer splits than cores.

    A metadata check, not a data check: on a cluster reading large inputs the
    scan already has thousands of splits and nothing happens.  On a small file
    with few parquet row groups, CPU-heavy row-local text work would otherwise
    run on a handful of threads.
    """
    want = int(df.sparkSession.sparkContext.defaultParallelism * min_factor)
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df
