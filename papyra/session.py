"""SparkSession helpers.

Cluster settings are read from the session; defaults are only filled in when
they are unset (tests, local runs). Nothing here points at a machine-local
folder when the cluster already names one.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every papyra job relies on (timezone for timestamp equality,
# AQE for runtime coalescing and skew handling).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "papyra") -> SparkSession:
    """Session for tests and local benchmarks."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("PAPYRA_DRIVER_MEM", "16g")))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_CHOSEN: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder (``spark.checkpoint.dir``); only
    when it is unset (tests, local runs) is a scratch folder chosen, once per
    application."""
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None) or _CHOSEN.get(sc.applicationId)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="papyra-ckpt-")
        _CHOSEN[sc.applicationId] = current
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # a session may refuse runtime changes of core settings
            pass
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Spark deletes the shuffle files of what is written in this block once it is written,
    not when the driver's JVM next collects garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def stage(df: DataFrame, name: str, by: str | None = None) -> tuple[DataFrame, str]:
    """:func:`materialize` and the path, for ``delete_path``; ``by`` is a column whose values
    get folders of their own."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    with shuffles_dropped(spark):
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.parquet(path), path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage: write ``df`` once as Parquet under the cluster's shared
    checkpoint folder and read it back, so later branches and actions do not
    recompute it (one pass, unlike ``checkpoint()``, which runs the plan a
    second time to write it). The shuffle files behind it go once it is written."""
    return stage(df, name)[0]


TASK_BYTES = 32 << 20


def packed(scan: DataFrame) -> DataFrame:
    """A file scan whose ranges are cut small (``spark.sql.files.maxPartitionBytes``), several
    ranges to a task: of the session's parallelism four tasks each at least, more for more
    than ``TASK_BYTES`` a task. The ranges and the order within each stay."""
    spark = scan.sparkSession
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes"))
    tasks = max(4 * spark.sparkContext.defaultParallelism, scan.rdd.getNumPartitions() * size // TASK_BYTES)
    return scan.coalesce(tasks)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``papyra`` importable in the Python workers (the Arrow kernels and
    pandas UDFs refer to it): zip the package once per application and add it
    with ``addPyFile``, as ``--py-files`` would. A cluster that has the
    package installed on its workers does not need this."""
    import os
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="papyra-pyfiles-"), "papyra.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)
