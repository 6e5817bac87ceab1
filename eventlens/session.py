"""Session helpers: a local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "eventlens") -> SparkSession:
    """Local session used by tests and bench.py (a cluster job brings its own session)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("EVENTLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application (as ``--py-files`` would)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    # On the driver alone: executors fetch it from the driver while the application runs.
    folder = _SHIPPED[sc.applicationId] = tempfile.TemporaryDirectory(prefix="eventlens-py-")
    root = Path(__file__).resolve().parent
    target = f"{folder.name}/{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(target)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster (spark.checkpoint.dir).

    Only when the session names none (local tests) do we set our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="eventlens-ckpt-")  # one process: this folder is shared
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written intermediate tables."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def scratch_root(spark: SparkSession) -> str:
    """The folder that holds all written intermediate tables of this application."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/eventlens-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's intermediate tables. Results that still read them must have been written."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more.

    The cleaner acts when the driver's JVM collects its garbage, which a driver with little to do may
    not do for half an hour, while files of finished phases fill the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df, name: str = "table", codec: str | None = None):
    """Cut lineage by writing ``df`` once as Parquet under the shared checkpoint
    folder and reading it back (one pass; an eager ``checkpoint`` computes its
    plan twice unless cached). Survives executor loss like any written table.
    ``codec``: how Parquet compresses it, if not as the session does.
    """
    spark = df.sparkSession
    path = shared_scratch(spark, name)
    df.write.mode("overwrite").parquet(path, compression=codec)
    out = spark.read.parquet(path)
    out._scratch_path = path
    return out


def discard(df) -> None:
    """Remove the table behind a frame that ``materialize`` returned, once no plan will read it again."""
    path = getattr(df, "_scratch_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
