"""Session helpers: a local session for tests and the shared scratch folder.

Lineage is cut with ``DataFrame.checkpoint()`` or with a table written under the
folder the cluster names in ``spark.checkpoint.dir``. That setting is read from the
session; only a session that has none (a local test run) gets one of our own.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "medoidlab") -> SparkSession:
    """A ``local[cores]`` session tuned for tests and benchmarks (no UI)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only when unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not current:
        current = spark.conf.get(_CHECKPOINT_KEY, None) or sc.getConf().get(_CHECKPOINT_KEY, None)
        if not current:
            if not _is_local(spark):
                raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that the driver and all executors share")
            current = tempfile.mkdtemp(prefix="medoidlab-ckpt-")
            spark.conf.set(_CHECKPOINT_KEY, current)
        sc.setCheckpointDir(current)
    return current


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers: unless the workers' ``PYTHONPATH``
    names its folder, a zip of it goes to the executors through Spark, once a context."""
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    sc = spark.sparkContext
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root in paths or any(f.startswith("medoidlab-src") for f in sc._python_includes):
        return
    base = os.path.join(tempfile.mkdtemp(prefix="medoidlab-zip-"), "medoidlab-src")
    sc.addPyFile(shutil.make_archive(base, "zip", root, os.path.basename(package)))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """On a local session only (tests, benchmarks): spread an input that arrives in fewer
    partitions than there are cores. On a cluster the input is returned unchanged."""
    if not _is_local(df.sparkSession):
        return df
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df
