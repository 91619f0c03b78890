"""Spark session and shared-folder helpers.

On a cluster the session is created by the platform; everything here only
fills in settings that are *unset*, so cluster values always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings a local or test session needs; never overrides an existing value.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "pagesift") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared (HDFS/object store) folder there; it is used as
    is. Where it is unset, a local run (tests) gets a private scratch folder; on
    a cluster that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="pagesift-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


_HANDED_OUT: dict[str, list[str]] = {}  # folders by application


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder (for written intermediate tables); ``drop_written`` deletes it."""
    root = ensure_checkpoint_dir(spark)
    path = os.path.join(root, *parts) if "://" not in root else "/".join([root.rstrip("/"), *parts])
    if parts:
        _HANDED_OUT.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_written(spark: SparkSession) -> int:
    """Delete the intermediate tables that this application wrote through ``shared_path``; how many there were.

    For a long-lived session, once the results that read them are written
    elsewhere: DataFrames over them cannot be read again. Checkpoints are not
    touched (Spark deletes them itself under
    ``spark.cleaner.referenceTracking.cleanCheckpoints``), nor are tables of
    other applications or folders that the caller named.
    """
    hadoop, dropped = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for name in _HANDED_OUT.pop(spark.sparkContext.applicationId, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        dropped += path.getFileSystem(hadoop).delete(path, True)
    return dropped


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``pagesift`` importable in Python workers (addPyFile of a zip).

    Needed when the package was not submitted with ``--py-files`` and the
    driver's working directory is not the repository; done once per
    SparkContext. The zip is staged on the driver and distributed by Spark.
    """
    import zipfile

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    # Submitted with --py-files (the usual cluster path): nothing to do.
    if "pagesift" in (sc.getConf().get("spark.submit.pyFiles", "") or ""):
        _SHIPPED.add(key)
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="pagesift-py-"), "pagesift.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
