"""The vector collection as a bucketed parquet table.

A collection is a folder with a one-row metadata table (name, dim, metric) and
the points, partitioned into BUCKETS buckets by a hash of the id. An upsert
reads the buckets that its rows fall into, keeps the merged rows in the shared
checkpoint folder and overwrites just those partitions (dynamic partition
overwrite). One writer at a time; readers wait for it. Where several must work
at once, a table format does it: the same ``upsert`` DataFrame feeds a MERGE.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import COLLECTION_METRIC
from ..session import cut_lineage

_META, _ROWS = "_meta", "buckets"
BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def create_collection(spark: SparkSession, root: str, name: str, dim: int,
                      metric: str = COLLECTION_METRIC) -> DataFrame:
    """Create if absent; return the metadata row (name, dim, metric).

    An existing collection must have the same dimension and metric.
    """
    meta_path = os.path.join(root, _META)
    if not _exists(spark, meta_path):
        (spark.createDataFrame([(name, int(dim), metric)], "name string, dim int, metric string")
         .coalesce(1).write.mode("overwrite").parquet(meta_path))
    else:
        known = spark.read.parquet(meta_path).first()
        if (known["dim"], known["metric"]) != (int(dim), metric):
            raise ValueError(f"the collection has dimension {known['dim']} and metric {known['metric']}, not {dim} and {metric}")
    return spark.read.parquet(meta_path)


def collection_dim(spark: SparkSession, root: str, dim: int | None = None) -> int:
    """The dimension of the metadata; ``dim``, if given, must equal it."""
    known = spark.read.parquet(os.path.join(root, _META)).first()["dim"] if _exists(spark, os.path.join(root, _META)) else dim
    if dim is not None and known != dim:
        raise ValueError(f"the collection has dimension {known}, not {dim}")
    return known


def bucket_of(key: str = "id"):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS)).cast("int")


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none where it does not exist."""
    fs, p = _fs(spark, path)
    return [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _fs(spark, old)
    if not fs.rename(p, _fs(spark, new)[1]):
        raise OSError(f"{old} could not be moved to {new}")


def read_points(spark: SparkSession, root: str, buckets: list[int] | None = None) -> DataFrame | None:
    """The current points (of some buckets); None where none were ever written."""
    path = os.path.join(root, _ROWS)
    if not _exists(spark, path):
        return None
    points = spark.read.parquet(path)
    return (points if buckets is None else points.where(F.col("bucket").isin(buckets))).drop("bucket")


def checked(points: DataFrame, dim: int) -> DataFrame:
    """Vectors must have the collection's dimension (fails the job otherwise).

    The check lives inside the kept ``vector`` expression; a separate check
    column that is dropped afterwards would be pruned away by the optimizer.
    """
    ok = F.size("vector") == F.lit(dim)
    return points.withColumn("vector", F.when(ok, F.col("vector")).otherwise(
        F.raise_error(F.lit(f"vector dimension differs from the collection's {dim}"))))


def upsert_points(spark: SparkSession, root: str, new: DataFrame, dim: int, order: str | None = None) -> None:
    """Keyed replacement by id: only the buckets of the new ids are read and written."""
    from ..operators.ingest import upsert
    dim = collection_dim(spark, root, dim)
    touched = [r[0] for r in new.select(bucket_of().alias("b")).distinct().collect()]  # at most BUCKETS numbers
    old = read_points(spark, root, touched)
    keep = old if old is not None else new.drop(order).where("false") if order else new.where("false")
    merged = cut_lineage(checked(upsert(keep, new, order=order), dim).withColumn("bucket", bucket_of()))
    (merged.repartition("bucket").sortWithinPartitions("bucket", "id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(os.path.join(root, _ROWS)))


def point_count(points: DataFrame) -> DataFrame:
    """A1."""
    return points.agg(F.count(F.lit(1)).alias("n_points"))


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Append rejected URLs, one folder per reason."""
    rejects.select("source", "url", "status", "reason").write.mode("append").partitionBy("reason").parquet(path)
