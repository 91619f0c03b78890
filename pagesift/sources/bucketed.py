"""Tables bucketed by url, so that joins on it need no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import strip_url

BUCKETS = 64


def write_bucketed(df: DataFrame, name: str, path: str, buckets: int = BUCKETS, key: str = "url") -> None:
    """Save ``df`` as table ``name`` under ``path``, bucketed and sorted by its stripped ``key``.

    Rows are dealt to the buckets first, so each bucket is one file.
    """
    clean = df.withColumn(key, strip_url(key))
    (clean.repartition(buckets, F.col(key)).write.format("parquet").mode("overwrite").option("path", path)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(name))


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
