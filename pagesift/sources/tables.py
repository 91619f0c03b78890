"""Scan of the landed parquet tables (S2 and the driver tables)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("pages", "documents", "embeddings", "benchmark", "conversations")
# Tables whose rows carry long text, and those columns: per-row regexp work
# dominates, so a scan selecting one with fewer splits than cores is spread.
TEXT_TABLES = ("pages", "documents", "conversations")
HEAVY_COLUMNS = ("html", "text")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin to the cluster's parallelism when the scan has fewer splits.

    A large table already yields many splits (one per file block), so this is
    a no-op at scale; it only keeps a one-row-group file from running every
    per-row regexp on a single core.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    # Only ever called on a bare (projected) scan: its RDD is built without running anything.
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Parquet scan; naming the columns keeps the ReadSchema minimal."""
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns:
        df = df.select(*columns)
    heavy = name in TEXT_TABLES and any(c in HEAVY_COLUMNS for c in (columns or df.columns))
    return spread(df) if heavy else df
