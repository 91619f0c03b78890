"""URL lists: headerless one-column CSV files.

The files are read as lines, so blank lines stay (they end a list). Each
write goes to its own ``batch=<n>`` folder and Spark writes one part file per
partition, so the order of a list over all its writes is (batch, file name,
split start, row position inside the split): ORDER. A slice by position never
needs a single-partition sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ids import dense_index
from .collection import _exists

ORDER = ["batch", "_file", "_start", "_row"]


def write_url_list(df: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = None,
                   order: str | None = None) -> None:
    """One column, no header; ``mode`` "overwrite" or "append".

    Without ``order`` the rows are written in the order they have. With it,
    in ascending order of that column (range-partitioned, no single task).
    """
    if mode not in ("overwrite", "append"):
        raise ValueError("mode must be overwrite or append")
    spark, batch = df.sparkSession, 0
    if mode == "append" and _exists(spark, path):
        batch = (spark.read.text(path).agg(F.max("batch")).first()[0] or 0) + 1
    groups = [partition_by] if partition_by else []
    if order:
        df = df.repartitionByRange(*groups, order).sortWithinPartitions(*groups, order)
    quoted = F.concat(F.lit('"'), F.replace("url", F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.when(F.col("url").rlike('^$|[",]'), quoted).otherwise(F.coalesce("url", F.lit("")))
    line = F.when(F.col("url") == "", F.lit("")).otherwise(line)
    (df.select(line.alias("value"), F.lit(batch).alias("batch"), *groups)
     .write.mode(mode).partitionBy("batch", *groups).text(path))


def read_url_list(spark: SparkSession, path: str, with_order: bool = False) -> DataFrame:
    """S3: (url[, partition columns][, batch, _file, _start, _row]); blank lines are empty URLs."""
    df = spark.read.text(path)
    if "batch" not in df.columns:  # files that something else wrote
        df = df.withColumn("batch", F.lit(0))
    v = F.col("value")
    url = F.when(v.rlike('^".*"$'), F.replace(F.substring(v, 2, F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v)
    rest = [c for c in df.columns if c not in ("value", "batch")]
    place = [F.col("batch"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
             F.monotonically_increasing_id().alias("_row")]
    return df.select(url.alias("url"), *rest, *(place if with_order else []))


def strip_trailing(df: DataFrame) -> DataFrame:
    """P4."""
    return df.withColumn("url", F.regexp_replace("url", r"\s+$", ""))


def with_positions(urls: DataFrame, order_cols: list[str], group_col: str | None = None) -> DataFrame:
    """0-based position of every row in ``order_cols`` order (per ``group_col``)."""
    keyed = ([group_col] if group_col else []) + order_cols
    indexed = dense_index(urls, keyed, start=0, col="_g")
    if not group_col:
        return indexed.withColumnRenamed("_g", "pos")
    # One row per group: small, so the offsets table is broadcast.
    first = indexed.groupBy(group_col).agg(F.min("_g").alias("_g0"))
    return (indexed.join(F.broadcast(first), group_col)
            .withColumn("pos", F.col("_g") - F.col("_g0")).drop("_g", "_g0"))


def url_slice(positioned: DataFrame, offset: int = -1, nb: int = -1, group_col: str | None = None) -> DataFrame:
    """``nb`` URLs from position ``offset`` (-1/0 = start, nb -1 = all);
    a blank line ends the list."""
    if not (nb == -1 or nb > 0):
        raise ValueError("the number of URLs must be positive")
    if offset < -1:
        raise ValueError("the offset must not be negative")
    start = max(offset, 0)
    blank = F.trim(F.col("url")) == ""
    df = positioned if group_col else positioned.withColumn("_all", F.lit(0))
    key = group_col or "_all"
    # First blank line per list at or after the offset: one row per list.
    stops = df.where(blank & (F.col("pos") >= start)).groupBy(key).agg(F.min("pos").alias("_stop"))
    cond = F.col("pos") >= start
    if nb > 0:
        cond = cond & (F.col("pos") < start + nb)
    out = df.where(cond).join(F.broadcast(stops), key, "left")
    out = out.where(F.col("_stop").isNull() | (F.col("pos") < F.col("_stop"))).drop("_stop")
    return out if group_col else out.drop("_all")
