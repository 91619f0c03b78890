"""Dense, ordered ids without a single-partition window (W1, S4 positions).

``row_number()`` over an unpartitioned window pulls every row into one
task. Instead: range-sort, checkpoint into the shared folder (so partition
contents are fixed even if an executor is lost and a task re-runs), count
rows per partition (one row per partition), turn the counts into offsets and
add each row's index inside its partition. Only the per-partition counts
(one row per partition) are broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def dense_index(df: DataFrame, order_cols: list[str], start: int | None = 1,
                col: str = "id", start_col: str | None = None) -> DataFrame:
    """Add ``col`` = start + 0-based position of the row in ``order_cols`` order.

    ``order_cols`` must be a total order (unique) for the ids to be
    reproducible. ``start_col`` names a column holding the start instead.
    """
    # The range sort samples its input before sorting it; persisting first
    # keeps expensive upstream projections (regexps, joins) from running twice.
    # An explicit partition count (at least the cluster's parallelism) keeps
    # AQE from folding CPU-heavy rows into a couple of byte-sized partitions.
    spark = df.sparkSession
    src = df.persist()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = cut_lineage(src.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols))
    src.unpersist()
    with_pid = ordered.withColumn("_pid", F.spark_partition_id())
    counts = with_pid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: the bound is the partition count, not the data.
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("long"), 33)
    base = F.col(start_col) if start_col else F.lit(int(start or 0))
    return (with_pid.withColumn("_local", local)
            .join(F.broadcast(offsets), "_pid")
            .withColumn(col, (base + F.col("_off") + F.col("_local")).cast("long"))
            .drop("_pid", "_local", "_off"))


def keyed_index(df: DataFrame, order_cols: list[str], start: int = 1, col: str = "id") -> DataFrame:
    """``dense_index`` for wide rows: only the order columns are sorted and checkpointed.

    The distinct keys are numbered (with how many rows each has) and joined
    back, so the rows themselves move once, by their key. Rows of equal keys
    are numbered in the order of the hash of all their columns.
    """
    keys = df.groupBy(*order_cols).agg(F.count(F.lit(1)).alias("_n"))
    ordered = cut_lineage(keys.repartitionByRange(*order_cols).withColumn("_pid", F.spark_partition_id()))
    sums = ordered.groupBy("_pid").agg(F.sum("_n").alias("_s"))
    # One row per partition: the bound is the partition count, not the data.
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_pid", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    first = (ordered.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(offsets), "_pid")
             .select(*[F.col(c).alias(f"_k_{c}") for c in order_cols], (F.col("_off") + F.col("_in")).alias("_first")))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in order_cols])
    turn = F.row_number().over(Window.partitionBy(*order_cols).orderBy(F.xxhash64(*df.columns)))
    return (df.join(first, same).withColumn(col, (F.lit(int(start)) + F.col("_first") + turn - 1).cast("long"))
            .select(*df.columns, col))
