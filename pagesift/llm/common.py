"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ..session import ship_package

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
         "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()),
         "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
# Texts handed to a Python function at a time (bytes): bounds a worker's memory.
SLICE_BYTES = 8 << 20


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def col(name: str) -> Column:
    """A column by its exact name, also when the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have (in any case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Cut consecutive rows into runs of about ``limit`` bytes (one row at least)."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def text_bytes(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string array; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return [t or b"" for t in array.cast(kind).to_pylist()]


def map_texts(df: DataFrame, fields: list[tuple[str, str]],
              make: Callable[[], Callable[[list[bytes]], list]],
              text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add columns computed from each row's whole text, without a shuffle.

    ``make()`` runs once per task and returns a function from a list of UTF-8
    texts to one list (or array) per field. The result has the ``keep``
    columns, then the fields; a field takes the place of a kept column of the
    same name.
    """
    ship_package(df.sparkSession)
    new = {name.lower() for name, _ in fields}
    keep = [c for c in keep if c.lower() not in new]
    at = keep.index(text_col) if text_col in keep else len(keep)
    cols = [col(c) for c in keep]
    if at == len(keep):
        cols.append(col(text_col).cast("string").alias(fresh(df, "_text_")))
    src = df.select(*cols)
    schema = StructType(list(src.schema.fields[:len(keep)]))
    for name, kind in fields:
        schema.add(name, DataType.fromDDL(kind))
    names = [*keep, *(n for n, _ in fields)]
    kinds = [ARROW[k] for _, k in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            texts = batch.column(at)
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
            for a, b in slices(sizes):
                made = fn(text_bytes(texts.slice(a, b - a)))
                arrays = [c.slice(a, b - a) for c in batch.columns[:len(keep)]]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return src.mapInArrow(run, schema)
