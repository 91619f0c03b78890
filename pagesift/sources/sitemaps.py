"""Sitemap XML files on disk (S1, file form).

Landed sitemap documents are read with Spark's built-in XML source: each
``<url>`` element is a row (``rowTag``), so a file is split into rows by the
reader itself and no document is ever held as one value. The document a
link came from is a partition column (or the file path).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LOC_TAG, URL_TAG


def write_sitemap_files(docs: DataFrame, path: str, key: str = "doc_url") -> None:
    """One folder per document (``key=<value>``), holding its XML text."""
    docs.select(key, "xml").write.mode("overwrite").partitionBy(key).text(path)


def read_sitemap_files(spark: SparkSession, path: str, row_tag: str = URL_TAG,
                       loc_tag: str = LOC_TAG) -> DataFrame:
    """(partition columns..., loc, file_path) for every ``row_tag`` element with a ``loc_tag``."""
    df = (spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE")
          .schema(f"`{loc_tag}` STRING").load(path))
    return (df.where(F.col(loc_tag).isNotNull())
            .withColumn("file_path", F.col("_metadata.file_path")))
