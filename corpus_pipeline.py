"""Training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
it as Parquet in the shared folder and rereads it as the next stage's docs.
The order: reject low quality, keep one document of each near-duplicate group,
drop contaminated documents, redact personal data, encode.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.llm.common import col, read_table
from pagesift.llm.pii import redact
from pagesift.llm.piece_bpe import encode_digest
from pagesift.llm.quality_rff import keep_quality
from pagesift.llm.simhash_gph import keep_one
from pagesift.llm.wu_manber import decontaminate
from pagesift.session import shared_path


def _sealed(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs with all columns but doc_id and text under names that no operator uses, and how to name them back."""
    names = {c: c if c in ("doc_id", "text") else f"kept_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[col(c).alias(n) for c, n in names.items()]), [col(n).alias(c) for c, n in names.items()]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality score is 0.5 or more."""
    sealed, back = _sealed(docs)
    return keep_quality(sealed, read_table(spark, sf_dir, "labels")).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: three-word shingles, three bits."""
    sealed, back = _sealed(docs)
    return keep_one(sealed, shingle=3, distance=3).select(*back)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's windows do not mark as contaminated."""
    sealed, back = _sealed(docs)
    found = decontaminate(sealed, read_table(spark, sf_dir, "benchmark"), keep=tuple(sealed.columns))
    return found.where(~F.col("contaminated")).select(*back)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind; n_chars follows the text (null where that is null)."""
    sealed, back = _sealed(docs)
    cleaned = redact(sealed).select(*back)
    length = F.char_length("text").cast("long").alias("n_chars")
    return cleaned.select(*[length if c == "n_chars" else col(c) for c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    return encode_digest(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("encoding", encoding)]

#: SQL has neither the classifier nor XXH64 fingerprints; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = read_table(spark, sf_dir, "documents"), shared_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}-{name}")
        docs = spark.read.parquet(f"{path}/{k}-{name}")
    return docs
