"""A corpus made ready for training, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; `run` writes
its result to the shared scratch folder and hands the next stage the table read
back, so a stage starts from files and not from its predecessor's lineage.

1. quality: the weak-label classifier rejects documents.
2. exact_dedup: of equal texts the row with the largest id stays.
3. near_dedup: of texts linked by SimHash fingerprints within two bits or by a
   Jaccard similarity of 0.8 or more on five-word shingles, the row with the
   smallest id stays.
4. decontaminate: documents holding a passage of a benchmark item go.
5. byte_bpe: texts become token ids, which decode to the text again.

Stages 1 to 4 return the columns of `documents`, whatever these are; rows that
stay are not changed. Null and empty texts are rejected by the first stage. An
empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import byte_bpe, decontaminate, exact_dedup, near_duplicates, quality
from threadloom.llm.common import drop_stage, stage
from threadloom.llm.registry import table
from threadloom.session import scratch_path, temporary_stages


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by fingerprints and by shared shingles."""
    return near_duplicates.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them."""
    import public_tokenizers

    found = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source"))
    return found.select("row.doc_id", "row.lang", "row.source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: SQL can express neither the classifier nor the shingles; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`."""
    docs, staged = table(spark, sf_dir, "documents"), False
    for name, apply in STAGES:
        path = scratch_path(spark, name)
        with temporary_stages(spark):  # what the operator staged for itself
            out = stage(apply(spark, docs, sf_dir), name, path)
        if staged:
            drop_stage(docs)
        docs, staged = out, True
    return docs
