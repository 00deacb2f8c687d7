"""A corpus pipeline: five stages over ``documents``, each on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet in the shared
folder and reads it again as the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staveframe.llm import jaccard, line_dedup, packing, quality, secrets
from staveframe.llm._lineage import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _like_documents(changed: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the number of characters of the text as it is now (null text: null)."""
    return changed.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; all others stay as they are, wordless ones too."""
    return quality.score(docs).where("keep").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave the texts; every document stays."""
    return _like_documents(line_dedup.dedup_lines(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id."""
    return jaccard.dedup(docs).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; every document stays."""
    return _like_documents(secrets.redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences; not the columns of ``documents``."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=60_000)  # workers serve all stages: little is kept


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near duplicates", near_stage), ("secrets", secret_stage), ("packing", packing_stage)]

#: The classifier, the Markov models and the packing can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of the folder; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
