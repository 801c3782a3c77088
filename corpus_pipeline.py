"""A training corpus from raw documents, stage by stage; each stage is written as Parquet and read again.

quality classifier -> toxicity -> MinHash near-dedup -> mixing -> BPE. All stages but the last return
the columns of documents, whatever others there are. Empty tables give empty ones. After mixing a row is a block of tokens: its doc_id and language are those of
the document that the block begins in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinata.llm import bpe, minhash_dedup, mixing, quality_crf, toxicity_ssk
from ostinata.llm.common import DOC_COLUMNS, own_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are good in the main; those without text go."""
    field = quality_crf.train(spark, sf_dir)
    limit = 0.5 if field is None else field.threshold
    docs = docs.select(*DOC_COLUMNS)
    return docs.withColumn("_quality", quality_crf.quality(field, "text")).where(F.col("_quality") >= limit).select(*DOC_COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic; those without text stay."""
    machine = toxicity_ssk.train(spark, sf_dir)
    docs = docs.select(*DOC_COLUMNS)
    return docs.withColumn("_toxicity", toxicity_ssk.toxicity(machine, "text")).where(F.coalesce(F.col("_toxicity.score") < 0.5, F.lit(True))).select(*DOC_COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, of rows with one doc_id one; rows without a doc_id stay, NULL texts are alike to nothing."""
    return minhash_dedup.one_of_each(docs.select(*DOC_COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token blocks drawn to the tempered source weights; NULL and empty texts give none, repeated rows are packed as often as they occur."""
    return mixing.as_documents(mixing.mix(docs, as_text=True)).select(*DOC_COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every block: doc_id, source, ids, n_tokens; every row is encoded by itself, a NULL text has NULL ids."""
    return bpe.encode(docs, keep=("doc_id", "source")).drop("row_key")


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", drop_copies),
    ("source mixing", mix_sources),
    ("BPE encoding", encode),
]

#: Trained models and MinHash have no SQL form; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; the stages' tables lie in the shared folder."""
    root = own_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{root}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
