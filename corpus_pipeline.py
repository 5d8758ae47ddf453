"""The corpus pipeline: quality filter, exact dedup, near dedup, source mix, encoding.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents, extra ones included,
whatever their names; empty tables pass through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import exact_dedup, mixing, quality, simhash, spm
from tidewell.llm.common import checkpoint_dir, table
from tidewell.llm.queries import TOKENIZERS


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Nulls, empties, repeats and empty tables: see quality.keep_good."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the smallest id's; null and empty texts are one group."""
    return exact_dedup.drop_exact(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, the smallest id's; texts without words are one group."""
    return simhash.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate takes it; a null source is a source, texts without words weigh nothing."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with token ids; a document taken twice comes twice, a null text has no tokens."""
    return spm.encode(docs.select("doc_id", "lang", "source", "text"), f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [("quality", keep_good), ("exact", drop_exact), ("near", drop_near), ("mix", mix_sources), ("encode", encode)]

#: SQL can't express the classifier or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each read back from the shared folder where the one before left it."""
    docs, place = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
