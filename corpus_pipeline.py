"""The corpus pipeline: documents in, packed sequences out.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the last
return the columns of ``docs``; what a stage drops or cuts is gone for the next
ones. ``run`` writes each stage's result as Parquet beside the checkpoints, in the
folder that the cluster shares, and rereads it for the next stage, so a lost
executor repeats a stage's tasks and never an earlier stage. A stage's table is
deleted once the next one is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parley.llm import linededup, packing, simhash, suffix, toxicity
from parley.llm.scratch import Scratch

#: Bytes of the repeats that the fourth stage removes: passages of over 50 words are
#: shorter than this in one case of 200 (README).
SPAN_BYTES = 280


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: trains on the labelled rows of ``docs``; documents it calls toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: later occurrences of three-line windows leave the texts."""
    return linededup.line_dedup(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of every SimHash group stays, the one with the smallest id."""
    return simhash.keep_one(docs)


def dedup_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: bytes covered by a string of ``SPAN_BYTES`` that starts elsewhere leave the texts."""
    return suffix.remove_repeats(docs, window=SPAN_BYTES)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the remaining texts as sequences of at most 4,096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("suffix-array dedup", dedup_spans),
    ("best-fit packing", pack),
]

#: A trained classifier and a genetic algorithm have no SQL; tests hold the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return docs
