"""The corpus pipeline: each stage takes the documents that the one before it kept and hands on its own.

Quality filter, line dedup, near-duplicate removal, benchmark decontamination, packing. All stages but the last return
the columns of their input. Defined cases, over those of the operators: null texts stay null through line dedup;
n_chars follows the text wherever it was given; a document that loses all its lines stays, with an empty text, as its
id may matter to later steps and it packs to one closing id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import decontaminate, line_dedup, ngram_join, packing, quality_fm
from sievemill.llm.common import materialise, table


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.3 go; the machine learns from the labelled documents among those of this stage."""
    return quality_fm.keep_good(docs, quality_fm.fit_quality(docs, table(spark, sf_dir, "labels")), 0.3)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from every document."""
    kept = line_dedup.dedup_lines(docs, min_docs=10)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    n = F.when(F.col("n_chars").isNotNull(), F.length(text)).cast(docs.schema["n_chars"].dataType)
    changed = {"text": text.alias("text"), "n_chars": n.alias("n_chars")}
    return kept.select([changed.get(c, F.col(f"`{c}`")) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links of five-word shingles at 0.8, the one with the smallest id stays."""
    return ngram_join.keep_one(docs, percent=80)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", filter_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("benchmark decontamination", decontaminate_documents),
    ("packing", pack),
]

#: Scores and ids of vocabularies are beyond SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's documents are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
