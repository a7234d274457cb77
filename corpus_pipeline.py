"""A corpus from documents to packed sequences: five stages, each of which works on all that the stage
before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changetree.llm.common import persisted, table
from changetree.llm.decontaminate import decontaminate
from changetree.llm.exact_dedup import keep_first
from changetree.llm.ngram_join import keep_one
from changetree.llm.packing import pack
from changetree.llm.quality import quality_scores
from changetree.llm.token_counts import default_tokenizer


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = quality_scores(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col(scored.columns[-1]) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the smallest doc_id."""
    return keep_first(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that near-duplicate links connect the document with the smallest doc_id."""
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    marked = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(~F.col(marked.columns[len(docs.columns)])).select(*[F.col(f"`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences of 4096 tokens."""
    return pack(docs, default_tokenizer())


STAGES = [
    ("quality_classifier", quality_filter),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier, the set join by hashes and the packing have no SQL form; tests/llm/test_pipeline.py compares the stages with brute
#: force on the smallest tables (of the classifier, that its decisions take effect).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = persisted(docs)
    return docs
