"""Corpus pipeline over ``documents``: stages built from the training-data operators.

Every stage works on all that its predecessor kept and is written to the shared folder, then read again, so a
lost executor never recomputes an earlier stage. Documents that the quality rules reject go, one document of
each near-duplicate class stays, documents that hold a benchmark window go, secret values are masked in place,
and the rest is packed into sequences. The first four return the columns they got; the last returns pieces.
A null id, a null text and repeated rows are treated as each operator defines; an empty table packs to no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from campaign_metrics.llm.decontaminate import drop_contaminated
from campaign_metrics.llm.packing import pack
from campaign_metrics.llm.quality import fit_quality, keep_quality
from campaign_metrics.llm.queries import document_owner
from campaign_metrics.llm.secret_scan import mask_secrets
from campaign_metrics.llm.simhash import MAX_BITS, SHINGLE_WORDS, keep_one_per_class
from campaign_metrics.llm.tables import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_class(docs, SHINGLE_WORDS, MAX_BITS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_secrets(docs, *document_owner())


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None  # boosted trees and BPE ids are beyond SQL; tests/llm/test_pipeline.py holds the brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
