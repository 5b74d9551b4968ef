"""From raw documents to token ids: rules, near copies, benchmark passages, personal data, ids.

Every stage takes (spark, docs, folder) and gives a DataFrame. All but the last give the
columns of the documents, so any prefix of the stages is a pipeline as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ebbline.llm import decontaminate, jaccard, pii, rules, segment
from ebbline.llm.common import stored, table

#: Near copies share 80 of 100 five-word shingles.
NEAR = jaccard.Likeness(k=5, part=80)
#: Segmentations per document.
SAMPLES = 2


def keep_by_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop what the current policy rejects."""
    return rules.filtered(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep the smallest id of every class of near copies."""
    return jaccard.one_per_class(docs, like=NEAR)


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, folder, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Replace personal data; every document stays."""
    return pii.redact(docs)


def segmented(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Sampled segmentations: doc_id, rank, ids, log_prob, inclusion."""
    return segment.encode(docs, segment.Pieces.load(), SAMPLES)


STAGES = [
    ("quality_rules", keep_by_rules),
    ("near_duplicates", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("segmentation", segmented),
]

#: Edit distances, components and sampling are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
