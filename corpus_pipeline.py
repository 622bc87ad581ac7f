"""A training-corpus pipeline: quality, near duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes a stage's rows as Parquet in
the session's shared folder and reads them again as the next stage's input. All stages but the last return
the columns of ``documents``. Decisions: rejected documents go; of each class of near duplicates the
document with the smallest doc_id stays; contaminated documents go; secrets are masked in place.

Rows that share a doc_id stay or go together. A row with a null doc_id stays only if it is of good quality:
it has no identity to link or to match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import cotraining, decontamination, jaccard_join, packing, secret_scan, shared
from webloom.llm.queries import tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cotraining.quality(docs, labels, carry=True).filter("kept").select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = jaccard_join.jaccard_join(docs)
    others = classes.filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, *tokenizer())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("packing", pack_sequences),
]

#: The first stage is a trained classifier, the last a tokenizer: SQL cannot express run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, sf_dir), name)
    name, stage = STAGES[-1]
    return shared.materialize(stage(spark, docs, sf_dir), name)
