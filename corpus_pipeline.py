"""The training-text pipeline: five stages, each on all that the stage before it kept.

Every function takes (spark, docs, sf_dir). All but the last return the columns of `documents`; the last returns the
pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm import decontaminate, jaccard_join, packing, secret_scan, toxicity
from flowsieve.llm.common import read, stored
from flowsieve.llm.queries import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the classifier chain calls toxic go."""
    chain = toxicity.fit_chain(docs, toxicity.category_labels(read(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs, chain)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of each class of copies and near copies the document with the least doc_id stays."""
    return jaccard_join.drop_near_copies(docs)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a benchmark window go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: secrets give way to a mark, and n_chars follows; the documents stay."""
    clean = secret_scan.redact_secrets(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token ids of what is left, packed into sequences."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("benchmark_decontamination", reject_contaminated),
    ("secret_scan", redact),
    ("packing", pack),
]

#: The classifier and the packing can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
