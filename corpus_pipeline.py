"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Toxic documents go, one document of each near-duplicate group stays, documents that hold a benchmark passage go, personal data is
masked, and what is left is packed. Every stage works on all that the one before kept, learns and counts on its own input, and all
but the last return the columns of documents, whatever their names. Verdicts belong to rows, not to ids.

Cases: null and empty texts are neither toxic nor contaminated, are near to nothing, hold no personal data, and are packed as an end
token each; a null text stays null until packing. A row of a null doc_id is judged by its text in every stage: copies of it go, and
so do contaminated ones. Of repeated rows, and of versions of one doc_id, the near-duplicate stage keeps one (the text of the least
hash); others judge each on its own. Very long texts are whole in every stage. Ties of components go to the smallest doc_id. Empty
tables give empty results, and without labels the toxicity grammar's own weights stand. Intermediate tables go to a new folder under
spark.checkpoint.dir, which is the caller's to remove once the result is written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import decontaminate, minhash_dedup, packing, pii, toxicity
from wardline.llm.common import shared_folder, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.distinct_documents(docs, minhash_dedup.STAGE_SIMILAR, minhash_dedup.STAGE_DISTANCE)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", _toxicity), ("near_duplicates", _near_duplicates), ("decontamination", _decontaminate), ("pii", _pii), ("packing", _pack)]
#: Learned weights and MinHash signatures are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
