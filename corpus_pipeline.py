"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Rows that the toxicity model rejects go, then lines that many documents share, then all but one of
each group of near copies, then documents that hold benchmark items; what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arrowleaf.llm import bpe, decontaminate, linededup, neardup, toxicity
from arrowleaf.llm.common import crc_fold, discard, made, work_path
from arrowleaf.llm.queries import codec, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows of ``docs`` outside the held-out fold and drop the texts judged toxic.

    Null and empty texts are scored like any other; rows are judged one by one, so repeats share their
    fate; without labels nothing is dropped but what the bare bias says; no rows give no rows.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", crc_fold("doc_id", 4) != 2)
    return toxicity.reject(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines that ten documents share out of all texts; every row stays.

    A null text stays null; a text of such lines alone becomes empty; rows without an id count as one
    document; no rows give no rows.
    """
    return linededup.drop_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of texts that five-word Jaccard similarities of 0.8 and more link.

    It is one of the smallest id, a null id coming last; null, empty and blank texts are one group; texts
    of fewer than five words are alike when their words are; no rows give no rows.
    """
    return neardup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows whose text holds a benchmark item, as it is or with other values.

    Null and empty texts hold none; rows of one id, or of none, are judged by their own texts; an empty
    benchmark drops nothing; no rows give no rows.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each text and decode it again: a row of counts and digests for each row.

    Null and empty texts have no tokens; repeated rows give repeated results; no rows give no rows.
    """
    return bpe.round_trip(docs, codec())


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: Learnt weights, near copies and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; the result is that of the last.

    A stage's intermediate tables, and the output of the stage before it, go once its own is written.
    """
    docs = table(spark, sf_dir, "documents")
    start = made()
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        schema, path = out.schema, work_path(spark, name.replace(" ", "-"))
        out.write.parquet(path)
        docs = spark.read.schema(schema).parquet(path)
        discard(spark, start, path)
    return docs
