"""A program over a stream of lists, with the same expression as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arrowleaf.functions.lists import run


def stream(spark: SparkSession, path: str, schema: str, tags: list[str]) -> DataFrame:
    """Rows of the files that arrive below ``path``, with the program's ``result``."""
    return spark.readStream.schema(schema).parquet(path).withColumn("result", run(tags))
