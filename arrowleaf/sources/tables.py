"""The driver's tables, lists per order, and line-delimited JSON."""

from __future__ import annotations

import hashlib
import os
import tomllib
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, xs, k): the quantities of an order's lines less 25, in line order; k is 1 to 10."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity").cast("long") - 25).alias("x")).alias("line")
    )
    own = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("line")), lambda s: s["x"]).alias("xs"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    none = F.array().cast("array<bigint>")
    return orders.join(own, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("xs", none).alias("xs"), (F.col("o_orderkey") % 10 + 1).alias("k"))


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """Records of a line-delimited file; blank lines are skipped and broken lines raise."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df if limit is None else df.limit(limit)


def write_jsonl(df: DataFrame, path: str, split: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(split) if split else writer).json(path)


def require(paths: dict[str, str]) -> None:
    """Raise for input files that are missing; the values say how to make them."""
    if gone := [f"{p} ({hint})" for p, hint in paths.items() if not os.path.exists(p)]:
        raise FileNotFoundError("missing input: " + "; ".join(gone))


def read_splits(spark: SparkSession, path: str, schema: str, splits: list[str]) -> DataFrame:
    """Some splits of a table written by ``write_jsonl``; the others are not read."""
    return spark.read.schema(f"{schema}, split string").json(path).where(F.col("split").isin(splits))


def append_log(df: DataFrame, path: str, fresh: bool = False) -> None:
    """Add rows to a line-delimited log, or start it anew; each row gets the time of writing."""
    now = F.lit(datetime.now(UTC).isoformat())
    df.withColumn("logged_at", now).write.mode("overwrite" if fresh else "append").json(path)


def cached(spark: SparkSession, source: str, root: str, salt: str, make) -> DataFrame:
    """``make(source table)`` kept below ``root`` under the name of the source's files, sizes, times and ``salt``."""
    files = sorted(os.path.join(d, f) for d, _, names in os.walk(source) for f in names) if os.path.isdir(source) else [source]
    state = "|".join(f"{f}:{os.stat(f).st_size}:{os.stat(f).st_mtime_ns}" for f in files) + salt
    path = os.path.join(root, hashlib.sha256(state.encode()).hexdigest()[:24])
    if not os.path.exists(os.path.join(path, "_SUCCESS")):
        make(spark.read.parquet(source)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def gallery(rows: DataFrame, path: str, title: str, body: str, language: str = "python") -> int:
    """A Markdown file of a section a row, written row by row; the number of sections."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        for n, r in enumerate(rows.select(title, body).toLocalIterator(), 1):
            f.write(f"## {r[0]}\n\n```{language}\n{r[1].rstrip()}\n```\n\n")
    return n


def settings(path: str, known: dict) -> dict:
    """A TOML file's values over the defaults in ``known``; a name that is not among them raises."""
    with open(path, "rb") as f:
        own = tomllib.load(f)
    if odd := sorted(set(own) - set(known)):
        raise ValueError(f"unknown settings {odd}")
    return {**known, **own}


def log_metrics(spark: SparkSession, path: str, run: str, step: int, values: dict[str, float]) -> None:
    """Append (run, step, name, value) rows to a table of metrics."""
    spark.createDataFrame([(run, step, k, float(v)) for k, v in values.items()], "run string, step long, name string, value double").write.mode("append").parquet(path)
