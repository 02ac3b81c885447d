"""Line dedup: drop lines that occur in many documents, and put the rest together again.

Lines are normalised (white space stripped at both ends, A-Z lower-cased), hashed with MD5, exploded
and counted by distinct documents; lines of frequent keys go, wherever they stand.  Counting shuffles
(hash, document) pairs, so a line that a third of all documents share is spread over every task; the
frequent keys come back to the lines by a lookup that broadcasts only keys that are provably few.

Defined cases: null and empty texts are one empty line; an empty key is never counted or dropped;
documents of the same id count once (all rows without an id are one document); repeated rows give
repeated results; no rows give no rows; other columns, whatever their names, are carried by
``drop_lines`` and ignored by ``line_report``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, materialise, skew_safe_semi, unused

_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line):
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def _digest(key):
    return F.unhex(F.md5(key))


def _dropped(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(doc_id, row_hash, gone): the digests of the frequent keys of each document that has some."""
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), _key), lambda k: F.length(k) >= min_chars))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), F.explode(F.transform(keys, _digest)).alias("h"))
    pairs = rows.groupBy("h", "doc_id").agg(F.lit(1).alias("one"))
    often = materialise(pairs.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs), "frequent-lines")
    total = often.agg(F.sum("n_docs")).first()[0] or 0
    hits = skew_safe_semi(rows, often, ["h"], "n_docs", total)
    return hits.groupBy("doc_id", "row_hash").agg(F.collect_set("h").alias("gone"))


def _kept(docs: DataFrame, min_docs: int, min_chars: int) -> tuple[DataFrame, str, str]:
    """``docs`` with two more columns, and their names: the digests dropped (or null) and the lines kept."""
    ident, row, own, gone, keep = unused(docs, "_id", "_row", "_h", "_gone", "_keep")
    found = _dropped(docs, min_docs, min_chars).select(F.col("doc_id").alias(ident), F.col("row_hash").alias(row), F.col("gone").alias(gone))
    d = docs.withColumn(own, F.xxhash64("text"))
    d = d.join(found, d["doc_id"].eqNullSafe(F.col(ident)) & (F.col(own) == F.col(row)), "left").drop(ident, row, own)
    lines = _lines(F.col("text"))
    some = F.filter(lines, lambda x: ~F.array_contains(F.col(gone), _digest(_key(x))))
    return d.withColumn(keep, F.when(F.col(gone).isNull(), lines).otherwise(some)), gone, keep


def line_report(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the text that stays."""
    k, _, keep = _kept(docs.select("doc_id", "text"), min_docs, min_chars)
    n = F.size(_lines(F.col("text"))).cast("long")
    return k.select("doc_id", n.alias("n_lines"), (n - F.size(keep)).alias("n_dropped"), F.sha2(F.array_join(keep, "\n").cast("binary"), 256).alias("kept_sha256"))


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with every column, and with text free of frequent lines; untouched texts stay as they are."""
    k, gone, keep = _kept(docs, min_docs, min_chars)
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(keep, "\n"))
    return k.withColumn("text", text).select(*columns(docs))
