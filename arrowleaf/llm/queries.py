"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, katz, linededup, pages, quality, simhash, tokenfiles, topk, toxicity
from .common import crc_fold, work_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=2)
def codec(path: str | None = None) -> bpe.Codec:
    return bpe.Codec(bpe.read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op1_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), codec())


def op3_html_extraction(spark, sf_dir):
    return pages.extract(table(spark, sf_dir, "pages"))


def op4_exact_topk(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op5_katz_lm(spark, sf_dir):
    return katz.train_and_score(table(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", crc_fold("doc_id", 5) != 0)
    out = quality.score(docs, model)
    return out.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", crc_fold("doc_id", 4) != 2)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op8_token_files(spark, sf_dir):
    path = work_path(spark, "tokens.orc")
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenfiles.write(table(spark, sf_dir, "documents"), path, f.read())
    return tokenfiles.with_crc(tokenfiles.read(spark, path))


def op9_line_dedup(spark, sf_dir):
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op10_simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_decontamination, op2_byte_bpe, op3_html_extraction, op4_exact_topk, op5_katz_lm, op6_quality, op7_toxicity, op8_token_files, op9_line_dedup, op10_simhash)
    return {f.__name__: f for f in own}


_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9_SQL = f"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), rows AS (
  SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM cut
), keyed AS (
  SELECT *, {_LOW.format(f"trim(line, {_BLANK})")} AS k FROM rows
), often AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT doc_id, pos, line, k IN (SELECT k FROM often) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP4_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_topk": OP4_SQL, "op9_line_dedup": OP9_SQL}
