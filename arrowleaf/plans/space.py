"""The space of all programs as a DataFrame, its labels, hashes, hold-out and split quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arrowleaf.functions.program import VOCABULARY

#: Pairs of operations kept out of training.
HELD_OUT = (("filter:even", "order:descending"), ("filter:positive", "order:reverse"), ("map:abs", "order:ascending"), ("order:ascending", "slice:take_last_k"))


def vocabulary(spark: SparkSession) -> DataFrame:
    """(i, tag, category, json) of the operations."""
    rows = spark.createDataFrame(list(enumerate(VOCABULARY)), "i int, tag string")
    p = F.split("tag", ":")
    json = F.concat(F.lit('["'), p[0], F.lit('","'), p[1], F.lit('"'), F.when(F.size(p) > 2, F.concat(F.lit(","), F.get(p, F.lit(2)))).otherwise(""), F.lit("]"))
    return rows.select("i", "tag", p[0].alias("category"), json.alias("json"))


def programs(spark: SparkSession) -> DataFrame:
    """Every program: pos, num_ops, tags, categories, canonical_json, semantic_hash.  24 + 24^2 + 24^3 rows.

    A position is read as digits to the base of the vocabulary, so enumeration is one projection.
    """
    n = len(VOCABULARY)
    starts = [0, n, n + n * n, n + n * n + n * n * n]
    parts = [t.split(":") for t in VOCABULARY]
    json = ['["' + '","'.join(p[:2]) + '"' + "".join(f",{a}" for a in p[2:]) + "]" for p in parts]
    pos = F.col("id").cast("int")
    size = F.when(pos < starts[1], 1).when(pos < starts[2], 2).otherwise(3)
    rest = pos - F.when(pos < starts[1], starts[0]).when(pos < starts[2], starts[1]).otherwise(starts[2])
    digit = lambda k: F.expr(f"cast(rest div {n**k} as int) % {n} + 1")
    digits = F.slice(F.array(digit(2), digit(1), digit(0)), 4 - F.col("num_ops"), F.col("num_ops"))
    named = lambda names: F.transform("digits", lambda d: F.element_at(F.array(*map(F.lit, names)), d))
    d = spark.range(starts[3]).select(pos.alias("pos"), size.alias("num_ops"), rest.alias("rest")).withColumn("digits", digits)
    text = F.concat(F.lit('{"ops":['), F.array_join(named(json), ","), F.lit("]}"))
    out = d.select("pos", "num_ops", named(VOCABULARY).alias("tags"), named([p[0] for p in parts]).alias("categories"), text.alias("canonical_json"))
    return out.withColumn("semantic_hash", F.sha2("canonical_json", 256))


def op_tags(tags: str = "tags") -> Column:
    """The sorted multiset of tags."""
    return F.array_sort(tags)


def seed_of(semantic_hash: str, base: int) -> Column:
    return F.conv(F.substring(semantic_hash, 1, 8), 16, 10).cast("long").bitwiseXOR(F.lit(base))


def held_out(tags: str = "tags", pairs=HELD_OUT) -> Column:
    """Whether both operations of a held-out pair occur, in any order."""
    hit = F.lit(False)
    for a, b in pairs:
        hit = hit | (F.array_contains(tags, a) & F.array_contains(tags, b))
    return hit


def dedup(df: DataFrame, key: str, pos: str) -> DataFrame:
    """The first row of each key by position, without a sort: a grouped minimum."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), pos).alias("r")).select("r.*")


def quotas(df: DataFrame, label: str, pos: str, share: float) -> DataFrame:
    """(label, n, quota): how many rows of each label a slice of ``share`` takes, with carried rounding.

    Running sums are doubles in the labels' order of appearance and rounded half to even.
    """
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    w = W.orderBy("first").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = F.rint(F.sum(F.col("n").cast("double") * share).over(w))
    # one row a label, and labels are few: a single window over them
    return g.withColumn("upto", run).withColumn("quota", (F.col("upto") - F.coalesce(F.lag("upto").over(W.orderBy("first")), F.lit(0.0))).cast("long")).select(label, "n", "quota")


def slice_rows(df: DataFrame, label: str, pos: str, key: str, shares: list[tuple[str, float]], seed: str, rest: str) -> DataFrame:
    """``df`` with ``split``: per label, each named share takes its quota in the order of a seeded hash.

    Places come from counts a label and bucket of the hash and ranks inside these, so a label that holds
    most rows is still spread over all tasks.
    """
    d = df.withColumn("_h", F.sha2(F.concat(F.lit(seed), key), 256)).withColumn("_b", F.substring("_h", 1, 3))
    before = d.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))  # at most 4096 rows a label
    before = before.select(F.col(label).alias("_l"), F.col("_b").alias("_c"), (F.sum("_n").over(W.partitionBy(label).orderBy("_b")) - F.col("_n")).alias("_before"))
    d = d.join(before, d[label].eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_c")))
    out = d.withColumn("_r", F.col("_before") + F.row_number().over(W.partitionBy(label, "_b").orderBy("_h")))
    used, split = F.lit(0), F.lit(rest)
    for i, (name, share) in enumerate(shares):
        q = quotas(df, label, pos, share).select(F.col(label).alias(f"_l{i}"), F.col("quota").alias(f"_q{i}"))
        out = out.join(q, out[label].eqNullSafe(q[f"_l{i}"]))
        split = F.when((F.col("_r") > used) & (F.col("_r") <= used + F.col(f"_q{i}")), name).otherwise(split)
        used = used + F.col(f"_q{i}")
    return out.withColumn("split", split).select(*df.columns, "split")


def splits(spark: SparkSession, seed: str = "0", held_share: float = 0.05, val_share: float = 0.1) -> DataFrame:
    """Every program with its split: compositional, paraphrase, boundary, val or train."""
    p = dedup(programs(spark), "semantic_hash", "pos").withColumn("label", F.array_join("categories", ">"))
    held = p.where(held_out()).withColumn("split", F.lit("test_compositional"))
    cut = slice_rows(p.where(~held_out()), "label", "pos", "semantic_hash", [("test_paraphrase", held_share), ("test_boundary", held_share)], seed, "train")
    rest = slice_rows(cut.where("split = 'train'").drop("split"), "label", "pos", "semantic_hash", [("val", val_share)], seed + "val", "train")
    return held.unionByName(cut.where("split <> 'train'")).unionByName(rest)


def leaks(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys found in more than one split."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def holdout_faults(splits: DataFrame, pairs=HELD_OUT, held: str = "test_compositional", train: str = "train") -> DataFrame:
    """(check, what): held-out pairs outside their split, their operations that training lacks, and others inside it."""
    outside = splits.where((F.col("split") != held) & held_out("tags", pairs)).select(F.lit("pair outside").alias("check"), F.col("semantic_hash").alias("what"))
    inside = splits.where((F.col("split") == held) & ~held_out("tags", pairs)).select(F.lit("other inside").alias("check"), F.col("semantic_hash").alias("what"))
    spark = splits.sparkSession
    ops = spark.createDataFrame([(t,) for t in sorted({t for p in pairs for t in p})], "tag string")
    seen = splits.where(F.col("split") == train).select(F.explode("tags").alias("tag")).distinct()
    never = ops.join(seen, "tag", "left_anti").select(F.lit("not in training").alias("check"), F.col("tag").alias("what"))
    return outside.unionByName(inside).unionByName(never)


def decoded(df: DataFrame, json: str = "canonical_json") -> DataFrame:
    """``df`` with the tags that a program's JSON holds; what is no program of one to three known operations gives null."""
    ops = F.from_json(F.col(json), "ops array<array<string>>")["ops"]
    tags = F.transform(ops, lambda o: F.array_join(o, ":"))
    known = F.array(*map(F.lit, VOCABULARY))
    fits = F.size(tags).between(1, 3) & F.forall(tags, lambda t: F.array_contains(known, t))
    return df.withColumn("tags", F.when(F.coalesce(fits, F.lit(False)), tags))
