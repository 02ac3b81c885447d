"""Test inputs for programs: boundary lists, random lists and lists that a program's filter rejects."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arrowleaf.functions.lists import run_each

#: The domain, boundary lists (None where one is drawn) and candidates for rejection.
MAX_LEN, LOW, HIGH, KS = 20, -100, 100, (1, 5, 10)
BOUNDARY = ([], [0], "positive", "negative", [7] * 8, [-7] * 8, [0] * 5, [-1, -2, -3, -4, -5], list(range(-5, 6)), [LOW, HIGH] * 5, list(range(MAX_LEN)), "longest")
FIRST = (([], 1), ([0], 1), ("single", 10), ([5] * 10, 1), (list(range(-5, 5)), 5), ([LOW, HIGH] * 5, 1), ([1, 3, 5, 7, 9], 1), (list(range(MAX_LEN)), 10))
REJECT = ([1, 3, 5, 7, 9], [2, 4, 6, 8], [-1, -3, -7], [-2, -4, -8], [0, 0, 0], [1, 2, 3], [100, 99, 98], [-100, -99, -98], [11, 13, 17], [100, 100], [-100, -100])
CASE = "struct<xs:array<bigint>,k:bigint>"


def drawn(what: str, seed: int) -> list[int]:
    """A list drawn by the hash of seed, name and place."""
    size, low, high = {"positive": (1, 1, HIGH), "negative": (1, LOW, -1), "single": (1, LOW, HIGH), "longest": (MAX_LEN, LOW, HIGH)}[what]
    digits = [hashlib.sha256(f"{seed}:{what}:{i}".encode()).hexdigest()[:8] for i in range(size)]
    return [int(d, 16) % (high - low + 1) + low for d in digits]


def boundary_lists(seed: int = 0) -> list[list[int]]:
    return [drawn(x, seed) if isinstance(x, str) else x for x in BOUNDARY]


def boundary(spark: SparkSession, seed: int = 0) -> DataFrame:
    """(case_no, xs, k): 12 lists, each with the least, the middle and the greatest k."""
    rows = [(i * len(KS) + j, xs, k) for i, xs in enumerate(boundary_lists(seed)) for j, k in enumerate(KS)]
    return spark.createDataFrame(rows, "case_no int, xs array<bigint>, k bigint")


def first_cases(spark: SparkSession, seed: int = 0) -> DataFrame:
    """(case_no, xs, k): the eight cases that lead a program's own suite."""
    rows = [(i, drawn(xs, seed) if isinstance(xs, str) else xs, k) for i, (xs, k) in enumerate(FIRST)]
    return spark.createDataFrame(rows, "case_no int, xs array<bigint>, k bigint")


def random_inputs(keys: DataFrame, key: str, n: int = 24, seed: int = 0) -> DataFrame:
    """n seeded (xs, k) for each key: length 0-20, elements -100-100, k 1-10."""
    draw = lambda *c: F.xxhash64(F.lit(seed), F.col(key), "case_no", *c)
    d = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("case_no"))
    size = F.pmod(draw(F.lit(-1)), F.lit(MAX_LEN + 1)).cast("int")
    xs = F.transform(F.slice(F.sequence(F.lit(1), F.lit(MAX_LEN)), F.lit(1), size), lambda i: F.pmod(draw(i), F.lit(HIGH - LOW + 1)) + LOW)
    return d.select(key, "case_no", xs.alias("xs"), (F.pmod(draw(F.lit(-2)), F.lit(10)) + 1).alias("k"))


def distinct_cases(cases: str | Column) -> Column:
    """An array of (xs, k) without later repeats, in order."""
    return F.array_distinct(cases)


def suite(programs: DataFrame, n: int = 24, seed: int = 0) -> DataFrame:
    """(semantic_hash, tags, cases): the leading cases and n random ones of each program, repeats dropped."""
    spark = programs.sparkSession
    lead = F.array(*[F.struct(F.array(*[F.lit(x) for x in r.xs]).cast("array<bigint>").alias("xs"), F.lit(r.k).cast("bigint").alias("k")) for r in first_cases(spark, seed).orderBy("case_no").collect()])
    drawn_ = random_inputs(programs, "semantic_hash", n, seed).groupBy("semantic_hash").agg(F.array_sort(F.collect_list(F.struct("case_no", "xs", "k"))).alias("c"))
    own = F.transform("c", lambda c: F.struct(c["xs"].alias("xs"), c["k"].alias("k")))
    return programs.select("semantic_hash", "tags").join(drawn_, "semantic_hash").select("semantic_hash", "tags", distinct_cases(F.concat(lead, own)).alias("cases"))


def reject_all(programs: DataFrame) -> DataFrame:
    """(semantic_hash, cand, xs, k): candidates whose first filter leaves nothing, with the first such k."""
    spark = programs.sparkSession
    c = spark.createDataFrame([(i, xs, j, k) for i, xs in enumerate(REJECT) for j, k in enumerate(KS)], "cand int, xs array<bigint>, j int, k bigint")
    p = programs.where(F.array_contains("categories", "filter")).select("semantic_hash", prefix().alias("tags"))
    # 33 fixed candidates a program
    empty = p.crossJoin(F.broadcast(c)).where(F.size(run_each()) == 0)
    return empty.groupBy("semantic_hash", "cand").agg(F.min_by(F.struct("xs", "k"), "j").alias("c")).select("semantic_hash", "cand", "c.xs", "c.k")


def prefix() -> Column:
    """The tags up to the first filter."""
    return F.slice("tags", F.lit(1), F.array_position("categories", "filter").cast("int"))


def boundary_suite(programs: DataFrame, seed: int = 0) -> DataFrame:
    """(semantic_hash, tags, cases): the boundary cases of each program and the lists that its filter rejects."""
    spark = programs.sparkSession
    fixed = F.array(*[F.struct(F.array(*[F.lit(x) for x in r.xs]).cast("array<bigint>").alias("xs"), F.lit(r.k).cast("bigint").alias("k")) for r in boundary(spark, seed).orderBy("case_no").collect()])
    rejected = reject_all(programs).groupBy("semantic_hash").agg(F.array_sort(F.collect_list(F.struct("cand", "xs", "k"))).alias("c"))
    own = F.coalesce(F.transform("c", lambda c: F.struct(c["xs"].alias("xs"), c["k"].alias("k"))), F.array().cast(f"array<{CASE}>"))
    return programs.select("semantic_hash", "tags").join(rejected, "semantic_hash", "left").select("semantic_hash", "tags", distinct_cases(F.concat(fixed, own)).alias("cases"))


def has_reject_all(programs: DataFrame, cases: DataFrame) -> DataFrame:
    """(semantic_hash, rejected): whether one of the program's own ``cases`` (semantic_hash, xs, k) leaves its first filter empty."""
    p = programs.where(F.array_contains("categories", "filter")).select("semantic_hash", prefix().alias("tags"))
    hit = p.join(cases.where(F.size("xs") > 0), "semantic_hash").groupBy("semantic_hash").agg(F.bool_or(F.size(run_each()) == 0).alias("rejected"))
    return programs.select("semantic_hash").join(hit, "semantic_hash", "left").select("semantic_hash", F.coalesce("rejected", F.lit(False)).alias("rejected"))


def labelled(cases: DataFrame, tags: str = "tags") -> DataFrame:
    return cases.withColumn("expected", run_each(tags))


def tests(suites: DataFrame) -> DataFrame:
    """``suites`` with its cases labelled: (semantic_hash, tests array<(xs, k, expected)>)."""
    rows = labelled(suites.select("semantic_hash", "tags", F.posexplode("cases").alias("at", "c")).select("semantic_hash", "tags", "at", "c.xs", "c.k"))
    own = rows.groupBy("semantic_hash").agg(F.array_sort(F.collect_list(F.struct("at", "xs", "k", "expected"))).alias("t"))
    return own.select("semantic_hash", F.transform("t", lambda t: F.struct(t["xs"].alias("xs"), t["k"].alias("k"), t["expected"].alias("expected"))).alias("tests"))
