import itertools
import random

import pytest
from pyspark.sql import functions as F

from arrowleaf.functions.lists import run, run_each, sql
from arrowleaf.functions.program import VOCABULARY, Op, Program, interpret, rewrite
from arrowleaf.plans import cases, space

rnd = random.Random(3)
INPUTS = [([], 1), ([0], 5), ([-7, 3, 10, -2, 8, 8, 5], 3), (list(range(-9, 10)), 10), ([rnd.randint(-100, 100) for _ in range(20)], 4)]


def test_identity():
    p = Program.of("filter:even", "map:mul_const:2")
    assert p.canonical_json == '{"ops":[["filter","even"],["map","mul_const",2]]}'
    assert Program.from_json(p.canonical_json) == p and p.seed(0) == int(p.semantic_hash[:8], 16)
    for bad in (["map:mul_const:4"], [], ["map:abs"] * 4, ["filter:prime"]):
        with pytest.raises(ValueError):
            Program.of(*bad)
    assert Op.parse("map:mul_const:3").to_json() == ["map", "mul_const", 3]


def test_rewrites_keep_results():
    for tags in itertools.chain.from_iterable(itertools.product(VOCABULARY, repeat=n) for n in (1, 2, 3)):
        short = rewrite(list(tags))
        if short != list(tags):
            for xs, k in INPUTS:
                assert interpret(short, xs, k) == interpret(list(tags), xs, k), tags


def test_all_programs_row_by_row(spark):
    d = space.programs(spark).select("pos", "tags").crossJoin(spark.createDataFrame([(i, xs, k) for i, (xs, k) in enumerate(INPUTS[2:4])], "i int, xs array<bigint>, k bigint"))
    got = d.select("tags", "i", run_each().alias("r")).toPandas()
    assert len(got) == 14424 * 2
    for r in got.itertuples():
        xs, k = INPUTS[2 + r.i]
        assert list(r.r) == interpret(list(r.tags), xs, k), r.tags


def test_compiled_programs(spark):
    d = spark.createDataFrame(INPUTS, "xs array<bigint>, k bigint").coalesce(1)
    some = [list(p) for p in itertools.product(VOCABULARY, repeat=2)]
    some += [[rnd.choice(VOCABULARY) for _ in range(3)] for _ in range(60)]
    some = rnd.sample(some, 120)
    for opt in (True, False):
        rows = d.select("xs", "k", *[run(t, optimise=opt).alias(f"c{i}") for i, t in enumerate(some)]).collect()
        for r in rows:
            for i, t in enumerate(some):
                assert list(r[f"c{i}"]) == interpret(t, list(r.xs), r.k), (t, sql(t, optimise=opt))


def test_space_and_splits(spark):
    p = space.programs(spark)
    assert p.count() == 14424 and p.select("semantic_hash").distinct().count() == 14424
    assert {r.semantic_hash for r in p.where("pos < 24").collect()} == {Program.of(t).semantic_hash for t in VOCABULARY}
    assert p.where(space.held_out()).count() == 554
    s = space.splits(spark).persist()
    assert {r["split"]: r["count"] for r in s.groupBy("split").count().collect()} == {"test_compositional": 554, "test_paraphrase": 694, "test_boundary": 694, "val": 1248, "train": 11234}
    assert space.leaks(s, "semantic_hash", "split").count() == 0
    s.unpersist()


def test_random_cases(spark):
    d = cases.random_inputs(spark.range(40).withColumnRenamed("id", "key"), "key", 24, 5)
    ok = (F.size("xs") <= 20) & F.col("k").between(1, 10) & F.forall("xs", lambda x: x.between(-100, 100))
    assert d.count() == 960 and d.where(~ok).count() == 0
    assert d.exceptAll(cases.random_inputs(spark.range(40).withColumnRenamed("id", "key"), "key", 24, 5)).count() == 0
    assert d.select(F.count_distinct("xs")).first()[0] > 800
