from itertools import product

from pyspark.sql import functions as F

from arrowleaf.functions.program import VOCABULARY, interpret
from arrowleaf.operators import render, verify
from arrowleaf.plans import space

INPUTS = (([], 3), ([5, -4, 0, 7, -9, 12, 4], 2), ([3, 3, -1, 8, -6], 9))


def fits(tags, style):
    return not style.needs or any(n in tags or any(t.startswith(n + ":") for t in tags) for n in style.needs)


def test_golden():
    by_name = {s.name: s for s in render.STYLES}
    assert len(by_name) == 62
    tags = ["filter:even", "map:mul_const:2", "order:ascending"]
    assert render.render(tags, by_name["list_comprehension"]) == "def solve(xs: list[int], k: int) -> list[int]:\n    return sorted([x * 2 for x in xs if x % 2 == 0])\n"
    assert render.render(["map:negate", "map:negate", "map:square"], by_name["list_comprehension_bare"]) == "def solve(xs, k):\n    return [(-(-v)) ** 2 for v in xs]\n"
    assert render.render(["map:negate", "map:negate", "map:negate"], by_name["list_comprehension_bare"]) == "def solve(xs, k):\n    return [-(-(-v)) for v in xs]\n"
    assert render.render(["order:reverse", "filter:gt_k"], by_name["for_loop_explicit_reverse"]).splitlines() == [
        "def solve(xs, k):", "    # 元のリストを複製する", "    result = list(xs)", "    # 並べ替える", "    result = result[::-1]", "    # 条件に合う要素だけを残す",
        "    tmp = []", "    for x in result:", "        if x > k:", "            tmp.append(x)", "    result = tmp", "    return result",
    ]


def test_every_style_computes_the_program():
    programs = [[t] for t in VOCABULARY] + [list(p) for p in product(VOCABULARY, repeat=2)][::3] + [list(p) for p in product(VOCABULARY, repeat=3)][::97]
    for tags in programs:
        codes = [render.render(tags, s) for s in render.STYLES if fits(tags, s)]
        assert len(set(codes)) == len(codes), tags
        for code in codes:
            assert verify.problem(code) is None, code
            scope: dict = {}
            exec(code, scope)  # our own rendering
            for xs, k in INPUTS:
                given = list(xs)
                assert scope["solve"](given, k) == interpret(tags, xs, k) and given == xs, code


def test_variants_and_replay(spark):
    p = space.programs(spark)
    counts = {r["n"]: r["count"] for r in p.select(F.size(render.applicable()).alias("n")).groupBy("n").count().collect()}
    assert counts == {52: 155, 54: 103, 60: 12564, 62: 1602}
    some = p.where("pos < 40")
    v = render.variants(some, 5)
    assert v.groupBy("pos").count().where("count <> 5").isEmpty() and v.count() == 200
    assert render.replay_faults(v, some).isEmpty()
    bad = v.limit(3).withColumn("code", F.lit("x"))
    assert render.replay_faults(bad, some).count() == 3
    assert render.replay_faults(v.limit(2).withColumn("code_style", F.lit("none")), some).count() == 2
