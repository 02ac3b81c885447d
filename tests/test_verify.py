import collections

import pytest
from pyspark.sql import functions as F

from arrowleaf.functions.program import interpret
from arrowleaf.operators import corpus, verify
from arrowleaf.plans import cases, space
from arrowleaf.sources import tables

HEAD = "def solve(xs, k):\n    "
GOOD = [
    HEAD + "return [x for x in xs if x > k]\n", HEAD + "out = []\n    for x in xs:\n        if x % 2 == 0:\n            out.append(x * 2)\n    out.sort()\n    return out\n",
    HEAD + "return list(map(lambda x: x + k, xs))\n", HEAD + "while k > 0:\n        k -= 1\n    return sorted(xs, reverse=True)[:k]\n", HEAD + "return [divmod(x, k)[1] + pow(x, 2) for x in xs]\n",
    "def solve(xs: list[int], k: int) -> list[int]:\n    return (lambda y: y)(xs)\n",
]
BAD = [
    "import os\n" + HEAD + "return xs\n", "from os import path\n" + HEAD + "return xs\n", HEAD + "return [().__class__ for x in xs]\n", HEAD + "return __builtins__\n", HEAD + "return eval('1')\n",
    HEAD + "open('x')\n    return xs\n", HEAD + "return xs.__str__()\n", HEAD + "return solve(xs, k)\n", "def helper(x):\n    return x\n" + HEAD + "return xs\n", HEAD + "def f(x):\n        return x\n    return xs\n",
    "class A:\n    pass\n" + HEAD + "return xs\n", "def run(xs, k):\n    return xs\n", "def solve(xs, n):\n    return xs\n", "x = 1\n" + HEAD + "return xs\n", HEAD + "with k as f:\n        pass\n    return xs\n",
    HEAD + "try:\n        return xs\n    except Exception:\n        return []\n", HEAD + "global g\n    return xs\n", "@list\n" + HEAD + "return xs\n", HEAD + "assert k\n    return xs\n", HEAD + "return [f'{x}' for x in xs]\n",
    HEAD + "return [str(x) for x in xs]\n", HEAD + "return xs[0](k)\n", HEAD + "match k:\n        case 1:\n            return xs\n", HEAD + "return [y := k]\n", "def solve(xs, k=1):\n    return xs\n", "def solve(*xs, k):\n    return xs\n",
    HEAD + "del k\n    return xs\n", HEAD + "raise k\n", "async " + HEAD + "return xs\n", HEAD + "yield xs\n", HEAD + "xs.sort.x = 1\n    return xs\n",
]


def test_static_rules():
    assert [verify.problem(c) for c in GOOD] == [None] * len(GOOD)
    assert all(verify.problem(c) in ("safety", "signature") for c in BAD), [c for c in BAD if verify.problem(c) is None]
    assert verify.problem(HEAD[:-6]) == "syntax" and verify.problem(None) == "signature"


def test_funnel(spark):
    t = [([3, 1, 2], 1, [1, 2, 3]), ([], 2, [])]
    codes = {
        "right": HEAD + "return sorted(xs)\n", "wrong": HEAD + "return xs\n", "impure": HEAD + "xs.sort()\n    return xs\n", "slow": HEAD + "while True:\n        pass\n", "raises": HEAD + "return xs[9]\n",
        "unsafe": BAD[0], "broken": "def", "tuple": HEAD + "return tuple(sorted(xs))\n", "long": HEAD + "return sorted(xs)" + " " * 200 + "\n", "none": None,
    }
    d = spark.createDataFrame([(n, c, t) for n, c in codes.items()] + [("untested", codes["right"], [])], "name string, code string, tests array<struct<xs:array<bigint>,k:bigint,expected:array<bigint>>>")
    got = {r.name: r for r in verify.verified(d).withColumn("ok", verify.ok()).collect()}
    assert {n for n, r in got.items() if r.ok} == {"right"}
    assert got["impure"].tests_passed and got["impure"].pure is False and got["slow"].failures == 2 and got["tuple"].executable
    assert not got["unsafe"].executable and got["unsafe"].pure is None and got["unsafe"].syntax_ok and not got["unsafe"].ast_safe
    assert not got["broken"].syntax_ok and not got["long"].length_ok and got["untested"].error == "no test cases to check against"
    f = corpus.funnel(verify.verified(d).withColumn("g", F.lit(1)), "g", ["syntax_ok", "tests_passed"]).first()
    assert f.n == 11 and f.tests_passed == pytest.approx(2 / 11)


def test_suites(spark):
    p = space.programs(spark).where("pos in (0, 5, 300, 5000)")
    full = cases.boundary_suite(p).collect()
    assert cases.boundary(spark).count() == 36 and len(cases.BOUNDARY) == 12 and cases.first_cases(spark).count() == 8
    for r in full:
        keys = [(tuple(c.xs), c.k) for c in r.cases]
        assert len(keys) == len(set(keys)) >= 36
    own = cases.tests(cases.suite(p, 24)).join(p, "semantic_hash").collect()
    for r in own:
        assert 20 < len(r.tests) <= 32 and all(t.expected == interpret(r.tags, t.xs, t.k) for t in r.tests)
        assert all(len(t.xs) <= 20 and all(-100 <= x <= 100 for x in t.xs) and 1 <= t.k <= 10 for t in r.tests)
    lists = cases.boundary_lists()
    assert 1 <= lists[2][0] <= 100 and -100 <= lists[3][0] <= -1 and len(lists[11]) == 20


def test_lines(spark):
    texts = ["x\n" * 40, "x\n" * 40 + "\n", "", None, "a\r\nb\x0cc\u2028d", "y" * 201, "\n"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    n, longest = corpus.line_extent("t")
    for r in d.select("i", n.alias("n"), longest.alias("m"), corpus.length_ok("t").alias("ok")).collect():
        t = texts[r.i]
        if t is not None:
            rows = t.splitlines()
            assert (r.n, r.m) == (len(rows), max(map(len, rows), default=0)), repr(t)
            assert r.ok == (len(rows) <= 40 and r.m <= 200)


def test_samples_and_batches(spark):
    d = spark.range(500)
    got = corpus.sample(d, "id", 120, "s")
    assert got.count() == got.distinct().count() == 120 and corpus.sample(d, "id", 900, "s").count() == 500 and corpus.sample(d, "id", 0, "s").count() == 0
    b = corpus.batches(d, "id", 64, 1).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in b] == [64] * 7 + [52]
    one, two = ({r.id: r.batch for r in corpus.batches(d, "id", 64, e).collect()} for e in (1, 2))
    assert one != two
    left, right = (spark.createDataFrame([(i, c) for i, c in enumerate(x)], f"p int, {n} string") for x, n in (("abc", "l"), ("xyz", "r")))
    assert {(r.at, r.l, r.r) for r in corpus.zipped(left, right, "p").collect()} == {(0, "a", "x"), (1, "b", "y"), (2, "c", "z")}
    with pytest.raises(Exception, match="unequal"):
        corpus.zipped(left, right.limit(2), "p").collect()
    with pytest.raises(ValueError):
        corpus.id_width(70_000)
    assert corpus.steps_of(8192, 100_000) == 12


def test_pair_training(spark):
    words = collections.Counter({"aaab": 5, "aab": 4, "abab": 3, "é": 2, "": 9})
    got = corpus.train_bpe(spark.createDataFrame(list(words.items()), "word string, n long"), 4, most=3)
    table = {w: [f"{b:02X}" for b in w.encode()] for w in words}
    want = []
    for _ in range(4):
        count = collections.Counter()
        for w, s in table.items():
            for p in zip(s, s[1:], strict=False):
                if len(p[0]) + len(p[1]) <= 6:
                    count[p] += words[w]
        if not count:
            break
        a, b = min(count, key=lambda p: (-count[p], p))
        want.append((a, b))
        for w, s in table.items():
            out = []
            for x in s:
                if out and out[-1] == a and x == b:
                    out[-1] = a + b
                else:
                    out.append(x)
            table[w] = out
    assert got == want


def test_sources(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="make it"):
        tables.require({str(tmp_path / "no"): "make it"})
    tables.write_jsonl(spark.createDataFrame([("train", 1), ("val", 2)], "split string, i int"), str(tmp_path / "j"), "split")
    assert [r.i for r in tables.read_splits(spark, str(tmp_path / "j"), "i int", ["val"]).collect()] == [2]
    for fresh, n in ((True, 1), (False, 2), (True, 1)):
        tables.append_log(spark.range(1), str(tmp_path / "log"), fresh)
        assert spark.read.json(str(tmp_path / "log")).count() == n
    spark.range(3).write.parquet(str(tmp_path / "src"))
    made = []

    def make(d):
        made.append(1)
        return d.withColumn("x", F.lit(1))

    for _ in range(2):
        assert tables.cached(spark, str(tmp_path / "src"), str(tmp_path / "keep"), "len=9", make).count() == 3
    assert len(made) == 1
    assert tables.gallery(spark.createDataFrame([("a", "x = 1\n")], "t string, c string"), str(tmp_path / "g.md"), "t", "c") == 1 and "```python\nx = 1\n```" in (tmp_path / "g.md").read_text()
    (tmp_path / "s.toml").write_text("steps = 3\n")
    assert tables.settings(str(tmp_path / "s.toml"), {"steps": 1, "lr": 0.1}) == {"steps": 3, "lr": 0.1}
    with pytest.raises(ValueError):
        tables.settings(str(tmp_path / "s.toml"), {})
    tables.log_metrics(spark, str(tmp_path / "m"), "r", 1, {"loss": 2.0})
    assert spark.read.parquet(str(tmp_path / "m")).first().value == 2.0
