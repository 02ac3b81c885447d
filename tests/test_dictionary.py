from pyspark.sql import functions as F

from arrowleaf.operators import dictionary


def test_pools_and_checks(spark):
    sizes = {"a": 1, "b": 2, "c": 10, "frame:x": 6, "d": 14}
    d = spark.createDataFrame([(k, i, f"{k}{i // 2}") for k, n in sizes.items() for i in range(n)], "key string, idx int, text string")
    p = dictionary.pools(d, "0")
    got = {(r["key"], r["pool"]): r["count"] for r in p.groupBy("key", "pool").count().collect()}
    # 2.5 and 3.5 are rounded half to even
    assert got == {("a", "shared"): 1, ("b", "reserved"): 1, ("b", "train"): 1, ("c", "reserved"): 2, ("c", "train"): 8, ("frame:x", "shared"): 6, ("d", "reserved"): 4, ("d", "train"): 10}
    out = dictionary.outside(p.select("key", "idx"), p, "train")
    assert out.count() == 7 and out.select("key").distinct().count() == 3
    keys = spark.createDataFrame([("a",), ("z",)], "key string")
    assert [r["key"] for r in dictionary.missing(keys, d).collect()] == ["z"]
    assert dictionary.repeated(d).agg(F.sum("n")).first()[0] == 32
