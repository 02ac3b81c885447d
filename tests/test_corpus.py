import pytest
from pyspark.sql import functions as F

from arrowleaf.operators import corpus
from arrowleaf.sources.tables import read_jsonl, write_jsonl
from arrowleaf.streaming.programs import stream


def test_join_last_wins_and_raises(spark):
    asts = spark.createDataFrame([("a", "h1"), ("b", "h2")], "spec_id string, semantic_hash string")
    said = spark.createDataFrame([("a", "h1", ["old"], 0), ("a", "h1", ["x", "y"], 1), ("b", "h2", ["z"], 2)], "spec_id string, semantic_hash string, value array<string>, pos int")
    code = spark.createDataFrame([("a", "h1", ["1", "2", "3"], 0), ("b", "h2", ["4"], 1), ("c", "h9", ["5"], 2)], "spec_id string, semantic_hash string, value array<string>, pos int")
    got = {r.spec_id: (r.instructions, r.codes) for r in corpus.corpus_join(asts, said, code).collect()}
    assert got == {"a": (["x", "y", "x"], ["1", "2", "3"]), "b": (["z"], ["4"])}
    with pytest.raises(Exception, match="no fit for b"):
        corpus.corpus_join(asts, said.where("spec_id = 'a'"), code).collect()


def test_strict_pairs(spark):
    d = spark.createDataFrame([(1, ["a", "b"], ["c", "d"])], "i int, x array<string>, y array<string>")
    assert [(r.at, r.left, r.right) for r in corpus.pairs(d, "x", "y", "i").collect()] == [(0, "a", "c"), (1, "b", "d")]
    with pytest.raises(Exception, match="unequal"):
        corpus.pairs(d.withColumn("y", F.array(F.lit("c"))), "x", "y", "i").collect()


def test_sample_flags_mask(spark):
    d = spark.range(25)
    assert corpus.percent_sample(d, "id", 10, "s").count() == 2  # 2.5 to even
    with pytest.raises(ValueError):
        corpus.percent_sample(d, "id", 101, "s")
    rows = spark.createDataFrame([(1, True, None, None), (2, None, None, None), (3, True, False, None), (4, True, True, "e")], "i int, ok boolean, cross_check_ok boolean, error string")
    assert [r.i for r in rows.where(corpus.verified(["ok"])).collect()] == [1]
    ids = spark.createDataFrame([([5, 6, 10, 20, 21, 2],)], "ids array<int>")
    assert ids.select(corpus.loss_labels("ids", 10)).first()[0] == [-100, -100, -100, 20, 21, 2]
    assert ids.select(corpus.right_padded("ids", F.lit(8), 0)).first()[0] == [5, 6, 10, 20, 21, 2, 0, 0]


def test_jsonl_and_stream(spark, tmp_path):
    d = spark.createDataFrame([("train", 1), ("val", 2)], "split string, i int")
    write_jsonl(d, str(tmp_path / "j"), "split")
    assert read_jsonl(spark, str(tmp_path / "j" / "split=val"), "i int").first().i == 2
    spark.createDataFrame([([3, 2, 4], 1)], "xs array<bigint>, k bigint").write.parquet(str(tmp_path / "s"))
    q = stream(spark, str(tmp_path / "s"), "xs array<bigint>, k bigint", ["filter:even", "order:ascending"]).writeStream.format("memory").queryName("lists_out").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("lists_out").first().result == [2, 4]
