import json

import pytest
from pyspark.sql import functions as F

from arrowleaf.operators import dictionary, instructions
from arrowleaf.plans import space

ONE = {k: v[:1] for k, v in instructions.OWN.items()}


def rows(spark, *programs):
    return spark.createDataFrame([(str(i), list(p)) for i, p in enumerate(programs)], "semantic_hash string, tags array<string>")


def sentence(spark, *tags, **at):
    d = instructions.chosen(rows(spark, tags), ONE)
    numbers = {**dict.fromkeys(instructions.GLUE, 0), "template": 0, **at}
    choice = F.struct(*[F.lit(v).alias(k) for k, v in numbers.items()], F.lit(0).alias("opening"), F.lit(0).alias("closing"), F.col("choice.ops").alias("ops"), F.col("choice.frames").alias("frames"))
    return instructions.told(d.withColumn("choice", choice), ONE).first().text


def test_sentence_types(spark):
    three = ("filter:even", "map:mul_const:3", "order:ascending")
    assert sentence(spark, *three) == "整数のリストxsについて、偶数の要素だけを残して、3倍して、昇順に並べるsolve関数を書いてください。"
    assert sentence(spark, "map:add_k", "map:square") == "整数のリストxsについて、kを足してから2乗するsolve関数を書いてください。"
    assert sentence(spark, "map:add_k", "order:reverse", "map:square") == "整数のリストxsについて、kを足して、並びを逆にして、2乗するsolve関数を書いてください。"
    assert sentence(spark, *three, template=1) == "整数のリストxsについて、まず偶数の要素だけを残して、次に3倍して、最後に昇順に並べるsolve関数を書いてください。"
    assert sentence(spark, *three, template=2) == "整数のリストxsについて、次の手順で処理するsolve関数を書いてください。まず、偶数の要素だけを残す。次に、3倍する。最後に、昇順に並べる。"
    assert sentence(spark, *three, template=2, style=1).endswith("(1) 偶数の要素だけを残す。(2) 3倍する。(3) 昇順に並べる。")
    assert sentence(spark, *three, template=3) == "整数のリストxsについて、昇順に並べるsolve関数を書いてください。ただし、昇順に並べる前に、偶数の要素だけを残して、3倍すること。"


def test_choices(spark):
    p = rows(spark, ["filter:even"], ["map:abs", "order:ascending"])
    one = instructions.chosen(p, attempts=30)
    assert {r.t for r in one.where("semantic_hash = '0'").select(F.col("choice.template").alias("t")).collect()} == {0}
    assert len({r.t for r in one.where("semantic_hash = '1'").select(F.col("choice.template").alias("t")).collect()}) == 4
    held = instructions.chosen(p, allowed={"filter:even": [1]}, attempts=20)
    assert {tuple(r.o) for r in held.where("semantic_hash = '0'").select(F.col("choice.ops").alias("o")).collect()} == {(1,)}
    with pytest.raises(Exception, match="no expression for filter:even"):
        instructions.chosen(p, {k: v for k, v in ONE.items() if k != "filter:even"}).collect()
    with pytest.raises(ValueError):
        instructions.chosen(p, sentences=("sung",))
    got = instructions.renderings(p, 5).collect()
    assert len({(r.semantic_hash, r.text) for r in got}) == len(got) and max(r.at for r in got) == 4
    assert instructions.renderings(p.limit(1), 500, ONE).count() == 1  # a small dictionary has one sentence only
    assert instructions.too_few(spark.createDataFrame([(["a"], ["x", "y"]), (["a"], ["x"])], "instructions array<string>, codes array<string>")).count() == 1


def test_replay(spark):
    p = rows(spark, ["filter:odd", "map:mul_const:2"])
    r = instructions.renderings(p, 3).withColumn("dictionary_sha256", F.lit("h"))
    assert instructions.replay_faults(r, p, instructions.OWN, "h").count() == 0
    assert instructions.replay_faults(r, p, instructions.OWN, "other").count() == 3
    assert instructions.replay_faults(r.withColumn("text", F.concat("text", F.lit("!"))), p, instructions.OWN, "h").count() == 3
    assert {x.fault for x in instructions.replay_faults(r, p, ONE, "h").collect()} <= {"unknown choice or dictionary", "differs"}


def test_dictionary_files(spark, tmp_path):
    d = dictionary.from_expressions(instructions.OWN)
    path = str(tmp_path / "d.json")
    dictionary.save(d, path)
    assert dictionary.load(spark, path) == d and dictionary.content_sha256(dictionary.load(spark, path)) == dictionary.content_sha256(d)
    assert len(d) == len(instructions.KEYS) == 26
    t = dictionary.table(spark, d)
    assert dictionary.structure_faults(t).count() == dictionary.contract_faults(t).count() == 0
    (tmp_path / "bad.json").write_text(json.dumps({"filter:even": {"slot_type": "TEXT", "expressions": ["x"]}}))
    with pytest.raises(ValueError, match="slot type"):
        dictionary.load(spark, str(tmp_path / "bad.json"))
    assert list(dictionary.load(spark, str(tmp_path / "bad.json"), strict=False)) == ["filter:even"]
    (tmp_path / "no.json").write_text("{")
    for name in ("no.json", "missing.json"):
        with pytest.raises(ValueError):
            dictionary.load(spark, str(tmp_path / name))


def test_holdout_and_decoding(spark):
    s = spark.createDataFrame(
        [("a", ["filter:even", "order:descending"], "train"), ("b", ["map:abs"], "test_compositional"), ("c", ["map:abs", "order:ascending", "slice:take_last_k"], "test_compositional")], "semantic_hash string, tags array<string>, split string"
    )
    got = {(r.check, r.what) for r in space.holdout_faults(s).collect()}
    assert {("pair outside", "a"), ("other inside", "b"), ("not in training", "map:abs")} <= got and ("not in training", "filter:even") not in got
    j = spark.createDataFrame([('{"ops":[["filter","even"],["map","mul_const",2]]}',), ('{"ops":[]}',), ('{"ops":[["map","mul_const",4]]}',), ("{",), (None,)], "canonical_json string")
    assert [r.tags for r in space.decoded(j).collect()] == [["filter:even", "map:mul_const:2"], None, None, None, None]
