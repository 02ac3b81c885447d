"""Near copies of the pipeline's stage against a brute force over all pairs."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from arrowleaf.llm import neardup, simhash
from arrowleaf.llm.common import ascii_words


def _set(text):
    words = ascii_words(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _groups(texts, share=0.8):
    """The smallest position of each text's component, over all pairs."""
    sets, root = [_set(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= share * (len(sets[i]) + len(sets[j]) - common) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return root


def _texts():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    texts = [None, "", " \n", "one two", "One  TWO", "a b c d e"]
    for _ in range(60):
        base = [rnd.choice(words) for _ in range(rnd.choice([30, 120, 400]))]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(rnd.randint(1, max(1, len(base) // 30))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    dense = [rnd.choice(words) for _ in range(200)]
    for _ in range(150):
        copy = list(dense)
        for _ in range(rnd.randint(1, 6)):
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
        texts.append(" ".join(copy))
    return texts


def test_stage_keeps_one_of_each(spark):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = _groups(texts)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect())
    assert got == sorted(set(want))
    assert neardup.one_of_each(docs.limit(0)).count() == 0


def test_blocks_change_nothing(spark):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots = {r.doc_id: r.root for r in neardup.grouped(docs, block=16).collect()}
    assert len({(roots[i], g) for i, g in enumerate(_groups(texts))}) == len(set(roots.values())) == len(set(_groups(texts)))


def test_repeated_texts_alike_to_none(spark):
    words = [f"v{i}" for i in range(60)]
    near = [" ".join(words[:40]), " ".join([*words[:39], "other"])]
    texts = [" ".join(words[40:])] * 50 + near * 20 + [None, ""] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sorted(r.doc_id for r in neardup.one_of_each(docs).collect())
    assert got == sorted(set(_groups(texts))) == [0, 50, 90]


def test_fingerprints_link_without_bands(spark, monkeypatch):
    """The links of SimHash count by themselves: here no band is shared."""
    texts = _texts()[:246]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    marks = neardup._marks
    alone = lambda d: marks(d).withColumn("keys", F.array(F.xxhash64("node")))
    monkeypatch.setattr(neardup, "_marks", alone)
    roots = {r.doc_id: r.root for r in neardup.grouped(docs).collect()}
    prints, sets = [simhash.fingerprint(t, 5) for t in texts], [_set(t) for t in texts]
    want, groups, whole = 0, 0, _groups(texts)
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            alike = common >= 0.8 * (len(sets[i]) + len(sets[j]) - common)
            assert roots[i] != roots[j] or whole[i] == whole[j]
            if sets[i] != sets[j] and alike and ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 4:
                want += 1
                groups += roots[i] == roots[j]
    assert want > 5 and groups == want
