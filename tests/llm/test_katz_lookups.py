"""What op5's lookups send for cold words and for the table, and that blocks come back as they went."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from arrowleaf.llm import katz
from arrowleaf.llm.common import ascii_words


def test_lookups_stay_small(spark, monkeypatch):
    """A cold token asks once, with its neighbours, and the table has gains only of pairs of two cold words."""
    rnd = random.Random(5)
    texts = [" ".join(f"w{int(rnd.paretovariate(0.5)) % 20_000}" for _ in range(100)) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    dealt, deal = [], type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda df, *a: dealt.append(df) or deal(df, *a))
    scored = katz._score(docs, *katz._learn(docs.select("text"), 100, 200))
    monkeypatch.undo()
    asked = next(df for df in dealt if "ids" in df.columns)
    size = "sum(length(a) + length(b) + length(c) + length(d))"
    in_table, in_asked = (asked.where(f"kind <> {katz.TEXT} and batch {x} 0").selectExpr(size).first()[0] for x in ("<", ">="))
    words = [w for t in texts for w in t.split()]
    often = {w for w, _ in sorted(((w, words.count(w)) for w in set(words)), key=lambda x: -x[1])[:100]}
    cold = sum(w not in often for w in words)
    pairs = len({p for t in texts for p in zip(t.split(), t.split()[1:], strict=False)})
    assert in_asked / cold < 24, (in_asked, cold)
    assert in_table / pairs < 16, (in_table, pairs)
    assert scored.count() == len(texts)


@pytest.mark.parametrize("kind", katz.KINDS)
def test_table_rows_come_back(kind):
    rng = np.random.default_rng(3)
    key = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2))
    if kind == katz.PAIR:
        key = np.unique(rng.integers(0, 2**32, 500).astype(np.uint32))
    n, gain = rng.integers(1, 300, len(key)), rng.random(len(key))
    other = rng.integers(0, 2**63 if kind == katz.FAR else 2 if kind == katz.WORD else 60_000, len(key)).astype(np.uint64)
    mixed = rng.permutation(len(key))
    rows = katz._table(7, kind, key[mixed], n[mixed], other[mixed] if kind == katz.FAR else other[mixed].astype(np.int64), gain[mixed])
    assert len(rows) == 7 and len({r[0] for r in rows}) == 7
    got = {int(k): (*rest,) for r in rows for k, *rest in zip(*katz._columns(r[2] + len(katz.KINDS), *r[3:6]), strict=True)}
    for i, k in enumerate(key.tolist()):
        assert kind == katz.FAR or got[k][0] == n[i]
        assert kind == katz.PAIR or got[k][1] == other[i]
        assert kind not in (katz.WORD, katz.FAR) or got[k][2] == gain[i]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_of_a_batch(kind):
    texts = [None, "", " ", "a", " A  b\tc\nd\x0be\x0cf\rg ", "x\x1cy\x1dz\x1f \x85 \xa0nb\u2003em", "ÉTÉ İSTANBUL ẞ ǅ 漢字 😀", "a\x00b \x00", "b a b a"]
    for some in (texts, texts[:3], texts[3:4], []):
        key, at, size = katz._words(pa.array(some, kind))
        assert key[at].tolist() == [xxhash.xxh64_intdigest(w) for t in some for w in ascii_words(t)]
        assert size.tolist() == [len(ascii_words(t)) for t in some]
    sliced = pa.array(texts, kind).slice(4, 3)
    assert katz._words(sliced)[2].tolist() == [len(ascii_words(t)) for t in texts[4:7]]
