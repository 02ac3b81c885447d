"""Every word keeps its own pairs: scores against a brute-force Katz model, whatever is broadcast."""

import collections
import math
import random

import numpy as np
import pytest

from arrowleaf.llm import katz

BEGIN, END = 0, ""


def _model(texts):
    """log10 P(w | h) of a Katz model over all words, by dictionaries."""
    words, pairs = collections.Counter(), collections.Counter()
    for t in texts:
        w = [*t.split(), END]
        words.update(w)
        pairs.update(zip([BEGIN, *w[:-1]], w, strict=True))
    dw, dp = (katz.discounts(collections.Counter(c.values())) for c in (words, pairs))
    n, after = sum(words.values()), collections.defaultdict(dict)
    single = {w: katz._d(dw, np.array(c)) * c / (n + 1) for w, c in words.items()}
    unseen = 1 - sum(single.values())
    for (h, w), c in pairs.items():
        after[h][w] = katz._d(dp, np.array(c)) * c

    def logp(h, w):
        own = after.get(h)
        if own is None:
            return math.log10(single.get(w, unseen))
        c = sum(pairs[h, x] for x in own)
        total = c if c - sum(own.values()) > 1e-9 * c else c + 1
        if w in own:
            return math.log10(own[w] / total)
        return math.log10((1 - sum(own.values()) / total) / (1 - sum(single[x] for x in own)) * single.get(w, unseen))

    assert sum(10 ** logp("w3", w) for w in single) + 10 ** logp("w3", "never") == pytest.approx(1)
    return logp


def test_every_word_has_pairs(spark):
    rnd = random.Random(7)
    # words of all ranks, a word that is always followed by the same one
    line = lambda: " ".join(x for _ in range(rnd.randint(0, 40)) for x in [f"w{int(rnd.paretovariate(0.6)) % 300}"] + ["los angeles"] * (rnd.random() < 0.1))
    texts = [line() for _ in range(150)]
    texts += texts[:20] + [""]
    asked = texts + ["never seen at all w3", "w1 never w1", "los w1 los never angeles w250 w251 w252", ""]
    logp = _model(texts)
    want = []
    for t in asked:
        w = [*t.split(), END]
        want.append(sum(logp(h, x) for h, x in zip([BEGIN, *w[:-1]], w, strict=True)))
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(asked)], "doc_id string, text string").repartition(3)
    for words, room in ((60_000, 4_000_000), (12, 30), (0, 0)):
        model, table = katz.fit(train, words, room)
        assert len(model.word) <= words and len(model.pair) <= room
        got = {r.doc_id: r for r in katz.score(docs, model, table).collect()}
        assert [got[f"d{i}"].score for i in range(len(asked))] == pytest.approx(want), words
        assert [got[f"d{i}"].n_tokens for i in range(len(asked))] == [len(t.split()) + 1 for t in asked]
        assert sum(got[f"d{i}"].n_known for i in range(len(texts))) == sum(len(t.split()) + 1 for t in texts)
    rare = table.where(f"kind = {katz.WORD}").toPandas().n.to_numpy()
    assert (10 ** model.rare_log(rare)).sum() + 10**model.unseen_log == pytest.approx(1)
