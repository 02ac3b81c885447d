"""Quality: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins.  Boosting goes round the features in turn; every step fits a
shallow tree (three cuts at most) to the gradient over one feature's bins and adds it to that
feature's lookup table.  Then the most useful pairs of features get tables of their own in the same
way.  A score is the logistic of an intercept plus one table entry a feature and pair, added up for
whole batches at once.  Learning takes at most ``sample`` labelled rows.

Defined cases: null and empty texts have the features of no words; whole texts are read; null or
repeated labels are handled by ``labelled_sample``; with no labels of both kinds every score is the
share of positive labels (0.5 when there are none).  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, sliced

FEATURES = (
    "log_words", "word_length", "upper_share", "digit_share", "mark_share", "other_symbol_share", "shout_share", "new_word_share", "line_length",
    "new_line_share", "pipe_share", "high_byte_share", "comma_share", "stop_share", "marks_a_word", "top_word_share", "capital_word_share", "new_pair_share",
)
_CLASS = np.zeros((256, 7), np.int64)
for _c in range(256):
    _s = chr(_c)
    _CLASS[_c] = [65 <= _c <= 90, 48 <= _c <= 57, _c < 128 and 32 < _c and not _s.isalnum(), _s in "#$%&*@^~<>{}[]\\_=+`/", _s == "|", _c >= 128, _s == ","]


def features(text: str | None) -> list[float]:
    raw = text.encode() if text else b""
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    upper, digit, mark, odd, pipe, high, comma = (np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS).tolist()
    lines = raw.split(b"\n")
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    shout = sum(c for w, c in seen.items() if len(w) > 1 and w.isupper())
    title = sum(c for w, c in seen.items() if 65 <= w[0] <= 90)
    stop = sum(c for w, c in seen.items() if w.endswith((b".", b"!", b"?", b".\"", b".)")))
    return [
        float(np.log1p(len(words))), len(raw) / n, upper / size, digit / size, mark / size, odd / size, shout / n, len(seen) / n, len(raw) / len(lines),
        len(set(lines)) / len(lines), pipe / n, high / size, comma / n, stop / n, mark / n, max(seen.values(), default=0) / n, title / n, pairs / max(len(words) - 1, 1),
    ]


def _tree(grad: np.ndarray, hess: np.ndarray, cuts: int, least: float) -> np.ndarray:
    """Leaf values over ordered bins after up to ``cuts`` best cuts."""
    edges = [0, len(grad)]
    cg, ch = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    for _ in range(cuts):
        best = (1e-9, 0)
        for a, b in zip(edges, edges[1:], strict=False):
            c = np.arange(a + 1, b)
            if len(c):
                gain = value(a, c) + value(c, b) - value(a, b)
                gain[(ch[c] - ch[a] < least) | (ch[b] - ch[c] < least)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), int(c[gain.argmax()]))
        if not best[1]:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(grad))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


@dataclass
class Gam:
    rounds: int = 150
    rate: float = 0.15
    bins: int = 32
    coarse: int = 8
    pairs: int = 6
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    wide: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    both: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, threshold: float = 0.3) -> Gam:
        """Learn; the intercept then puts the most accurate cut of every fifth row at ``threshold``."""
        if not len(y) or y.min() == y.max():
            p = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
            self.base, self.cuts = float(np.log(p / (1 - p))), []
            return self
        held = np.arange(len(y)) % 5 == 4
        self._learn(x[~held], y[~held])
        raw, truth = self.raw(x[held]), y[held]
        order = np.argsort(-raw, kind="stable")
        good = np.cumsum(truth[order] * 2 - 1)
        if len(good) and good.max() > 0 and truth.min() < truth.max():
            ties = np.append(raw[order][1:] < raw[order][:-1], True)
            j = int(np.argmax(np.where(ties, good, -np.inf)))
            cut = (raw[order[j]] + raw[order[min(j + 1, len(raw) - 1)]]) / 2
            self.base += float(np.log(threshold / (1 - threshold)) - cut)
        return self

    def _learn(self, x, y):
        q = lambda k: [np.unique(np.quantile(c, np.linspace(0, 1, k + 1)[1:-1])) for c in x.T]
        self.cuts, self.wide = q(self.bins), q(self.coarse)
        fine, wide = self._bin(x, self.cuts), self._bin(x, self.wide)
        p = y.mean()
        self.base = float(np.log(p / (1 - p)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for k, b in enumerate(fine):
                s = 1 / (1 + np.exp(-f))
                g, h = np.bincount(b, y - s, len(self.tables[k])), np.bincount(b, s * (1 - s), len(self.tables[k]))
                step = self.rate * _tree(g, h, 3, 1.0)
                self.tables[k] += step
                f += step[b]
        s = 1 / (1 + np.exp(-f))
        gains = []
        for i in range(len(wide)):
            for j in range(i + 1, len(wide)):
                w = len(self.wide[j]) + 1
                cell = wide[i] * w + wide[j]
                n = (len(self.wide[i]) + 1) * w
                g, h = np.bincount(cell, y - s, n), np.bincount(cell, s * (1 - s), n)
                gains.append((float((g * g / (h + 5.0)).sum()), i, j))
        chosen = [(i, j, np.zeros((len(self.wide[i]) + 1) * (len(self.wide[j]) + 1))) for _, i, j in sorted(gains, reverse=True)[: self.pairs]]
        for _ in range(self.rounds // 3):
            for i, j, t in chosen:
                w = len(self.wide[j]) + 1
                cell = wide[i] * w + wide[j]
                s = 1 / (1 + np.exp(-f))
                g, h = np.bincount(cell, y - s, len(t)).reshape(-1, w), np.bincount(cell, s * (1 - s), len(t)).reshape(-1, w)
                # a cut of one feature, then a cut of the other on either side
                halves = _tree(g.sum(1), h.sum(1), 1, 1.0)
                top = halves == halves[0]
                step = np.zeros_like(g)
                for part in (top, ~top):
                    if part.any():
                        step[part] = _tree(g[part].sum(0), h[part].sum(0), 1, 1.0)
                step = self.rate * step.ravel()
                t += step
                f += step[cell]
        self.both = chosen

    @staticmethod
    def _bin(x, cuts):
        return [np.searchsorted(c, col, side="right") for c, col in zip(cuts, x.T, strict=True)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not self.cuts:
            return out
        for t, b in zip(self.tables, self._bin(x, self.cuts), strict=True):
            out += t[b]
        wide = self._bin(x, self.wide)
        for i, j, t in self.both:
            out += t[wide[i] * (len(self.wide[j]) + 1) + wide[j]]
        return out


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, label: str, fold_ok, sample: int = 8192, model: Gam | None = None) -> Gam:
    """Learn from at most ``sample`` labelled rows; ``fold_ok`` says which ids may be learnt from."""
    model = model or Gam()
    ids = labelled_sample(labels, label, fold_ok, sample)

    def run(batches):
        for big in batches:
            for b in sliced(big):
                x = _matrix(b.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, x.T)], ["id", "y", *FEATURES])

    d = docs.select(F.col("doc_id").alias("sample_id"), "text").join(F.broadcast(ids), "sample_id")
    kinds = "id long, y int, " + ", ".join(f"{f} double" for f in FEATURES)
    got = d.select(F.xxhash64("sample_id").alias("id"), "y", "text").mapInArrow(run, kinds).toPandas()
    got = got.sort_values(["id", *FEATURES])
    return model.fit(got[list(FEATURES)].to_numpy(float), got["y"].to_numpy(float))


def score(docs: DataFrame, model: Gam, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few tables of fixed size

    def run(batches):
        for big in batches:
            for b in sliced(big):
                s = 1 / (1 + np.exp(-np.clip(shared.value.raw(_matrix(b.column(1).to_pylist())), -700, 700)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
