"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of its words, word pairs and pairs with one word between, hashed
into ``2**bits`` slots.  Per-coordinate rates and an L1 term leave few non-zero weights, which are
broadcast; their number is bounded by the table.  Learning takes at most ``sample`` labelled rows.

Defined cases: null and empty texts have no features and take the bias alone; whole texts are read;
null or repeated labels are handled by ``labelled_sample``; with no labels of both kinds every score
is the share of positive labels (0 when there are none).  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashMemo, labelled_sample, sliced

#: ASCII punctuation parts words, as white space does.
_PART = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def slots(text: str | None, memo: HashMemo, bits: int) -> np.ndarray:
    """The text's feature slots, each once."""
    words = text.encode().lower().translate(_PART).split() if text else []
    h = memo.array(words)
    down = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        parts = [h * _PAIR, (h[:-1] * _PAIR + h[1:]) * _SKIP, (h[:-2] * _SKIP + h[2:]) * _PAIR]
    return np.unique(np.concatenate([(p >> down).astype(np.uint32) for p in parts]))


@dataclass
class Ftrl:
    """Sparse weights: ``score`` is the logistic of bias plus the weights of the slots that are set."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0
    epochs: int = 5
    index: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def fit(self, rows: list[np.ndarray], y: np.ndarray, threshold: float = 0.3) -> Ftrl:
        """Learn, and move the bias so that the cut of best cross-validated F1 falls at ``threshold``."""
        if not len(y) or y.min() == y.max():
            p = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
            self.bias = float(np.log(p / (1 - p)))
            return self
        # every row is scored by a model that has not seen it; the cut of best F1 becomes the threshold
        fold, raw = np.arange(len(y)) % 3, np.zeros(len(y))
        for k in range(3):
            w, b = self._learn([r for r, h in zip(rows, fold, strict=True) if h != k], y[fold != k])
            raw[fold == k] = [w[r].sum() + b for r, h in zip(rows, fold, strict=True) if h == k]
        order = np.argsort(-raw, kind="stable")
        hit = np.cumsum(y[order])
        n = np.arange(1, len(raw) + 1)
        last = np.append(raw[order][1:] < raw[order][:-1], True)  # of rows with equal scores
        f1 = np.where(last & (hit >= 0.5 * n), 2 * hit / (n + y.sum()), 0)
        j = int(np.argmax(f1))
        # without a cut of which half are positive nothing that was learnt tells the labels apart
        cut = (raw[order[j]] + raw[order[min(j + 1, len(raw) - 1)]]) / 2 if f1[j] else raw.max() + 1.0
        w, b = self._learn(rows, y)
        self.index = np.flatnonzero(w).astype(np.uint32)
        self.weight = w[self.index]
        self.bias = float(b - cut + np.log(threshold / (1 - threshold)))
        return self

    def _learn(self, rows, y):
        z, n = np.zeros(1 << self.bits), np.zeros(1 << self.bits)
        zb = nb = 0.0  # the bias, without L1
        rate = lambda ni: (self.beta + np.sqrt(ni)) / self.alpha + self.l2

        def weights(zi, ni):
            return np.where(np.abs(zi) <= self.l1, 0.0, -(zi - np.sign(zi) * self.l1) / rate(ni))

        deal = np.random.default_rng(7)
        for _ in range(self.epochs):
            for i in deal.permutation(len(rows)):
                r = rows[i]
                zi, ni = z[r], n[r]
                w, wb = weights(zi, ni), -zb / rate(nb)
                g = 1 / (1 + np.exp(-np.clip(w.sum() + wb, -35, 35))) - y[i]
                z[r] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / self.alpha * w
                n[r] = ni + g * g
                zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / self.alpha * wb
                nb += g * g
        return weights(z, n), -zb / rate(nb)

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.index] = self.weight
        return out


def _views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Each row's slots, as views of the column's own memory."""
    out: list[np.ndarray] = []
    for c in column.cast(pa.binary()).chunks:
        _, ends, data = c.buffers()
        if len(c):
            at = np.frombuffer(ends, np.int32)[c.offset : c.offset + len(c) + 1] // 4
            x = np.frombuffer(data, np.uint32, data.size // 4) if data else np.zeros(0, np.uint32)
            out += [x[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str, fold_ok, sample: int = 16_000, model: Ftrl | None = None) -> Ftrl:
    """Learn from at most ``sample`` labelled rows; ``fold_ok`` says which ids may be learnt from.

    One task learns; the driver gets the weights only.
    """
    model = model or Ftrl()
    bits = model.bits
    ids = labelled_sample(labels, label, fold_ok, sample)

    def run(batches):
        memo = HashMemo()
        for big in batches:
            for b in sliced(big):
                feats = [slots(t, memo, bits).tobytes() for t in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(feats, pa.binary())], ["id", "y", "f"])

    d = docs.select(F.col("doc_id").alias("sample_id"), "text").join(F.broadcast(ids), "sample_id")
    rows = d.select(F.xxhash64("sample_id").alias("id"), "y", "text").mapInArrow(run, "id long, y int, f binary")

    def learn(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            got = pa.Table.from_batches(held)
            order = pc.sort_indices(got, sort_keys=[("id", "ascending"), ("f", "ascending")]).to_numpy()
            views = _views(got.column("f"))
            m = model.fit([views[i] for i in order], got.column("y").to_numpy()[order].astype(float))
            yield pa.RecordBatch.from_pydict({"slots": pa.array([m.index.tobytes()]), "weights": pa.array([m.weight.tobytes()]), "bias": pa.array([float(m.bias)])})

    got = rows.repartition(1).mapInArrow(learn, "slots binary, weights binary, bias double").collect()
    if not got:
        return model.fit([], np.zeros(0))
    model.index, model.weight, model.bias = np.frombuffer(got[0]["slots"], np.uint32), np.frombuffer(got[0]["weights"]), got[0]["bias"]
    return model


def score(docs: DataFrame, model: Ftrl, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**bits weights

    def run(batches):
        m, memo = shared.value, HashMemo()
        w = m.dense()
        for big in batches:
            for b in sliced(big):
                raw = np.array([w[slots(t, memo, m.bits)].sum() + m.bias for t in b.column(1).to_pylist()])
                s = 1 / (1 + np.exp(-np.clip(raw, -700, 700)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def reject(docs: DataFrame, model: Ftrl, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not judged toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m, memo = shared.value, HashMemo()
        w = m.dense()
        cut = np.log(threshold / (1 - threshold))
        for big in batches:
            for b in sliced(big):
                keep = [bool(w[slots(t, memo, m.bits)].sum() + m.bias < cut) for t in b.column(at).to_pylist()]
                yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
