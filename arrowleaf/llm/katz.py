"""Katz backoff language model: Good-Turing discounts and exactly normalised backoff weights.

The model is of order two: pair -> word -> unseen word.

* Every training word is in the vocabulary and keeps its own pairs, as history and as prediction.
* P(w) is the word's Good-Turing discounted share of the training tokens and one more; words that were never
  met are one class, which takes the mass that is left.
* P(w | h) = d(c) c(h,w) / c(h) for pairs seen in training, else a(h) P(w); a(h) makes the sum over all words
  one.  A history whose discounts leave nothing counts one token more, so that some is left.
* d(r) is Katz's discount for r <= 5 from the counts of counts over all pairs (or words).
* A text's score is a sum of terms that are looked up apart: of each token log P(w) + log a(w), and of each pair
  seen in training its gain, what it adds to the backed-off value, log P(w|h) - log a(h) - log P(w).

The ``max_words`` most frequent words (hot) have an id of 16 bits and are broadcast, with the ``max_pairs`` most
frequent pairs of hot words; both only save lookups.  The others (cold) go by their 64-bit hash.  Pairs are
counted where what they lack is at hand: pairs with a cold word w meet by w, where c(w) is the sum of their
counts; pairs with a cold history h then meet by h, where c(h) is.

Counts, tables and lookups travel as packed blocks, one a task or batch of texts and target partition, sorted by
key.  A text asks once for each cold token, with its neighbours: the word and both its pairs are answered where
the word is filed.  Tables hold counts, and gains only of pairs of two cold words; the others follow from the
counts, the cold word and what is broadcast.  A block of lookups is answered by sums for each of its texts.

Defined cases: null and empty texts are the end token alone; a null id is the empty text for the fold;
rows of equal id and text give equal rows; no training tokens leave counts of zero (N = V = 0) and
P(unseen) = P(end) = 1/2; words and pairs with a cold word are told apart by 64-bit hashes; other columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, discard, drop_shuffles, made, materialise, sliced

RARE, END, BEGIN = 0, 1, 2
#: Vocabulary ids are below this.
IDS = 1 << 16
#: Kinds of the table: cold words, pairs of hot words, pairs (other, key) of a hot history and a cold word, pairs
#: (key, other) of a cold history and a hot word, pairs (other, key) of two cold words.
WORD, PAIR, BEFORE, AFTER, FAR = KINDS = range(5)
#: Pairs of hot words; pairs with a cold word, filed by it; pairs of a cold history and a hot word, filed by the history.
HOT, BY_WORD, BY_HISTORY = 0, 1, 2
#: What a row of the lookups is about, beside HOT: cold words and their pairs, texts.
COLD, TEXT = 1, 2
#: Packed blocks by partition, what they are about, and batch of texts (the table: its kind less the number of kinds).
BLOBS = "part int, kind int, batch long, a binary, b binary, c binary, d binary"
K = 5
_hash = xxhash.xxh64_intdigest
#: The end token's key among words: no word is empty.
END_KEY = _hash(b"")


def _signed(keys: np.ndarray) -> np.ndarray:
    return keys.astype(np.uint64).view(np.int64)


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        return np.unique(keys, return_counts=True)
    k, at = np.unique(keys, return_inverse=True)
    return k, np.bincount(at, weights, len(k)).astype(np.int64)


class Tally:
    """Distinct keys and counts of a task; flushed as sorted blobs by partition when it grows large."""

    def __init__(self, parts: int, limit: int = 4_000_000):
        self.parts, self.limit = parts, limit
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, weights: np.ndarray | None = None) -> None:
        k, n = _counted(keys, weights)
        self.held.append((k, n))
        self.size += len(k)

    def full(self) -> bool:
        if self.size > self.limit:
            self.fold()
        return self.size > self.limit // 2

    def fold(self) -> None:
        if len(self.held) > 1:
            k, n = _counted(np.concatenate([h[0] for h in self.held]), np.concatenate([h[1] for h in self.held]))
            self.held, self.size = [(k, n)], len(k)

    def blobs(self) -> pa.RecordBatch:
        """(part, keys, counts): keys as differences of sorted values, both in as few bytes as fit."""
        self.fold()
        rows: tuple[list, list, list] = ([], [], [])
        for k, n in self.held:
            for p, own in _parted(k, self.parts):
                for c, v in zip(rows, (p, _steps(k[own]), pack(n[own])), strict=True):
                    c.append(v)
        self.held, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], ["part", "keys", "counts"])


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Partitions of keys: of 64-bit hashes by range, so that sorted ones stay together, of others by a hash."""
    with np.errstate(over="ignore"):
        mixed = keys if keys.dtype == np.uint64 else keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _parted(keys: np.ndarray, parts: int):
    """(part, its rows in their order) of sorted keys."""
    part, order = _part(keys, parts), None
    if keys.dtype != np.uint64:
        order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
        part = part[order]
    cut = np.searchsorted(part, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)).tolist():
        own = slice(cut[p], cut[p + 1])
        yield p, own if order is None else order[own]


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as LEB128: seven bits a byte, the high bit where more follow."""
    v = values.astype(np.uint64)
    width = max(1, -(-int(v.max(initial=0)).bit_length() // 7))
    if width == 1:
        return v.astype(np.uint8).tobytes()
    out, some = np.empty((len(v), width), np.uint8), np.ones((len(v), width), bool)
    for j in range(width):
        rest = v >> np.uint64(7 * j)
        out[:, j] = rest
        if j:
            some[:, j] = rest != 0
    out[:, :-1] = out[:, :-1] & 127 | some[:, 1:].view(np.uint8) << 7
    return out[some].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    last = np.flatnonzero(raw < 128)
    if len(last) == len(raw):
        return raw.astype(np.uint64)
    first = np.concatenate([[0], last[:-1] + 1]).astype(np.int64)
    out, length = (raw[first] & np.uint8(127)).astype(np.uint64), last - first + 1
    some = np.flatnonzero(length > 1)
    for j in range(1, 10):
        if not len(some):
            break
        out[some] |= (raw[first[some] + j] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * j)
        some = some[length[some] > j + 1]
    return out


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys, as packed differences."""
    return pack(np.diff(keys, prepend=keys.dtype.type(0)))


def _keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct ``ascii_words`` of texts, which of them each word is, and how many words a text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    size = lists.value_lengths().to_numpy().astype(np.int64)
    found = lists.flatten().dictionary_encode()
    at, key = found.indices.to_numpy(), np.zeros(0, np.uint64)
    if len(at):
        words = found.dictionary.cast(pa.large_binary())
        _, ends, data = words.buffers()
        cut = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1].tolist()
        raw = data.to_pybytes() if data else b""
        # a word is hashed once a batch: that takes less time than a memo of all words
        key = np.fromiter((_hash(raw[a:b]) for a, b in zip(cut, cut[1:], strict=False)), np.uint64, len(words))
        none = np.flatnonzero(np.diff(cut) == 0)
        if len(none):  # around white space at a text's ends
            some = at != none[0]
            size = np.bincount(np.repeat(np.arange(len(size)), size)[some], minlength=len(size))
            at = at[some]
    return key, at, size


def _count(docs: DataFrame, parts: int) -> DataFrame:
    """(part, key, n) of the words, by hash, and ends of all rows of (text)."""

    def gather(batches):
        tally = Tally(parts)
        for big in batches:
            for b in sliced(big):
                key, at, size = _words(b.column(0))
                n = np.bincount(at, minlength=len(key))
                tally.add(np.append(key[n > 0], np.uint64(END_KEY)), np.append(n[n > 0], len(size)))
                if tally.full():
                    yield tally.blobs()
        if tally.held:
            yield tally.blobs()

    def add_up(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, part = 0, -1

        def merged():
            k, n = _counted(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            held[:] = [(k, n)]
            return k, n

        def out():
            k, n = merged()
            for at in range(0, len(k), 200_000):
                e = slice(at, at + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[e]), part), pa.int32()), pa.array(_signed(k[e])), pa.array(n[e], pa.int64())], ["part", "key", "n"])

        for b in batches:
            for p, keys, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if p != part and held:
                    yield from out()
                    held.clear()
                    size = 0
                part = p
                k = np.cumsum(unpack(keys), dtype=np.uint64)
                held.append((k, unpack(counts).astype(np.int64)))
                size += len(k)
                if size > 4_000_000:
                    size = len(merged()[0]) // 2
        if held:
            yield from out()

    blobs = docs.mapInArrow(gather, "part int, keys binary, counts binary")
    return blobs.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(add_up, "part int, key long, n long")


def discounts(counts: dict[int, int]) -> np.ndarray:
    """Katz's d(0..K) from counts of counts; absolute discounting where they are too irregular."""
    n = [counts.get(r, 0) for r in range(K + 2)]
    d = np.ones(K + 1)
    if n[1]:
        tail = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else -1
        if not ((d[1:] > 0) & (d[1:] < 1)).all():
            cut = max(n[1], 1) / max(n[1] + 2 * n[2], 1)
            cut = min(max(cut, 0.05), 0.95)
            d[1:] = 1 - cut / np.arange(1, K + 1)
    return d


def _d(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.where(c <= K, d[np.minimum(c, K)], 1.0)


@dataclass
class Model:
    """What is broadcast: the ``max_words`` most frequent words and the ``max_pairs`` most frequent of their pairs.

    Id RARE stands for all other words, cold and unseen.
    """

    tokens: int  # N
    types: int  # V
    word: np.ndarray  # sorted keys of the hot words
    ident: np.ndarray
    count: np.ndarray  # by id, over training tokens; that of BEGIN is the number of texts
    pair: np.ndarray  # sorted frequent pairs, h << 16 | w
    pair_gain: np.ndarray  # log10 P(w|h) - log10 a(h) - log10 P(w)
    whole: bool  # these are all pairs of hot words
    single_log: np.ndarray  # log10 P(w) by id
    back_log: np.ndarray  # log10 a(h) by id
    hist_log: np.ndarray  # log10 by id of what d(c) c(h,w) is times, to be P(w|h)
    word_d: np.ndarray  # discounts of words
    pair_d: np.ndarray  # discounts of pairs
    unseen_log: float  # log10 of the unseen class's share of RARE

    def gains(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each of sorted pairs adds as far as the broadcast goes, and whether it has to be asked for."""
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        some, back = key[new], np.cumsum(new) - 1
        gain, known = np.zeros(len(some)), np.full(len(some), self.whole)
        if len(self.pair):
            at = np.minimum(np.searchsorted(self.pair, some), len(self.pair) - 1)
            found = self.pair[at] == some
            gain[found] = self.pair_gain[at[found]]
            known |= found
        return gain[back], ~known[back]

    def hot_gain(self, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What pairs of hot words add, by their training counts."""
        h, w = (key >> key.dtype.type(16)).astype(np.int64), (key & key.dtype.type(0xFFFF)).astype(np.int64)
        return self.hist_log[h] + self.pair_log(n) - self.back_log[h] - self.single_log[w]

    def pair_log(self, n: np.ndarray) -> np.ndarray:
        return np.log10(_d(self.pair_d, n) * n)

    def single(self, c: np.ndarray) -> np.ndarray:
        """P(w) of words by training count."""
        return _d(self.word_d, c) * c / (self.tokens + 1)

    def rare_log(self, c: np.ndarray) -> np.ndarray:
        """log10 of a cold word's share of RARE by its training count."""
        return np.log10(self.single(c)) - self.single_log[RARE]

    def base_log(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.types + 1)))


def _tokens(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts, each text's with its end, and how many these are; ids of hot words, and from IDS on hashes."""
    key, at, size = _words(texts)
    place, hot = _find(model.word, key)
    key = np.where(key < IDS, key + np.uint64(IDS), key)
    key[hot] = model.ident[place[hot]]
    got = np.full(len(at) + len(size), END, np.uint64)
    word = np.ones(len(got), bool)
    word[np.cumsum(size + 1) - 1] = False
    got[word] = key[at]
    return got, size + 1


def _ids(got: np.ndarray) -> np.ndarray:
    return np.where(got >= IDS, RARE, got).astype(np.int64)


def _pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs, above the keys of pairs of hot words."""
    with np.errstate(over="ignore"):
        x = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) | np.uint64(1 << 63)


class Sides:
    """Distinct pairs (x, y) with a cold x, and their counts; flushed as blobs by x's partition."""

    def __init__(self, kind: int, parts: int):
        self.kind, self.parts, self.size = kind, parts, 0
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> None:
        if len(x):
            self.held.append((x, y, np.ones(len(x), np.int64) if n is None else n))
            self.size += len(x)

    def fold(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs by x."""
        if not self.held:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        x, y, n = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.argsort(_pair_key(x, y))
        x, y, n = x[order], y[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        x, y, n = x[at], y[at], np.add.reduceat(n, at)
        order = np.argsort(x)
        self.held, self.size = [(x[order], y[order], n[order])], len(at)
        return self.held[0]

    def blobs(self) -> list[tuple]:
        x, y, n = self.fold()
        self.held, self.size = [], 0
        return [(p, self.kind, _steps(x[own]), pack(y[own]), pack(n[own])) for p, own in _parted(x, self.parts)]


def _count_pairs(train: DataFrame, shared, parts: int) -> DataFrame:
    """(kind, key, other, n, total) of all pairs.

    HOT: key is h << 16 | w.  BY_WORD: key is w, other is h, total is c(w).  BY_HISTORY: key is h, other is w.
    """

    def gather(batches):
        model = shared.value
        hot, by_word, by_history = Tally(parts, 2_000_000), Sides(BY_WORD, parts), Sides(BY_HISTORY, parts)

        def out():
            rows = by_word.blobs() + by_history.blobs()
            if hot.held:
                rows += [(p, HOT, k, b"", n) for p, k, n in zip(*(c.to_pylist() for c in hot.blobs().columns), strict=True)]
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["part", "kind", "keys", "others", "counts"])

        for big in batches:
            for b in sliced(big):
                w, size = _tokens(model, b.column(0))
                h = np.roll(w, 1)
                h[np.cumsum(size) - size] = BEGIN
                cold_h, cold_w = h >= IDS, w >= IDS
                both = ~(cold_h | cold_w)
                hot.add((h[both] << np.uint64(16) | w[both]).astype(np.uint32))
                by_word.add(w[cold_w], h[cold_w])
                some = cold_h & ~cold_w
                by_history.add(h[some], w[some])
                for side in (by_word, by_history):
                    if side.size > 600_000:
                        side.fold()
                if hot.full() or max(by_word.size, by_history.size) > 400_000:
                    yield out()
        yield out()

    def add_up(batches):
        at, hot, side = None, [], None

        def out():
            if at[1] == HOT:
                key, n = _counted(np.concatenate([k for k, _ in hot]), np.concatenate([n for _, n in hot]))
                other, total = np.zeros(len(key), np.uint64), np.zeros(len(key), np.int64)
            else:
                key, other, n = side.fold()
                total = np.zeros(len(key), np.int64)
                if at[1] == BY_WORD:
                    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                    total = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(key))))
            for i in range(0, len(key), 200_000):
                e = slice(i, i + 200_000)
                cols = [pa.array(np.full(len(key[e]), at[1], np.int32)), pa.array(_signed(key[e])), pa.array(_signed(other[e])), pa.array(n[e], pa.int64()), pa.array(total[e], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["kind", "key", "other", "n", "total"])

        for b in batches:
            for part, kind, keys, others, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (part, kind) != at:
                    if at:
                        yield from out()
                    at, hot, side, held = (part, kind), [], Sides(kind, 1), 0
                k, n = _keys(keys), unpack(counts).astype(np.int64)
                if kind == HOT:
                    hot.append((k, n))
                    held += len(k)
                    if held > 4_000_000:
                        hot[:] = [_counted(np.concatenate([x for x, _ in hot]), np.concatenate([x for _, x in hot]))]
                        held = len(hot[0][0]) // 2
                else:
                    side.add(k, unpack(others), n)
        if at:
            yield from out()

    blobs = train.mapInArrow(gather, "part int, kind int, keys binary, others binary, counts binary")
    blobs = blobs.repartition(parts, "part").sortWithinPartitions("part", "kind")
    return blobs.mapInArrow(add_up, "kind int, key long, other long, n long, total long")


def _table(parts: int, kind: int, key: np.ndarray, n: np.ndarray, other: np.ndarray, gain: np.ndarray) -> list[tuple]:
    """Rows of BLOBS of a kind of the table, by key.

    WORD: n is c(key), other is one where the discounts leave nothing, gain is log10 a(key).  FAR has gains and no
    counts, the other kinds have counts and no gains.
    """
    order = np.argsort(key)
    key, n, other, gain = key[order], n[order], other[order], gain[order]
    rows = []
    for p, own in _parted(key, parts):
        if kind == WORD:
            more = pack(n[own] << 1 | other[own]), gain[own].tobytes()
        elif kind == FAR:
            more = other[own].tobytes(), gain[own].tobytes()
        else:
            more = pack(n[own]), b"" if kind == PAIR else pack(other[own])
        rows.append((p, HOT if kind == PAIR else COLD, kind - len(KINDS), _steps(key[own]), *more, b""))
    return rows


def _columns(kind: int, one: bytes, two: bytes, three: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, n, other, gain) of such a row."""
    key = _keys(one)
    n, other, gain = np.zeros(len(key), np.int64), np.zeros(len(key), np.uint64), np.zeros(len(key))
    if kind == FAR:
        other, gain = np.frombuffer(two, np.uint64), np.frombuffer(three)
    else:
        n = unpack(two).astype(np.int64)
    if kind == WORD:
        n, other, gain = n >> 1, (n & 1).astype(np.uint64), np.frombuffer(three)
    elif kind in (BEFORE, AFTER):
        other = unpack(three)
    return key, n, other, gain


class Lookup:
    """What a task holds of a partition of the table: gains of pairs, and cold words. Words are added first."""

    def __init__(self, model: Model):
        self.model, self.held = model, []
        self.word = self.pair = None

    def add(self, kind: int, *blobs: bytes) -> None:
        m = self.model
        key, n, other, gain = _columns(kind, *blobs)
        if kind == WORD:
            self.held.append((key, n, other.astype(np.int64), gain))
            return
        if kind == PAIR:
            self.held.append((key, m.hot_gain(key, n)))
            return
        words = self.words()
        if kind == FAR:
            self.held.append((_pair_key(other, key), gain))
            return
        at, id_ = np.searchsorted(words[0], key), other.astype(np.int64)
        if kind == BEFORE:
            self.held.append((_pair_key(other, key), m.hist_log[id_] - m.back_log[id_] + m.pair_log(n) - words[4][at]))
        else:
            self.held.append((_pair_key(key, other), m.pair_log(n) - np.log10(words[1] + words[2])[at] - words[3][at] - m.single_log[id_]))

    def _sorted(self, columns: int) -> list[np.ndarray]:
        if not self.held:
            return [np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * (columns - 1)]
        got = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        order, self.held = np.argsort(got[0]), []
        return [c[order] for c in got]

    def words(self) -> list[np.ndarray]:
        """key, c(w), one where the discounts leave nothing, log10 a(w), log10 P(w)."""
        if self.word is None:
            self.word = self._sorted(4)
            self.word.append(np.log10(self.model.single(self.word[1])))
        return self.word

    def gains(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What pairs add, and which of them are in the table."""
        if self.pair is None:
            self.pair = self._sorted(2)
        at, hit = _find(self.pair[0], key)
        gain = np.zeros(len(key))
        gain[hit] = self.pair[1][at[hit]]
        return gain, hit


def _find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys are in a sorted table, and whether they are."""
    at = np.minimum(np.searchsorted(table, key), max(len(table) - 1, 0))
    return at, table[at] == key if len(table) else np.zeros(len(key), bool)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of BLOBS."""
    types = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], BLOBS.replace(",", "").split()[::2])


def _weights(n: np.ndarray, mass: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a(h), and what scales the pairs of h, from c(h) and the sums of d(c) c(h,w) / c(h) and of P(w) over its pairs."""
    scale = np.where(1 - mass < 1e-9, n / (n + 1.0), 1.0)
    return np.where(mass > 0, (1 - mass * scale) / np.maximum(1 - lower, 1e-12), 1.0), scale


def _histogram(table: DataFrame) -> dict[int, int]:
    """How many keys have each count: a row a distinct count, of which there are O(sqrt(tokens))."""
    return {r["n"]: r["k"] for r in table.groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}


def _least(hist: dict[int, int], room: int, least: int) -> int:
    """The smallest count from which at most ``room`` keys are left."""
    kept, cut = 0, max(hist, default=0) + 1
    for c in sorted(hist, reverse=True):
        kept += hist[c]
        if kept > room:
            break
        cut = c
    return max(cut, least)


def fit(train: DataFrame, max_words: int = 60_000, max_pairs: int = 4_000_000) -> tuple[Model, DataFrame]:
    """The model of the texts in ``train`` (one column, text), and its table (key, kind, n, gain, other).

    The table holds the cold words and the pairs that are not broadcast. Gains are there for WORD (log10 a(key)),
    PAIR and FAR.
    """
    model, blocks = _learn(train, max_words, max_pairs)
    shared = train.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for batch, *blobs in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                kind = batch + len(KINDS)
                key, n, other, gain = _columns(kind, *blobs)
                gain = shared.value.hot_gain(key, n) if kind == PAIR else gain
                cols = [pa.array(_signed(key)), pa.array(np.full(len(key), kind, np.int32)), pa.array(n), pa.array(gain), pa.array(_signed(other))]
                yield pa.RecordBatch.from_arrays(cols, ["key", "kind", "n", "gain", "other"])

    return model, blocks.mapInArrow(run, "key long, kind int, n long, gain double, other long")


def _learn(train: DataFrame, max_words: int = 60_000, max_pairs: int = 4_000_000) -> tuple[Model, DataFrame]:
    """The model and its table in BLOBS."""
    spark = train.sparkSession
    start = made()
    if max_words > 65_000:
        raise ValueError("a hot word's id has 16 bits")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    table = materialise(_count(train, parts), "words")
    end = _signed(np.array([END_KEY], np.uint64))[0]
    hist = _histogram(table)
    tokens, types = sum(c * k for c, k in hist.items()), sum(hist.values())
    texts = (table.where(F.col("key") == int(end)).select("n").first() or [0])[0]
    cut = _least(hist, max_words, 1)
    top = table.where((F.col("n") >= cut) & (F.col("key") != int(end))).select("key", "n").toArrow()
    key = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    word, n = key[order], top.column("n").to_numpy()[order]
    ident = np.arange(3, 3 + len(word))
    count = np.concatenate([[max(tokens - int(n.sum()) - texts, 0), texts, texts], n]).astype(np.int64)
    none = np.zeros(0)
    word_d = discounts(hist)
    single_of = lambda c: _d(word_d, c) * c / (tokens + 1)
    every = np.array(sorted(hist), np.int64)
    left = 1 - float((single_of(every) * np.array([hist[c] for c in every.tolist()])).sum()) if tokens else 0.5
    single = np.concatenate([[0, single_of(count[END]) if tokens else 0.5, 0], single_of(count[3:])])
    single[RARE] = max(1 - single.sum(), left)
    with np.errstate(divide="ignore"):
        single_log = np.log10(single)
    unseen_log = float(np.log10(left) - single_log[RARE])
    model = Model(tokens, types, word, ident, count, none.astype(np.uint32), none, True, single_log, np.zeros(len(count)), np.zeros(len(count)), word_d, word_d, unseen_log)
    shared = spark.sparkContext.broadcast(model)
    discard(spark, start)
    found = materialise(_count_pairs(train, shared, parts), "pairs")
    drop_shuffles(spark)
    by_kind = found.groupBy((F.col("kind") == HOT).alias("hot"), "n").agg(F.count(F.lit(1)).alias("k")).collect()
    hist_hot, hist2 = {r["n"]: r["k"] for r in by_kind if r["hot"]}, {}
    for r in by_kind:
        hist2[r["n"]] = hist2.get(r["n"], 0) + r["k"]
    d = discounts(hist2)

    def ends(b):
        """h by id, P(w) and the counts of pairs with a hot history."""
        kind, key, other, n, total = (b.column(i).to_numpy() for i in range(5))
        by_word = kind == BY_WORD
        h = np.where(by_word, other, key >> 16)
        w = np.where(by_word, RARE, key & 0xFFFF)
        return h, np.where(by_word, single_of(total), single[w]), n

    def sums(batches):
        mass, lower = np.zeros(len(count)), np.zeros(len(count))
        for b in batches:
            h, p, n = ends(b)
            mass += np.bincount(h, _d(d, n) * n / np.maximum(count[h], 1), len(count))
            lower += np.bincount(h, p, len(count))
        some = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(mass[some]), pa.array(lower[some])], ["h", "mass", "lower"])

    hot_history = found.where((F.col("kind") == HOT) | (F.col("kind") == BY_WORD) & F.col("other").between(0, IDS - 1))
    by_h = hot_history.mapInArrow(sums, "h long, mass double, lower double").groupBy("h").agg(F.sum("mass").alias("mass"), F.sum("lower").alias("lower")).toArrow()
    mass, lower = np.zeros(len(count)), np.zeros(len(count))
    for x, name in ((mass, "mass"), (lower, "lower")):
        x[by_h.column("h").to_numpy()] = by_h.column(name).to_numpy()
    back, scale = _weights(count, mass, lower)
    back_log, hist_log = np.log10(back), np.log10(scale) - np.log10(np.maximum(count, 1))
    model.back_log, model.hist_log, model.pair_d = back_log, hist_log, d
    known = replace(model)

    def gains(batches):
        for b in batches:
            key = b.column(1)
            yield pa.RecordBatch.from_arrays([key, pa.array(known.hot_gain(key.to_numpy(), b.column(3).to_numpy()))], ["key", "gain"])

    def hot_blobs(batches):
        """Of the pairs with a hot history."""
        held = []

        def out():
            kind, key, other, n = (np.concatenate(x) for x in zip(*held, strict=True))
            rows, none = [], np.zeros(len(key))
            for some, kind, of in ((kind == HOT, PAIR, np.uint32), (kind == BY_WORD, BEFORE, np.uint64)):
                rows += _table(parts, kind, key[some].astype(of), n[some], other[some], none[some])
            return _rows(rows)

        for b in batches:
            held.append(tuple(b.column(i).to_numpy() for i in range(4)))
            if sum(len(x[0]) for x in held) > 500_000:
                yield out()
                held.clear()
        if held:
            yield out()

    pair_cut = _least(hist_hot, max_pairs, 1)
    often = (F.col("kind") == HOT) & (F.col("n") >= pair_cut)
    hot = found.where(often).mapInArrow(gains, "key long, gain double").toArrow()
    pair = hot.column("key").to_numpy().astype(np.uint32)
    order = np.argsort(pair)
    model.pair, model.pair_gain = pair[order], hot.column("gain").to_numpy()[order]
    model.whole = pair_cut <= 1
    shared.unpersist()

    def by_history(batches):
        """Blobs of the pairs with a cold history, by its partition; c(w) goes along where w is cold."""
        held = []

        def out():
            h, w, n, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h)
            h, w, n, c = h[order], w[order], n[order], c[order]
            rows = [(p, _steps(h[own]), pack(w[own]), pack(n[own]), pack(c[own])) for p, own in _parted(h, parts)]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i else pa.int32()) for i in range(5)], ["part", "h", "w", "n", "c"])

        for b in batches:
            kind, key, other, n, total = (b.column(i).to_numpy() for i in range(5))
            key, other, turned = key.view(np.uint64), other.view(np.uint64), kind == BY_WORD
            held.append((np.where(turned, other, key), np.where(turned, key, other), n, total))
            if sum(len(x[0]) for x in held) > 1_000_000:
                yield out()
                held.clear()
        if held:
            yield out()

    def cold_gains(batches):
        held, at = [], None

        def out():
            h, w, n, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h)
            h, w, n, c = h[order], w[order], n[order].astype(np.int64), c[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
            p = np.where(w < IDS, single[np.where(w < IDS, w, 0).astype(np.int64)], single_of(c))
            times = np.add.reduceat(n, first)
            share = _d(d, n) * n / times[of]
            back, scale = _weights(times, np.add.reduceat(share, first), np.add.reduceat(p, first))
            back = np.log10(back)
            rows = _table(parts, WORD, h[first], times, (scale < 1).astype(np.int64), back)
            far = w >= IDS
            gain = np.zeros(len(h))
            gain[far] = (np.log10(scale[of] * share) - back[of] - np.log10(p))[far]
            rows += _table(parts, AFTER, h[~far], n[~far], w[~far], gain[~far])
            return _rows(rows + _table(parts, FAR, w[far], n[far], h[far], gain[far]))

        for b in batches:
            for part, h, *more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != at and held:
                    yield out()
                    held.clear()
                at = part
                held.append((_keys(h), *map(unpack, more)))
        if held:
            yield out()

    cold = found.where((F.col("kind") == BY_HISTORY) | (F.col("kind") == BY_WORD) & ~F.col("other").between(0, IDS - 1))
    cold = cold.mapInArrow(by_history, "part int, h binary, w binary, n binary, c binary").repartition(parts, "part").sortWithinPartitions("part")
    return model, hot_history.where(~often).mapInArrow(hot_blobs, BLOBS).unionByName(cold.mapInArrow(cold_gains, BLOBS))


def score(docs: DataFrame, model: Model, table: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row of (doc_id, text)."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        for b in batches:
            kind, key, n, other, gain = (b.column(i).to_numpy() for i in range(5))
            rows = []
            for k in KINDS:
                some = kind == k
                rows += _table(parts, k, key[some].astype(np.uint32 if k == PAIR else np.uint64), n[some], other[some].astype(np.uint64 if k == FAR else np.int64), gain[some])
            yield _rows(rows)

    return _score(docs, model, table.select("kind", "key", "n", "other", "gain").mapInArrow(run, BLOBS))


def _with_ids(rows: pa.RecordBatch, ids: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, ids], [*rows.schema.names, "ids"])


def _questions(docs: DataFrame, shared, parts: int) -> DataFrame:
    """BLOBS and ids, of (doc_id, text): the texts, and what has to be looked up for them."""

    def ask(batches):
        """Of each batch of texts, a row of sums over what is broadcast, and rows of keys to be looked up."""
        m = shared.value
        place = TaskContext.get().partitionId() << 32
        base_by_id, single_log = m.base_log(m.count), m.single_log.copy()
        base_by_id[RARE] = single_log[RARE] = 0
        for big in batches:
            for b in sliced(big, 2_000_000):
                n = b.num_rows
                got, size = _tokens(m, b.column(1))
                start, of = np.cumsum(size) - size, np.repeat(np.arange(n), size)
                before = np.roll(got, 1)
                before[start] = BEGIN
                ids, h, cold = _ids(got), _ids(before), got >= IDS
                hot = np.flatnonzero(~(cold | (before >= IDS)))
                pair = (h[hot] << 16 | ids[hot]).astype(np.uint32)
                order = np.argsort(pair)
                pair, hot = pair[order], hot[order]
                gain = np.zeros(len(got))
                gain[hot], more = m.gains(pair)
                add_up = lambda x: np.add.reduceat(x, start)  # noqa: B023, E731
                known = add_up((~cold).astype(np.int64)) if m.tokens else np.zeros(n, np.int64)
                sums = add_up(m.back_log[h] + single_log[ids] + gain)
                rows = [(place % parts, TEXT, place, size.tobytes(), add_up(base_by_id[ids]).tobytes(), sums.tobytes(), known.tobytes())]
                pair, text = pair[more], of[hot[more]]
                rows += [(p, HOT, place, _steps(pair[own]), pack(text[own]), b"", b"") for p, own in _parted(pair, parts)]
                at = np.flatnonzero(cold)
                at = at[np.argsort(got[at])]
                word, text, after = got[at], of[at], got[at + 1]  # an end follows
                after[after >= IDS] = RARE
                rows += [(p, COLD, place, _steps(word[own]), pack(text[own]), pack(before[at[own]]), pack(after[own])) for p, own in _parted(word, parts)]
                ends = pa.array([0, *[n] * len(rows)], pa.int32())
                yield _with_ids(_rows(rows), pa.ListArray.from_arrays(ends, b.column(0)))
                place += 1

    return docs.mapInArrow(ask, f"{BLOBS}, ids array<{docs.schema['doc_id'].dataType.simpleString()}>")


def _score(docs: DataFrame, model: Model, blocks: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast(model)
    questions = _questions(docs.select("doc_id", "text"), shared, parts)
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def answer(batches):
        """Rows of texts as they are, and for each row of questions its sums by text."""
        m, at, known = shared.value, None, None
        unseen, unseen_base = m.single_log[RARE] + m.unseen_log, m.base_log(0)
        for b in batches:
            yield b.filter(pa.array(b.column(1).to_numpy() == TEXT))
            rows = []
            for part, kind, batch, one, two, three, four in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if kind == TEXT:
                    continue
                if (part, kind) != at:
                    at, known = (part, kind), Lookup(m)
                if batch < 0:
                    known.add(batch + len(KINDS), one, two, three)
                    continue
                key, of, base, found = _keys(one), unpack(two).astype(np.int64), b"", b""
                if kind == HOT:
                    value, some = known.gains(key)
                    texts = np.unique(of[some])
                else:
                    words, texts = known.words(), np.unique(of)
                    place, hit = _find(words[0], key)
                    place, value, bases = place[hit], np.full(len(key), unseen), np.full(len(key), unseen_base)
                    value[hit] = words[3][place] + words[4][place]
                    bases[hit] = m.base_log(words[1][place])
                    before, after = unpack(three), unpack(four)
                    some = np.flatnonzero(after)
                    value += known.gains(_pair_key(before, key))[0]
                    value[some] += known.gains(_pair_key(key[some], after[some]))[0]
                    base, found = np.bincount(of, bases)[texts].tobytes(), pack(np.bincount(of, hit)[texts])
                if len(texts):
                    rows.append((part, kind, batch, _steps(texts), base, np.bincount(of, value)[texts].tobytes(), found))
            if rows:
                yield _with_ids(_rows(rows), pa.nulls(len(rows), b.column(7).type))

    def finish(batches):
        """The rows of a batch of texts come first, then the sums to be added."""
        held = None

        def out():
            ids, _, size, base, sums, known = held
            return pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(known), pa.array(base), pa.array(sums)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

        for b in batches:
            for i, (kind, batch, one, two, three, four) in enumerate(zip(*(b.column(c).to_pylist() for c in range(1, 7)), strict=True)):
                if kind == TEXT:
                    if held:
                        yield out()
                    held = (b.column(7)[i].values, batch, np.frombuffer(one, np.int64), np.frombuffer(two).copy(), np.frombuffer(three).copy(), np.frombuffer(four, np.int64).copy())
                    continue
                texts = _keys(one).astype(np.int64)
                held[4][texts] += np.frombuffer(three)
                if kind == COLD:
                    held[3][texts] += np.frombuffer(two)
                    held[5][texts] += unpack(four).astype(np.int64)
        if held:
            yield out()

    asked = blocks.unionByName(questions, allowMissingColumns=True)
    asked = asked.repartition(parts, "part").sortWithinPartitions("part", "kind", "batch")
    told = asked.mapInArrow(answer, questions.schema).repartition(parts, "batch").sortWithinPartitions("batch", F.col("kind").desc())
    return told.mapInArrow(finish, f"doc_id {doc_type}, n_tokens long, n_known long, base_score double, score double")


def train_and_score(docs: DataFrame, folds: int = 10, held: int = 0) -> DataFrame:
    """Learn from the texts outside the held-out fold and score all."""
    d = docs.select("doc_id", "text")
    model, blocks = _learn(d.where(crc_fold("doc_id", folds) != held).select("text"))
    out = _score(d, model, blocks)
    return out.select("doc_id", (crc_fold("doc_id", folds) == held).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
